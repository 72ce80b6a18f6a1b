import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `spans` string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty and long texts, ties, repeats and clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(40)
    rows = []
    for i in range(60):
        text = "\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            text += "\n" + passage + "\n" + line(8)
        rows.append((i, text, ("en", "fr")[i % 2], f"s{i % 4}", len(text)))
    base = rows[3][1].split(" ")
    for i in range(60, 70):  # near copies
        base[i % len(base)] = "changed"
        rows.append((i, " ".join(base), "en", None, 1))
    rows += [
        (70, rows[7][1], None, "s1", None),  # a copy
        (71, None, "en", "s0", 0),
        (72, "", "fr", "s0", 0),
        (73, " \n\t \n", None, None, None),
        (74, "one", "en", "s0", 3),
        (None, rows[7][1], "en", "s2", 2),
        (None, None, None, None, None),
        (75, "same same same " * 60, "fr", "s3", 1),
        (76, (line(30) + "\n") * 3, "en", "s3", 1),
        (77, line(6000), "en", "s2", 9),
        (78, "Ünï çødé word more 12345 !!!", "fr", "s2", 9),
        (7, rows[7][1], "en", "s1", 5),  # a repeated row
        (8, "another text under a known id", "en", "s1", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, 1.0, "x") for r in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
