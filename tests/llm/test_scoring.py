"""Quality, language, secrets, licenses, mixing and decontamination against plain versions."""

import hashlib
import math
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontamination, language, licenses, mixing, quality, secrets

KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def test_secrets(spark):
    texts = [
        None, "", "é password=abcdefghijkl ü", 'PassWord" : "x' + "y" * 11 + '" token=short', "password=token: abcdefghijklmnop",
        "AKIA" + "Z" * 13 + " AKIA" + "Q" * 14, "AKIAAKIA" + "B" * 20, "0123456789abcdef" * 3, "deadbeef" * 2 + "G" + "a" * 15,
        "user=alice then Zm9vYmFyQmF6UXV4MTIzNA== end", "far " + "x " * 300 + "Zm9vYmFyQmF6UXV4MTIzNA", "https://host.example key Zm9vYmFyQmF6UXV4MTIzNA",
        "api_key='" + "k" * 40 + "'", "secret=" + "0123456789abcdef",
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[2], "s"), (2, texts[2], "s")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[2] if r.doc_id is None else texts[r.doc_id] or ""
        found = []
        for kind, (name, pattern, group, least) in enumerate(KINDS):
            found += [(m.start(), kind, m.end(), name) for m in pattern.finditer(text) if len(m[group]) >= least]
        base = [f"{name}:{start}:{end}" for start, _, end, name in sorted(found)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
    linked = {r.doc_id: r.n_linked for r in got}
    assert linked[9] == 2 and linked[11] == 2 and linked[10] == 0


def test_secret_scan_is_native(docs):
    plan = secrets.find_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing(docs, corpus):
    got = mixing.mix(docs).collect()
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((c[0], words(c[1]), c[3]) for c in corpus)
    sizes = Counter()
    for c in corpus:
        sizes[c[3]] += words(c[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:  # share, cap, share the excess again
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        for s in over:
            target[s] = 3 * sizes[s]
        if not over:
            target |= share
            break
        open_ -= set(over)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and 0 <= min(positions) and max(positions) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_positions_invert_the_demand(spark):
    shares = [(k / 50, a, b) for k in range(51) for a, b in mixing.SCHEDULES]
    df = spark.createDataFrame(shares, "q double, a double, b double")
    for r in df.select("*", mixing.demand_position(F.col("q"), F.col("a"), F.col("b")).alias("t")).collect():
        assert (r.a * r.t + (r.b - r.a) * r.t**2 / 2) / ((r.a + r.b) / 2) == pytest.approx(r.q, abs=1e-9)


def test_every_pass_is_scheduled(spark):
    """Passes against a walk word by word; a source taken several times is spread over all of training."""
    rows = [(i, "w " * (1 + i % 5), "a" if i < 300 else "bc"[i % 2]) for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = mixing.scheduled(mixed).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert taken == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    for turn, source in enumerate("abc"):
        own = sorted((r for r in got if r.source == source), key=lambda r: (r["pass"], hashlib.md5(str(r.doc_id).encode()).hexdigest()))
        goal, done = round(own[0].target), 0
        a, b = mixing.SCHEDULES[turn]
        for r in own:
            share = min(1.0, (done + r.size / 2) / goal)
            assert (a * r.position + (b - a) * r.position**2 / 2) / ((a + b) / 2) == pytest.approx(share, abs=1e-9)
            done += r.taken
        assert done == goal
        if source == "c":
            assert {r["pass"] for r in own} == {0, 1, 2} and max(r.position for r in own) > 0.98


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        letters = ("etaoinsh", "ßüäöqxyz")[i % 2]
        own = [word(letters) for _ in range(rng.randint(20, 80))]
        good = i % 3 > 0
        rows.append((i, " ".join(own) if good else " | ".join(own[:8] * 4).upper(), ("en", "de")[i % 2], "s"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 456", "de", "s"), (None, "etaoin shtea", "en", "s"), (5, rows[5][1], None, None)]
    labels += [(5, None, None), (None, 1, 0), (7, 9, 0), (9999, 1, 0)]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_quality(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in known if r.held_out]) > 0.95
    again = quality.classify(docs.repartition(5), labels).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in got) == sorted((repr(r.doc_id), round(r.score, 9)) for r in again)
    assert {r.predicted for r in quality.classify(docs, labels.limit(0)).collect()} == {1}


def test_pairs_rank_by_logistic_loss():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, quality.FEATURES))
    y = (x[:, 0] - x[:, 1] > 0.5).astype(int)
    ranking = quality.fit_pairs(x, y)
    assert np.mean((ranking.score(x) >= 0.7) == (y == 1)) > 0.95
    assert np.sum(ranking.score(x) < 0.7) == np.sum(y == 0)  # the cut is that quantile


def test_language(labelled):
    docs, _ = labelled
    got = language.identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == "und" and by_id[None] == "en"
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert np.mean([r.lang_pred == ("en", "de")[r.doc_id % 2] for r in held]) > 0.95
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_long_documents_is_learned(spark):
    """A language of which all labelled documents are longer than what is learned of one."""
    rng = random.Random(13)
    line = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, line("abcdefgh", 50), "en") for i in range(30)]
    # Only the middle of a book is like the short texts; its head is not.
    rows += [(i, line("0123456789", 4000) + line("ñopqrstu", 8000), "es") for i in range(30, 42)]
    rows += [(i, line("ñopqrstu", 20), None) for i in range(42, 60)]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 30 else "es") for r in got)
    text = "ñ".encode() * 70000 + b"end"
    own = language.pieces(text, 32768)
    assert len(own) == 16 and all(p.decode(errors="ignore")[0] == "ñ" for p in own) and own[-1].endswith(b"end")
    assert language.pieces(text[:32768], 32768) == [text[:32768]]


def test_code_lengths_are_exact():
    """Against a context tree that walks byte by byte."""
    rng = random.Random(6)
    texts = {k: [bytes(rng.choice(a) for _ in range(200)) for _ in range(3)] for k, a in (("x", b"abc"), ("y", b"bcd\xff"))}
    model = language.PartialMatching(texts)
    trees = {}
    for name, own in texts.items():
        tree = trees[name] = defaultdict(Counter)
        for text in own:
            padded = language.padded(text)
            for i in range(language.ORDER, len(padded)):
                for order in range(language.ORDER + 1):
                    tree[padded[i - order : i]][padded[i]] += 1

    def bits(tree, text):
        padded, total = language.padded(text), 0.0
        for i in range(language.ORDER, len(padded)):
            for order in range(language.ORDER, -1, -1):
                seen = tree.get(padded[i - order : i])
                if seen is None:
                    continue
                n, q = seen.total(), len(seen)
                if padded[i] in seen:
                    total -= math.log2(seen[padded[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            else:
                total += 8
        return total

    queries = [b"", b"a", b"abcabcbd", b"zzz\xff\x00" * 9, bytes(rng.randrange(256) for _ in range(300))]
    for block in (7, 1 << 20):
        got = model.code_lengths(queries, block)
        assert np.allclose(got, [[bits(trees[k], q) for k in model.languages] for q in queries])


def test_licenses(spark):
    t = licenses.TEMPLATES
    rows = [
        (1, "words before it\n" + t["MIT"] + "\nand after", "MIT"), (2, t["GPL-3.0"], "GPL-3.0"), (3, t["GPL-2.0"], "GPL-2.0"),
        (4, "prose. " + t["Apache-2.0"] + " more prose", "Apache-2.0"), (5, "a license to dance, he said", ""), (6, None, ""), (7, "", ""),
        (8, t["MIT-text"].replace("Software", "Program", 1), "MIT-text"), (9, "ü" * 50 + "\n" + t["all-rights-reserved"], "all-rights-reserved"),
        (10, "This work is licensed under the GNU General Public License, version 7.", ""), (None, t["CC-BY-NC-4.0"], "CC-BY-NC-4.0"),
        (11, t["BSD-3-Clause"], "BSD-3-Clause"), (12, "\n".join([t["MIT"], "other words here", t["GPL-3.0"]]), "GPL-3.0,MIT"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, found string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: name for i, _, name in rows}
    span = got[9].found[0]
    assert rows[8][1][span.start : span.end] == t["all-rights-reserved"] and span.differences == 0


def _licenses_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [[f.license for f in r.found] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_wrapped_licenses(spark):
    """Every template over several lines, bare and in comments, with text before and behind."""
    cases = []
    for name, text in licenses.TEMPLATES.items():
        for mark in ("", "# ", " * ", "// "):
            lines = textwrap.wrap(text, 76 - len(mark))
            lines += textwrap.wrap(text, 30)  # and again, narrower
            cases.append((name, "\n".join(mark + x for x in ["A file of words.", "", *lines, "", "More of them here."])))
    got = _licenses_of(spark, [text for _, text in cases])
    assert [(name, found) for (name, _), found in zip(cases, got) if found != [name, name]] == []


def test_licenses_in_running_text(spark):
    """Short notices with prose of any length on both sides, several in a block, the same one twice."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    t = licenses.TEMPLATES
    cases = [([name], f"{prose(n)} {t[name]} {prose(n)}") for name in t for n in (2, 10, 90)]
    pairs = (["CC-BY-4.0", "all-rights-reserved"], ["MIT", "Apache-2.0"], ["MIT", "MIT"], ["all-rights-reserved", "GPL-2.0", "MIT-text", "ISC"])
    cases += [(names, between.join(t[name] for name in names)) for names in pairs for between in (" ", " or ", " " + prose(12) + " ")]
    cases += [
        ([], "under the GNU General Public License, version 7. Chapter 3 of this work is licensed"),
        (["CC-BY-NC-SA-4.0"], "Licensed under CC BY-NC-SA 4.0."), ([], "Licensed under CC BY-SA-XX 4.0."), ([], f"All words {prose(9)} rights {prose(9)} reserved, licensed or not"),
    ]
    got = _licenses_of(spark, [text for _, text in cases])
    assert [(names, found) for (names, _), found in zip(cases, got) if found != names] == []


def test_licenses_are_not_taken_for_one_another(spark):
    """Every template altered by one word in twelve, and every pair one after the other."""
    rng = random.Random(3)
    t = licenses.TEMPLATES
    matcher = licenses.Matcher()
    cases = []
    for name, text in t.items():
        telling = {w for k, n in enumerate(matcher.names) if n == name for needed, _ in matcher.apart[k] for w in needed}
        own = text.split()
        plain = [i for i, w in enumerate(own) if not (set(licenses.words(w.encode())) & telling or any(c.isdigit() for c in w))]
        for i in rng.sample(plain, len(own) // 12):
            own[i] = rng.choice(["changed", own[i] + " added", "moreover"])
        cases.append(([name], "Some words. " + " ".join(own) + " And others."))
    cases += [([a, b], f"{t[a]} {t[b]}") for a in t for b in t]
    cases += [
        (["BSD-3-Clause"], t["BSD-3-Clause"].replace("copyright holder nor", "University nor")),
        ([], t["BSD-2-Clause"].split("Redistributions in")[0]),
        (["LGPL-3.0"], t["GPL-3.0"].replace("General", "Lesser General")), (["AGPL-3.0-header"], t["GPL-3.0-header"].replace("General", "Affero General")),
        ([], t["GPL-3.0-header"].replace("version 3", "version 4")),
    ]
    got = _licenses_of(spark, [text for _, text in cases])
    wrong = [(names, found) for (names, _), found in zip(cases, got) if found != names]
    assert wrong == []


def test_compression_finds_and_ranks_the_candidates():
    t, matcher = licenses.TEMPLATES, licenses.Matcher()
    every = licenses.Matcher(least=-1e9)
    for name, text in t.items():
        block = licenses.words(("some words before " + text + " and some behind it").encode())
        ranked = [matcher.names[k] for _, k in matcher.ranked(block)]
        assert name in ranked and len(ranked) < 0.6 * len(t)
        assert len(every.ranked(block)) == len(t)
        explained = [(n, matcher.names[k]) for n, k in matcher.ranked(block) if matcher.compare(k, block)]
        assert explained[0][1] == name
    assert licenses.Matcher(least=5.0).scan(t["MIT-text"].encode())[1] == []
    assert [f.license for f in matcher.scan(t["Apache-2.0-header"].encode())[1]] == ["Apache-2.0-header"]


def test_license_candidates_against_a_plain_version():
    """Bytes saved, measured anew for every cue, template and block of a text."""
    import zstandard

    rng = random.Random(6)
    t, matcher = licenses.TEMPLATES, licenses.Matcher()
    names = sorted(t)
    for _ in range(6):
        own = []
        for name in rng.sample(names, 3):
            own += ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(0, 40))] + t[name].split()
        block = licenses.words(" ".join(own).encode())
        expected = []
        for k, name in enumerate(names):
            plain = b" ".join(licenses.words(t[name].encode()))
            size = lambda data, **o: len(zstandard.ZstdCompressor(compression_params=licenses._parameters(), **o).compress(data))
            given = zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            saved = lambda data: size(data) - size(data, dict_data=given)  # noqa: E731, B023
            if saved(b" ".join(block)) >= 0.4 * saved(plain):
                expected.append((saved(b" ".join(block)), k))
        assert matcher.ranked(block) == sorted(expected, key=lambda c: (-c[0], c[1]))


def test_common_words():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_words(a, b) == table[-1][-1]


@pytest.fixture(scope="module")
def leaked(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.randint(15, 55)), "x") for k in range(30)] + [(30, None, "x"), (31, "", "x"), (32, "...", "x")]
    rows, truth = [], set()
    for i in range(150):
        words = line(rng.randint(60, 300)).split()
        if i % 3 == 0:
            item = items[i % 30][1].split()
            if i % 2:  # a paraphrase: one word in eight is another
                item = [rng.choice(vocabulary) if k % 8 == 5 else w for k, w in enumerate(item)]
            at = rng.randrange(len(words))
            words[at:at] = item
            truth.add((i, items[i % 30][0]))
        rows.append((i, " ".join(words).capitalize(), 0))
    rows += [(200, None, 0), (201, "", 0), (202, "?!", 0), (None, items[4][1], 0), (203, items[5][1].upper(), 0)]
    truth |= {(None, 4), (203, 5)}
    return spark.createDataFrame(rows, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string"), truth


def test_leaks(leaked):
    docs, items, truth = leaked
    out = decontamination.with_leaks(docs, items)
    assert out.columns == [*docs.columns, "leaks"]
    got = {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks}
    assert got == truth
    with pytest.raises(ValueError):
        decontamination.with_leaks(docs, items, name="TEXT")
    assert {len(r.leaks) for r in decontamination.with_leaks(docs, items.limit(0)).collect()} == {0}


def test_candidates_find_what_brute_force_finds(leaked, spark):
    """Recall of the retrieval: every leak that comparing all items with all texts finds."""
    docs, items, _ = leaked
    texts = {r.doc_id: decontamination.plain_words((r.text or "").encode()) for r in docs.collect()}
    brute = set()
    for item in items.where("length(text) > 5").collect():
        own = decontamination.plain_words(item.text.encode())
        for doc, words in texts.items():
            for at in range(0, max(1, len(words) - len(own) + 1), 4):
                if decontamination.common_words(own, words[at : at + len(own) + 8]) >= decontamination.COMMON * len(own):
                    brute.add((doc, item.item_id))
    got = {(r.doc_id, x.item_id) for r in decontamination.with_leaks(docs, items).collect() for x in r.leaks}
    assert len(brute & got) >= 0.9 * len(brute) and brute


def test_space_is_learned_from_every_row(spark):
    """Of more than 2,000 documents and items, each has words of its own, and each such word a direction."""
    docs = spark.createDataFrame([(k, f"d{k} e{k} f{k % 40} g{k % 7}") for k in range(2300)], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(12))) for k in range(2300)], "item_id bigint, text string")
    space = decontamination.latent_space(docs, items, decontamination.rarity(docs))
    both = docs.select("text").union(items.select("text"))
    slots = {s for r in both.select(decontamination.word_slots(F.col("text")).alias("s")).collect() for s in r.s}
    assert len(slots) > 15000 and np.linalg.norm(space[sorted(slots)], axis=1).min() > 1e-9


def test_the_driver_holds_few_copies_of_the_space(spark):
    """One block is 15 MB; before, the driver held five at a time."""
    docs = spark.createDataFrame([(k, f"d{k} e{k % 9} f{k % 40}") for k in range(300)], "doc_id bigint, text string")
    idf = decontamination.rarity(docs)
    tracemalloc.start()
    try:
        decontamination.latent_space(docs, docs.select("text"), idf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6


def test_counters_of_words_inside_tasks(spark):
    texts = ["", " \n", "a", "Ab, (cd)[ef]! x", "ÜBER Ñandú Ωmega \u00a0 x\u2003y", "z" * 31 + " " + "Q" * 32 + "\t" + "é" * 200, "x" * 8 + " " + "y" * 15 + "\x0b\x0c1"]
    texts += [" ".join("w" * k for k in range(1, 40)), "last"]
    plain = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").select(decontamination.word_slots(F.col("text")).alias("s")).collect()]
    slots, lengths = decontamination.text_slots([t.encode() for t in texts])
    assert [s.tolist() for s in np.split(slots, np.cumsum(lengths)[:-1])] == plain


def test_sketch_against_a_dense_product():
    rng = np.random.default_rng(3)
    idf = rng.uniform(0.05, 9, decontamination.DIMS)
    basis = rng.normal(size=(decontamination.DIMS, 5)).astype(np.float32)
    frequent = np.argsort(idf)[:40]
    texts = [np.where(rng.random(n) < 0.5, rng.choice(frequent, n), rng.integers(0, 900, n)).astype(np.uint16) for n in (0, 1, 47, 48, 49, 500, 96, 3000)]
    passages = [t[k : k + decontamination.PASSAGE] for t in texts for k in range(0, len(t), decontamination.PASSAGE)]
    dense = np.array([np.bincount(p, minlength=decontamination.DIMS) * idf for p in passages])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["slots"])
    got = np.zeros(basis.shape)
    for part in decontamination._sketch(lambda: basis, idf)([batch]):
        got[part["slot"].to_numpy()] = np.array(part["v"].to_pylist())
    assert np.abs(got - dense.T @ (dense @ basis)).max() < 1e-4


def test_words_of_long_items_in_regions():
    """As many of the item's words, in any order, as a plain count finds; items of more than 64 words too."""
    rng = random.Random(21)
    items = [[rng.randrange(n) for _ in range(n)] for n in (1, 15, 64, 65, 130)]
    texts = [" ".join(f"w{w}" for w in item).encode() for item in items]
    held = decontamination.Retriever(list(range(len(items))), texts, items, np.ones((decontamination.DIMS, 1), dtype=np.float32))
    table = np.zeros(decontamination.DIMS + 1, dtype=np.uint64)
    for k, item in enumerate(items):
        regions = [[w if rng.random() < share else 5000 for w in item] for share in (0, 0.3, 0.5, 0.6, 0.7, 0.8, 1) for _ in range(9)]
        tail = item[-max(4, len(item) // 3) :]
        share = lambda words, region: sum(w in region for w in words) / len(words)
        expected = [share(item, r) >= 0.75 or (share(item, r) >= 0.5 and share(tail, r) >= 0.8) for r in regions]
        assert held._possible(k, np.array(regions), table).tolist() == expected and not table.any()


def test_sums_of_the_space_do_not_grow_with_the_files(spark):
    docs = spark.createDataFrame([(k, f"d{k} e{k % 9} f{k % 40}") for k in range(400)], "doc_id bigint, text string").repartition(100)
    slots = decontamination._few(decontamination.worded(docs))
    assert slots.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and slots.count() == 400


@pytest.mark.parametrize("length", [5, 4 * 2048 + 9, 20011])
def test_candidates_against_each_window_alone(length):
    """Texts of less than one and of several batches of windows, the irregular last window too, and two batches of items."""
    rng, vocabulary = np.random.default_rng(31), 400
    space = np.zeros((decontamination.DIMS, 6), dtype=np.float32)
    space[:vocabulary] = rng.standard_normal((vocabulary, 6))
    items = [rng.integers(0, vocabulary, n).tolist() for n in rng.choice([6, 14, 23, 31, 46, 70], 300)]
    held = decontamination.Retriever(list(range(len(items))), [b" ".join(b"w%d" % w for w in i) for i in items], items, space)
    held._possible = lambda item, regions, table: np.ones(len(regions), dtype=bool)
    text = rng.integers(0, vocabulary, length)
    got = {(start, width, item): cosine for start, width, item, cosine in held.candidates(text, 0, length)}
    blocks = -(-length // 4)
    sums = np.append(np.zeros((1, 6)), np.cumsum(np.vstack([space[text], np.zeros((400, 6))]).astype(float), axis=0), axis=0)
    seen = 0
    for width, own in held.classes:
        starts = sorted({*range(0, max(1, blocks - width + 1), max(1, width // 4)), max(0, blocks - width)})
        window = sums[np.array(starts) * 4 + width * 4] - sums[np.array(starts) * 4]
        cosines = held.unit[own] @ (window / np.linalg.norm(window, axis=1, keepdims=True)).T
        for b, item in enumerate(own.tolist()):
            for start, cosine in zip(starts, cosines[b].tolist()):
                found = got.pop((start * 4, width * 4, item), None)
                if abs(cosine - 0.55) > 1e-4:
                    assert (found is not None) == (cosine > 0.55)
                if found is not None:
                    seen += 1
                    assert abs(found - cosine) < 1e-4
    assert seen and not got


def test_no_leak_of_the_rule_is_filtered():
    """Short leaks with half of an item's words and all of its last third, under cosines that let all pass."""
    rng = random.Random(14)
    vocabulary = [f"w{k}".encode() for k in range(3000)]
    slot = {w: k for k, w in enumerate(vocabulary)}
    items = [rng.sample(vocabulary, n) for n in (25, 26, 30, 37, 38, 45, 55) for _ in range(4)]
    texts = []
    for item in items:
        tail = len(item) // 3
        need = -(-len(item) // 2) + 1 - tail
        kept = sorted(rng.sample(range(len(item) - tail), need))
        filler = lambda: rng.choices(vocabulary, k=rng.randint(0, 1))
        words = [w for k in kept for w in [item[k], *filler()]] + item[-tail:]
        texts.append(rng.choices(vocabulary, k=90) + words + rng.choices(vocabulary, k=70))
    space = np.ones((decontamination.DIMS, 1), dtype=np.float32)
    got = decontamination.Retriever(list(range(len(items))), [b" ".join(w) for w in items], [[slot[w] for w in i] for i in items], space)
    hits = got.search(pa.array([b" ".join(t).decode() for t in texts]), pa.array([[slot[w] for w in t] for t in texts], pa.list_(pa.int32())))
    assert [[h.item for h in own] for own in hits] == [[k] for k in range(len(items))]


def test_recall_of_planted_leaks_by_share_kept(spark):
    """Benchmark items in running text of the test tables, with a share of their words and the whole last third."""
    sf_dir, rng = "/root/testdata/sf0.01", random.Random(16)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = {r.item_id: r.text.split() for r in items.collect()}
    clean = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars between 400 and 3000").orderBy("doc_id").limit(200).collect()]
    rows, planted = [], {}
    for k, share in enumerate([0.55, 0.65, 0.8, 1.0] * 50):
        item = rng.choice([i for i, w in words.items() if len(w) >= 12])
        own, tail = words[item], max(4, len(words[item]) // 3)
        need = max(0, math.ceil(share * len(own)) - tail)
        kept = sorted(rng.sample(range(len(own) - tail), min(need, len(own) - tail)))
        at = rng.randrange(len(clean[k]))
        rows.append((k, " ".join(clean[k][:at] + [own[i] for i in kept] + own[-tail:] + clean[k][at:])))
        planted[k] = (share, item)
    found = decontamination.with_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items)
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in found.collect()}
    for share in (0.55, 0.65, 0.8, 1.0):
        own = [item in got[k] for k, (s, item) in planted.items() if s == share]
        assert sum(own) >= 0.9 * len(own), (share, sum(own), len(own))


def test_ranking_against_plain_gradient_descent():
    """The same pairs, loss and threshold, worked out with loops."""
    rng = np.random.default_rng(4)
    n, width = 40, quality.FEATURES
    x = rng.normal(size=(n, width)) * np.linspace(0.5, 3, width)
    labels = (x[:, 0] + x[:, 3] + rng.normal(size=n) > 0).astype(int)
    got = quality.fit_pairs(x, labels)
    mean, spread = [c.mean() for c in x.T], [c.std() + 1e-6 for c in x.T]
    z = [[(v - m) / s for v, m, s in zip(row, mean, spread)] for row in x]
    good, bad = ([i for i in range(n) if labels[i] == k] for k in (1, 0))
    most = max(len(good), len(bad))
    pairs = [(good[i % len(good)], bad[(i + i // most * 7) % len(bad)]) for i in range(8 * most)]

    def loss(w):
        margins = (sum(wi * (a - b) for wi, a, b in zip(w, z[g], z[b_])) for g, b_ in pairs)
        return sum(math.log1p(math.exp(-m)) for m in margins) / len(pairs) + 0.01 / 2 * sum(v * v for v in w)

    least = loss(got.weights)
    for j in range(width):  # the loss is convex: no step along any axis, or at random, lowers it
        for step in (-0.01, 0.01):
            moved = got.weights.copy()
            moved[j] += step
            assert loss(moved) > least
    assert all(loss(got.weights + 0.05 * rng.normal(size=width)) > least for _ in range(10))
    raw = sorted(sum(wi * v for wi, v in zip(got.weights, row)) for row in z)
    assert got.cut == pytest.approx((raw[len(bad) - 1] + raw[len(bad)]) / 2)
    scores = got.score(x)
    assert [(s >= 0.7) for s in scores] == [r >= got.cut for r in got.raw(x)]


def test_features_against_plain_counts():
    rng = random.Random(17)
    for _ in range(30):
        text = "".join(rng.choice("aB1 .!|#\né\t,") for _ in range(rng.randint(0, 120)))
        data, words = text.encode(), text.encode().split()
        got = quality.features(data)
        if not words:
            assert got == [0.0] * quality.FEATURES
            continue
        n, lengths = len(words), [len(w) for w in words]
        mean = sum(lengths) / n
        lines = [x for x in data.split(b"\n") if x.strip()]
        expected = [
            math.log1p(n) / 10, mean / 10, math.sqrt(sum((v - mean) ** 2 for v in lengths) / n) / 10,
            math.sqrt(sum(words[i] == words[i + 1] for i in range(n - 1)) / max(1, n - 1)), len(set(words)) / n,
            len(set(words)) / math.sqrt(n) / 10, max(words.count(w) for w in words) / n,
            len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(1, n - 1) if n > 1 else 1.0,
            len(set(lines)) / len(lines), math.log1p(len(lines)) / 10, math.log1p(n / len(lines)) / 10,
            sum(w[-1:] in b".,;:?" for w in words) / n,
        ]
        assert got[-12:] == pytest.approx(expected)
        assert sum(v * v for v in got[:-12]) == pytest.approx(1.0)  # shares of all bytes


def test_empty_tables(spark, no_docs, labelled):
    assert secrets.find_secrets(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0
    assert language.identify(no_docs).count() == 0
    assert quality.classify(no_docs, labelled[1]).count() == 0
    assert decontamination.with_leaks(no_docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
