"""Sharding against a plain version: the smallest capacity, even cuts, gapless slots."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm.queries import QUERIES
from keelson.llm.registry import load
from keelson.llm.sharding import Ends, _own_shards, minimax_cuts, text_shards


def greedy(sizes, capacity, shards):
    """Whether the sizes fill at most so many shards in their order."""
    used, room = 0, 0
    for size in sizes:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
        room -= size
    return used <= shards


def plain_cuts(sizes, shards):
    """The smallest capacity by trying all, and the cuts drawn to the even share, group by group."""
    total, ends = sum(sizes), list(np.cumsum(sizes)) if sizes else []
    ends = [0, *map(int, ends)]
    capacity = next(c for c in range(total + 1) if greedy(sizes, c, shards))
    least = [total]
    for _ in range(shards - 1):
        least.append(min(e for e in ends if e >= least[-1] - capacity))
    least.reverse()
    made, at = [], 0
    for k in range(1, shards):
        below = lambda x: max(e for e in ends if e <= x)
        at = max(at, min(below(at + capacity), max(least[k - 1], below(total * k // shards))))
        made.append(at)
    return capacity, made + [total]


def plain_shards(rows, shards, overhead=16):
    """Shard, slot, size and checksum of every row, by id and text."""
    content = [(i, (t or "").encode()) for i, t in rows]
    sizes, key = Counter(), {}
    for _, b in content:
        key[b] = hashlib.sha256(b).hexdigest()
        sizes[key[b]] += len(b) + overhead
    largest = sorted(sizes.items(), key=lambda g: (-g[1], g[0]))[:shards]
    own = _own_shards(largest, sum(sizes.values()), shards)
    rest = sorted(k for k in sizes if k not in own)
    cuts = plain_cuts([sizes[k] for k in rest], shards - len(own))[1]
    place, upto = {k: s for s, k in enumerate(own)}, 0
    for k in rest:
        upto += sizes[k]
        place[k] = len(own) + sum(upto > c for c in cuts[:-1])
    inside = defaultdict(list)
    for i, b in content:
        turn = hashlib.sha256(f"{'' if i is None else i}:{key[b]}".encode()).hexdigest()
        inside[place[key[b]]].append((turn, i, len(b) + overhead, zlib.crc32(b)))
    out = []
    for shard, members in inside.items():
        members.sort(key=lambda m: m[0])
        out += [(i, size, crc, shard, slot) for slot, (_, i, size, crc) in enumerate(members)]
    return sorted(out, key=repr)


def zoomed(sizes, digits):
    """Cuts by ranges of hash prefixes, as the driver sees them."""
    keys = sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in range(len(sizes)))
    ends = np.cumsum(np.array(sizes, dtype=np.int64))

    def ranges(length, inside=None):
        found = {}
        for key, end in zip(keys, ends):
            if inside is None or key[: length - 1] in inside:
                count = found.get(key[:length], (0, 0))[1]
                found[key[:length]] = (int(end), count + 1)
        p = list(found)
        return (
            np.array(p, dtype=object),
            np.array([found[x][0] for x in p], dtype=np.int64),
            np.array([found[x][1] for x in p], dtype=np.int64),
        )

    def refine(prefixes):
        parts = [ranges(n + 1, {p for p in prefixes if len(p) == n}) for n in {len(p) for p in prefixes}]
        return tuple(np.concatenate(c) for c in zip(*parts))

    return lambda shards: minimax_cuts(Ends(*ranges(digits)), shards, refine)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_from_ranges_match_cuts_from_groups(seed):
    rng = random.Random(seed)
    shape = [lambda: 7, lambda: rng.randint(1, 40), lambda: int(rng.paretovariate(0.9)) % 400 + 1][seed % 3]
    sizes = [shape() for _ in range(rng.choice([1, 5, 41, 300]))]
    for shards in (1, 2, 7, 40):
        capacity, cuts = plain_cuts(sizes, shards)
        assert zoomed(sizes, 1)(shards) == cuts
        held = np.diff([0, *cuts])
        assert held.max() == capacity and held.sum() == sum(sizes)


def test_even_sizes_leave_no_shard_empty():
    assert set(np.diff([0, *zoomed([5] * 101, 1)(40)])) == {10, 15}


def test_no_groups():
    none = (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    assert minimax_cuts(Ends(*none), 3, None) == [0, 0, 0]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_odd_rows(docs, corpus, shards):
    found = text_shards(docs, shards, bucket_rows=4)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert _rows(found) == plain_shards([(r[0], r[1]) for r in corpus], shards)


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "copied text" if i % 3 == 0 else f"text {i}") for i in range(600)] + [(None, "no id")] * 50
    found = _rows(text_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 10))
    assert found == plain_shards(rows, 10)
    sizes = Counter()
    for _, size, _, shard, _ in found:
        sizes[shard] += size
    assert len(sizes) == 10 and max(sizes.values()) == 200 * 27  # the copies fill one shard


def test_empty_table(no_docs):
    assert _rows(text_shards(no_docs)) == []


def test_no_shards_is_an_error(no_docs):
    with pytest.raises(ValueError):
        text_shards(no_docs, 0)


def test_query_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op11_sharding"](spark, sf_dir).collect()
    rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found), key=repr) == plain_shards(rows, 40)
