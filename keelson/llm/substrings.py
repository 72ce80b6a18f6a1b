"""Removal of word sequences that occur in earlier documents, by suffix automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, picked, spread_join, stored, texts_as_bytes
from .registry import load, register

WORDS = 13  # words of a window
ANCHOR = 5  # words of an anchor; every window owns the anchor with the least hash in it
CONTEXTS = 2000  # different pieces around one anchor that one automaton takes


class SuffixAutomaton:
    """All subsequences of several word sequences, each with the earliest document it is in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [float("inf")]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(float("inf"))
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, to: int) -> int:
        """The state of exactly the sequences of ``state`` followed by ``word``."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: Sequence[bytes], document: int) -> None:
        last = 0
        for word in words:
            to = self.next[last].get(word)
            if to is not None:
                last = self._split(last, word, to)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                state = last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, word, self.next[state][word])
                last = new
            self.first[last] = min(self.first[last], document)

    def freeze(self) -> None:
        """Pass the earliest documents on to the shorter sequences; call once, after all ``add``."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            self.first[up] = min(self.first[up], self.first[state])

    def statistics(self, words: Sequence[bytes], width: int) -> Iterator[tuple[int, float]]:
        """For each position, the length of the longest match that ends there, and the
        earliest document of its last ``width`` words (infinity if the match is shorter)."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            at = state
            while at > 0 and self.length[self.link[at]] >= width:
                at = self.link[at]
            yield matched, self.first[at] if matched >= width else float("inf")


def earliest(pieces: list[list[bytes]], documents: list[int], width: int) -> list[list[int]]:
    """For each piece and each window of it, the earliest document that has the window."""
    if len(pieces) == 1:  # its automaton is a path
        return [[documents[0]] * (len(pieces[0]) - width + 1)]
    automaton = SuffixAutomaton()
    for piece, document in zip(pieces, documents):
        automaton.add(piece, document)
    automaton.freeze()
    found = ([first for _, first in automaton.statistics(piece, width)] for piece in pieces)
    return [[int(first) for first in ends[width - 1 :]] for ends in found]  # a piece is in its own automaton


class _Hashes(dict):
    """Hashes of words; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def runs(texts: list[list[bytes]], hashes: dict, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The windows of documents as runs: document, anchor hash, first window and number of windows.

    A window owns the anchor in it with the least hash, the first among equals, so
    the choice depends on the words of the window only. Neighbouring windows that own the
    same anchor form a run. The documents are laid end to end and worked on together;
    windows over an end are left out.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(lengths.sum())
    if n < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=n)
    mixed = np.zeros(n - anchor + 1, dtype=np.uint64)
    for j in range(anchor):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : n - anchor + 1 + j]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    place = np.arange(len(mixed), dtype=np.uint64)
    low = (mixed & ~np.uint64(0xFFFFFFFF)) | place  # the texts have fewer than 2^32 words
    span, have = width - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    document = np.repeat(np.arange(len(texts)), lengths)[: len(owner)]
    at = np.arange(len(owner)) - begin[document]
    inside = np.flatnonzero(at + width <= lengths[document])
    owner, document, at = owner[inside], document[inside], at[inside]
    if not len(owner):
        return document, owner, at, owner
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (document[1:] != document[:-1])])
    return document[start], mixed[owner[start]].view(np.int64), at[start], np.diff(np.r_[start, len(owner)])


def _together(batch: pa.RecordBatch, size: int = 1 << 16) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of a batch's texts, some texts at a time: the place of the first, and the texts."""
    first, held, words = 0, [], 0
    for k, text in enumerate(texts_as_bytes(batch.column("text"))):
        held.append(text.split())
        words += len(held[-1])
        if words > size:
            yield first, held
            first, held, words = k + 1, [], 0
    if held:
        yield first, held


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _anchors(width: int, anchor: int):
    """The different anchors of each document; a word repeated all over gives one."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in stream:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for first, texts in _together(batch):
                document, owned, _, _ = runs(texts, hashes, width, anchor)
                order = np.lexsort((owned, document))
                document, owned = document[order], owned[order]
                new = np.r_[True, (document[1:] != document[:-1]) | (owned[1:] != owned[:-1])][: len(order)]
                at = first + document[new]
                yield _rows(anchor=pa.array(owned[new]), doc_id=pa.array(ids[at]), text_key=pa.array(keys[at]))

    return run


def _cut(width: int, anchor: int):
    """The texts of a document's runs at the anchors that other documents have too."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in stream:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            lists = batch.column("anchors")
            for first, texts in _together(batch):
                document, owned, starts, counts = runs(texts, hashes, width, anchor)
                shared = lists.slice(first, len(texts))
                holder = np.repeat(np.arange(len(texts)), shared.value_lengths().to_numpy(zero_copy_only=False))
                # A run is kept if its document has its anchor in the list. Two pairs of one
                # number would only let a piece more through, which changes no result.
                kept = np.flatnonzero(np.isin(_pair(document, owned), _pair(holder, shared.flatten().to_numpy())))
                document, starts, counts = document[kept], starts[kept], counts[kept]
                ends = starts + counts + width - 1
                pieces = [b" ".join(texts[d][i:j]) for d, i, j in zip(document.tolist(), starts.tolist(), ends.tolist())]
                yield _rows(
                    anchor=pa.array(owned[kept]), piece=pa.array(pieces, pa.binary()).cast(pa.string()),
                    doc_id=pa.array(ids[first + document]), text_key=pa.array(keys[first + document]),
                    start=pa.array(starts.astype(np.int32)),
                )

    return run


def _pair(document: np.ndarray, owned: np.ndarray) -> np.ndarray:
    return owned ^ (document * np.int64(0x2545F4914F6CDD1D))


def _shards(width: int):
    """One automaton for the pieces of each anchor; rows come sorted by anchor."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        out: tuple[list, list, list] = ([], [], [])

        def solve() -> None:
            if held[0]:
                out[0].extend([now] * len(held[0]))
                out[1].extend(held[2])
                if len(held[0]) == 1:  # the automaton of one piece is a path
                    out[2].append([held[1][0]] * (held[0][0].count(b" ") + 2 - width))
                else:
                    out[2].extend(earliest([piece.split() for piece in held[0]], held[1], width))

        def made() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, out[2])]).astype(np.int32)
            firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(out[2])), pa.int64()))
            return _rows(anchor=pa.array(out[0], pa.int64()), piece_key=pa.array(out[1], pa.int64()), firsts=firsts)

        for batch in stream:
            pieces = texts_as_bytes(batch.column("piece"))
            for anchor, piece, first, key in zip(batch.column("anchor").to_pylist(), pieces, batch.column("first").to_pylist(), batch.column("piece_key").to_pylist()):
                if anchor != now:
                    solve()
                    now, held = anchor, ([], [], [])
                    if len(out[0]) > 1 << 14:
                        yield made()
                        out = ([], [], [])
                held[0].append(piece)
                held[1].append(first)
                held[2].append(key)
        solve()
        yield made()

    return run


def _kept(width: int):
    """The words of each document that no repeated window covers."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column("starts").to_pylist()
            total, removed, kept, spans = [], [], [], []
            for k, text in enumerate(texts_as_bytes(batch.column("text"))):
                words = text.split()
                own = []
                for start in sorted(set(lists[k] or ())):
                    if own and start <= own[-1][1]:
                        own[-1][1] = start + width
                    else:
                        own.append([start, start + width])
                rest, at = [], 0
                for start, end in own:
                    rest += words[at:start]
                    at = end
                rest += words[at:]
                total.append(len(words))
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
                spans.append(own)
            yield _rows(
                doc_id=batch.column("doc_id"), n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                kept=pa.array(kept, pa.binary()).cast(pa.string()), spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            )

    return run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, anchor: int = ANCHOR, contexts: int = CONTEXTS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words
    that stay, joined by one space) and ``spans`` (removed word ranges, end exclusive).

    A word goes if a window of ``width`` words that covers it also starts in a document
    with a smaller id; windows are judged on the input. The documents are their own
    reference, which is as large as the input and so cannot be broadcast whole. It is dealt
    to shards by content instead: every window owns the anchor with the least hash in it,
    so equal windows meet at one anchor. Anchors of one document only are left out. Around
    the others, equal pieces of text are taken once with their earliest document, each
    shard's automaton is built from them, and the pieces are streamed against it; copies
    of a passage, however many, get the result by a join. An anchor with more than
    ``contexts`` different pieces is resolved by its whole windows instead, with
    the same result.

    A null text has no words and ``kept`` is empty. A document with a null id is kept whole
    and is no reference. Documents with the same id are not earlier than one another.
    Shorter texts than a window stay whole. Words are compared byte by byte, unchanged.
    Extra columns are not read. An empty table gives no rows.
    """
    own = picked(docs, doc_id=id_col, text=text_col)
    own = own.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("text_key", F.xxhash64("text"))
    sources = own.where("doc_id is not null and text is not null")

    owned = sources.mapInArrow(_anchors(width, anchor), "anchor bigint, doc_id bigint, text_key bigint")
    at = Window.partitionBy("anchor")
    shared = owned.withColumn("low", F.min("doc_id").over(at)).withColumn("high", F.max("doc_id").over(at)).where("low < high")
    marked = shared.groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))
    cut = sources.join(marked, ["doc_id", "text_key"]).mapInArrow(
        _cut(width, anchor), "anchor bigint, piece string, doc_id bigint, text_key bigint, start int"
    )
    pieces = stored(cut.withColumn("piece_key", F.xxhash64("piece")))

    once = stored(pieces.groupBy("anchor", "piece", "piece_key").agg(F.min("doc_id").alias("first")))
    busy = once.groupBy("anchor").agg(F.count("*").alias("held")).where(F.col("held") > contexts).select("anchor")
    shards = once.join(busy, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    solved = shards.mapInArrow(_shards(width), "anchor bigint, piece_key bigint, firsts array<bigint>")
    firsts = stored(solved.union(_by_window(once.join(busy, "anchor", "left_semi"), width)))

    met = spread_join(pieces.drop("piece"), firsts, ["anchor", "piece_key"], "inner")
    later = F.filter(
        F.transform("firsts", lambda first, i: F.when(first < F.col("doc_id"), F.col("start") + i)), lambda s: s.isNotNull()
    )
    starts = met.select("doc_id", "text_key", later.alias("starts")).where(F.size("starts") > 0)
    starts = starts.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    found = own.join(starts, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")
    return found.mapInArrow(_kept(width), "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<array<bigint>>")


def _by_window(once: DataFrame, width: int) -> DataFrame:
    """The earliest documents of the windows of each piece, by grouping whole windows."""
    words = F.split("piece", " ")
    opened = once.select("anchor", "piece_key", "first", words.alias("w")).select(
        "anchor", "piece_key", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.array_join(F.slice("w", i, width), " ")))
    )
    least = opened.groupBy("col").agg(F.min("first").alias("least"))
    joined = spread_join(opened.select("anchor", "piece_key", "pos", "col"), least, ["col"], "inner")
    ordered = joined.groupBy("anchor", "piece_key").agg(F.array_sort(F.collect_list(F.struct("pos", "least"))).alias("all"))
    return ordered.select("anchor", "piece_key", F.col("all.least").alias("firsts"))


OP1_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents),
windows AS (
  SELECT row, doc_id, s, array_to_string(words[s : s + {WORDS - 1}], ' ') AS win
  FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - {WORDS - 2})) AS s FROM w)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
covered AS (
  SELECT DISTINCT row, unnest(range(s, s + {WORDS})) AS i FROM windows JOIN firsts USING (win) WHERE first < doc_id),
lists AS (SELECT row, list(i) AS gone FROM covered GROUP BY row),
kept AS (SELECT doc_id, words, [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS k FROM w LEFT JOIN lists USING (row))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@register("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
