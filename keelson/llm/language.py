"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hash_sample, picked, shared_value, texts_as_bytes
from .quality import held_out
from .registry import load, register

UNDETERMINED = "und"
ORDER = 3  # bytes of context; an n-gram of context and symbol fits into 32 bits


class Table:
    """Rows of numbers by unsigned key, looked up many at a time.

    Keys are put into slots by multiplicative hashing; those whose slot is taken go to
    another, smaller table with another multiplier, until none is left.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.uint64)
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left, mix = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            bits = max(4, int(np.ceil(np.log2(len(left) * 4))))
            shift = np.uint64(64 - bits)
            slots = np.full(1 << bits, -1, dtype=np.int32)
            factor = np.uint64(mix)
            at = self._slot(self.keys[left], factor, shift)
            slots[at] = left  # the last key of a slot stays
            self.levels.append((factor, shift, slots))
            left = left[slots[at] != left]
            mix = (mix * 0xD1342543DE82EF95 | 1) % (1 << 64)

    @staticmethod
    def _slot(keys: np.ndarray, mix: np.uint64, shift: np.uint64) -> np.ndarray:
        return (keys * mix) >> shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = None
        for mix, shift, slots in self.levels:
            wanted = keys if left is None else keys[left]
            row = slots[self._slot(wanted, mix, shift)]
            hit = row >= 0
            hit[hit] = self.keys[row[hit]] == wanted[hit]
            if left is None:
                out[hit] = row[hit]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = row[hit]
                left = left[~hit]
            if not len(left):
                break
        return out


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The n-gram that ends at each byte from ``ORDER`` on, as a number."""
    out = np.zeros(len(data) - ORDER, dtype=np.uint64)
    for back in range(length - 1, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - back : len(data) - back]
    return out


def padded(text: bytes) -> bytes:
    """A text with the context in which its first bytes are coded."""
    return b"\n" * ORDER + text


class PartialMatching:
    """Variable-order byte context trees, one per language, with frozen counts.

    A context that a language has seen n times with q different next bytes codes a byte
    seen c times with probability c / (n + q), and escapes to the context one byte shorter
    with probability q / (n + q). A context never seen is left without cost. Below order
    zero every byte has 1/256. The code length of a text is the sum over its bytes.
    """

    def __init__(self, texts: Mapping[str, list[bytes]]) -> None:
        self.languages = sorted(texts)
        n = len(self.languages)
        counted = []  # by language, by order: n-grams, counts
        for language in self.languages:
            data = [np.frombuffer(padded(t), dtype=np.uint8) for t in texts[language] if t]
            by_order = []
            for order in range(ORDER + 1):
                grams = [_grams(d, order + 1) for d in data]
                by_order.append(np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_counts=True))
            counted.append(by_order)
        self.symbols: list[tuple[Table, np.ndarray]] = []
        self.escapes: list[tuple[Table, np.ndarray]] = []
        for order in range(ORDER + 1 if n else 0):
            contexts = np.unique(np.concatenate([c[order][0] >> np.uint64(8) for c in counted]))
            escape = np.zeros((len(contexts), n))
            table = Table(contexts)
            grams = np.unique(np.concatenate([c[order][0] for c in counted]))
            cost = np.zeros((len(grams), n))
            shorter = self._cost(order - 1, grams & np.uint64((1 << (8 * order)) - 1))
            at = table.find(grams >> np.uint64(8))
            for k, by_order in enumerate(counted):
                own, counts = by_order[order]
                mine = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(mine, weights=counts, minlength=len(contexts))
                kinds = np.bincount(mine, minlength=len(contexts))
                seen = total > 0
                escape[seen, k] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[:, k] = escape[at, k] + shorter[:, k]
                cost[np.searchsorted(grams, own), k] = -np.log2(counts / (total + kinds)[mine])
            self.escapes.append((table, escape))
            self.symbols.append((Table(grams), cost))

    def _cost(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each n-gram in each language, by contexts up to ``order``."""
        if order < 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        table, cost = self.symbols[order]
        row = table.find(grams)
        out = cost[row]  # rows of -1 are set below
        left = np.flatnonzero(row < 0)
        if len(left):
            missed = grams[left]
            contexts, escape = self.escapes[order]
            context = contexts.find(missed >> np.uint64(8))
            away = np.where((context >= 0)[:, None], escape[context], 0.0)
            out[left] = away + self._cost(order - 1, missed & np.uint64((1 << (8 * order)) - 1))
        return out

    def code_lengths(self, texts: list[bytes], block: int = 1 << 20) -> np.ndarray:
        """Bits of each whole text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        if not texts or not self.languages:
            return total
        data = np.frombuffer(b"".join(map(padded, texts)), dtype=np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        begins = ends - [len(t) for t in texts]
        for start in range(ORDER, len(data), block):  # bounds the memory, whatever the texts' lengths
            stop = min(len(data), start + block)
            inside = np.arange(np.searchsorted(ends, start, "right"), np.searchsorted(begins, stop, "left"))
            low, high = np.maximum(begins[inside], start), np.minimum(ends[inside], stop)
            inside, low, high = (v[high > low] for v in (inside, low, high))
            if not len(inside):
                continue
            edge = np.zeros(stop - start + 1, dtype=np.int8)
            np.add.at(edge, low - start, 1)
            np.add.at(edge, high - start, -1)
            grams = _grams(data[start - ORDER : stop], ORDER + 1)[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
            first = np.cumsum(high - low) - (high - low)
            total[inside] += np.add.reduceat(self._cost(ORDER, grams), first, axis=0)
        return total


def pieces(text: bytes, most: int, size: int = 2048) -> list[bytes]:
    """A text of at most ``most`` bytes whole, else so many bytes of it in even pieces over its length.

    Pieces start with a character.
    """
    if len(text) <= most:
        return [text]
    count = max(1, most // size)
    out = []
    for k in range(count):
        start = k * (len(text) - size) // max(1, count - 1)
        while start < len(text) and text[start] & 0xC0 == 0x80:
            start += 1
        out.append(text[start : start + size])
    return out


def learn(docs: DataFrame, docs_per_language: int = 400, bytes_per_doc: int = 32768) -> PartialMatching:
    """Trees from ``docs`` (text, lang), with texts and languages that are not null.

    Each language has at most ``docs_per_language`` documents, those with the smallest
    hash. Of a document of more than ``bytes_per_doc`` bytes, ``pieces`` spread evenly over
    the whole text are learned. The languages are listed, one row each, and their samples
    come to the driver.
    """

    @F.arrow_udf("array<binary>")
    def learned(column: pa.Array) -> pa.Array:
        return pa.array([pieces(t, bytes_per_doc) for t in texts_as_bytes(column)], pa.list_(pa.binary()))

    known = docs.where((F.octet_length("text") > 0) & F.col("lang").isNotNull())
    languages = [r.lang for r in known.select("lang").distinct().collect()]
    texts = {}
    for language in languages:
        sample = hash_sample(known.where(F.col("lang") == language), ["doc_id", "text"], docs_per_language)
        texts[language] = sorted(bytes(t) for r in sample.select(learned("text").alias("t")).collect() for t in r.t)
    return PartialMatching(texts)


def language_of(text: Column, model: PartialMatching, spark: SparkSession) -> Column:
    """A struct of ``lang`` and ``score`` for each text.

    The language is the one with the shortest code, the first by name among equals. The
    score is its share of the likelihood, 2^-bits, of all languages.
    """
    shared = shared_value(spark, model)  # bounded by the sample it was learned from

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(column: pa.Array) -> pa.Array:
        own = shared()
        bits = own.code_lengths(texts_as_bytes(column))
        if not own.languages:
            names, score = [UNDETERMINED] * len(column), np.zeros(len(column))
        else:
            names = [own.languages[k] for k in bits.argmin(axis=1)]
            score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return of(text)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Documents whose crc32 of the id leaves 1 when divided by 3 are held out and not
    learned from, nor are those with a null language. Only the text is an input of the
    prediction. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing was learned. Null ids are predicted. Equal texts get equal
    results. Extra columns are not read. An empty table gives no rows.
    """
    own = picked(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", held_out("doc_id", 3, 1))
    model = learn(own.where("not held_out"), docs_per_language)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    guessed = own.select("doc_id", "held_out", lettered.alias("lettered"), language_of(F.col("text"), model, own.sparkSession).alias("g"))
    return guessed.select(
        "doc_id",
        "held_out",
        F.when(F.col("lettered"), F.col("g.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("g.score")).otherwise(0.0).alias("score"),
    )


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
