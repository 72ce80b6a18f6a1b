"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import picked, quoted, shared_value, stored, texts_as_bytes
from .registry import load, register

DIMS = 1 << 15  # counters of words; a fixed size, whatever the vocabulary
RANK, EXTRA = 48, 8  # dimensions of the latent space, and those more that the sketch has
HOP = 4  # words of a block; windows start and end with one
PASSAGE = 48  # words of a passage that the space is learned from
TOGETHER = 1 << 14  # passages that are multiplied at a time
FREQUENT = 256  # counters of the most frequent words, multiplied as a dense matrix
BLOCK = 20000  # benchmark items that a task holds at a time
COSINE = 0.55  # least cosine of a candidate
COMMON, LOOSE, ANSWER = 0.75, 0.5, 0.8  # shares of an item's words found in order
SEED = 7

_MARKS = ".,;:!?\"'()[]"
_PLAIN = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _MARKS.encode(), bytes(range(0x61, 0x7B)) + b" " * len(_MARKS)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), ASCII punctuation taken as blanks."""
    return text.translate(_PLAIN).split()


def word_slots(text: Column) -> Column:
    """The counter of each of those words, by DataFrame functions; letters of other alphabets in lower case too."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"""[\x20\x09-\x0D.,;:!?"'()\[\]]+"""), "")
    return F.transform(found, lambda w: F.xxhash64(w).bitwiseAND(F.lit(DIMS - 1)).cast("int"))


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_XX = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def word_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of words in ``data``, those of one length together; eight bytes must follow them."""
    a, b, c, d, e = _XX
    out = np.empty(len(first), dtype=np.uint64)
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    ends = np.searchsorted(length[order], np.arange(1, 33))
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    for n in range(1, 32):
        own = order[ends[n - 1] : ends[n]]
        h, at = np.full(len(own), int(e) + 42 + n, dtype=np.uint64), first[own]
        for done in range(0, n - 7, 8):
            h ^= _turned(eight[at + done].view("<u8")[:, 0] * b, 31) * a
            h = _turned(h, 27) * a + d
        if n % 8:
            lane = eight[at + n // 8 * 8].view("<u8")[:, 0]
            if n % 8 >= 4:
                h ^= (lane & np.uint64(0xFFFFFFFF)) * a
                h, lane = _turned(h, 23) * b + c, lane >> np.uint64(32)
            for _ in range(n % 4):
                h ^= (lane & np.uint64(0xFF)) * e
                h, lane = _turned(h, 11) * a, lane >> np.uint64(8)
        h = (h ^ h >> np.uint64(33)) * b
        h = (h ^ h >> np.uint64(29)) * c
        out[own] = h ^ h >> np.uint64(32)
    for k in order[ends[31] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[first[k] : first[k] + length[k]].tobytes(), 42)
    return out


def text_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_slots`` gives, inside a task: the counters of all texts end to end, and how many each has."""
    lower = [t if t.isascii() else t.decode(errors="replace").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *lower, b" " * 8]).translate(_PLAIN), dtype=np.uint8)
    turn = np.flatnonzero(np.diff(_BLANK[data])) + 1
    first, length = turn[::2], turn[1::2] - turn[::2]
    slots = (word_hashes(data, first, length) & np.uint64(DIMS - 1)).astype(np.uint16)
    return slots, np.diff(np.searchsorted(first, np.cumsum([len(t) + 1 for t in lower])), prepend=0)


def worded(texts: DataFrame) -> DataFrame:
    """The counters of the words of each text that is not null: ``slots``, 16 bits for each."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                slots, lengths = text_slots(texts_as_bytes(batch.column(0)[start : start + 512]))
                found = [s.tobytes() for s in np.split(slots, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["slots"])

    return texts.where("text is not null").select("text").mapInArrow(run, "slots binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a batch of ``worded`` end to end, and how many each text has."""
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), dtype=np.uint16), np.array([len(x) // 2 for x in found], dtype=np.int64)


def _rarity(slots: DataFrame, rows: int) -> np.ndarray:
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DIMS, dtype=np.int64)
        for batch in stream:
            flat, lengths = _flat(batch.column(0))
            key = np.repeat(np.arange(len(lengths)) * DIMS, lengths) + flat
            key.sort()
            held += np.bincount(key[np.diff(key, prepend=-1) > 0] % DIMS, minlength=DIMS)
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], ["slot", "n"])

    counted = _few(slots).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(DIMS)
    held[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return np.log((1 + rows) / (1 + held)).clip(0.05)


def rarity(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each counter, over all documents."""
    return _rarity(worded(docs), docs.count())


def _few(slots: DataFrame) -> DataFrame:
    """All rows in no more tasks than run at a time: each sends up to one row a counter, so
    that what is shuffled does not grow with the files."""
    return slots.coalesce(max(1, slots.sparkSession.sparkContext.defaultParallelism))


def _summed(rows: np.ndarray, at: np.ndarray, key: np.ndarray, total: np.ndarray) -> None:
    """Adds ``rows[at]`` to ``total[key]``; ``key`` is sorted. The last of ``rows`` is zero.

    Rows of one key are added in groups of eight, the sums again, until each key has one.
    """
    while True:
        first = np.flatnonzero(np.diff(key, prepend=-1))
        own, held = key[first], np.diff(first, append=len(key))
        if held.max(initial=0) <= 1:
            total[own] += rows[at]
            return
        groups = -(-held // 8)
        place = np.arange(len(key)) + np.repeat((np.cumsum(groups) - groups) * 8 - first, held)
        padded = np.full(int(groups.sum()) * 8, len(rows) - 1, dtype=np.int64)
        padded[place] = at
        padded, ones = padded.reshape(-1, 8), np.ones((1, 8), dtype=np.float32)
        sums = np.zeros((len(padded) + 1, rows.shape[1]), dtype=np.float32)
        for start in range(0, len(padded), 1024):
            part = padded[start : start + 1024]
            sums[start : start + len(part)] = np.matmul(ones, rows.take(part, axis=0))[:, 0]
        rows, at, key = sums, np.arange(len(padded)), np.repeat(own, groups)


def _sketch(get, idf: np.ndarray):
    """One step of the power method for a partition: the rows of A^T A W that its passages touch.

    Counters are renamed by falling idf, so that those of frequent words are the last.
    """
    by_idf = np.argsort(-idf, kind="stable")
    renamed = np.append(np.empty(DIMS, dtype=np.uint16), np.uint16(DIMS))  # the last fills the last passage of a text
    renamed[by_idf] = np.arange(DIMS, dtype=np.uint16)
    idf = np.append(idf[by_idf], 0.0)
    rare = DIMS - FREQUENT

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = get()[by_idf]
        width = basis.shape[1]
        weighted = np.zeros((DIMS + 1, width), dtype=np.float32)
        weighted[:rare] = basis[:rare] * idf[:rare, None]
        dense = np.ascontiguousarray(basis[rare:])
        total = np.zeros((DIMS, width))

        def add(passages: np.ndarray) -> None:
            """A passage's row of A has for each counter its words times the idf, over the norm."""
            passages = np.sort(passages, axis=1)
            few = np.count_nonzero(passages < rare, axis=1)
            by_few = np.argsort(few)
            passages, few = passages[by_few], few[by_few]
            flat = passages.reshape(-1)
            first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (np.arange(1, len(flat)) % PASSAGE == 0)))
            at, slot = first // PASSAGE, flat[first]
            weight = np.diff(first, append=len(flat)) * idf[slot]
            scale = (1 / np.bincount(at, weight * weight, len(passages))).astype(np.float32)
            often = np.flatnonzero((slot >= rare) & (slot < DIMS))
            held = np.zeros((len(passages), FREQUENT), dtype=np.float32)
            held[at[often], slot[often] - rare] = weight[often]
            image = np.zeros((len(passages) + 1, width), dtype=np.float32)
            np.matmul(held, dense, out=image[:-1])
            for start in range(0, len(passages), 256):
                part = passages[start : start + 256, : few[start : start + 256].max()]
                image[start : start + len(part)] += np.matmul(np.ones((1, part.shape[1]), dtype=np.float32), weighted.take(part, axis=0))[:, 0]
            image[:-1] *= scale[:, None]
            total[rare:] += held.T @ image[:-1]
            own = np.flatnonzero(flat < rare)
            own = own[np.argsort(flat[own], kind="stable")]
            _summed(image, own // PASSAGE, flat[own].astype(np.int64), total)

        for batch in stream:
            flat, lengths = _flat(batch.column(0))
            parts = -(-lengths // PASSAGE)
            ahead = (np.cumsum(parts) - parts) * PASSAGE - (np.cumsum(lengths) - lengths)
            filled = np.full(int(parts.sum()) * PASSAGE, DIMS, dtype=np.uint16)
            filled[np.arange(len(flat)) + np.repeat(ahead, lengths)] = renamed[flat]
            filled = filled.reshape(-1, PASSAGE)
            for start in range(0, len(filled), TOGETHER):
                add(filled[start : start + TOGETHER])
        total[:rare] *= idf[:rare, None]
        total = total[renamed[:DIMS]]
        touched = np.flatnonzero(total.any(axis=1))
        for start in range(0, len(touched), 4096):
            own = touched[start : start + 4096]
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total[own].astype(np.float32).reshape(-1)), width).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(own), rows], ["slot", "v"])

    return run


def latent_space(docs: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The vector of each counter in the latent space, times its idf.

    A randomised SVD of the TF-IDF matrix of passages: a random block is multiplied by
    A^T A in three passes over the passages, made orthonormal in between, and the small
    remaining problem is solved on the driver. Each dimension is divided by its singular
    value: else the few that tell languages and frequent words apart would make all
    passages of a language alike. The passages are those of all documents and all items;
    the products are summed by Spark. What a task holds, and what comes to the driver, has
    a fixed size.
    """
    return _space(stored(worded(docs).union(worded(items))), idf)


def _space(slots: DataFrame, idf: np.ndarray) -> np.ndarray:
    spark, texts, width = slots.sparkSession, _few(slots), RANK + EXTRA
    basis = np.random.default_rng(SEED).standard_normal((DIMS, width))
    for last in (False, False, True):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        product = texts.mapInArrow(_sketch(shared_value(spark, basis), idf), "slot bigint, v array<float>")
        summed = product.groupBy("slot").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width))).toArrow()
        # The driver holds the sums, the image and the basis, and no further copy.
        image, slot = np.zeros((DIMS, width)), summed["slot"].to_numpy()
        for i in range(width):
            image[slot, i] = summed[f"v{i}"].to_numpy()
        del summed, slot
        if last:
            values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            top = np.argsort(-values)[:RANK]
            basis = basis @ turn[:, top] / np.sqrt(np.maximum(values[top], 1e-9))
        else:
            image += 1e-12 * basis
            basis = image
            del image
    return (basis * idf[:, None]).astype(np.float32)


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        if here := places.get(word):
            both = row & here
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _tail(length: int) -> int:
    """Words of an item's last third, where its answer stands."""
    return max(4, length // 3)


@dataclass
class Hit:
    item: int
    cosine: float
    common: float
    answer: float
    start: int


class Retriever:
    """Searches texts for a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[bytes], slots: list[list[int]], space: np.ndarray, cosine: float = COSINE) -> None:
        kept = [k for k, found in enumerate(slots) if found]
        self.cosine = cosine
        self.space = np.vstack([space, np.zeros((1, space.shape[1]), dtype=np.float32)])  # the last row pads
        self.ids, self.words = [ids[k] for k in kept], [plain_words(texts[k]) for k in kept]
        vectors = np.array([space[slots[k]].sum(axis=0, dtype=np.float64) for k in kept]).reshape(len(kept), space.shape[1])
        self.unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.bits = [self._bits(np.array(slots[k])) for k in kept]
        lengths = np.array([max(1.0, len(w) / HOP) for w in self.words])
        blocks = np.array([round(1.5 ** round(math.log(n, 1.5))) for n in lengths], dtype=np.int64)
        self.classes = [(int(n), np.flatnonzero(blocks == n)) for n in np.unique(blocks)]
        self.widest = int(blocks.max()) * HOP if len(blocks) else 0

    @staticmethod
    def _bits(slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
        """The different counters of an item, the places of each as bits, 64 places at a time,
        and the bits of the last third."""
        own, which = np.unique(slots, return_inverse=True)
        places, tails = [], []
        for start in range(0, len(slots), 64):
            here = np.arange(start, min(start + 64, len(slots)))
            bit = np.uint64(1) << (here - start).astype(np.uint64)
            places.append(np.zeros(len(own), dtype=np.uint64))
            np.bitwise_or.at(places[-1], which[here], bit)
            tails.append(np.bitwise_or.reduce(bit[here >= len(slots) - _tail(len(slots))], initial=np.uint64(0)))
        return own, places, tails

    def _possible(self, item: int, regions: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Whether each region has as many of the item's words, in any order, as a leak must have in order.

        ``regions`` has a row of counters for each; ``table`` is zero, and left so.
        """
        own, places, tails = self.bits[item]
        found, tail = np.zeros(len(regions), dtype=np.int64), np.zeros(len(regions), dtype=np.int64)
        for bits, last in zip(places, tails):
            table[own] = bits
            held = np.bitwise_or.reduce(table[regions], axis=1)
            found += np.bitwise_count(held)
            tail += np.bitwise_count(held & last)
        table[own] = 0
        length = len(self.words[item])
        return (found / length >= COMMON) | ((found / length >= LOOSE) & (tail / min(length, _tail(length)) >= ANSWER))

    def candidates(self, held: np.ndarray, at: int, stop: int) -> Iterator[tuple[int, int, int, float]]:
        """Windows of ``held[at:stop]`` near an item in the latent space: start, width, item, cosine.

        Windows are made of blocks of ``HOP`` words. Each item is compared with windows
        of about its length, a quarter of it apart. Of those near enough, the window, widened
        as for the check, must have the words that the rule of ``search`` asks for: hash
        collisions let more through, but no leak is dropped.
        """
        slots, none = held[at:stop], len(self.space) - 1
        table = np.zeros(none + 1, dtype=np.uint64)
        count, longest = -(-len(slots) // HOP), self.widest // HOP
        # Blocks, then sums of 2, 4, 8 ... of them; zeros behind stand for what a window lacks.
        padded = np.full((count + longest) * HOP, none, dtype=np.int64)
        padded[: len(slots)] = slots
        padded, ones = padded.reshape(-1, HOP), np.ones((1, HOP), dtype=np.float32)
        sums = [np.empty((len(padded), self.space.shape[1]), dtype=np.float32)]
        for start in range(0, len(padded), 2048):
            sums[0][start : start + 2048] = np.matmul(ones, self.space.take(padded[start : start + 2048], axis=0))[:, 0]
        while 2 << (len(sums) - 1) <= longest:
            half = 1 << (len(sums) - 1)
            sums.append(sums[-1][:-half] + sums[-1][half:])
        # The words around, as far as a window may be widened.
        margin = longest * HOP
        around = np.full(margin + count * HOP + 2 * margin, none, dtype=np.int64)
        low, high = max(0, at - margin), min(len(held), at + count * HOP + 2 * margin)
        around[low - at + margin : high - at + margin] = held[low:high]
        for width, items in self.classes:
            step = max(1, width // 4)
            start = np.arange(0, max(1, count - width + 1), step)
            regular = len(start)
            if start[-1] < count - width:
                start = np.append(start, count - width)
            unit, least, near = self.unit[items], np.empty(len(start), dtype=np.float32), []
            for low in range(0, len(start), 2048):  # as many windows as the cache holds
                here = start[low : low + 2048]
                evenly = len(here) - (low + len(here) > regular)
                window, done = np.zeros((len(here), self.space.shape[1]), dtype=np.float32), 0
                for k in range(width.bit_length()):
                    if width >> k & 1:
                        first = int(here[0]) + done
                        window[:evenly] += sums[k][first : first + evenly * step : step][:evenly]
                        window[evenly:] += sums[k][here[evenly:] + done]
                        done += 1 << k
                own = self.cosine * np.sqrt(np.einsum("ij,ij->i", window, window))
                floor = np.maximum(own, 1e-9)
                least[low : low + len(here)] = own
                for block in range(0, len(items), 256):
                    dots = (unit[block : block + 256] @ window.T).reshape(-1)
                    found = np.flatnonzero((dots.reshape(-1, len(here)) >= floor).reshape(-1))
                    j, i = np.divmod(found, len(here))
                    near.append((j + block, i + low, dots[found]))
            j, i, dots = (np.concatenate(parts) for parts in zip(*near))
            by_item = np.argsort(j, kind="stable")
            ends = np.searchsorted(j[by_item], np.arange(len(items) + 1)).tolist()
            half = width * HOP // 2
            regions = np.lib.stride_tricks.sliding_window_view(around, width * HOP + 2 * half)
            for b, item in enumerate(items.tolist()):
                own = by_item[ends[b] : ends[b + 1]]
                if not len(own):
                    continue
                own = own[self._possible(item, regions[start[i[own]] * HOP + margin - half], table)]
                a = i[own]
                for first, cosine in zip((start[a] * HOP).tolist(), (dots[own] / least[a] * self.cosine).tolist()):
                    yield first, width * HOP, item, cosine

    def _judged(self, item: int, region: list[bytes]) -> tuple[float, float]:
        own = self.words[item]
        tail = own[-_tail(len(own)) :]
        return common_words(own, region) / len(own), common_words(tail, region) / len(tail)

    def search(self, texts: pa.Array, slots: pa.Array, span: int = 1 << 17) -> list[list[Hit]]:
        """The items found in each whole text.

        Texts are laid end to end and cut into overlapping spans, so that memory is
        bounded. A candidate is checked in every text that its window touches: a leak has
        ``COMMON`` of the item's words in order, or ``LOOSE`` of them and ``ANSWER`` of its
        last third, where the answer stands.
        """
        best: dict[tuple[int, int], Hit] = {}
        tried: set[tuple[int, int, int]] = set()
        held = slots.flatten().to_numpy()
        bounds = np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))
        words: tuple[int, list[bytes]] = (-1, [])
        for at in range(0, len(held) if self.ids else 0, span):
            found = self.candidates(held, at, at + span + 2 * self.widest)
            for start, width, item, cosine in sorted(found):
                low, high = at + start, at + start + width
                for k in range(int(np.searchsorted(bounds, low, "right")), len(bounds)):
                    first = int(bounds[k - 1]) if k else 0
                    if first >= high:
                        break
                    if bounds[k] == first or (k, item, low) in tried or (k, item) in best and best[k, item].common == 1.0:
                        continue
                    tried.add((k, item, low))
                    if words[0] != k:
                        words = (k, plain_words(texts[k].as_py().encode()))
                    begin = max(0, low - first - width // 2)
                    common, answer = self._judged(item, words[1][begin : high - first + width // 2])
                    if common >= COMMON or (common >= LOOSE and answer >= ANSWER):
                        old = best.get((k, item))
                        if old is None or common > old.common:
                            best[k, item] = Hit(item, cosine, common, answer, begin)
        out: list[list[Hit]] = [[] for _ in range(len(texts))]
        for (k, _), hit in best.items():
            out[k].append(hit)
        return out


_HIT = "struct<item_id:bigint,cosine:double,common:double,answer:double,near_word:bigint>"


def leaks(text: Column, get) -> Column:
    """For each text the benchmark items found in it, as an array of structs."""

    @F.arrow_udf(f"array<{_HIT}>")
    def of(texts: pa.Array) -> pa.Array:
        retriever, out = get(), []
        for start in range(0, len(texts), 512):
            some = texts[start : start + 512]
            found, lengths = text_slots(texts_as_bytes(some))
            slots = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths))), pa.array(found))
            for hits in retriever.search(some, slots):
                hits.sort(key=lambda h: retriever.ids[h.item])
                out.append(
                    [{"item_id": retriever.ids[h.item], "cosine": round(h.cosine, 3), "common": h.common, "answer": h.answer, "near_word": h.start} for h in hits]
                )
        item = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64()), ("near_word", pa.int64())])
        return pa.array(out, pa.list_(item))

    return of(text)


def with_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str = "leaks") -> DataFrame:
    """``docs`` with the array column ``name`` of the benchmark items in each text.

    The idf is counted over all documents, the latent space learned by ``latent_space``,
    and the items are searched in blocks of at most ``BLOCK``, which each task holds. Null
    and blank texts hold none. Null and repeated ids keep their rows. Items that are null
    or blank are never found; equal items are all found. A clashing column is an error.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has {name}")
    spark = docs.sparkSession
    own = picked(docs, doc_id=id_col, text=text_col)
    asked = picked(items, item_id=item_col, text=item_text_col).where("text is not null")
    asked = asked.withColumn("h", F.xxhash64("item_id", "text"))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    slots = stored(worded(own))
    idf = _rarity(slots, own.count())
    space = _space(slots.union(worded(asked)), idf)
    columns = []
    for block in range(blocks):
        got = asked.where(F.pmod("h", F.lit(blocks)) == block).orderBy("item_id", "text")
        got = got.select("item_id", "text").collect()
        texts = [r.text.encode() for r in got]
        found, lengths = text_slots(texts)
        parts = [s.tolist() for s in np.split(found, np.cumsum(lengths)[:-1])] if texts else []
        retriever = Retriever([r.item_id for r in got], texts, parts, space)
        columns.append(leaks(quoted(text_col), shared_value(spark, retriever)))
    return docs.withColumn(name, F.concat(*columns) if blocks > 1 else columns[0])


@register("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leak: the document, the item, and how it was confirmed."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return with_leaks(docs, items).select("doc_id", F.explode_outer("leaks").alias("l")).where("l is not null").select("doc_id", "l.*")
