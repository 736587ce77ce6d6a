"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

A benchmark item of n words is looked for in windows of about n words: window lengths form a ladder whose steps
grow by ``_STEP``, a window starts at every seventh of its length (and at both ends of a text), and an item is
compared with the lengths near its own. A window's 64-bit SimHash is taken over its word bigrams, from running sums,
so its cost does not depend on its length.

Fingerprints are matched by a multi-index of four 16-bit blocks: of two fingerprints within ``RADIUS`` = 15 bits one
block differs in at most 3 bits, so the index holds, block by block, every value within 3 bits of an item's, and no
fingerprint within the radius is missed. Hits are then verified exactly: the best window of the item's
own length near the hit is compared with the item by Jaccard over 5-word shingles (with repeats), plain and weighted: a shingle
that several distinct item texts have weighs less, by their number. From 0.75 on in either it is a leak, and the larger
one is the similarity. Weights are counted once over all items, so no result depends on the passes.

The items are the stated query set. They are indexed in passes of a bounded number, each broadcast and run over all
documents, so the index never outgrows a task; besides it a task holds 16 bytes for each shingle that several texts have. Documents are read in place; only leaks are shuffled.

An item with fewer than five words is its one shingle: it is found where its words stand one after the other.

Defined cases: null or empty texts have no leaks; items without words are in no text; items with equal texts are each reported; rows that repeat an id are searched one by one and
``find_leaks`` reports the best window of the id; empty tables give no leaks; other columns are ignored by
``find_leaks`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from driftline.llm.texts import Words, give_back, mix, pieces, shingles, spread, text_bytes

RADIUS = 15
SIMILARITY = 0.75
ITEMS_PER_PASS = 2_000
_STEP, _NEAR, _STRIDE = 1.22, 1.23, 7
_SLICE = 60_000
_SHINGLE = 5


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next."""
    return mix(h[:-1] + mix(h[1:] + np.uint64(1)))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out + mix(h[k:len(h) - n + 1 + k] + np.uint64(k + 1)))
    return out


def _running(pair: np.ndarray) -> np.ndarray:
    """Running counts of each bit over the pairs; differences are right modulo 2^16."""
    bits = np.unpackbits(pair.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(pair) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=out[1:])
    return out


def _fingerprints(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the words ``start`` to ``end`` (exclusive), which hold ``end - start - 1`` pairs."""
    held = total[end - 1] - total[start]
    bits = held > ((end - start - 1) // 2).astype(np.uint16)[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def ladder(sizes: np.ndarray) -> list[int]:
    out = [int(sizes.min())]
    while out[-1] < sizes.max():
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * _STEP))))
    return out


def _ball() -> np.ndarray:
    """All 16-bit masks with at most 3 bits."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= RADIUS // 4]


class ItemIndex:
    """The items of one pass: their words' shingles, and for each window length the multi-index of those near it."""

    def __init__(self, ids: list, texts: list[str], common: tuple[np.ndarray, np.ndarray]):
        data, at = text_bytes(pa.array(texts, pa.string()))
        words = Words(data, at)
        size = np.diff(words.bounds)
        self.ids = ids
        self.size = size
        found, where = shingles(words, _SHINGLE)
        self.bags = [Counter(found[where[i]:where[i + 1]].tolist()) for i in range(len(ids))]
        self.common = common
        self.weights = [dict(zip(bag, self._weights(list(bag)))) for bag in self.bags]
        own = np.repeat(np.arange(len(ids)), np.diff(where))
        self.members = np.unique(found ^ mix(own.astype(np.uint64) + np.uint64(77)))
        total = _running(_pairs(words.hash))
        self.prints = _fingerprints(total, words.bounds[:-1], words.bounds[1:])
        long = size >= _SHINGLE
        self.lengths, self.blocks = ladder(size[long]) if long.any() else [], []
        self.short = {n: self._by_run(words, np.flatnonzero(size == n), n) for n in np.unique(size[~long]).tolist()}
        ball = _ball()
        for length in self.lengths:
            near = np.flatnonzero(long & (size <= length * _NEAR) & (size * _NEAR >= length))
            parts = []
            for b in range(4):
                value = ((self.prints[near] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint32)
                keys = (value[:, None] ^ ball[None, :]).ravel()
                order = np.argsort(keys, kind="stable")
                parts.append((np.searchsorted(keys[order], np.arange((1 << 16) + 1)).astype(np.int32),
                              np.repeat(near, len(ball))[order].astype(np.int32)))
            self.blocks.append(parts)

    @staticmethod
    def _by_run(words: Words, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the items of ``n`` words, in order, and the items."""
        keys = _runs(words.hash, n)[words.bounds[items]]
        order = np.argsort(keys, kind="stable")
        return keys[order], items[order]

    def _exact(self, words: Words, found: dict) -> None:
        """The first place of each short item that stands in a text word for word."""
        for n, (keys, items) in self.short.items():
            own = _runs(words.hash, n)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for at in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(words.bounds, at, "right")) - 1
                if at + n <= words.bounds[text + 1]:
                    for item in items[low[at]:high[at]].tolist():
                        found.setdefault((text, item), (1.0, at - int(words.bounds[text]), n))

    def _weights(self, keys: list[int]) -> list[float]:
        """1 / number of distinct item texts that have the shingle, 1 where none or one has it."""
        held, weight = self.common
        if not len(held) or not keys:
            return [1.0] * len(keys)
        keys = np.array(keys, np.uint64)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return np.where(held[at] == keys, weight[at], 1.0).tolist()

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of every verified hit in the texts, the best one per text and item."""
        words = Words(*text_bytes(column))
        n, found = len(words.hash), {}
        self._exact(words, found)
        longest = max(self.lengths, default=0)
        for low in range(0, n, _SLICE) if longest else ():
            high = min(n, low + _SLICE + 2 * longest)
            total = _running(_pairs(words.hash[low:high])) if high - low > 1 else None
            if total is None:
                continue
            for length, parts in zip(self.lengths, self.blocks):
                start, end = self._windows(words.bounds, low, min(n, low + _SLICE), length)
                if len(start):
                    prints = _fingerprints(total, start - low, end - low)
                    at, item = self._near(prints, parts)
                    self._verify(words, start[at], end[at], item, length, found)
        return [(t, i, *v) for (t, i), v in found.items()]

    @staticmethod
    def _windows(bounds: np.ndarray, low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that begin between ``low`` and ``high``: a grid, and the first and last of each text."""
        first, last = bounds[:-1], bounds[1:]
        grid = np.arange(low, high, max(1, length // _STRIDE))
        text = np.searchsorted(bounds, grid, "right") - 1
        grid = grid[grid + length <= last[text]]
        full = last - first >= length
        short = ~full & (100 * (last - first) >= 75 * length) & (last - first > 1)
        start = np.concatenate([grid, first[full], last[full] - length, first[short]])
        end = np.concatenate([grid + length, first[full] + length, last[full], last[short]])
        inside = (start >= low) & (start < high)
        return start[inside], end[inside]

    def _near(self, prints: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items whose fingerprints are within the radius."""
        keys = []
        for b, (offset, items) in enumerate(parts):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            count = (offset[value + 1] - offset[value]).astype(np.int64)
            at, item = np.repeat(np.arange(len(prints)), count), items[spread(offset[value].astype(np.int64), count)]
            good = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
            keys.append((at[good].astype(np.int64) << 24) | item[good])
        both = np.unique(np.concatenate(keys))
        return both >> 24, both & 0xFFFFFF

    def _verify(self, words: Words, start, end, item, length: int, found: dict) -> None:
        slack = max(1, length // _STRIDE) + int(length * (_STEP - 1)) + 1
        bounds = words.bounds
        text = np.searchsorted(bounds, start, "right") - 1
        first = np.maximum(start - slack, bounds[text])
        last = np.minimum(end + slack, bounds[text + 1])
        ok = last - first >= _SHINGLE
        first, last, text, item = first[ok], last[ok], text[ok], item[ok]
        count = last - first - _SHINGLE + 1
        at = spread(first, count)
        if not len(at):
            return
        grams = np.unique(at)
        rolled = np.zeros(len(grams), np.uint64)
        for k in range(_SHINGLE):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mix(words.hash[grams + k] + np.uint64(k))
        rolled = mix(rolled)
        keys = rolled[np.searchsorted(grams, at)] ^ mix(np.repeat(item, count).astype(np.uint64) + np.uint64(77))
        place = np.minimum(np.searchsorted(self.members, keys), len(self.members) - 1)
        shared = np.add.reduceat((self.members[place] == keys).astype(np.int64), np.cumsum(count) - count)
        need = 0.5 * np.maximum(self.size[item] - _SHINGLE + 1, 1)
        for j in np.flatnonzero(shared >= need):
            key = (int(text[j]), int(item[j]))
            if found.get(key, (0,))[0] > 1 - 1e-9:
                continue
            own = rolled[np.searchsorted(grams, np.arange(first[j], last[j] - _SHINGLE + 1))].tolist()
            value, where, size = self._best(own, int(item[j]))
            if value >= SIMILARITY - 1e-9 and value > found.get(key, (0,))[0]:
                found[key] = (value, int(first[j] + where - bounds[text[j]]), size)

    def _best(self, own: list[int], item: int) -> tuple[float, int, int]:
        """The most similar window of the item's length among the shingles ``own``, by weighted or plain similarity."""
        bag, size = self.bags[item], int(self.size[item])
        weights, every = self._weights(own), [1.0] * len(own)
        found = self._slide(own, every, bag, float(sum(bag.values())), size)
        if any(w < 1 for w in weights) or any(w < 1 for w in self.weights[item].values()):
            found = max(found, self._slide(own, weights, bag, sum(self.weights[item][k] * c for k, c in bag.items()), size), key=lambda x: x[0])
        return found

    @staticmethod
    def _slide(own: list[int], weights: list[float], bag: Counter, whole: float, size: int) -> tuple[float, int, int]:
        n = min(size - _SHINGLE + 1, len(own))
        held: Counter = Counter()
        total, shared, best = 0.0, 0.0, (-1.0, 0, 0)
        for at, key in enumerate(own):
            w = weights[at]
            shared += w * (held[key] < bag.get(key, 0))
            held[key] += 1
            total += w
            if at >= n:
                old, w = own[at - n], weights[at - n]
                held[old] -= 1
                shared -= w * (held[old] < bag.get(old, 0))
                total -= w
            if at >= n - 1 and shared / (total + whole - shared) > best[0] + 1e-9:
                best = (shared / (total + whole - shared), at - n + 1, n + _SHINGLE - 1)
        return best


def _common(benchmark: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least two distinct item texts have, in order, and their weights; equal words are one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            words = Words(*text_bytes(b.column(0)))
            found, where = shingles(words, _SHINGLE)
            own = [int.from_bytes(blake2b(words.hash[i:j].tobytes(), digest_size=8).digest(), "little", signed=True)
                   for i, j in zip(words.bounds[:-1], words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(own, np.int64), np.diff(where))), pa.array(found.view(np.int64))], ["own", "key"])

    items = benchmark.select(F.col(text).alias("t")).filter(F.col("t").isNotNull())
    held = items.mapInArrow(run, "own long, key long").distinct().groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    keys = held.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], 1.0 / held.column("n").to_numpy()[order]


def _passes(benchmark: DataFrame, item_id: str, text: str, per_pass: int) -> Iterator[tuple[list, list[str]]]:
    """The items, at most about ``per_pass`` at a time."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    items = items.filter(F.col("t").rlike("[^\\x20\\x09-\\x0D]"))
    passes = -(-items.count() // per_pass)
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(passes)) == k).collect()
        if rows:
            yield [r.i for r in rows], [r.t for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``first_word`` (from 0) and ``n_words`` of the best window of each leaking pair."""
    context = docs.sparkSession.sparkContext
    kind = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, " \
           "similarity double, first_word long, n_words long"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    found = docs.sparkSession.createDataFrame([], kind)
    common = context.broadcast(_common(benchmark, item_text))
    for ids, texts in _passes(benchmark, item_id, item_text, per_pass):
        shared = context.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            index = None
            for b in pieces(batches, "t"):
                index = index or ItemIndex(*shared.value, common.value)
                hits = index.leaks(b.column(1))
                if hits:
                    t, i, s, first, n = zip(*hits)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array([index.ids[k] for k in i]), pa.array(s, pa.float64()),
                                                      pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                                                     ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.unionByName(rows.mapInArrow(run, kind))
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    context = docs.sparkSession.sparkContext
    common = context.broadcast(_common(benchmark, item_text))
    for ids, texts in _passes(benchmark, item_id, item_text, per_pass):
        shared = context.broadcast((ids, texts))
        kept: list = []

        @F.arrow_udf(BooleanType())
        def leaks(column: pa.Array) -> pa.Array:
            if not kept:
                give_back()
                kept.append(ItemIndex(*shared.value, common.value))
            out, done = np.zeros(len(column), bool), 0
            for b in pieces(iter([pa.RecordBatch.from_arrays([column.cast(pa.string())], ["t"])]), "t"):
                out[[done + h[0] for h in kept[0].leaks(b.column(0))]] = True
                done += b.num_rows
            return pa.array(out)

        docs = docs.filter(~leaks(F.col(text)))
    return docs
