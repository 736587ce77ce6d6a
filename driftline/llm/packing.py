"""Packing of token sequences by bin completion.

Documents are encoded; those longer than a sequence are cut into pieces of its length, the first piece taking what is
left over. As few sequences as possible then hold all pieces.

* *Sizes.* What a packing has to know is how many pieces there are of each size: ``capacity`` numbers, whatever the number
  of documents. A task numbers its pieces of each size, and one aggregation gives the counts and where each task's
  numbers begin.
* *Search.* Bin completion takes the largest size that is left and lists the undominated fillings of the room around it (no
  piece or pair in it can be exchanged for a larger piece that is left), the fullest first. A filling is used as often as
  the counts allow, so the depth of the search follows the number of sizes. The best-fit decreasing packing of what
  is left is the incumbent of every node; a branch ends where the waste so far and the waste that the rest can't avoid exceed
  what a better packing could have. The first branches of the root are searched by separate tasks; the best result counts. ``nodes`` bounds
  the work of each; an exhausted bound costs sequences, never pieces, and a packing with as many sequences as the lower bound ends the
  search at once.
* *Places.* The result is a table of patterns: which sizes, how often. The i-th piece of a size finds its pattern, copy and
  slot by arithmetic, so the table (at most a few rows per size) goes to the pieces and no group of pieces is ever gathered.

Defined cases: null is the empty text, whose only token is the end id; rows that repeat an id are separate documents
with pieces of the same numbers; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.known_pieces import KnownPieces
from driftline.llm.texts import padded, pieces, text_bytes
from driftline.session import join_small, materialise

CAPACITY = 1024
BRANCHES = 6
NODES = 2_000
_FILLINGS = 24  # tried at one node
_STEPS = 600  # of one enumeration
_INCUMBENT = 50  # nodes of so many levels complete their packing by best fit
#: The splitter that cutting before white space and punctuation relies on.
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SHIFT = 48  # a size and the number of a piece of that size are one number
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORDLY = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 124 for c in range(256)])
_UNSURE = np.zeros(256, bool)  # bytes that may end a white-space character
_UNSURE[[28, 29, 30, 31, *range(128, 192)]] = True


class ByteIds(KnownPieces):
    """Token ids of whole texts by way of runs that the splitter never joins.

    Its pieces are a word, a number or a run of other characters with at most one blank before, or white space. So a piece
    always ends where a character that isn't white space is followed by ASCII white space, and where an ASCII
    letter or digit is followed by punctuation. ``|`` is left out, as special tokens have one behind a letter. What looks
    like the end of a white-space character beyond ASCII is left uncut. Another splitter gets whole texts.
    """

    def __init__(self, path: str):
        super().__init__(path)
        made = json.loads(self.tokenizer.to_str())
        special = made["added_tokens"]
        plain = all(t["content"].startswith("<|") and t["content"].endswith("|>") and t["content"][2:-2].isalnum() and t["content"].isascii()
                    and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in special)
        self.by_run = plain and made["normalizer"] is None and made["pre_tokenizer"] == _SPLITTER
        if self.by_run:
            self.join_by(made["added_tokens"])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and their counts."""
        data, at = text_bytes(column)
        if not self.by_run or not len(data):
            return self.joined(self.entries(data, padded(data), at[:-1], at[1:]), np.arange(len(at)), end)
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        unsure = _UNSURE[data[:-1]]
        # A byte of 128 to 191 ends a white-space character only after certain lead bytes.
        lead = data == 0xC2
        long_lead = (data >= 0xE1) & (data <= 0xE3)
        spacelike = np.zeros(len(data) - 1, bool)
        spacelike[1:] |= lead[:-2]
        spacelike[2:] |= long_lead[:-3]
        spacelike |= (data[:-1] >= 28) & (data[:-1] < 32)
        cut[1:] = (space[1:] & ~space[:-1] & ~(unsure & spacelike)) | (_PUNCTUATION[data[1:]] & _WORDLY[data[:-1]])
        full = np.flatnonzero(np.diff(at) > 0)
        cut[at[full]] = True
        start = np.flatnonzero(cut)
        bounds = np.searchsorted(start, at)
        return self.joined(self.entries(data, padded(data), start, np.append(start[1:], len(data))), bounds, end)


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (32-bit, little-endian) of every piece, written.

    ``part`` is the task that made it and ``nth`` its number among the task's pieces of its length.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = ByteIds.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in pieces(batches, "t"):
            ids, count = coder.encode(b.column(1), end)
            made = -(-count // capacity)
            doc = np.repeat(np.arange(len(count)), made)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
            first = count - (made - 1) * capacity
            length = np.where(number == 0, first[doc], capacity)
            start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
            order = np.argsort(length, kind="stable")
            new = np.append(True, length[order][1:] != length[order][:-1])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            at = np.append(0, np.cumsum(length)) * 4
            held = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                 held.cast(pa.binary()), pa.array(np.full(len(length), part, np.int32)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return materialise(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long"), "pieces")


# --- The search: counts per size in, patterns out. ---

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, and the sizes of each with their numbers


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each sequence takes, again and again, the largest piece that fits."""
    left, out = counts.copy(), []
    size = capacity
    while size:
        if not left[size]:
            below = np.flatnonzero(left[:size])
            size = int(below[-1]) if len(below) else 0
            continue
        filling, room, s = {size: 1}, capacity - size, size
        left[size] -= 1
        while room:
            fits = np.flatnonzero(left[:min(s, room) + 1])
            if not len(fits):
                break
            s = int(fits[-1])
            take = min(room // s, int(left[s]))
            filling[s] = filling.get(s, 0) + take
            left[s] -= take
            room -= take * s
        times = 1 + min(int(left[s]) // k for s, k in filling.items())
        for s, k in filling.items():
            left[s] -= k * (times - 1)
        out.append((times, tuple(filling.items())))
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: the bound of sums, and for each k that of pieces that can't share a sequence.

    Pieces above capacity - k stand alone, those above half are apart, and the rest from k on only fills the room of the latter.
    """
    number, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * np.arange(capacity + 1)))
    half = capacity // 2
    k = np.arange(1, half + 1)
    apart = number[capacity - k + 1] - number[half + 1]
    room = apart * capacity - (total[capacity - k + 1] - total[half + 1])
    rest = np.maximum(0, total[half + 1] - total[k] - room)
    fewest = number[-1] - number[capacity - k + 1] + apart - (-rest // capacity)
    return int(max(-(-total[-1] // capacity), fewest.max(initial=0)))


def fillings(left: np.ndarray, size: int, capacity: int, most: int = _FILLINGS) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings of the room beside one piece of ``size``, the fullest first, larger pieces first among equals."""
    room = capacity - size
    have = [int(s) for s in np.flatnonzero(left[:min(room, size) + 1])[::-1]]
    held = {s: int(left[s]) - (s == size) for s in have}
    have = [s for s in have if held[s] > 0]
    fits = np.searchsorted(-np.array(have, np.int64), -np.arange(room + 1)).tolist()  # the first place whose size fits a room
    found: dict[tuple, int] = {}
    full = 0
    stack = [(0, room, ())]
    for _ in range(_STEPS):
        if not stack or full == most:
            break
        i, space, taken = stack.pop()
        i = max(i, fits[space])
        if i == len(have):
            if taken not in found:
                found[taken] = space
                full += not space
            continue
        s = have[i]
        # The next smaller size comes last, more of this one first.
        stack.append((i + 1, space, taken))
        for k in range(1, min(space // s, held[s]) + 1):
            stack.append((i + 1, space - k * s, taken + ((s, k),)))
    if not found:
        found[()] = room
    present = set(have)

    def dominated(taken: tuple, space: int) -> bool:
        used = dict(taken)
        free = [s for s in have if held[s] > used.get(s, 0)]
        parts = [s for s, _ in taken]
        for s in parts:  # one piece for a larger one
            if any(s < t <= s + space for t in free):
                return True
        for a, s in enumerate(parts):  # two pieces for one of at least their size
            for t in parts[a:]:
                if (s != t or used[s] > 1) and any(s + t <= u <= s + t + space for u in free if u in present):
                    return True
        return False

    every = sorted(found.items(), key=lambda x: (x[1], [(-s, -k) for s, k in x[0]]))
    kept = []
    for taken, space in every:
        if len(kept) == most:
            break
        if not dominated(taken, space):
            kept.append(taken)
    return kept or [every[0][0]]


def complete(counts: np.ndarray, capacity: int, branch: int = 0, nodes: int = NODES) -> list[Pattern]:
    """The best packing found by bin completion below filling number ``branch`` of the first node that has a choice.

    Best fit where there is no such filling.
    """
    best = best_fit(counts, capacity)
    fewest = sum(t for t, _ in best)
    floor = lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    # A node: what is left, the patterns so far, sequences and waste of these. The stack holds the next branches, the best on top.
    stack = [(counts.copy(), (), 0, 0, 0, branch)]
    while stack and fewest > floor and nodes > 0:
        left, path, used, waste, depth, only = stack.pop()
        nodes -= 1
        sizes = np.flatnonzero(left)
        if not len(sizes):
            if used < fewest:
                best, fewest = _unrolled(path), used
            continue
        if waste > (fewest - 1) * capacity - total or used + lower_bound(left, capacity) >= fewest:
            continue
        if only is None and depth % _INCUMBENT == 0:
            rest = best_fit(left, capacity)
            if used + sum(t for t, _ in rest) < fewest:
                best, fewest = _unrolled(path) + rest, used + sum(t for t, _ in rest)
        size = int(sizes[-1])
        choices = fillings(left, size, capacity)
        if only is not None and (len(choices) > 1 or only):
            choices, only = (choices[only:only + 1], None) if len(choices) > 1 else (choices, only)
        for taken in reversed(choices):
            filling = dict(taken)
            filling[size] = filling.get(size, 0) + 1
            times = min(int(left[s]) // k for s, k in filling.items())
            now = left.copy()
            for s, k in filling.items():
                now[s] -= k * times
            free = capacity - sum(s * k for s, k in filling.items())
            stack.append((now, (path, (times, tuple(filling.items()))), used + times, waste + free * times, depth + 1, only))
    return best


def _unrolled(path: tuple) -> list[Pattern]:
    out = []
    while path:
        path, last = path
        out.append(last)
    return out[::-1]


def plan(spark: SparkSession, counts: np.ndarray, capacity: int, branches: int = BRANCHES, nodes: int = NODES) -> list[Pattern]:
    """The packing with the fewest sequences of all branches' searches, each in a task of its own."""
    first = best_fit(counts, capacity)
    if sum(t for t, _ in first) <= lower_bound(counts, capacity):
        return first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for branch in b.column(0).to_pylist():
                found = complete(counts, capacity, branch, nodes)
                yield pa.RecordBatch.from_pydict({"branch": [branch], "n": [sum(t for t, _ in found)], "patterns": [json.dumps(found)]})

    tried = spark.range(branches, numPartitions=branches).mapInArrow(run, "branch long, n long, patterns string")
    best = tried.orderBy("n", "branch").first()
    return [(t, tuple((s, k) for s, k in taken)) for t, taken in json.loads(best.patterns)]


def _rows(patterns: list[Pattern], capacity: int) -> list[tuple]:
    """One row per size of each pattern: which pieces of the size it takes, its first sequence, number per sequence and offset."""
    used, sequence, out = np.zeros(capacity + 1, np.int64), 0, []
    for times, taken in patterns:
        offset = 0
        for size, k in taken:
            out.append((size, int(used[size]), sequence, k, offset))
            used[size] += k * times
            offset += size * k
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
         branches: int = BRANCHES, nodes: int = NODES) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id`` and ``offset`` of every piece of ``docs``."""
    made = cut_pieces(docs, tokenizer, end, capacity, doc_id, text)
    spark = docs.sparkSession
    per_task = materialise(made.groupBy("part", "length").agg(F.count("*").alias("held")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("held").alias("held")).collect():  # a row per size
        counts[row.length] = row.held
    rows = _rows(plan(spark, counts, capacity, branches, nodes), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(per_task.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")), "places")
    placed = join_small(made, base, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")), "inner")
    nth = F.col("base") + F.col("nth")
    found = _looked_up(spark, rows)(F.col("length"), nth)
    placed = placed.withColumn("at", found).withColumn("i", nth - F.col("at.first"))
    return placed.select("doc_id", "piece", "start", "length", "ids",
                         (F.col("at.sequence") + F.floor(F.col("i") / F.col("at.k"))).alias("sequence_id"),
                         (F.col("at.offset") + F.col("i") % F.col("at.k") * F.col("length")).alias("offset"))


def _looked_up(spark: SparkSession, rows: list[tuple]):
    """The pattern row of the ``nth`` piece of a length, found in arrays that all tasks get."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0] << _SHIFT | table[:, 1], table[:, 1:]))

    @F.pandas_udf("first long, sequence long, k long, offset long")
    def find(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        begins, values = shared.value
        at = np.searchsorted(begins, length.to_numpy() << _SHIFT | nth.to_numpy(), "right") - 1
        return pd.DataFrame(values[at], columns=["first", "sequence", "k", "offset"])

    return find
