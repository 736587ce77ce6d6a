"""Similarity join of texts by the Jaccard coefficient of their word n-grams.

Two texts link when their sets of distinct 5-word shingles (letters A-Z in lower case) satisfy
100 * |x & y| >= threshold * |x | y|. All texts that links connect form a component.

* *Order.* Shingles are ordered rare first. One pass counts in how many documents each occurs: tasks send sorted,
  packed hashes, one block per range of the hash, and a range's task merges them. What matters of the result
  fits a sketch of fixed size: the frequency class (the logarithm) of the shingles in four documents or more,
  or, if those are too many, of the most frequent classes that fit. The order is (class in the sketch, hash). It is
  the same for all texts whatever the sketch says, and that is all that prefix filtering asks for: the sketch decides
  how long posting lists get, never which links are found.
* *Prefix.* Texts that link share one of the first n - ceil(t n) + 1 shingles of both. Prefixes are sent packed: a
  range's task finds the posting lists with two nodes or more, and only those become rows. The whole sets of the nodes in
  them are made once more from their texts.
* *Copies.* Texts with equal sets are one node, so exact copies cost nothing beyond the first.
* *Pairs.* A posting list is not opened into all its pairs. In each round every list names a few pivots, and all others
  of the list are compared with them unless both are in one component already. A pivot has then met the whole list
  and leaves it, and lists whose nodes are all in one component are dropped. The number of pivots grows by the round,
  so lists end after a few rounds and every pair is either compared or known to be connected. Entries of a list carry the
  size and the bitmap of their node, so that the join of lists and pivots itself drops what the length filter, the positional
  filter (what can still be shared behind the match) or the bitmap filter rules out: a bit is the parity of the shingles
  of one of 512 hash classes, and two sets differ in a shingle at least for each bit in which their bitmaps differ.
  Each pair that is left is verified once in a round on the whole sets.
* *Components.* The links of a round connect components; labels spread by minima and by jumps until nothing changes.

Shingles are 64-bit hashes of words; two different shingles of one text, or of two compared ones, agree by chance about
once in 10^19 / (words squared). A node is a 64-bit hash of a whole set and its size: among 10^9 different texts two
agree with a chance of 3 in 100.

Defined cases: null texts and texts without words have an empty set, no links and are components of their
own; with fewer than five words the whole sequence is the one shingle; rows that repeat an id are judged row by row,
and a component is named by the smallest id in it; equal texts are linked; an empty table gives an empty result;
columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.texts import Words, give_back, mix, pieces, shingles, text_bytes
from driftline.session import BROADCAST_ROWS_CONF, DEFAULT_BROADCAST_ROWS, arrow_batches, join_small, materialise

THRESHOLD = 75
SKETCH_BITS = 24
SKETCH_KEYS = 1 << (SKETCH_BITS - 2)
#: Shingles of fewer documents than 2 to this power are rare alike, at every size of the input.
LEAST_CLASS = 2
#: Rows of texts that go to Python at once.
BATCH_ROWS = 1_000
#: Bytes that go to Python at once: the packed rows take tens of kilobytes each.
BATCH_BYTES = 4 * 1024 * 1024
_PROBES = 3
#: The columns of a set's bitmap, 64 bits each.
BITMAP = [f"bits{i}" for i in range(8)]
_KEY_BYTES = 6


def text_sets(batch_column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found, at = shingles(Words(*text_bytes(batch_column)), size)
    out = []
    for i in range(len(at) - 1):
        s = np.sort(found[at[i]:at[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def needed(n: int, threshold: int) -> int:
    """The least number of shared shingles of a text with ``n``: ceil(threshold * n / 100)."""
    return -(-threshold * n // 100)


def _bucket_bits(spark: SparkSession) -> int:
    """Ranges of the hash: a few per shuffle partition."""
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, 64) - 1, 1 << 16).bit_length()


def _pack(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first 48 bits behind a bucket's own, as bytes."""
    return ((keys << np.uint64(bits)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]


def _unpack(parts: list[bytes]) -> np.ndarray:
    raw = np.zeros((sum(map(len, parts)) // _KEY_BYTES, 8), np.uint8)
    raw[:, :_KEY_BYTES] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _KEY_BYTES)
    return raw.reshape(-1).view(np.uint64)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array changes."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The rows of each bucket, from batches sorted by it (the first column)."""
    now, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def frequencies(docs: DataFrame, size: int) -> DataFrame:
    """``bucket``, ``keys`` (packed 64-bit), ``classes`` (packed bytes): the shingles in two documents or more.

    A task adds up what it holds before it sends, so that a frequent shingle goes out once per block. Class c
    holds the counts from 2^c on.
    """
    bits = _bucket_bits(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, n = [], 0

        def send():
            keys = np.concatenate(held)
            keys.sort()
            first = _firsts(keys)
            count = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            packed, rows = _pack(keys, bits), []
            for i in np.flatnonzero(np.diff(cut)):
                k, c = packed[cut[i]:cut[i + 1]], count[cut[i]:cut[i + 1]]
                rows.append((i, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()))
            at, once, more, counts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary()),
                                               pa.array(counts, pa.binary())], ["bucket", "once", "more", "counts"])

        for b in pieces(batches, "t"):
            for s in text_sets(b.column(0), size):
                held.append(s)
                n += len(s)
            if n > 500_000:
                yield send()
                held, n = [], 0
        if n:
            yield send()
        del held
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            _, once, more, counts = zip(*rows)
            keys = np.concatenate([_unpack(list(once)), _unpack(list(more))])
            count = np.ones(len(keys), np.int64)
            repeated = np.frombuffer(b"".join(counts), np.uint32)
            count[len(keys) - len(repeated):] = repeated
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = _firsts(keys)
            total = np.add.reduceat(count[order], first)
            many = total > 1
            classes = np.floor(np.log2(total[many])).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([keys[first][many].tobytes()], pa.binary()), pa.array([classes.tobytes()], pa.binary()),
                 pa.array([np.bincount(classes, minlength=64).tolist()], pa.list_(pa.int64()))], ["bucket", "keys", "classes", "sizes"])
        give_back()

    sent = docs.select(F.col("t")).mapInArrow(blocks, "bucket int, once binary, more binary, counts binary")
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket")
    return materialise(ordered.mapInArrow(merge, "bucket int, keys binary, classes binary, sizes array<long>"), "shingle-counts")


class Sketch:
    """Frequency classes of the shingles: ``table`` of 2^``SKETCH_BITS`` bytes, cut into one part per bucket."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def slots(keys: np.ndarray, part_bits: int) -> list[np.ndarray]:
        h = mix(keys)
        step = mix(h) | np.uint64(1)
        return [((h + np.uint64(k) * step) >> np.uint64(64 - part_bits)).astype(np.int64) for k in range(_PROBES)]

    @classmethod
    def build(cls, counts: DataFrame) -> "Sketch":
        bits = _bucket_bits(counts.sparkSession)
        part_bits = SKETCH_BITS - bits
        sizes = counts.select(F.posexplode("sizes").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
        least, total = 64, 0
        for c, n in sorted(((r.c, r.n) for r in sizes), reverse=True):
            if total + n > SKETCH_KEYS or c < LEAST_CLASS:
                break
            least, total = c, total + n

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, keys, classes in zip(*[c.to_pylist() for c in b.columns]):
                    part = np.zeros(1 << part_bits, np.uint8)
                    c = np.frombuffer(classes, np.uint8)
                    k, c = np.frombuffer(keys, np.uint64)[c >= least], c[c >= least]
                    for at in Sketch.slots(k, part_bits):
                        np.maximum.at(part, at, c)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["bucket", "part"])

        table = np.zeros(1 << SKETCH_BITS, np.uint8)
        for row in counts.select("bucket", "keys", "classes").mapInArrow(fill, "bucket int, part binary").toLocalIterator():
            table[row.bucket << part_bits:(row.bucket + 1) << part_bits] = np.frombuffer(row.part, np.uint8)
        return cls(table, bits)


def _classes(table: np.ndarray, bits: int, s: np.ndarray) -> np.ndarray:
    """The class of each shingle hash; never below its true one if that is in the sketch."""
    part_bits = SKETCH_BITS - bits
    base = (s >> np.uint64(64 - bits)).astype(np.int64) << part_bits
    out = None
    for at in Sketch.slots((s << np.uint64(bits)) >> np.uint64(16), part_bits):
        c = table[base + at]
        out = c if out is None else np.minimum(out, c)
    return out


def _node(s: np.ndarray) -> np.uint64:
    """A hash of a whole set and its size."""
    return mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each hash class, 64 classes to a number."""
    size = 64 * len(BITMAP)
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(sketch: tuple, s: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the prefix and their places in the order."""
    p = len(s) - needed(len(s), threshold) + 1
    # Hashes are sorted, so a stable sort by class gives the order.
    first = np.argsort(_classes(*sketch, s), kind="stable")[:p]
    return s[first], np.arange(p)


def _meet(keys: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> tuple:
    """The entries in order of key and node, without repeats; where keys begin; and which entries share a key with another node."""
    order = np.lexsort((places, nodes, keys))
    keys, nodes, places = keys[order], nodes[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, places = keys[new], nodes[new], places[new]
    first = _firsts(keys)
    size = np.diff(np.append(first, len(keys)))
    return keys, nodes, places, first, np.repeat(size > 1, size)


def find_postings(docs: DataFrame, shared, size: int, threshold: int, id_type: str) -> DataFrame:
    """Rows of two kinds: ``doc_id``, ``n`` and ``node`` of each document, and the postings ``token``, ``node``, ``place``.

    Only lists that hold two nodes or more are given. A task compares what it holds first: a list of two nodes or more
    goes on as it is, and one entry of every list goes to the task of the shingle's range. So a shingle of very many
    prefixes arrives there once per block. ``place`` is the place in the prefix in 256ths of its length.
    """
    bits = _bucket_bits(docs.sparkSession)
    names = ["bucket", "keys", "nodes", "places", "doc_id", "n", "node", "token", "place"]
    out = names[4:]

    def kinds(id_kind):
        return dict(zip(names, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), id_kind, pa.int32(), pa.int64(), pa.int64(), pa.int32())))

    def rows(kind, columns, **given):
        full = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[c], kind[c]) if c in given else pa.nulls(full, kind[c]) for c in columns], columns)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, n, turn, kind = [], 0, 0, None

        def send():
            keys, nodes, places, first, met = _meet(*[np.concatenate(x) for x in zip(*held)])
            if met.any():
                # The bits that packing leaves out are cleared here, too.
                token = (keys[met] >> np.uint64(max(16 - bits, 0))) << np.uint64(max(16 - bits, 0))
                yield rows(kind, names, bucket=(token >> np.uint64(64 - bits)).astype(np.int32), node=nodes[met].view(np.int64),
                           token=token.view(np.int64), place=places[met].astype(np.int32))
            keys, nodes, places = keys[first], nodes[first], places[first]
            cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            at, packed = np.flatnonzero(np.diff(cut)), _pack(keys, bits)
            yield rows(kind, names, bucket=at.astype(np.int32), **{
                c: [x[cut[i]:cut[i + 1]].tobytes() for i in at] for c, x in (("keys", packed), ("nodes", nodes), ("places", places))})

        for b in pieces(batches, "t"):
            kind = kind or kinds(b.schema.field(0).type)
            sets = text_sets(b.column(1), size)
            own = np.array([_node(s) for s in sets], np.uint64)
            turn += 1
            yield rows(kind, names, bucket=(turn * 31 + np.arange(len(sets))).astype(np.int32) % np.int32(1 << bits), doc_id=b.column(0),
                       n=np.array([len(s) for s in sets], np.int32), node=own.view(np.int64))
            for s, node in zip(sets, own):
                tokens, places = _prefix(shared.value, s, threshold) if len(s) else (s, s)
                if len(tokens):
                    p = len(s) - needed(len(s), threshold) + 1
                    held.append((tokens, np.full(len(tokens), node), (places * 256 // p).astype(np.uint8)))
                    n += len(tokens)
            if n > 300_000:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()
        del held
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: dict = {}

        def split(b):
            """Passes the finished rows on; the packed ones are left."""
            kind.update(kinds(b.schema.field(4).type))
            done = b.filter(b.column(6).is_valid())
            return pa.RecordBatch.from_arrays(done.columns[4:], out), b.filter(b.column(1).is_valid()).select(names[:4])

        finished: list = []

        def packed():
            for b in batches:
                done, rest = split(b)
                if done.num_rows:
                    finished.append(done)
                yield rest

        for bucket, lists in _by_bucket(packed()):
            yield from finished
            finished.clear()
            _, keys, nodes, places = zip(*lists)
            keys = (np.uint64(bucket) << np.uint64(64 - bits)) | ((_unpack(list(keys)) << np.uint64(16)) >> np.uint64(bits))
            keys, nodes, places, _, met = _meet(keys, np.frombuffer(b"".join(nodes), np.uint64), np.frombuffer(b"".join(places), np.uint8))
            if met.any():
                yield rows(kind, out, node=nodes[met].view(np.int64), token=keys[met].view(np.int64), place=places[met].astype(np.int32))
        yield from finished
        give_back()

    columns = f"doc_id {id_type}, n int, node long, token long, place int"
    sent = docs.mapInArrow(blocks, f"bucket int, keys binary, nodes binary, places binary, {columns}")
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket")
    return materialise(ordered.mapInArrow(merge, columns), "shingle-postings")


def _checked_semi(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of ``left`` whose ``column`` is in ``right``, null being a value; ``right`` is broadcast if it is small."""
    spark = left.sparkSession
    limit = int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
    small = right.limit(limit + 1).count() <= limit
    right = right.withColumnRenamed(column, "other_")
    return left.join(F.broadcast(right) if small else right, F.col(column).eqNullSafe(F.col("other_")), "left_semi")


def candidate_sets(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """One row per node with postings: ``node``, ``n``, its bitmap and the ``whole`` set."""
    wanted = materialise(found.filter("token is not null").select("node").distinct(), "candidates")
    of_docs = _checked_semi(found.filter("token is null"), wanted, "node")
    ids = materialise(of_docs.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "candidate-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in pieces(batches, "t"):
            sets = [s for s in text_sets(b.column(1), size) if len(s)]
            if sets:
                bits = np.stack([bitmap(s) for s in sets], axis=1)
                n = np.array([len(s) for s in sets], np.int32)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(_node(s).view(np.int64)) for s in sets], pa.int64()), pa.array(n), *[pa.array(x) for x in bits],
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "n", *BITMAP, "whole"])

    schema = f"node long, n int, {', '.join(f'{b} long' for b in BITMAP)}, whole array<long>"
    sets = _checked_semi(docs, ids, "doc_id").mapInArrow(run, schema)
    sets = materialise(_checked_semi(sets, wanted, "node"), "shingle-sets")
    if sets.select("node").count() > sets.select("node").distinct().count():  # rows that repeat an id
        sets = materialise(sets.groupBy("node").agg(F.first(F.struct(*sets.columns)).alias("s")).select("s.*"), "shingle-sets")
    return sets


def _distinct_lists(postings: DataFrame) -> DataFrame:
    """One of the lists that hold the same nodes: near copies share hundreds, which would all name the same pairs."""
    once = postings.groupBy("token", "node").agg(F.min("place").alias("place"))
    same = ["size", "mark", "lo", "hi"]
    lists = once.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("mark"),
                                      F.min("node").alias("lo"), F.max("node").alias("hi"))
    kept = lists.filter("lo <> hi").groupBy(*same).agg(F.min("token").alias("token")).select("token")
    return once.join(kept, "token", "left_semi")


def _alive(postings: DataFrame) -> DataFrame:
    """The lists that still hold two components or more."""
    open_lists = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return postings.join(open_lists, "token", "left_semi")


def _pairs(postings: DataFrame, pivots: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a node and a pivot of one of its lists that pass the filters, and the pivots of each list."""
    slot = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
    named = postings.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("node", "comp", "n", "place", *BITMAP)).alias("v"))
    named = materialise(named.select("token", "v"), "pivots")
    both = postings.join(named, "token").filter((F.col("comp") != F.col("v.comp")) & (F.col("node") != F.col("v.node")))
    n, m = F.col("n"), F.col("v.n")
    # Least number to share: s >= t / (100 + t) * (n + m).
    share = F.ceil((n + m) * threshold / (100.0 + threshold) - 1e-9)
    length = 100 * F.least(n, m) >= threshold * F.greatest(n, m)
    # Lists are met in any order, so a match need not be the first: what lies before it may be shared too.
    # Places are known to a 256th of the prefix: the latest of the match counts before it, the earliest behind it.
    def earliest(size, place):  # the place, from its 256ths
        return F.floor(place * (size - F.ceil(size * threshold / 100.0 - 1e-9) + 1) / 256.0)

    behind = F.least(n - earliest(n, F.col("place")), m - earliest(m, F.col("v.place")))
    position = F.least(earliest(n, F.col("place") + 1), earliest(m, F.col("v.place") + 1)) + 1 + behind >= share
    # Sets that share so much differ in n + m - 2 * share shingles at most.
    differ = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"v.{b}"))) for b in BITMAP)
    pairs = both.filter(length & position & (differ <= n + m - 2 * share)).select(F.least("node", "v.node").alias("a"),
                                                                                  F.greatest("node", "v.node").alias("b")).distinct()
    return pairs, named.select("token", F.col("v.node").alias("node"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that link, each compared once on both whole sets."""
    # Only sets of pairs travel: where pairs are few they are broadcast to the sets.
    pairs = materialise(pairs, "pairs")
    left = join_small(sets.select(F.col("node").alias("a"), F.col("whole").alias("x")), pairs, ["a"], "inner")
    wanted = join_small(sets.select(F.col("node").alias("b"), F.col("whole").alias("y")), pairs.select("b").distinct(), ["b"], "left_semi")
    shared = F.size(F.array_intersect("x", "y"))
    linked = 100 * shared >= threshold * (F.size("x") + F.size("y") - shared)
    return left.join(wanted, "b").filter(linked).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that edges (``a``, ``b``) connect it with.

    Each round every node takes the least label of its neighbours and then that label's own label, so
    labels travel twice as far from round to round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = materialise(both.toDF("node", "other"), "edges")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        new = materialise(least.join(jump, "new").select("node", F.least("new", "far").alias("comp"), "old"), "labels")
        if new.filter("comp <> old").isEmpty():
            return labels
        labels = new.select("node", "comp")


def link_components(postings: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``node`` and ``comp`` of the nodes that have links; ``sets`` has one row per node of the postings."""
    labels = None
    postings = join_small(_distinct_lists(postings), sets.select("node", "n", *BITMAP), ["node"], "inner").withColumn("comp", F.col("node"))
    postings, pivots = materialise(postings, "postings"), 1
    while not postings.isEmpty():
        pairs, named = _pairs(postings, pivots, threshold)
        links = materialise(_verified(pairs, sets, threshold), "links")
        rest = postings.join(named, ["token", "node"], "left_anti")
        if not links.isEmpty():
            # Links join components of the rounds before.
            if labels is not None:
                for end in ("a", "b"):
                    names = labels.select(F.col("node").alias(end), F.col("comp").alias("c"))
                    links = links.join(names, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
            joined = components(links)
            if labels is None:
                labels = joined
            else:
                step = joined.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
                moved = labels.join(step, "comp", "left").select("node", F.coalesce("c", "comp").alias("comp"))
                labels = materialise(moved.unionByName(joined.join(labels, "node", "left_anti")), "labels")
            rest = rest.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        postings, pivots = materialise(_alive(rest), "postings"), pivots * 8
    return labels if labels is not None else sets.select("node", F.col("node").alias("comp")).limit(0)


def similar_components(docs: DataFrame, threshold: int = THRESHOLD, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        sketch = Sketch.build(frequencies(rows, size))
        shared = spark.sparkContext.broadcast((sketch.table, sketch.bits))
        posted = find_postings(rows, shared, size, threshold, docs.schema[doc_id].dataType.simpleString())
        shared.unpersist()
        sets = candidate_sets(rows, posted, size)
    labels = link_components(posted.filter("token is not null").select("token", "node", "place"), sets, threshold)
    found = posted.filter("token is null").select("doc_id", "n", "node")
    plain = found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = plain.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = named.join(smallest, "comp").select("node", "component_id")
    out = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_component(joined: DataFrame) -> Column:
    """True for the row that stays of each group."""
    return joined["doc_id"] == joined["component_id"]
