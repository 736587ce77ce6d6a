"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, divided by its size, is the number of copies of each of its documents, such as
1.3. The whole part is taken; the rest is a probability to round. The pivotal method meets two documents at
a time and moves mass (words) from one to the other, in a random direction with odds that keep both
expectations, until one of the two is taken wholly or not at all; the other goes on to the next. The mass of
a source never changes, so its words differ from the target by less than the size of its last document.
Documents meet in falling order of size, so that the last ones are small.

Each source is split into leaves of about ``leaf_rows`` documents by a hash of the id. A leaf passes on one
undecided document at most, and its smallest documents (one in 50), which can take up what large ones leave. Those of a
source form the leaves of the next level, up to a root that rounds the last one by chance: a reduction tree in
which every level has about a fiftieth of the rows of the one below.
All draws are hashes of ids and level, so a rerun or a repeated task gives the same mix.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its
own, last in order; equal sizes are ordered by hash, then id; repeated rows are rounded row by row
(``mixed_documents`` gives rows equal in id, text and source one decision); an empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import BROADCAST_ROWS_CONF, DEFAULT_BROADCAST_ROWS, materialise
from driftline.llm.texts import mix as scramble

LEAF_ROWS = 1000
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``n_rows``, ``target``, ``copies`` (target over size).

    Sources in code-point order, null last, weigh ``weights`` over and over. Together they get
    ``share`` of all sizes; a target stops at ``cap`` times its source's size, and the excess goes to the others
    by weight. So targets are ``min(cap * size, level * weight)``; the level only rises while sources
    reach their cap, one aggregation of the source table a round.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    kind = sized.schema["source"].dataType.simpleString()
    table = materialise(spark.createDataFrame(ranked, f"source {kind}, source_size long, n_rows long, weight double"), "sources")
    level, full = 0.0, -1
    limit, want = F.col("source_size") * cap, F.sum("source_size") * share
    while True:
        capped = limit <= F.col("weight") * level if full >= 0 else F.lit(False)
        total, held, rest, n = table.agg(want, F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
                                         F.sum(capped.cast("long"))).head()
        if n is None or n == full or not rest:
            break
        level, full = (total - held) / rest, n
    target = F.least(limit, F.col("weight") * level)
    copies = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= limit, cap).otherwise(F.col("target") / F.col("source_size"))
    return table.withColumn("target", target).withColumn("copies", copies)


def _round(table: pa.Table, level: int, held_back: int) -> pa.Table:
    """Meet the documents of one leaf.

    The ``held_back`` smallest stay out, and at most one more stays undecided (``p`` between 0 and
    1); with none held back this is a root, which rounds the last one by chance.
    """
    h, size, p = table["h"].to_numpy(), table["size"].to_numpy().astype(float), table["p"].to_numpy().copy()
    names = np.array([str(x) for x in table["key"].to_pylist()])
    order = np.lexsort((names, h, -size))
    order = order[:max(len(order) - held_back, 0)]
    draw = (scramble(h.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019) * np.uint64(level + 1)) >> np.uint64(11)) / float(1 << 53)
    a = -1
    for b in order:
        if not 0 < p[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        up, down = min(size[a] * (1 - p[a]), size[b] * p[b]), min(size[a] * p[a], size[b] * (1 - p[b]))
        if draw[b] * (up + down) < down:
            a_ends = size[a] * (1 - p[a]) <= size[b] * p[b]
            pa_, pb = (1.0, p[b] - up / size[b]) if a_ends else (p[a] + up / size[a], 0.0)
        else:
            a_ends = size[a] * p[a] <= size[b] * (1 - p[b])
            pa_, pb = (0.0, p[b] + down / size[b]) if a_ends else (p[a] - down / size[a], 1.0)
        p[a], p[b] = pa_, pb
        near = [i for i in (a, b) if 1e-12 < p[i] < 1 - 1e-12]
        for i in (a, b):
            if i not in near:
                p[i] = round(p[i])
        a = near[0] if near else -1
    if not held_back and a >= 0:
        p[a] = float(scramble(np.array([h[a]]).astype(np.uint64) ^ np.uint64(0x9FB21C651E98DF25))[0] >> np.uint64(11)) / (1 << 53) < p[a]
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _rounder(level: int, leaf_rows: int):
    def run(table: pa.Table) -> pa.Table:
        return _round(table, level, 0 if table["n_rows"][0].as_py() <= leaf_rows else max(4, leaf_rows // 50))

    return run


def choose(sized: DataFrame, targets: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``sized`` (``key``, ``source``, ``size``) with ``source_size``, ``target`` and ``taken``, the whole number of copies."""
    spark = sized.sparkSession
    limit = int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
    side = targets.select(F.col("source").alias("source_"), "source_size", "target", "copies", "n_rows")
    if side.limit(limit + 1).count() <= limit:
        side = F.broadcast(side)
    whole, size = F.floor("copies"), F.col("size")
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_").select(
        "key", "source", "size", "source_size", "target", "n_rows", whole.alias("whole"),
        F.when(size > 0, F.col("copies") - whole).otherwise(0.0).alias("p"), F.xxhash64(F.col("key").cast("string"), F.lit(29)).alias("h"))
    rows = materialise(rows, "mix-rows")
    done, left, level = [rows.filter("p = 0")], rows.filter("p > 0"), 0
    while not left.isEmpty():
        leaves = F.ceil(F.col("n_rows") / leaf_rows)
        placed = left.withColumn("leaf", F.pmod(F.xxhash64("h", F.lit(level)), leaves))
        single = left.filter(F.col("n_rows") > leaf_rows).isEmpty()
        met = materialise(placed.groupBy("source", "leaf").applyInArrow(_rounder(level, leaf_rows), placed.schema), "mix-level").drop("leaf")
        done.append(met.filter("p = 0 or p = 1"))
        if single:
            break
        rest = met.filter("p > 0 and p < 1")
        counts = rest.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "source_")
        if counts.limit(limit + 1).count() <= limit:
            counts = F.broadcast(counts)
        left = rest.join(counts, F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "n_rows").withColumnRenamed("n", "n_rows")
        left = materialise(left.select(*rows.columns), "mix-rest")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("key", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("taken"))


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", leaf_rows: int = LEAF_ROWS, **targets) -> DataFrame:
    """``key`` (the id), ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (copies) of every row of ``docs``."""
    sized = docs.select(F.col(doc_id).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = materialise(sized, "sizes")
    return choose(sized, source_targets(sized, **targets), leaf_rows)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", leaf_rows: int = LEAF_ROWS, **targets) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with the columns of ``docs``.

    Rows equal in id, text and source are one unit of the mix.
    """
    unit = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text"), F.col(source).alias("source"))
    rows = docs.select(unit.alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = materialise(rows.groupBy("key", "source").agg(F.sum("size").alias("size")), "sizes")
    taken = materialise(choose(sized, source_targets(sized, **targets), leaf_rows).select("key", "taken").filter("taken > 0"), "mix")
    names = docs.columns
    held = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), unit.alias("key"))
    same = [F.col(f"l.key.{c}").eqNullSafe(F.col(f"r.key.{c}")) for c in ("id", "text", "source")]
    chosen = held.alias("l").join(taken.alias("r"), same[0] & same[1] & same[2])
    copies = chosen.select(F.col("l.row").alias("row"), F.explode(F.sequence(F.lit(1), F.col("r.taken").cast("int"))).alias("copy"))
    return copies.select("row.*")
