"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups' roots, and each row's proof.

A leaf is the SHA-256 of its row's fields, each written as its length in UTF-8 bytes, ``:`` and the value, null as ``-``. The leaves
of a group ascend by id. On each level every ``arity`` consecutive nodes are a run, the last one may be shorter, even one node; a
run's digests, as lowercase hex texts one after the other, hash to its parent. A group's last node is its
subroot; the subroots, in the order of the groups, make one more tree in the same way.

* *Places.* Leaves are range-partitioned by (group, id, leaf, row) and numbered inside a partition; a table with one
  row per partition and group turns that into places in the group. No group is sorted in one task.
* *Levels.* A level meets itself by equijoins on the sibling's place: place XOR 1 for two, the other slots of the run
  otherwise. Rows in slot 0 then hash their run and emit the parent. Levels shrink by ``arity``, so all together move about
  as much as the leaves twice.
* *Proofs.* From the top down each level's nodes take the path of their parent and put their own siblings in front.
  Digests travel as 32 bytes.

Every level is written to the shared folder, so a lost executor costs a level at most.

Defined cases: null ids come first, and rows with one id are ordered by leaf; equal rows have equal leaves and stand side by side;
a null group is a group of its own, before the others; a lone leaf is its group's subroot, and a lone subroot is the root; an
empty table has no rows; columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from driftline.session import join_small, materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32  # bytes of a digest


def _nothing() -> Column:
    return F.array().cast("array<binary>")


def digest(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """A value with its length before it, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _run(own: Column, slot: Column, others: Column) -> Column:
    """The parent of a node in ``slot`` and its siblings, whose digests follow one another in ``others``."""
    left = F.substring(others, F.lit(1), slot * _SIZE)
    right = F.substring(others, slot * _SIZE + 1, F.octet_length(others))
    return digest(F.concat(hexed(left), hexed(own), hexed(right)))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order within their group and the group's size ``n``.

    The order has to be total. Equal places can't occur: numbers are given in one written pass.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            local = []
            for g in b.column(b.schema.get_field_index(group)).to_pylist():
                seen, now = (seen if now == (g,) else 0), (g,)
                local.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(local, pa.int64())],
                                             [*b.schema.names, "part", "local"])

    schema = StructType([*rows.schema, StructField("part", IntegerType()), StructField("local", LongType())])
    ordered = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    numbered = materialise(ordered.mapInArrow(number, schema), "numbered")
    counts = numbered.groupBy(group, "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(group).alias("of_group"), F.col("part").alias("of_part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"),
                         F.sum("held").over(Window.partitionBy(group)).alias("n"))
    met = F.col(group).eqNullSafe(F.col("of_group")) & (F.col("part") == F.col("of_part"))
    out = join_small(numbered, materialise(base, "places"), met, "inner")
    return out.select(*rows.columns, (F.col("base") + F.col("local")).alias("place"), "n")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``grp``, ``place``, ``n``, ``own``, ``slot`` and ``others``, the siblings' digests in the order of their slots."""
    slot = (F.col("place") % arity).cast("int")
    out = nodes.withColumn("slot", slot)
    for k in range(1, arity):
        at = F.col("place").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("place") - slot + (slot + k) % arity
        other = nodes.select(F.col("grp").alias("og"), F.col("place").alias("op"), F.col("own").alias(f"own_{k}"))
        met = F.col("grp").eqNullSafe(F.col("og")) & (F.col("at") == F.col("op"))
        out = join_small(out.withColumn("at", at), other, met, "left").drop("at", "og", "op")
    # Offset k leads to slot + k, beyond the last slot around to the first ones.
    parts = [F.when((F.col("slot") + k >= arity) == wraps, F.col(f"own_{k}")) for wraps in (True, False) for k in range(1, arity)]
    others = F.concat(*[F.coalesce(p, F.lit(b"")) for p in parts])
    return out.select("grp", "place", "n", "own", "slot", others.alias("others"))


def tree(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Paths and roots of all groups of ``leaves`` (``grp``, ``place``, ``n``, ``own``).

    The paths have ``grp``, ``place`` and ``path`` (the siblings of each level, from the leaf up), the roots ``grp`` and ``own``.
    """
    level = materialise(leaves.select("grp", "place", "n", "own"), "nodes")
    levels, roots = [], []
    most = level.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(level.filter("n = 1").select("grp", "own"))
        if most <= 1:
            break
        met = materialise(_with_siblings(level.filter("n > 1"), arity), "level")
        levels.append(met.select("grp", "place", "others"))
        parents = met.filter("slot = 0").select("grp", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("n") / arity).alias("n"),
                                                _run(F.col("own"), F.col("slot"), F.col("others")).alias("own"))
        level, most = materialise(parents, "nodes"), -(-most // arity)
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    paths = None
    for met in reversed(levels):
        own = F.array("others")
        if paths is None:
            paths = materialise(met.select("grp", "place", own.alias("path")), "paths")
            continue
        up = paths.select(F.col("grp").alias("ug"), F.col("place").alias("up"), F.col("path").alias("above"))
        on = F.col("grp").eqNullSafe(F.col("ug")) & (F.floor(F.col("place") / arity) == F.col("up"))
        joined = join_small(met, up, on, "left")
        path = F.concat(own, F.coalesce("above", _nothing()))
        paths = materialise(joined.select("grp", "place", path.alias("path")), "paths")
    if paths is None:
        paths = level.select("grp", "place", _nothing().alias("path")).limit(0)
    return paths, materialise(every, "roots")


def folded(start: Column, place: Column, path: Column, arity: int = 2) -> Column:
    """The root that a leaf at ``place`` and the siblings of its path lead to."""
    def up(now: Column, others: Column) -> Column:
        own = _run(now["own"], (now["place"] % arity).cast("int"), others)
        return F.struct(own.alias("own"), F.floor(now["place"] / arity).alias("place"))

    return F.aggregate(path, F.struct(start.alias("own"), place.alias("place")), up, lambda now: now["own"])


def proof(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, hexed), "").cast("binary"), 256)


def build_manifest(rows: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id",
                   group: str = "lang", arity: int = 2) -> DataFrame:
    """``doc_id``, ``grp``, ``place``, ``leaf``, ``subroot``, ``root`` of each row, digests as 32 bytes, ``path`` to the
    subroot, and ``top_place`` and ``top_path`` from there.

    ``now`` is the leaf of the row as it reads with the columns in ``tampered`` replaced: what is to be verified.
    """
    changed = tampered or {}
    own = leaf([F.col(c) for c in fields])
    now = leaf([changed.get(c, F.col(c)) for c in fields])
    differs = F.lit(False)
    for c in fields:
        if c in changed:
            differs = differs | ~F.col(c).eqNullSafe(changed[c])
    made = rows.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("grp"), own.alias("own"),
                       F.when(differs, now).alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = materialise(placed(materialise(made, "leaves"), "grp", ["doc_id", "own", "row"]).drop("row"), "leaves")
    paths, subroots = tree(leaves, arity)
    tops = materialise(placed(subroots.select("grp", "own", F.lit(0).alias("one")), "one", ["grp"]), "tops")
    top_paths, root = tree(tops.select(F.col("one").alias("grp"), "place", "n", "own"), arity)
    root = root.first()
    named = tops.select(F.col("grp").alias("tg"), F.col("place").alias("top_place"), F.col("own").alias("subroot"))
    named = named.join(top_paths.select(F.col("place").alias("top_place"), F.col("path").alias("top_path")), "top_place", "left")
    up = paths.select(F.col("grp").alias("pg"), F.col("place").alias("pp"), "path")
    out = join_small(leaves, up, F.col("grp").eqNullSafe(F.col("pg")) & (F.col("place") == F.col("pp")), "left")
    out = join_small(out, materialise(named, "tops"), F.col("grp").eqNullSafe(F.col("tg")), "inner")
    return out.select("doc_id", "grp", "place", F.col("own").alias("leaf"), F.coalesce("changed", "own").alias("now"), "subroot",
                      F.lit(bytes(root.own) if root else b"").alias("root"), F.coalesce("path", _nothing()).alias("path"), "top_place",
                      F.coalesce("top_path", _nothing()).alias("top_path"))


def verified(manifest: DataFrame, arity: int = 2) -> DataFrame:
    """The manifest with its digests as hex texts, the digest of each proof, the root each row leads to now, and whether that is the root."""
    names = ("leaf", "subroot", "root")
    subroot = folded(F.col("now"), F.col("place"), F.col("path"), arity)
    root = folded(subroot, F.col("top_place"), F.col("top_path"), arity)
    out = manifest.select("doc_id", "grp", "place", *[hexed(F.col(c)).alias(c) for c in names],
                          proof(F.concat("path", "top_path")).alias("proof_sha256"), hexed(root).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
