"""Records of large JSON array files, each file read by many tasks.

Spark reads a file with one JSON array in one task. Here the files are read as text cut at ``}``, which Spark splits by
byte ranges, and the objects are put together again:

* A range starts behind some ``}``. Whether that one stood inside a string, and how many braces were open there, depends on all that
  comes before. So a first pass finds for each range what it does to that state from either start (outside or inside a string): one
  row per range. Running sums over these rows give every range its true start.
* A second pass walks each range from its start and gives out the objects that end in it. Only an object that reaches over
  an edge is put together from its pieces, which are found and written beforehand, for the ranges that have any.

The ranges come from a session of its own whose split size is fixed, so both passes see the same ones whatever the
cluster does in between. A task takes as many ranges as make up a partition of usual size: what a task and the file that
it writes cost does not count once per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.session import is_small, materialise

SPLIT_CONF = "spark.sql.files.maxPartitionBytes"
_SEPARATOR = "}"
_QUOTE, _BACKSLASH, _OPEN, _CLOSE = (ord(c) for c in '"\\{}')
_BETWEEN = np.zeros(256, bool)  # what may stand between objects
_BETWEEN[[*b" \t\r\n,[]"]] = True
_STEP = 4 << 20


def in_string(data: np.ndarray, inside: bool) -> np.ndarray:
    """Whether the text behind each byte is inside a string; a quote behind an odd number of backslashes doesn't count."""
    quote = data == _QUOTE
    at = np.flatnonzero(quote)
    if len(at) and (data == _BACKSLASH).any():
        solid = np.maximum.accumulate(np.where(data != _BACKSLASH, np.arange(len(data)), -1))
        before = np.where(at > 0, at - 1 - np.where(at > 0, solid[at - 1], 0), 0)
        quote[at[before % 2 == 1]] = False
    return (np.cumsum(quote) + int(inside)) % 2 == 1


def open_braces(data: np.ndarray, within: np.ndarray, depth: int) -> np.ndarray:
    """How many braces are open behind each byte."""
    return depth + np.cumsum(((data == _OPEN) & ~within).astype(np.int64) - ((data == _CLOSE) & ~within))


class Walk:
    """The objects of one range, fed piece by piece.

    ``head`` is what belongs to an object that was open at the start, ``rest`` what stands behind the last object.
    """

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = bool(inside), int(depth)
        self.waits = self.inside or self.depth > 0  # for the end of the object that was open
        self.head, self.rest = b"", b""

    def feed(self, text: bytes) -> list[bytes]:
        """The objects that end in ``text``, and other text between them."""
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return []
        within = in_string(data, self.inside)
        depth = open_braces(data, within, self.depth)
        self.inside, self.depth = bool(within[-1]), int(depth[-1])
        start, out = 0, []
        for stop in (np.flatnonzero((data == _CLOSE) & ~within & (depth <= 0)) + 1).tolist():
            if self.waits:
                self.head, self.waits = self.head + text[:stop], False
            else:
                out.extend(split(self.rest + text[start:stop]))
            self.rest, start = b"", stop
        if self.waits:
            self.head += text
        else:
            self.rest += text[start:]
        return out


def split(text: bytes) -> list[bytes]:
    """The object that ``text`` ends with, and before it what should not stand there."""
    at = text.find(b"{")
    between = text if at < 0 else text[:at]
    stray = bool(between) and not _BETWEEN[np.frombuffer(between, np.uint8)].all()
    return ([between] if stray else []) + ([text[at:]] if at >= 0 else [])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """Range by range in order: the range's columns, text of bounded size, and whether it is the range's last.

    The reader takes ``}`` away. It is put back, but not behind the last line of a file that ends otherwise (``uncut``).
    """
    def text(last: bool) -> bytes:
        return b"}".join(held) + (b"" if last and row.get("uncut") else b"}")

    now, row, held, size = None, {}, [], 0
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        lines = columns.pop("value").to_pylist()
        for i, (path, block) in enumerate(zip(columns["path"].to_pylist(), columns["block"].to_pylist())):
            if (path, block) != now:
                if now:
                    yield row, text(True), True
                now, row, held, size = (path, block), {n: c[i].as_py() for n, c in columns.items()}, [], 0
            elif size > _STEP:
                yield row, text(False), False
                held, size = [], 0
            held.append(lines[i])
            size += len(lines[i]) + 1
    if now:
        yield row, text(True), True


def _task_bytes(spark: SparkSession, total: int) -> int:
    """What a task reads of ``total`` bytes by Spark's own rule for its sources."""
    conf = spark._jsparkSession.sessionState().conf()
    each = max(conf.filesOpenCostInBytes(), total // spark.sparkContext.defaultParallelism)
    return max(1, min(conf.filesMaxPartitionBytes(), each))


def _lines(spark: SparkSession, paths: list[str], split_bytes: int, total: int) -> DataFrame:
    reader = spark.newSession()
    reader.conf.set(SPLIT_CONF, str(split_bytes))
    reader.conf.set("spark.sql.files.openCostInBytes", str(split_bytes))  # else splits follow the number of cores
    # Listing takes a task per file otherwise.
    reader.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    lines = reader.read.option("lineSep", _SEPARATOR).text(paths)
    lines = lines.coalesce(max(1, -(-total // _task_bytes(spark, total))))  # a range stays whole and in order
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("value"))


def _effects(lines: DataFrame) -> DataFrame:
    """One row per range: its bytes, whether it turns outside into inside a string, the braces it opens from either start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, turns, opened_out, opened_in = 0, False, 0, 0
        for at, text, last in _pieces(batches):
            data = np.frombuffer(text, np.uint8)
            within = in_string(data, turns)
            n, turns = n + len(text), bool(within[-1])
            opened_out += int(open_braces(data, within, 0)[-1])
            opened_in += int(open_braces(data, ~within, 0)[-1])
            if last:
                yield pa.RecordBatch.from_pylist([{"path": at["path"], "block": at["block"], "length": at["length"], "bytes": n,
                                                   "turns": int(turns), "opened_out": opened_out, "opened_in": opened_in}])
                n, turns, opened_out, opened_in = 0, False, 0, 0

    return materialise(lines.mapInArrow(
        run, "path string, block long, length long, bytes long, turns long, opened_out long, opened_in long"), "ranges")


def _starts(effects: DataFrame) -> DataFrame:
    """Each range with its true start, whether its last line was no line before a ``}``, and whether it leaves an object open."""
    ranges = Window.partitionBy("path").orderBy("block")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1
    opened = F.when(F.col("inside"), F.col("opened_in")).otherwise(F.col("opened_out"))
    known = effects.withColumn("inside", inside).withColumn("depth", F.coalesce(F.sum(opened).over(before), F.lit(0)))
    # One byte too many: a brace that isn't there. The reader drops a byte order mark of three bytes.
    longer = F.sum("bytes").over(Window.partitionBy("path")) - F.col("length")
    ends = F.lead("block").over(ranges).isNull()
    open_behind = F.lead("inside").over(ranges) | (F.lead("depth").over(ranges) > 0)
    return materialise(known.select("path", "block", "inside", "depth", (ends & longer.isin(1, -2)).alias("uncut"),
                                    F.coalesce(open_behind, F.lit(False)).alias("passes_on")), "range-starts")


def _walked(lines: DataFrame, starts: DataFrame, edges: bool) -> DataFrame:
    """The objects that begin and end in a range; with ``edges``, what ranges add to the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for at, text, last in _pieces(batches):
            if at["inside"] is None:
                raise RuntimeError(f"{at['path']} changed while it was read")
            walk = walk or Walk(at["inside"], at["depth"])
            found = walk.feed(text)
            if last and not walk.waits and not at["passes_on"]:
                found += split(walk.rest)
            if not edges and found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])
            if last:
                rows = ([(0, walk.head)] if walk.head else []) + ([(1, walk.rest)] if at["passes_on"] and not walk.waits else [])
                if edges and rows:
                    yield pa.RecordBatch.from_pylist([{"path": at["path"], "block": at["block"], "part": k, "record": x} for k, x in rows])
                walk = None

    known = starts.withColumnsRenamed({"path": "p", "block": "b"})
    same = (F.col("path") == F.col("p")) & (F.col("block") == F.col("b"))
    if is_small(known):
        met = lines.join(F.broadcast(known), same, "left")
    else:  # an exchange leaves the lines of a range in any order
        met = lines.withColumn("at", F.monotonically_increasing_id()).join(known, same, "left")
        met = met.sortWithinPartitions("path", "block", "at").drop("at")
    met = met.drop("p", "b", "length")
    if not edges:
        return met.mapInArrow(run, "record binary")
    met = met.where(F.col("inside") | (F.col("depth") > 0) | F.col("passes_on"))
    return met.mapInArrow(run, "path string, block long, part long, record binary")


def _over_edges(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """The objects that reach over an edge: each begins with the rest of a range and goes on with the heads of the next ones."""
    parts = materialise(_walked(lines, starts, True), "range-edges")
    nth = F.sum("part").over(Window.partitionBy("path").orderBy("block", "part"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "record"))), lambda x: x["record"].cast("string"))
    whole = parts.withColumn("nth", nth).groupBy("path", "nth").agg(F.array_join(texts, "").cast("binary").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for r in b.column(0).to_pylist() for x in split(r)], pa.binary())], ["record"])

    return materialise(whole.select("record").mapInArrow(run, "record binary"), "edge-records")


def json_records(spark: SparkSession, paths: list[str], split_bytes: int, total: int | None = None) -> DataFrame:
    """``record``: the text of every object of the array files ``paths`` (UTF-8), and of what else stands between them.

    ``total`` is the files' size together, if it is known.

    An object may hold others, and strings with brackets, braces and quotes. Where a file ends inside an object the rest of it
    is one record, so that a parser tells that it is malformed.
    """
    if total is None:
        total = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    lines = _lines(spark, paths, split_bytes, total)
    starts = _starts(_effects(lines))
    found = _walked(lines, starts, False)
    if not starts.where(F.col("passes_on")).isEmpty():
        found = found.unionByName(_over_edges(lines, starts))
    return found.select(F.col("record").cast("string").alias("record"))
