"""Readers of landed catalogue and history records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import orbit
from driftline.schema import CATALOGUE, DERIVED, HISTORY_CASTS, RAW_HISTORY
from driftline.sources.json_records import json_records
from driftline.sources.writers import clustered_name


_MALFORMED = "_malformed"


_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".xz")


def _read_text_fields(spark: SparkSession, path: str, fields: list[str], array_files: bool, split_bytes: int | None = None) -> DataFrame:
    """Records with every value as text, and the whole record in ``_malformed`` where it is no JSON.

    Array files above ``split_bytes`` (``spark.sql.files.maxPartitionBytes`` by default) are read by many tasks each;
    compressed ones can't be. Such a file has to be UTF-8.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, _MALFORMED]])
    reader = spark.read.schema(schema).options(multiLine=array_files, mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED)
    if not array_files:
        return reader.json(path)
    split = split_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the listing alone is read
    large = (F.col("length") > split) & ~F.lower("path").rlike("(" + "|".join(x.replace(".", "[.]") for x in _PACKED) + ")$")
    files = files.select("path", "length", large.alias("large")).collect()
    if not any(f.large for f in files):
        return reader.json(path)
    parse = F.from_json("record", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED})
    total = sum(f.length for f in files if f.large)
    out = json_records(spark, [f.path for f in files if f.large], split, total).select(parse.alias("r")).select("r.*")
    small = [f.path for f in files if not f.large]
    return out.unionByName(reader.json(small)) if small else out


def split_catalogue(spark: SparkSession, path: str, array_files: bool = True, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed catalogue records, and as text the others with the fields at fault.

    Values may land as text or as numbers. A record needs an id; a semi-major axis may be missing but must
    be a number if it is there. ``array_files`` reads files that each hold one JSON array, large ones with many tasks;
    without it the files hold one record or array per line.
    """
    raw = _read_text_fields(spark, path, CATALOGUE.fieldNames(), array_files, split_bytes)
    numbers = {"NORAD_CAT_ID": "bigint", "SEMIMAJOR_AXIS": "double"}
    bad = {f: F.col(f).try_cast(kind).isNull() for f, kind in numbers.items()}
    bad["SEMIMAJOR_AXIS"] &= F.col("SEMIMAJOR_AXIS").isNotNull()
    faults = F.array_compact(F.array(
        F.when(F.col(_MALFORMED).isNotNull(), F.lit("record")), *[F.when(test, F.lit(f)) for f, test in bad.items()]))
    marked = raw.withColumn("faults", faults)
    good = marked.where(F.size("faults") == 0).select(
        *[F.col(f).try_cast(numbers[f]).alias(f) if f in numbers else F.col(f) for f in CATALOGUE.fieldNames()])
    return good, marked.where(F.size("faults") > 0)


def read_catalogue(spark: SparkSession, path: str, array_files: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Catalogue records from JSON; an unusable record fails the job (``split_catalogue`` returns it)."""
    raw = _read_text_fields(spark, path, CATALOGUE.fieldNames(), array_files, split_bytes)

    def checked(field: str, kind: str, needed: bool) -> Column:
        value = F.col(field).try_cast(kind)
        bad = value.isNull() & (F.lit(needed) | F.col(field).isNotNull() | F.col(_MALFORMED).isNotNull())
        told = F.concat(F.lit(f"unusable {field}: "), F.coalesce(field, _MALFORMED, F.lit("null")))
        return F.when(bad, F.raise_error(told).cast(kind)).otherwise(value).alias(field)

    return raw.select(checked("NORAD_CAT_ID", "bigint", True), "OBJECT_NAME", "COUNTRY_CODE", "OBJECT_TYPE",
                      checked("SEMIMAJOR_AXIS", "double", False))


def read_raw_history(spark: SparkSession, path: str, array_files: bool = True, split_bytes: int | None = None) -> DataFrame:
    """History records from JSON, every value as text.

    A record that is no JSON has no fields at all; it is a reject like any other without an id.
    """
    return _read_text_fields(spark, path, RAW_HISTORY.fieldNames(), array_files, split_bytes).drop(_MALFORMED)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A typed history from Parquet, with nanosecond times from other writers made microseconds.

    Spark refuses such columns unless ``spark.sql.legacy.parquet.nanosAsLong`` is set, as
    ``build_session`` does. Files written here need no setting.
    """
    df = spark.read.parquet(path)
    times = [n for n in ("epoch", "creation_date")
             if n in df.columns and isinstance(df.schema[n].dataType, T.LongType)]
    return df.withColumns({
        n: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + ({n} div 1000) * interval '0.000001' second")
        for n in times})


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_clustered``, whose clustering the planner knows."""
    name, path = clustered_name(path), path.rstrip("/")
    if not spark.catalog.tableExists(name):
        layout = json.loads(spark.read.text(f"{path}/_layout").first().value)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"""create table if not exists {name} ({columns}) using parquet clustered by (`{layout["entity"]}`)
            sorted by (`{layout["entity"]}`, `{layout["time"]}`) into {layout["buckets"]} buckets location '{path}'""")
    return spark.table(name)


def derive(df: DataFrame) -> DataFrame:
    """Add semi-major axis, apogee, period and velocity."""
    sma = orbit.semi_major_axis(F.col("mean_motion"))
    return df.withColumn("sma", sma).withColumns({
        "apogee": orbit.apogee(F.col("sma"), F.col("eccentricity")),
        "period": orbit.period(F.col("sma")),
        "velocity": orbit.velocity(F.col("sma"))})


_MAY_BE_MISSING = {"object_name", "creation_date"}


def _cast(field: str, kind: str) -> Column:
    return F.col(field).try_cast(kind)


def _bad(name: str) -> Column:
    """Whether the field of typed column ``name`` cannot be used."""
    field, kind = HISTORY_CASTS[name]
    if name in _MAY_BE_MISSING:
        return F.col(field).isNotNull() & _cast(field, kind).isNull()
    if name == "mean_motion":
        return ~F.coalesce(_cast(field, kind) > 0, F.lit(False))
    return _cast(field, kind).isNull()


def typed_history(raw: DataFrame) -> DataFrame:
    """Raw records to the typed history; any unusable value fails the job."""
    columns = []
    for name, (field, kind) in HISTORY_CASTS.items():
        complaint = F.concat(F.lit(f"unusable {field}: "), F.coalesce(F.col(field), F.lit("null")))
        columns.append(F.when(_bad(name), F.raise_error(complaint).cast(kind))
                       .otherwise(_cast(field, kind)).alias(name))
    return derive(raw.select(columns)).select(*HISTORY_CASTS, *DERIVED)


def split_history(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed history of usable records, and the others with the fields at fault."""
    faults = F.array_compact(F.array(*[
        F.when(_bad(name), F.lit(field)) for name, (field, _) in HISTORY_CASTS.items()]))
    good = raw.where(F.size(faults) == 0).select(
        [_cast(field, kind).alias(name) for name, (field, kind) in HISTORY_CASTS.items()])
    rejects = raw.withColumn("faults", faults).where(F.size("faults") > 0)
    return derive(good).select(*HISTORY_CASTS, *DERIVED), rejects
