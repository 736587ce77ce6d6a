"""A corpus pipeline: quality, near copies, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is
written and read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontamination, mixing, ngram_join, token_files
from driftline.llm import positive_unlabelled as pu
from driftline.llm.queries import trusted_labels
from driftline.session import materialise, new_path

#: From which quality score on a document stays.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the positive-unlabelled classifier scores at least ``QUALITY``."""
    model = pu.fit(pu.feature_table(docs), trusted_labels(spark, sf_dir, 4, 2).filter("quality = 1"))
    return docs.filter(model.column("text") >= QUALITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the one with the smallest id, null ids last.

    Texts without words are in no group and stay; rows with one id and one text count as one document, rows with one id
    and different texts as several: they are decided by (id, text), equal ids by hashes of the texts.
    """
    names = ("no_id", "id", "h1", "h2")
    values = F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    key = F.struct(*[v.alias(n) for n, v in zip(names, values)])
    joined = materialise(ngram_join.similar_components(docs.select(key.alias("doc_id"), "text")), "components")

    def of(keys: DataFrame) -> tuple[DataFrame, Column]:
        """Distinct keys and the null-safe condition that a row of ``docs`` has one of them."""
        keys = keys.select(*[F.col(f"doc_id.{n}").alias(f"key_{n}") for n in names]).distinct()
        return keys, functools.reduce(lambda x, y: x & y, [v.eqNullSafe(F.col(f"key_{n}")) for n, v in zip(names, values)])

    kept = docs.join(*of(joined.filter(~ngram_join.first_of_component(joined))), "left_anti")
    doubled = joined.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    if doubled.isEmpty():
        return kept
    doubled = of(doubled)
    return kept.join(*doubled, "left_anti").unionByName(kept.join(*doubled, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; one row per document as read back from them."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    manifest = token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(manifest, path=path)


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("source mix", mixture),
    ("token files", tokens),
]

#: Training, random rounding and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
