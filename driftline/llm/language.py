"""Language of web pages by Bayesian fusion of four kinds of evidence.

* *Text*: log likelihood of the page's visible text under byte-trigram counts of each language, learnt from labelled
  documents by grouped counting over all of them. The trigrams are hashed to ``BUCKETS`` classes, so the table
  that scoring needs is small whatever the corpus. All languages are scored, ``BLOCK`` at a time. Long texts are tempered: the sum counts as that of ``TEXT_WEIGHT``
  trigrams at most, since neighbouring trigrams are not independent.
* *Markup*: what the page declares in its ``lang`` attribute.
* *Address*: the country suffix of its host and a language code as the first part of its path.
* *Host*: the share of languages among all pages of the host, by text, markup and address. It is smoothed towards the shares
  of the registered domain, which are smoothed towards those of the top-level domain and of all pages:
  (count + strength * share above) / (total + strength). Pages of one host, even a third of all pages, only meet in sums.

How reliable markup and address are is learnt, too: P(declared | language) is counted from the pages' text
verdicts over all pages. The posterior is the product of all, normalised.

Defined cases: null pages and pages without text have no text evidence; an unknown or missing declaration and an address that is
null or names no language say nothing; with no evidence at all the host's, or the overall, shares decide; ties go to the
first language by name; equal pages get equal verdicts; an empty table gives an empty result, and with no
labelled documents the text says nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.texts import pieces, text_bytes
from driftline.session import join_small, materialise

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
TEXT_WEIGHT = 60.0
#: Languages scored at once: 8 MB of broadcast table.
BLOCK = 64
STRENGTH = 5.0
# Country suffixes whose main language is one of those served.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es",
            "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "tr": "tr"}


def trigram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every byte trigram; case is folded for A-Z, other bytes than letters read as a blank."""
    data, at = text_bytes(column)
    fold = np.full(256, 32, np.uint32)
    fold[128:] = np.arange(128, 256)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    x = fold[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    who = np.searchsorted(at, np.arange(len(key)), "right") - 1
    inside = (np.arange(len(key)) + 3 <= at[who + 1]) & (key != 0x202020)
    mixed = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return mixed[inside].astype(np.int64), who[inside]


def count_trigrams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all labelled documents; each task sends its sums only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches, "t"):
            key, who = trigram_buckets(b.column(1))
            names = b.column(0).to_pylist()
            index = {name: k for k, name in enumerate(dict.fromkeys(names))}
            of = np.array([index[n] for n in names])
            for name, k in index.items():
                total[name] = total.get(name, 0) + np.bincount(key[of[who] == k], minlength=BUCKETS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                                             ["lang", "bucket", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("t")).filter(F.col("lang").isNotNull())
    sums = rows.mapInArrow(run, "lang string, bucket int, n long")
    return sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """log P(bucket | language), one row per language."""
    table = np.full((len(languages), BUCKETS), 0.5)
    place = {x: k for k, x in enumerate(languages)}
    for r in counts.filter(F.col("lang").isin(list(languages))).toLocalIterator():
        table[place[r.lang], r.bucket] += r.n
    return np.log(table / table.sum(1, keepdims=True))


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, comments, navigation and tags."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def evidence(pages: DataFrame, languages: Sequence[str], counts: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``domain``, ``top``, ``declared``, ``addressed`` and ``text_log`` (one log likelihood per language)."""
    known = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    parts = F.split(host, r"\.")
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.element_at(parts, -1)]
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))).alias("domain"),
        F.element_at(parts, -1).alias("top"), F.when(F.array_contains(known, declared), declared).alias("declared"),
        F.when(F.array_contains(known, path), path).when(F.array_contains(known, suffix), suffix).alias("addressed"),
        visible_text(F.col(html)).alias("t"))
    rows = rows.withColumn("text_log", F.array().cast("array<double>"))
    # A task holds the table of one block at a time; between blocks the rows are written.
    for at in range(0, len(languages), BLOCK):
        score = _text_log(pages.sparkSession, text_model(counts, languages[at:at + BLOCK]))
        rows = rows.withColumn("text_log", F.concat("text_log", score("t")))
        rows = materialise(rows if at + BLOCK < len(languages) else rows.drop("t"), "page-evidence")
    return rows


def _text_log(spark: SparkSession, model: np.ndarray):
    """Column function of the texts' log likelihoods, one per row of ``model``."""
    shared = spark.sparkContext.broadcast(model.astype(np.float32))

    @F.arrow_udf("array<double>")
    def text_log(column: pa.Array) -> pa.Array:
        out = []
        for b in pieces(iter([pa.RecordBatch.from_arrays([column.cast(pa.string())], ["t"])]), "t"):
            key, who = trigram_buckets(b.column(0))
            n = np.bincount(who, minlength=b.num_rows)
            each = np.stack([np.bincount(who, row[key], b.num_rows) for row in shared.value], 1)
            out.append(each * (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None])
        return pa.array([r.tolist() for x in out for r in x], pa.list_(pa.float64()))

    return text_log


def _best(logs: Column, languages: Sequence[str]) -> Column:
    """The language of the largest number, the first of equals."""
    names = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    return names[F.array_position(logs, F.array_max(logs)).cast("int") - 1]


def _confusion(rows: DataFrame, column: str, languages: Sequence[str]) -> DataFrame:
    """``column`` and ``column_logs``: log P(said | language) for each language, counted over the pages where both are known."""
    found = rows.filter(F.col(column).isNotNull()).groupBy("by_text", column).count().collect()
    place = {x: k for k, x in enumerate(languages)}
    n = np.zeros((len(languages), len(languages)))
    for r in found:
        n[place[r.by_text], place[r[column]]] = r["count"]
    logs = np.log((n + 0.2 + 1.8 * np.eye(len(n))) / (n.sum(1, keepdims=True) + 2.0 + 0.2 * (len(n) - 1)))
    table = [(x, logs[:, k].tolist()) for x, k in place.items()]
    return rows.sparkSession.createDataFrame(table, f"{column} string, {column}_logs array<double>")


def identify(pages: DataFrame, counts: DataFrame, languages: Sequence[str] | None = None, strength: float = STRENGTH,
             page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``lang``, ``probability`` and what each kind of evidence alone says."""
    counts = materialise(counts, "trigram-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect()) if languages is None else list(languages)
    if not languages:
        return pages.select(F.col(page_id).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"),
                            *[F.lit(None).cast("string").alias(c) for c in ("by_text", "declared", "addressed", "host")])
    rows = evidence(pages, languages, counts, page_id, url, html)
    some = F.array_max("text_log") < 0
    rows = rows.withColumn("by_text", F.when(some, _best(F.col("text_log"), languages)))
    sure = rows.filter(F.col("by_text").isNotNull())
    own = F.col("text_log")
    for column in ("declared", "addressed"):
        rows = join_small(rows, _confusion(sure, column, languages), [column], "left")
        own = F.zip_with(own, F.coalesce(f"{column}_logs", F.array_repeat(F.lit(0.0), len(languages))), lambda x, y: x + y)
    rows = materialise(rows.withColumn("own", own).drop("declared_logs", "addressed_logs"), "page-own")
    # One vote per page, by its own evidence; host, domain and suffix only meet as sums.
    votes = rows.filter(some | F.col("declared").isNotNull() | F.col("addressed").isNotNull()).withColumn("vote", _best(F.col("own"), languages))
    hosts = materialise(votes.groupBy("top", "domain", "host", "vote").agg(F.count("*").cast("double").alias("n")), "host-votes")
    all_of = {r.vote: r.n for r in hosts.groupBy("vote").agg(F.sum("n").alias("n")).collect()}
    total = sum(all_of.values())
    above = F.array(*[F.lit((all_of.get(x, 0) + 1) / (total + len(languages))) for x in languages])

    def level(*keys: str) -> DataFrame:
        """The keys and ``votes``: those of each language that has some."""
        sums = hosts.groupBy(*keys, "vote").agg(F.sum("n").alias("n"))
        return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("votes"))

    def smoothed(parent: Column) -> Column:
        names = F.array(*[F.lit(x) for x in languages])
        whole = F.aggregate(F.map_values("votes"), F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(names, parent, lambda x, p: (F.coalesce(F.col("votes")[x], F.lit(0.0)) + strength * p) / (whole + strength))

    tops = level("top").select("top", smoothed(above).alias("share_top"))
    domains = level("top", "domain").join(tops, "top").select("domain", smoothed(F.col("share_top")).alias("share_domain"))
    shares = level("domain", "host").join(domains, "domain")
    shares = materialise(shares.select("host", smoothed(F.col("share_domain")).alias("share")), "host-shares")
    fused = join_small(rows, shares, ["host"], "left")
    total_log = F.zip_with("own", F.coalesce("share", above), lambda a, b: a + F.log(b))
    fused = fused.withColumn("z", total_log).withColumn("top_z", F.array_max("z"))
    probability = 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top_z")))
    return fused.select("page_id", _best(F.col("z"), languages).alias("lang"), probability.alias("probability"), "by_text", "declared", "addressed", "host")
