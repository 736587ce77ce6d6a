"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op4_quality_rules")
def op4(spark, sf_dir):
    from driftline.llm.quality_rules import judge

    judged = judge(documents(spark, sf_dir))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")


@query("op7_licence_scan")
def op7(spark, sf_dir):
    from driftline.llm.licences import find_licences

    found = find_licences(documents(spark, sf_dir))
    return found.select("doc_id", "line", "licence", F.round("dice", 6).alias("dice"), "passage")


@query("op10_secret_scan")
def op10(spark, sf_dir):
    from driftline.llm.secrets import BASE_RULES, find_secrets

    found = find_secrets(documents(spark, sf_dir))
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)

    def digest(spans: str):
        return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")

    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE_RULES]
    rows = found.select("doc_id", "found", F.expr(f"filter(found, x -> x.kind in ({base}))").alias("base"), *counts)
    return rows.select("doc_id", *[f"n_{r.kind}" for r in BASE_RULES], F.sha2(digest("base"), 256).alias("base_sha256"),
                       digest("found").alias("spans"))


def trusted_labels(spark: SparkSession, sf_dir: str, folds: int, held_out: int) -> DataFrame:
    """The label rows that may be learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)


def fold(folds: int, held_out: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out).alias("held_out")


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    from pyspark.sql.types import DoubleType

    from driftline.llm import positive_unlabelled as pu

    features = pu.feature_table(documents(spark, sf_dir))
    model = pu.fit(features, trusted_labels(spark, sf_dir, 4, 2).filter("quality = 1"))
    score = F.round(pu.score_packed(model)("x"), 9).cast(DoubleType())
    scored = features.select("doc_id", fold(4, 2), score.alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    from driftline.llm import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, trusted_labels(spark, sf_dir, 5, 0))
    scored = docs.select("doc_id", fold(5, 0), model.column("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_token_files")
def op3(spark, sf_dir):
    import public_tokenizers

    from driftline.llm.token_files import read_documents, write_token_files
    from driftline.session import new_path

    path = new_path(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(manifest, path=path)


@query("op2_source_mix")
def op2(spark, sf_dir):
    from driftline.llm.mixing import mix_sizes

    mixed = mix_sizes(documents(spark, sf_dir))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("taken") * F.col("size")).alias("taken"), "source")


_COMPONENTS = r"""with recursive w as (select doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
x as (select doc_id, unnest(s) as g from s),
p as (select l.doc_id as a, r.doc_id as b, count(*) as c from x l join x r on l.g = r.g and l.doc_id < r.doc_id group by all),
e as (select a, b from p join n l on a = l.doc_id join n r on b = r.doc_id where 100 * c >= 75 * (l.n + r.n - c)),
both_ways as (select a, b from e union all select b, a from e),
reach(doc_id, comp) as (select doc_id, doc_id from n union select b, comp from reach join both_ways on reach.doc_id = a)
select doc_id, n as n_shingles, min(comp) as component_id from reach join n using (doc_id) group by doc_id, n"""


@query("op1_ngram_join", _COMPONENTS)
def op1(spark, sf_dir):
    from driftline.llm.ngram_join import similar_components

    return similar_components(documents(spark, sf_dir))


@query("op6_decontamination")
def op6(spark, sf_dir):
    from driftline.llm.decontamination import find_leaks

    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("op9_language_id")
def op9(spark, sf_dir):
    from driftline.llm.language import count_trigrams, identify

    found = identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), count_trigrams(documents(spark, sf_dir)))
    return found.withColumn("probability", F.round("probability", 6))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    from driftline.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# CRC-32 from its table by rule, the trees level by level, each document's siblings, and its leaf folded over them.
_MERKLE = r"""with recursive t(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, xor(v >> 1, (v & 1) * 3988292384) from t where k < 8),
tab as (select list(v order by i) as tab from t where k = 8),
d as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) % 7 = 0 as tampered from documents, tab),
l as (select doc_id, lang, leaf, case when tampered and n_chars is not null then
    sha256(head || strlen(cast(n_chars + 1 as varchar)) || ':' || cast(n_chars + 1 as varchar) || tail) else leaf end as now,
  row_number() over (partition by lang order by doc_id) - 1 as place, count(*) over (partition by lang) as n
  from (select *, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') || tail) as leaf from (select *,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head, coalesce(strlen(text) || ':' || text, '-') as tail from d))),
g as (select row_number() over (order by lang nulls first) as g, lang from (select distinct lang from l)),
tree(g, level, place, n, h) as (select g, 0, place, n, leaf from l join g on l.lang is not distinct from g.lang
  union all select g, max(level) + 1, place // 2, max((n + 1) // 2), sha256(string_agg(h, '' order by place)) from tree where n > 1 group by g, place // 2),
subroot as (select g, max(level) as depth, max_by(h, level) as h from tree where n = 1 group by g),
top(level, place, n, h) as (select 0, g - 1, (select count(*) from subroot), h from subroot
  union all select max(level) + 1, place // 2, max((n + 1) // 2), sha256(string_agg(h, '' order by place)) from top where n > 1 group by place // 2),
root as (select max_by(h, level) as h from top where n = 1),
row_at as (select doc_id, l.lang, leaf, now, place, g.g, depth, s.h as subroot from l join g on l.lang is not distinct from g.lang join subroot s on s.g = g.g),
steps as (select r.doc_id, t.level, (r.place >> t.level) & 1 as slot, t.h from row_at r join tree t
    on t.g = r.g and t.place = xor(r.place >> t.level, 1) and t.n > 1 and t.level < depth
  union all select r.doc_id, depth + t.level, ((r.g - 1) >> t.level) & 1, t.h from row_at r join top t on t.place = xor((r.g - 1) >> t.level, 1) and t.n > 1),
height as (select max(level) as top_depth from top),
fold(doc_id, level, last, h) as (select doc_id, 0, depth + top_depth, now from row_at, height
  union all select f.doc_id, f.level + 1, last, sha256(case when s.h is null then f.h when s.slot = 1 then s.h || f.h else f.h || s.h end)
  from fold f left join steps s on s.doc_id = f.doc_id and s.level = f.level where f.level < last),
proof as (select doc_id, sha256(string_agg(h, '' order by level)) as p from steps group by doc_id)
select r.doc_id, r.lang, r.place, r.leaf, r.subroot, root.h as root, coalesce(p, sha256('')) as proof_sha256, f.h as folded_root, f.h = root.h as verified
from row_at r join fold f on f.doc_id = r.doc_id and f.level = f.last left join proof on proof.doc_id = r.doc_id, root"""


@query("op12_merkle_manifest", _MERKLE)
def op12(spark, sf_dir):
    from driftline.llm.manifest import build_manifest, verified

    sevenths = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(sevenths, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = verified(build_manifest(documents(spark, sf_dir), {"n_chars": tampered}))
    return found.withColumnRenamed("grp", "lang")


@query("op11_bin_packing")
def op11(spark, sf_dir):
    import public_tokenizers

    from driftline.llm.packing import pack

    packed = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
