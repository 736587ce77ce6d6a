"""Secret scan with a trigram inverted index over the texts.

Every rule is a regular expression. Its mandatory trigrams become a Boolean query
(``trigrams.trigram_query``). The index holds, for every trigram that some query names, the ids
of the texts that hold it in lower case. Intersecting the postings gives the candidates
of each rule, and only those texts are searched with the expression; a rule without mandatory
trigrams scans all texts. The index never loses a match: it only says where none can be.

Defined cases: a null text is empty and holds no secret; rows that share an id, or have none, share their
candidates and are searched one by one; an empty table gives an empty result; columns
besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.trigrams import trigram_query
from driftline.session import join_small, materialise


@dataclass(frozen=True)
class SecretRule:
    """``min_length`` holds for ``group``; shorter finds are dropped after matching."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 1


#: ``hex`` and ``access`` ask for the length inside the expression: their match is a maximal run
#: from its start, so this drops the same runs as a check afterwards.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    SecretRule("url_login", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%!*-]+@"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def trigram_index(docs: DataFrame, rules: Sequence[SecretRule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (``trigram``, ``doc_id``) of the trigrams that the rules ask for, written in trigram order."""
    grams = sorted({g for r in rules for option in trigram_query(r.regex) or [] for g in option})
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select("doc_id", held.alias("held")).select("doc_id", F.explode("held").alias("trigram"))
    return materialise(postings.sortWithinPartitions("trigram", "doc_id"), "trigram-index")


def candidates(index: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """``doc_id`` and ``rules``: the names of the rules whose query its postings satisfy."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    grams = sorted({g for q in queries.values() for option in q or [] for g in option})
    place = {g: n for n, g in enumerate(grams)}
    words = -(-len(grams) // 62)
    masks = [F.create_map(*[F.lit(x) for g in grams if place[g] // 62 == n for x in (g, 1 << (place[g] % 62))]) for n in range(words)]
    known = index.filter(F.col("trigram").isin(grams))
    bits = [F.bit_or(F.coalesce(mask[F.col("trigram")], F.lit(0)).cast("long")).alias(f"bits{n}") for n, mask in enumerate(masks)]
    held = known.groupBy("doc_id").agg(*bits)

    def satisfied(query):
        out = F.lit(False)
        for option in query:
            all_of = F.lit(True)
            for n in range(words):
                mask = sum(1 << (place[g] % 62) for g in option if place[g] // 62 == n)
                if mask:
                    all_of = all_of & (F.col(f"bits{n}").bitwiseAND(F.lit(mask)) == F.lit(mask))
            out = out | all_of
        return out

    named = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(kind)) for kind, q in queries.items() if q]))
    return held.select("doc_id", named.alias("rules")).filter(F.size("rules") > 0)


def find_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: spans (start, rank of the rule, end, kind, secret) in order, of every row.

    Offsets count code points; ends are exclusive. A match is placed by cutting the text at
    the expression: what lies between the cuts and the matches alternate.
    """
    wanted = materialise(candidates(trigram_index(docs, rules, doc_id, text), rules), "secret-candidates")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Null ids have candidates as any other id, and meet them only in a null-safe join.
    rows = join_small(rows, wanted.withColumnRenamed("doc_id", "asked_id"), F.col("doc_id").eqNullSafe(F.col("asked_id")), "left")
    parts = []
    for rank, rule in enumerate(rules):
        asked = F.lit(True) if trigram_query(rule.regex) is None else F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        hit = asked & F.col("t").rlike(rule.regex)
        found = {"m": F.regexp_extract_all("t", F.lit(rule.regex), F.lit(0)), "gaps": F.split("t", rule.regex)}
        if rule.group:
            found["g"] = F.regexp_extract_all("t", F.lit(rule.regex), F.lit(rule.group))
        parts.append(F.when(hit, F.struct(*[c.alias(name) for name, c in found.items()])).alias(f"p{rank}"))
    rows = rows.select("doc_id", *parts)
    # Ends are running sums of the lengths: each step adds what lies twice as far back, so n matches take n log n.
    rows = rows.select("doc_id", *[f"p{rank}" for rank in range(len(rules))], *[F.expr(f"""case when p{rank} is not null then aggregate(
            filter(transform(sequence(0, 30), k -> shiftleft(1, k)), d -> d < size(p{rank}.m)),
            zip_with(slice(p{rank}.gaps, 1, size(p{rank}.m)), p{rank}.m, (gap, m) -> cast(length(gap) + length(m) as bigint)),
            (sums, d) -> transform(sums, (x, i) -> x + if(i < d, 0L, get(sums, i - d)))) end""").alias(f"e{rank}") for rank in range(len(rules))])
    spans = []
    for rank, rule in enumerate(rules):
        secret = "g" if rule.group else "m"
        spans.append(F.expr(f"""case when p{rank} is not null then filter(
            zip_with(e{rank}, zip_with(p{rank}.m, p{rank}.{secret}, (m, g) -> struct(m as m, g as g)), (e, x) -> struct(
              e - length(x.m) as start, {rank} as rank, e as end, '{rule.kind}' as kind, x.g as secret)), x -> length(x.secret) >= {rule.min_length})
          else cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,secret:string>>) end"""))
    return rows.select("doc_id", F.sort_array(F.concat(*spans)).alias("found"))
