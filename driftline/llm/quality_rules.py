"""Weak supervision of text quality: rules vote or abstain, and EM finds how far to trust each.

The text is read once and becomes one row of counts; nothing but counts is written or shuffled.
Rules look at the counts and vote 1 (good), -1 (bad) or abstain (0). The votes of all documents
are reduced to a table of vote patterns (at most 3 to the power of the rules), and
expectation-maximisation over that table estimates, for each rule, how often it votes either way
on good and on bad documents. A document is kept where the posterior probability of good is at
least one half.

Defined cases: a null text has no words; documents with equal counts get equal verdicts; an empty
table gives an empty result; repeated rows are judged one by one; columns other than the
id and the text are not looked at and not returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_distinct", "n_upper", "n_calls", "n_digits", "n_symbol_words")


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the counts; where neither holds it abstains."""

    name: str
    bad: str
    good: str = "false"


#: EM learns from agreement, so every kind of junk has two rules that look at it from different
#: sides, and a rule votes good only where it sees no sign of any kind.
RULES = (
    Rule("symbols", "n_symbols > 0.03 * word_chars"),
    Rule("symbol_words", "n_symbol_words > 0.15 * n_words"),
    Rule("repeated_words", "n_repeat_words > 0.35 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines"),
    Rule("variety", "n_words >= 40 and n_words < 4000 and n_distinct < 0.2 * n_words"),
    Rule("capitals", "n_upper > 0.3 * word_chars"),
    Rule("exclamations", "n_calls > 0.3 * n_words"),
    Rule("digits", "n_digits > 0.3 * word_chars"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words"),
    Rule("prose", "n_words < 5", "n_words >= 20 and word_chars between 3 * n_words and 10 * n_words and n_upper < 0.15 * word_chars"
         " and n_symbols < 0.02 * word_chars and n_repeat_words < 0.2 * n_words"),
    Rule("varied_words", "false", "n_words >= 20 and n_repeat_words < 0.2 * n_words and n_dup_lines <= 0.1 * n_lines"
         " and n_calls < 0.1 * n_words and n_symbol_words < 0.05 * n_words and n_upper < 0.15 * word_chars"),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the counts of every whole text. No rows are moved.

    Repeated windows are found by sorting the hashes of the 3-word windows of a text beside
    their places, only where a hash occurs twice.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.btrim("t", F.lit(SPACE_CHARS)).alias("s"))
    rows = rows.select("doc_id", "t", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(
        F.split("s", f"[{SPACE}]+")).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "").alias("lines"))
    plain = F.translate("t", SPACE_CHARS, "")
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(plain).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _without(F.col("t"), "!").cast("long").alias("n_calls"),
        _without(F.col("t"), "0123456789").cast("long").alias("n_digits"),
        F.size(F.filter("w", lambda x: F.translate(x, SYMBOLS, "") != x)).cast("long").alias("n_symbol_words"),
        F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(slice(w, 1, size(w) - 2), "
               "(x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))) end").alias("keys"))
    kept = ["doc_id", *COUNTS[:4], *MORE_COUNTS]
    rows = rows.select(*kept, F.expr(
        "case when size(array_distinct(keys)) < size(keys) then "
        "sort_array(transform(keys, (x, i) -> struct(x as h, i as i))) end").alias("s"))
    rows = rows.select(*kept, F.expr(
        "case when s is not null then sort_array(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or "
        "x.h <=> get(s, i + 1).h), x -> x.i)) end").alias("at"))
    repeated = F.expr("coalesce(aggregate(transform(at, (x, i) -> least(3, coalesce(get(at, i + 1), x + 3) - x)), "
                      "0L, (total, x) -> total + x), 0L)")
    return rows.select("doc_id", *COUNTS[:4], repeated.alias("n_repeat_words"), *MORE_COUNTS)


def with_votes(counts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return counts.withColumn("votes", F.array(*[
        F.when(F.expr(r.bad), F.lit(-1)).when(F.expr(r.good), F.lit(1)).otherwise(F.lit(0)) for r in rules]))


@dataclass(frozen=True)
class LabelModel:
    """``prior``: share of good documents; ``accuracies``: how often a rule is right where it votes."""

    prior: float
    accuracies: tuple[float, ...]

    def log_odds(self, votes: Column) -> Column:
        """Log odds of good: each vote counts by the odds of its rule, an abstention says nothing."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, a in enumerate(self.accuracies):
            total = total + votes[j] * math.log(a / (1 - a))
        return total

    def posterior(self, votes: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit_label_model(voted: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = 30, tolerance: float = 1e-4,
                    prior: float = 0.8, accuracy: float = 0.9) -> LabelModel:
    """EM over the vote patterns of all rows, from the given start.

    Each round is one small aggregation over the pattern table. One right and one wrong vote are
    added to every rule, so that accuracies stay inside (0, 1) and a rule that never votes
    stays neutral.
    """
    patterns = materialise(voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "vote-patterns")
    model = LabelModel(prior, (accuracy,) * len(rules))
    for _ in range(rounds):
        weighted = patterns.select("votes", "n", (F.col("n") * model.posterior(F.col("votes"))).alias("g"))
        n, g = F.col("n"), F.col("g")
        cells = []
        for j in range(len(rules)):
            vote = F.col("votes")[j]
            cells += [F.sum(F.when(vote == 1, g).when(vote == -1, n - g).otherwise(0.0)), F.sum(F.when(vote != 0, n).otherwise(0.0))]
        found = list(weighted.agg(F.sum("n"), F.sum("g"), *cells).head())
        if not found[0]:
            return model
        new = LabelModel((found[1] + 1) / (found[0] + 2),
                         tuple((right + 1) / (cast + 2) for right, cast in zip(found[2::2], found[3::2])))
        moved = max(abs(a - b) for a, b in zip(new.accuracies, model.accuracies))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, keep_from: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``votes``, ``quality`` (posterior of good) and ``good``."""
    voted = materialise(with_votes(text_counts(docs, doc_id, text), rules), "quality-votes")
    model = fit_label_model(voted, rules)
    judged = voted.withColumn("quality", model.posterior(F.col("votes")))
    return judged.withColumn("good", F.col("quality") >= keep_from)
