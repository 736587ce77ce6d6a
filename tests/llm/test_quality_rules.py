from collections import Counter

from brute import counts

from driftline.llm.quality_rules import LabelModel, RULES, fit_label_model, judge, text_counts, with_votes

SCHEMA = "doc_id long, text string, n_words string, t int"
ODD = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "é\x0bß\x0c# |<>", "l\n\nl\n l\nl\n", "a b c d a b c e b c d",
       " wide space", "w " * 30000, "A!! B!! C!! " * 40]


def test_counts_are_those_of_a_plain_loop(spark):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD + ODD)], SCHEMA)
    got = {r.doc_id: tuple(r[1:6]) for r in text_counts(rows).collect()}
    assert got == {i: counts(t) for i, t in enumerate(ODD + ODD)}


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_em_equals_a_plain_em(spark):
    votes = [(1, 0, 1), (1, 0, 0), (0, -1, 1), (-1, -1, 0), (1, 1, 1), (-1, 0, -1)]
    rows = [(list(v), n) for v, n in zip(votes, (40, 30, 6, 5, 50, 4))]
    table = spark.createDataFrame([(v,) for v, n in rows for _ in range(n)], "votes array<int>")
    got = fit_label_model(table, RULES[:3], rounds=7, tolerance=0)
    prior, accuracies = 0.8, [0.9] * 3
    for _ in range(7):
        right, cast, good, total = [1.0] * 3, [2.0] * 3, 1.0, 2.0
        for v, n in rows:
            p = [prior, 1 - prior]
            for j, x in enumerate(v):
                if x:
                    p = [p[0] * (accuracies[j] if x > 0 else 1 - accuracies[j]), p[1] * (accuracies[j] if x < 0 else 1 - accuracies[j])]
            p = [x / sum(p) for x in p]
            good, total = good + n * p[0], total + n
            for j, x in enumerate(v):
                if x:
                    right[j] += n * p[x < 0]
                    cast[j] += n
        prior, accuracies = good / total, [r / c for r, c in zip(right, cast)]
    assert abs(got.prior - prior) < 1e-9
    assert all(abs(a - b) < 1e-9 for a, b in zip(got.accuracies, accuracies))
    assert isinstance(got, LabelModel)


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"word{i % 97}{chr(97 + i % 23)} text." for i in range(150))
    rows = [(i, prose + f" end{i}") for i in range(200)] + [(1000 + i, f"THE{i}!! AND!! OF!! IT!! " * 40) for i in range(20)]
    rows += [(2000 + i, f"a{i}*** b&&& c### d%%% e$$$ " * 20) for i in range(20)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.good for r in got if r.doc_id < 1000) == {True: 200}
    assert not any(r.good for r in got if r.doc_id >= 1000)
    assert with_votes(spark.createDataFrame([], "n_words long"), ()).columns[-1] == "votes"
