from collections import Counter, defaultdict

from brute import WORD

from driftline.llm.mixing import mix_sizes, mixed_documents

SCHEMA = "doc_id long, text string, source string, target double"


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            out[s] += left * weight[s] / total
        left = sum(max(0, out[s] - 2 * sizes[s]) for s in free)
        for s in [s for s in free if out[s] >= 2 * sizes[s]]:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
    return out


def rows(n=3000):
    out = []
    for i in range(n):
        text = None if i % 211 == 0 else "" if i % 199 == 0 else "w " * (1 + i * 7919 % (900 if i % 50 == 0 else 90))
        out.append((i, text, ["a", "hot", "B", "é", "\U0001f600", None, "tiny"][min(i % 9, 6) if i % 3 else 1], 1.0))
    return out


def test_targets_and_totals(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mix_sizes(docs, leaf_rows=50).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    by = defaultdict(int)
    for i, _, s, _ in rows():
        by[s] += size[i]
    want, taken = plain_targets(by), Counter()
    assert sorted(r.key for r in got) == list(range(3000))
    for r in got:
        assert (r.size, r.source_size) == (size[r.key], by[r.source]) and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2
        taken[r.source] += r.taken * r.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= 90, (s, taken[s], target)
    again = mix_sizes(docs.repartition(3), leaf_rows=50).collect()
    assert {r.key: r.taken for r in got} == {r.key: r.taken for r in again}


def test_expected_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 4 else "b", 0.0) for i in range(4000)], SCHEMA)
    for source, rate in (("a", 1.5), ("b", 1.5)):
        got = [r.taken for r in mix_sizes(docs, weights=(3, 1), leaf_rows=100).collect() if r.source == source]
        assert abs(sum(got) / len(got) - rate) < 0.05 and set(got) == {1, 2}


def test_rows_repeat_and_empty(spark):
    docs = spark.createDataFrame(rows(300) + [(1, "x y", "a", 1.0)] * 3, SCHEMA).withColumn("key", docs_extra())
    out = mixed_documents(docs, leaf_rows=20)
    assert out.columns == docs.columns
    n = Counter(tuple(r)[:3] for r in out.collect())
    assert n[(1, "x y", "a")] in (0, 3, 6) and max(n.values()) <= 6
    assert mix_sizes(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def docs_extra():
    from pyspark.sql import functions as F
    return F.lit("clash")
