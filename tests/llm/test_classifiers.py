import math
import random

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import positive_unlabelled as pu
from driftline.llm import toxicity
from driftline.llm.queries import QUERIES

DRAW = random.Random(8)
BASE = "/root/testdata/sf0.01"


def prose(n):
    return " ".join(DRAW.choice(["some", "words", "make", "text", "of", "the", "usual", "kind", "here", "there"]) + str(DRAW.randrange(90)) for _ in range(n)) + "."


def junk(n):
    return " ".join(f"w{DRAW.randrange(50)}***" for _ in range(n))


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_features_do_not_depend_on_the_batch():
    texts = [None, "", " ", "a", "A!! B!!", "x\ny\nx\nx", prose(300), junk(80), "é　日本", "w " * 50000]
    whole = pu.text_features(pa.array(texts, pa.string()))
    for t, x in zip(texts, whole):
        assert np.allclose(pu.text_features(pa.array([t], pa.string()))[0], x)
    assert whole.min() >= 0 and whole.max() <= 1 and whole.shape == (10, pu.N_FEATURES)
    assert pu.text_features(pa.array([], pa.string())).shape == (0, pu.N_FEATURES)


def test_positive_unlabelled(spark):
    rows = [(i, prose(DRAW.randint(30, 300)) if i % 5 else junk(DRAW.randint(30, 300)), "x") for i in range(1500)]
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (1, rows[1][1], "x")], "doc_id long, text string, positive string")
    trusted = spark.createDataFrame([(i,) for i in range(1500) if i % 5 and i % 3 == 0], "doc_id long")
    model = pu.fit(pu.feature_table(docs), trusted)
    assert 0.7 < model.prior < 0.9
    got = docs.select("doc_id", model.column("text").alias("s")).collect()
    good = np.array([r.doc_id % 5 > 0 for r in got if r.doc_id < 1500])
    score = np.array([r.s for r in got if r.doc_id < 1500])
    assert (score[good] >= 0.7).mean() > 0.98 and (score[~good] < 0.7).mean() > 0.98
    assert all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if r.doc_id == 1}) == 1


def test_positive_unlabelled_without_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = docs.limit(0)
    assert pu.fit(pu.feature_table(none), none.select("doc_id")).prior == 0.5
    model = pu.fit(pu.feature_table(docs), none.select("doc_id"))
    assert docs.select(model.column("text").alias("s")).head().s == pytest.approx(0.5)


def test_risk_is_minimal_and_not_negative(spark):
    """Against a plain evaluation of the risk around the weights found."""
    rows = [(i, prose(40) if i % 3 else junk(40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [i for i in range(300) if i % 3 and i % 2]
    model = pu.fit(pu.feature_table(docs), spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    x = pu.text_features(pa.array([t for _, t in rows])).astype(np.float32).astype(float)

    def risk(w, prior, ridge):
        g, p = x @ w, x[ids] @ w
        negatives = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, p).mean()
        return -prior * p.mean() + np.logaddexp(0, g).mean() + ridge / 2 * w @ w, negatives
    assert risk(model.weights, model.prior, 1e-4)[1] >= -1e-6
    packed = pu.feature_table(docs).selectExpr("x", "doc_id % 3 <> 0 and doc_id % 2 = 1 as positive")
    w, _ = pu._newton(packed, 0.6, False, 25, 1e-2)
    for _ in range(100):
        assert risk(w + np.array([DRAW.gauss(0, 0.3) for _ in w]), 0.6, 1e-2)[0] >= risk(w, 0.6, 1e-2)[0] - 1e-4


def test_ftrl_equals_a_plain_loop():
    examples = [(np.array(sorted(DRAW.sample(range(30), 6)) + [1 << toxicity.BUCKET_BITS]), DRAW.randint(0, 1)) for _ in range(200)]
    w, bias = toxicity.ftrl(examples, 0.5, 1.0, 0.3, 0.1, 2)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= 0.3:
            return 0.0
        return -(z[i] - math.copysign(0.3, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)
    for _ in range(2):
        for at, y in examples:
            now = {int(i): weight(int(i)) for i in at}
            g = 1 / (1 + math.exp(-sum(now.values()))) - y
            for i, v in now.items():
                z[i] = z.get(i, 0) + g - (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / 0.5 * v
                n[i] = n.get(i, 0) + g * g
    assert all(abs(w[i] - weight(i)) < 1e-9 for i in range(30)) and abs(bias - weight(1 << toxicity.BUCKET_BITS)) < 1e-9


def test_toxicity(spark):
    def text(bad):
        words = prose(60).split()
        for _ in range(2 * bad):
            words.insert(DRAW.randrange(len(words)), DRAW.choice(["Vile,", "nasty", "awful!"]))
        return " ".join(words)
    rows = [(i, text(i % 6 == 0)) for i in range(1200)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(800)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for shard_rows in (5000, 400):
        model = toxicity.fit(docs, labels, shard_rows=shard_rows)
        got = {r.doc_id: r.s for r in docs.select("doc_id", model.column("text").alias("s")).collect()}
        held = np.array([got[i] for i in range(800, 1200)])
        assert ((held >= 0.5) == np.array([i % 6 == 0 for i in range(800, 1200)])).mean() > 0.97
        assert got[9000] == got[9001] and 0 < got[9000] < 0.5 and len(model.index) < 2000
    none = toxicity.fit(docs, labels.limit(0))
    assert docs.select(none.column("text").alias("s")).head().s == 0.5 and docs.limit(0).select(model.column("text")).count() == 0


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{BASE}/labels.parquet").toPandas()
    for name, label, least in (("op5_quality_classifier", "quality", 0.97), ("op8_toxicity", "toxic", 0.85)):
        got = QUERIES[name](spark, BASE).toPandas()
        assert len(got) == 1000 and got.score.between(0, 1).all()
        held = got.merge(labels, on="doc_id").query("held_out")
        assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


def test_an_id_of_many_rows_trains_toxicity_once(spark):
    rows = [(i, f"word{i % 7} {'vile slur' if i % 2 else 'kind note'} tail{i % 5}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    one = toxicity.fit(spark.createDataFrame(rows, schema), labels, l1=0.1)
    many = toxicity.fit(spark.createDataFrame(rows + [rows[1]] * 500, schema), labels, l1=0.1)
    assert len(one.index) and one.index.tolist() == many.index.tolist()
    assert one.value.tolist() == many.value.tolist() and one.bias == many.bias
