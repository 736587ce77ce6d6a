import random

import pyarrow as pa
import pyarrow.parquet as pq
from brute import WORD

import corpus_pipeline
from driftline.session import materialise

DRAW = random.Random(6)
VOCAB = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("", "n", "ring", "ly", "ter")]


def prose(n):
    return [DRAW.choice(VOCAB) for _ in range(n)]


def planted(folder):
    items = [prose(30) for _ in range(3)]
    rows = [(i, " ".join(prose(DRAW.randint(60, 200))) + ".", "en", f"s{i % 3}") for i in range(240)]
    rows += [(300 + i, " ".join(w + "***" for w in prose(80)), "en", "s0") for i in range(30)]
    rows += [(400 + i, rows[i][1] + f" extra{i}", "en", "s1") for i in range(20)] + [(450 + i, rows[7][1], "en", None) for i in range(5)]
    rows += [(500 + i, " ".join(prose(50) + items[i] + prose(50)), "en", "s2") for i in range(3)]
    rows += [(600, None, None, None), (601, "", "en", "s1")]
    names = ["doc_id", "text", "lang", "source"]
    table = pa.table({n: pa.array([r[k] for r in rows], pa.int64() if n == "doc_id" else pa.string()) for k, n in enumerate(names)})
    pq.write_table(table.append_column("n_chars", pa.array([len(r[1] or "") for r in rows])), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1, 2], "text": [" ".join(x) for x in items]}), f"{folder}/benchmark.parquet")
    ids = [r[0] for r in rows if r[0] % 2]
    pq.write_table(pa.table({"doc_id": ids, "quality": [int(not 300 <= i < 400) for i in ids], "toxic": [0] * len(ids)}), f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_each_stage_decides_on_its_own_input(spark, tmp_path):
    rows = planted(tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "stage")
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:4])
    kept = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert not [i for i in kept[0] if 300 <= i < 400] and len([i for i in kept[0] if i < 300]) >= 200
    alone = set(kept[0]) & set(range(240))
    assert set(kept[1]) >= alone and not [i for i in kept[1] if 400 <= i < 500 and i - 400 in alone] and len(set(kept[1]) & set(range(450, 455))) == 0
    assert set(kept[2]) == set(kept[1]) - {500, 501, 502}
    total = {i: len(WORD.findall(rows[i][1] or "")) for i in kept[2]}
    assert set(kept[3]) <= set(kept[2]) and abs(sum(total[i] for i in kept[3]) / sum(total.values()) - 1.5) < 0.02
    assert kept[4] == kept[3]


def test_run_is_the_stages(spark, tmp_path):
    planted(tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"} and got.count() > 200
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_decides_by_id_and_text(spark):
    one, two, three, four = (" ".join(prose(80)) for _ in range(4))
    rows = [(1, one), (5, one + " extra"), (5, two), (6, three), (6, three + " extra"), (None, three + " more"), (None, four),
            (None, four + " extra"), (7, two + " extra"), (8, None), (None, None), (None, ""), (9, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for copies in (docs, docs.union(docs.filter("doc_id = 1 or text like '%extra'"))):
        kept = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.near_copies(spark, copies, "").collect())
        ids = [i for i, _ in kept]
        assert ids == [0, 0, 0, 1, 5, 6, 8, 9] and (1, one) in kept and (5, two) in kept
        assert len([t for i, t in kept if i == 0 and t.startswith(four)]) == 1 and len([t for _, t in kept if t.startswith(three)]) == 1
