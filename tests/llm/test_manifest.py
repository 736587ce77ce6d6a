import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.llm.manifest import build_manifest, verified
from driftline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, place int, own string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    n = n if n is None else n + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def climb(nodes, arity):
    """The root, and each node's siblings (left and right) level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[k:k + arity] for k in range(0, len(nodes), arity)]
        for i, p in enumerate(at):
            run, slot = runs[p // arity], p % arity
            paths[i].append((run[:slot], run[slot + 1:]))
        at, nodes = [p // arity for p in at], [h("".join(r)) for r in runs]
    return nodes[0], paths


def fold(own, path):
    for left, right in path:
        own = h("".join([*left, own, *right]))
    return own


def plain(rows, arity=2, tampers=lambda i: False):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subroots, groups = [], []
    for lang in langs:
        held = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = climb([leaf(r) for r in held], arity)
        subroots.append(subroot)
        groups.append((held, subroot, paths))
    root, tops = climb(subroots, arity)
    out = []
    for (held, subroot, paths), top in zip(groups, tops):
        for row, path in zip(held, paths):
            whole = path + top
            now = fold(leaf(row, 1 if tampers(row[0]) else 0), whole)
            out.append((row[0], leaf(row), subroot, root, h("".join(x for l, r in whole for x in l + r)), now, now == root))
    return sorted(out, key=repr)


def got(spark, rows, arity=2, parts=5):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    tampered = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = verified(build_manifest(docs, {"n_chars": tampered}, arity=arity), arity)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=repr)


def table():
    rows = [(i * 7 % 101, f"text {i} é" * (i % 4), ["en", "fr", "日本", "a"][i % 7 % 4], "s" if i % 5 else None, i) for i in range(90)]
    rows += [(5, None, None, None, None), (6, "", None, "", 0), (None, "no id", "en", "s", 1), (None, "no id, either", "en", "s", 1)]
    rows += [(3, "alone", "zz", "s", 5)] + [(12, "again", "fr", "s", 7)] * 30 + [(12, "other", "fr", "s", 7)] + [(200, "long " * 200_000, "en", "s", 9)]
    return rows


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_is_the_plain_tree(spark, arity):
    rows = table()
    want = plain(rows, arity, lambda i: i is not None and i % 3 == 0)
    assert got(spark, rows, arity) == want
    assert {w[-1] for w in want} == {True, False}


def test_shuffle_joins_give_the_same_tree(spark):
    spark.conf.set("driftline.broadcastRows", "0")
    try:
        assert got(spark, table()[:60]) == plain(table()[:60], 2, lambda i: i is not None and i % 3 == 0)
    finally:
        spark.conf.unset("driftline.broadcastRows")


def test_small_tables(spark):
    assert got(spark, []) == []
    one = [(4, "x", "en", None, 1)]
    assert got(spark, one) == plain(one) and got(spark, one)[0][3] == leaf(one[0])
    two = one + [(4, "x", None, None, 1)]
    assert got(spark, two) == plain(two)


def test_query_is_the_contract(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    found = QUERIES["op12_merkle_manifest"](spark, base).collect()
    rows = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found), key=repr)
    assert rows == plain(docs, 2, lambda i: zlib.crc32(str(i).encode()) % 7 == 0)
    link = duckdb.connect()
    link.execute(f"create view documents as select * from read_parquet('{base}/documents.parquet')")
    columns = sorted(found[0].asDict())
    want = link.execute(f"select {', '.join(columns)} from ({ORACLES['op12_merkle_manifest']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in found)
