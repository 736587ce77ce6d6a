"""Every registered query of the package, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from driftline.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are absent")
COLUMNS = {
    "op1_ngram_join": {"doc_id", "n_shingles", "component_id"}, "op2_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5_quality_classifier": {"doc_id", "held_out", "score", "predicted"}, "op6_decontamination": {"doc_id", "item_id", "similarity"},
    "op7_licence_scan": {"doc_id", "licence", "dice"}, "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_language_id": {"page_id", "lang", "probability"}, "op10_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_bin_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op12_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op13_embedding_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, BASE)
    assert COLUMNS[name] <= set(got.columns)
    if name not in ("op6_decontamination", "op7_licence_scan", "op9_language_id", "op13_embedding_whitening"):
        docs = {r.doc_id for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in got.select("doc_id").collect()} == docs


def test_every_number_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and "pipeline" in entry.queries()
