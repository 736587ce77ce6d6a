import random

import numpy as np
from brute import WORD

from test_token_files import thue_morse

from driftline.llm import ngram_join
from driftline.llm.ngram_join import components, similar_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, threshold=75):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def texts(seed=1):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: draw.choices(vocab, k=n)
    out = [None, "", " \n", "one", "ONE", "one two three four", "É x", "é x", "a b c d e", "a b c d e f"]
    passage = prose(60)
    for _ in range(25):
        base = prose(draw.choice([8, 30, 80, 200]))
        for _ in range(draw.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            out.append(" ".join(copy[:draw.choice([len(copy), len(copy), len(copy) - 3])]))
    out += [" ".join(passage + prose(draw.randint(5, 40))) for _ in range(40)]
    out += [" ".join(prose(6)) + " " + " ".join(passage) for _ in range(10)] + [out[20]] * 5
    draw.shuffle(out)
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs).collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows)


def test_components_are_those_of_all_pairs(spark):
    check(spark, texts())


def test_a_sketch_too_small_for_the_repeated_shingles(spark, monkeypatch):
    """Then the rare ones count as class 0 and all prefixes are sent."""
    monkeypatch.setattr(ngram_join, "SKETCH_KEYS", 40)
    check(spark, texts(2))


def test_a_chain_longer_than_a_list(spark):
    words = [f"v{i}" for i in range(260)]
    check(spark, [" ".join(words[3 * i:3 * i + 60]) for i in range(60)])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.comp for r in components(edges).collect()} == {0}


def test_empty_table_and_repeated_ids(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (7, "other words"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in similar_components(docs).collect()) == [(0, 0), (3, 3), (7, 3), (7, 3), (7, 7)]
    assert similar_components(docs.limit(0)).count() == 0


def test_structured_words_are_told_apart(spark):
    rows = [f"{w} x y z u" for bits in range(10, 15) for w in thue_morse(bits)]
    check(spark, rows + rows[:2])


def test_bitmaps_differ_in_no_more_bits_than_sets_differ_in_shingles():
    draw = np.random.default_rng(5)
    for size in (1, 40, 300, 3000):
        x = draw.integers(0, 2**63, size).astype(np.uint64)
        for gone in (0, 1, size // 7, size):
            y = np.concatenate([x[gone:], draw.integers(0, 2**63, gone // 2).astype(np.uint64)])
            bits = np.unpackbits((ngram_join.bitmap(x) ^ ngram_join.bitmap(y)).view(np.uint8)).sum()
            assert bits <= len(np.setxor1d(x, y))
    assert bits > 0


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """Their lists are long and their sizes alike: bitmaps tell them apart before any whole set is read."""
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(110)]
    rows = [" ".join(passage + [f"x{draw.randrange(10**9)}" for _ in range(90)]) for _ in range(60)]
    rows += [rows[0] + " more", rows[1] + " more"]
    compared, verified = [], ngram_join._verified

    def counted(pairs, sets, threshold):
        compared.append(pairs.count())
        return verified(pairs, sets, threshold)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    # With shingles of many texts not told from rare ones, the prefixes hold those of the passage.
    monkeypatch.setattr(ngram_join, "SKETCH_KEYS", 0)
    check(spark, rows)
    assert 2 <= sum(compared) <= 10


def test_python_gets_few_bytes_at_once(spark, monkeypatch):
    held, names = [], ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    find = ngram_join.find_postings
    monkeypatch.setattr(ngram_join, "find_postings", lambda *a: held.append([spark.conf.get(name) for name in names]) or find(*a))
    similar_components(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert held == [[str(ngram_join.BATCH_ROWS), str(ngram_join.BATCH_BYTES)]]
    assert [spark.conf.get(name) for name in names] == before
