import random
from collections import Counter

import numpy as np

from driftline.llm.decontamination import RADIUS, _ball, _fingerprints, _pairs, _running, clean_documents, find_leaks
from driftline.llm.texts import Words, text_bytes

DRAW = random.Random(4)
VOCAB = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300


def prose(n):
    return DRAW.choices(VOCAB, k=n)


ITEMS = [prose(n) for n in (5, 16, 23, 31, 40, 59)]


def bag(words):
    return Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def plain(text, item):
    words, best = (text or "").lower().split(), 0
    for s in range(max(1, len(words) - len(item) + 1)):
        a, b = bag(words[s:s + len(item)]), bag(item)
        if a | b:
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best


def planted():
    texts = [None, "", "one", " ".join(prose(5000))]
    for item in ITEMS:
        for at in (0, 7, 300):
            body = prose(300)
            texts.append(" ".join(body[:at] + item + body[at:]))
        texts += [" ".join(item), " ".join(item).upper(), "\n".join(item[: len(item) // 2])]
        if len(item) > 25:
            edited = list(item)
            edited[len(item) // 2] = "changed"
            texts.append(" ".join(prose(50) + edited + prose(50)))
    return texts


def test_leaks_are_those_of_a_plain_search(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id int, similarity string")
    rows = [(i, " ".join(t)) for i, t in enumerate(ITEMS)] + [(100, None), (101, ""), (102, "too short")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(ITEMS) if plain(t, item) >= 0.75}
    for per_pass in (2000, 2):
        assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, per_pass=per_pass).collect()} == want
    kept = {r.doc_id for r in clean_documents(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want} and clean_documents(docs, bench).columns == docs.columns
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_index_reaches_every_print_within_the_radius():
    ball = set(_ball().tolist())
    assert len(ball) == 697
    for _ in range(2000):
        flips = DRAW.sample(range(64), DRAW.randint(0, RADIUS))
        mask = sum(1 << f for f in flips)
        assert any((mask >> (16 * b)) & 0xFFFF in ball for b in range(4))


def test_fingerprints_equal_a_plain_simhash():
    words = Words(*text_bytes(__import__("pyarrow").array([" ".join(prose(200))])))
    pair = _pairs(words.hash)
    start, end = np.array([0, 3, 50]), np.array([16, 40, 200])
    got = _fingerprints(_running(pair), start, end)
    for g, a, b in zip(got, start, end):
        want = sum(1 << k for k in range(64) if sum(int(p) >> k & 1 for p in pair[a:b - 1]) * 2 > b - a - 1)
        assert int(g) == want


def test_repeated_items_and_shared_passages_keep_their_leaks(spark):
    """Near copies of repeated items, and of a passage that items share, at every size of a pass."""
    draw = random.Random(9)
    item, head = draw.choices(VOCAB, k=50), draw.choices(VOCAB, k=30)
    near = list(item)
    near[25] = "changed"
    items = [item] * 4 + [head + draw.choices(VOCAB, k=12) for _ in range(3)]
    other = items[4][:20] + ["changed"] + items[4][21:]
    docs = [" ".join(prose(40) + x + prose(40)) for x in (near, other, prose(50))]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if plain(t, x) >= 0.75}
    assert want >= {(0, i) for i in range(4)} | {(1, 4)}
    seen = [{(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(frame, bench, per_pass=n).collect()} for n in (2000, 1)]
    assert seen[0] == seen[1] and set(seen[0]) >= want
    assert [r.doc_id for r in clean_documents(frame, bench).collect()] == [2]


def test_items_under_five_words_and_structured_words(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    items = {1: "Rare three words", 2: "lone", 3: f"{one} x y z u", 4: "rare THREE words", 5: " ", 6: "four words in here"}
    texts = ["before rare three\nwords behind", "rare three", "words lone", f"{other} x y z u", f"say {one} x y z u", "three words rare", "four words in", None, "x " * 70_000 + "rare three words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for per_pass in (2000, 1):
        got = {(r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in find_leaks(docs, bench, per_pass=per_pass).collect()}
        assert got == {(0, 1, 1.0, 1, 3), (0, 4, 1.0, 1, 3), (2, 2, 1.0, 1, 1), (4, 3, 1.0, 1, 5), (8, 1, 1.0, 70_000, 3), (8, 4, 1.0, 70_000, 3)}
    assert [r.doc_id for r in clean_documents(docs, bench).orderBy("doc_id").collect()] == [1, 3, 5, 6, 7]
