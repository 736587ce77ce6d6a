import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftline.llm.packing import ByteIds, best_fit, complete, fillings, lower_bound, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", " \t", "a  b", "a \n b", "a\n\nb", "a  b", "a   b", "é  è", "日本　 語", "x\x1c y", "a\x85 b", "it's IT'S don't 's", "<|endoftext|> a <|endoftext|>b", "a<|endoftext|>  ",
       "one,two;three. four!", "12,345 6|7", "a\r\n\tb  ", "word " * 1500, "x" * 3000]


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_runs_encode_like_whole_texts():
    draw = random.Random(4)
    alphabet = list("aAbZ's. ,|<>#\t\n é 　 ß09_\x1c日") + ["<|endoftext|>", "'ll", "the", " ", "  ", " ", "\x85"]
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randint(1, 40))) for _ in range(4000)]
    coder = ByteIds(PATH)
    assert coder.by_run
    for _ in range(2):
        ids, count = coder.encode(pa.array(texts), 2)
        for got, want in zip(np.split(ids, np.cumsum(count)[:-1]), ids_of(texts)):
            assert np.array_equal(got, want)


def test_another_splitter_gets_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    coder = ByteIds(other)
    tok = Tokenizer.from_file(other)
    assert not coder.by_run
    assert coder.encode(pa.array(ODD), 2)[0].tolist() == [i for t in ODD for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1).astype(np.int64)


def fewest(sizes, capacity):
    """The least number of bins, by trying all ways."""
    @functools.cache
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = set()
        for mask in range(1 << len(rest)):
            beside = tuple(s for k, s in enumerate(rest) if mask >> k & 1)
            if first + sum(beside) <= capacity:
                found.add(tuple(s for k, s in enumerate(rest) if not mask >> k & 1))
        return 1 + min(solve(f) for f in found)
    return solve(tuple(sorted(sizes, reverse=True)))


def check(patterns, sizes, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for times, taken in patterns:
        assert times > 0 and sum(s * k for s, k in taken) <= capacity
        for s, k in taken:
            used[s] += times * k
    assert np.array_equal(used, histogram(sizes, capacity))
    return sum(t for t, _ in patterns)


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_least_number(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 20, 30])
    sizes = [draw.randint(1, capacity * 2 // 3) for _ in range(9)]
    counts = histogram(sizes, capacity)
    least = fewest(sizes, capacity)
    assert lower_bound(counts, capacity) <= least
    assert check(best_fit(counts, capacity), sizes, capacity) >= least
    assert min(check(complete(counts, capacity, b, 500), sizes, capacity) for b in range(6)) == least


def test_search_beats_best_fit(spark):
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2] * 50  # 20 a bin
    sizes += [11, 7, 7, 5, 5, 5] * 40
    counts = histogram(sizes, 20)
    found = check(plan(spark, counts, 20), sizes, 20)
    assert lower_bound(counts, 20) <= found <= check(best_fit(counts, 20), sizes, 20)


def test_fillings_are_undominated_and_fullest_first():
    left = histogram([9, 5, 4, 3, 2, 2, 1], 10)
    assert fillings(left, 5, 10)[0] == ((4, 1), (1, 1))
    for taken in fillings(left, 5, 10):
        assert sum(s * k for s, k in taken) <= 5
    assert fillings(histogram([9, 8], 10), 9, 10) == [()]


def test_packing_holds_every_piece(spark):
    draw = random.Random(1)
    texts = ODD + [" ".join(draw.choices(["alpha", "beta", "gamma,", "delta"], k=draw.randint(0, 60))) for _ in range(200)]
    rows = [(i % 150, t, "x", 1, 2, 3) for i, t in enumerate(texts)] + [(None, "no id", "x", 1, 2, 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, start int, part int, length int").repartition(5)
    got = pack(docs, PATH, capacity=64).collect()
    want = []
    for (i, *_), ids in zip(rows, ids_of([r[1] for r in rows])):
        made = -(-len(ids) // 64)
        ends = [len(ids) - 64 * k for k in range(made)][::-1]
        want += [(i, n, b - len(p), len(p), zlib.crc32(p.tobytes())) for n, (b, p) in enumerate(zip(ends, np.split(ids, ends[:-1])))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got), key=repr) == sorted(want, key=repr)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    counts = histogram([r.length for r in got], 64)
    assert lower_bound(counts, 64) <= len(held) <= sum(t for t, _ in best_fit(counts, 64))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pack(docs.limit(0), PATH).count() == 0
    assert [(r.length, r.offset, bytes(r.ids)) for r in pack(docs, PATH).collect()] == [(1, 0, b"\x02\0\0\0")]
