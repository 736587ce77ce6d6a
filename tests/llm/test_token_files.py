import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from tokenizers import Tokenizer

from driftline.llm import known_pieces
from driftline.llm.token_files import TokenFile, WordIds, read_documents, write_token_files
from driftline.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t", "Hello, WORLD", "it's IT'S", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "é\x0bÉ\x0cÁ J̌ ǰ",
       "ΑΣ Σ İ", "a b c", " ́x", "x" * 5000, "日本 語\r\n#", "#", "word " * 9000]


def wanted(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_words_encode_like_whole_texts():
    draw = random.Random(2)
    alphabet = list("aAbZ's'. ,<|>#\t\n é́İΣß-09_") + ["<|endoftext|>", "'ll", "the", " "]
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(2000)]
    ids, count = WordIds(PATH).encode(pa.array(texts), 2)
    for got, want in zip(np.split(ids, np.cumsum(count)[:-1]), wanted(texts)):
        assert np.array_equal(got, want)


def test_files_hold_every_document(spark):
    texts = ODD + [f"text {i} " * (i % 90) for i in range(700)]
    docs = spark.createDataFrame([(3 * i % 1001, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, start string, part int")
    path = new_path(spark, "tokens")
    manifest = write_token_files(docs.repartition(5), path, PATH, length=64, rows=4)
    got = read_documents(manifest, path=path).orderBy("start").collect()
    order = sorted(range(len(texts)), key=lambda i: 3 * i % 1001)
    want, start = wanted(texts), 0
    assert [r.doc_id for r in got] == [3 * i % 1001 for i in order]
    for r, i in zip(got, order):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[i]), zlib.crc32(want[i].tobytes()))
        start += r.n_tokens
    stream = np.concatenate([want[i] for i in order])
    at = 0
    for row in sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["part"]):
        file = TokenFile(pyarrow.fs.LocalFileSystem(), row)
        for k in reversed(range(row["n_sequences"])):
            ids, mask = file.sequence(k)
            n = min(64, row["n_tokens"] - 64 * k)
            assert np.array_equal(ids[:n], stream[at + 64 * k:at + 64 * k + n]) and sum(mask.to_pylist()) == n
            assert not ids.flags.owndata
        at += row["n_tokens"]


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    path = new_path(spark, "tokens")
    got = read_documents(write_token_files(docs, path, PATH), path=path).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3]
    empty = new_path(spark, "tokens")
    assert read_documents(write_token_files(docs.limit(0), empty, PATH), path=empty).count() == 0


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_have_their_own_ids():
    texts = [w for bits in range(10, 15) for w in thue_morse(bits)]
    ids, count = WordIds(PATH).encode(pa.array(texts), 2)
    for got, want in zip(np.split(ids, np.cumsum(count)[:-1]), wanted(texts)):
        assert np.array_equal(got, want)


def test_words_with_one_hash_keep_their_ids(monkeypatch):
    monkeypatch.setattr(known_pieces, "lane_hash", lambda value, number, first, size: size.astype(np.uint64) % np.uint64(3))
    texts = ODD + ["some words of several sizes", "other words with sizes, too", "some words"]
    encoder = WordIds(PATH)
    for _ in range(2):
        ids, count = encoder.encode(pa.array(texts), 2)
        for got, want in zip(np.split(ids, np.cumsum(count)[:-1]), wanted(texts)):
            assert np.array_equal(got, want)


def test_another_splitter_gets_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    ids, count = WordIds(other).encode(pa.array(ODD), 2)
    tok = Tokenizer.from_file(other)
    assert ids.tolist() == [i for t in ODD for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]


def test_many_pieces_go_to_the_tokenizer_in_one_text(monkeypatch):
    """Fresh pieces cost no call each, and one that holds what begins a special token is encoded by itself."""
    words = WordIds(PATH)
    rng = random.Random(8)
    made = ["".join(rng.choice("abcdeéßзя́'0.9$#-") for _ in range(rng.randint(1, 12))) for _ in range(700)]
    made[5:5] = ["<|endoftext|>", "a<|startoftext|>b", "<", "x<y", "́", "<|endoftext|>"]
    seen, real = [], words._encoded
    monkeypatch.setattr(words, "_encoded", lambda texts: seen.append(len(texts)) or real(texts))
    ids, count = words.encode(pa.array([*made, " ".join(made)]), 2)
    plain = Tokenizer.from_file(PATH)
    wanted = [plain.encode(t, add_special_tokens=False).ids + [2] for t in [*made, " ".join(made)]]
    assert ids.tolist() == [x for w in wanted for x in w] and count.tolist() == [len(w) for w in wanted]
    assert sum(seen) < 50
