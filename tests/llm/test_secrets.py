import random
import re
import time

from brute import base_spans

from driftline.llm.queries import QUERIES
from driftline.llm.secrets import BASE_RULES, RULES, SecretRule, candidates, find_secrets, trigram_index
from driftline.llm.trigrams import trigram_query

ODD = [None, "", 'token = "abc', "token=abcde secret: abcdef", "api_key=token:abcdefghi", "PASSWORD: hunter2hunter TOKEN=xyzxyz",
       "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B9" * 9, "deadbeef" * 3, "deadbeef" * 2 + "g" + "0" * 24,
       "\U0001f600 secret=\U0001f600 secret='abcdef' \U0001f600 " + "0123456789abcdef" * 2, "token=secret=abcdef", 'apikey":"abc.def/gh"',
       "token = abcdefg " * 300, "to\nken=abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]


def spans(rows):
    import hashlib
    for r in rows:
        base = [x for x in r.found if x.kind in ("assign", "access", "hex")]
        joined = ",".join(f"{x.kind}:{x.start}:{x.end}" for x in base)
        yield r.doc_id, (*(sum(x.kind == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans_are_those_of_plain_matching(spark):
    draw = random.Random(5)
    parts = ["token", "secret", "api_key", "apikey", "PassWord", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "f" * 24, "\n", "é"]
    texts = ODD + ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    assert dict(spans(find_secrets(docs).collect())) == {i: base_spans(t) for i, t in enumerate(texts)}


def test_added_kinds_and_offsets(spark):
    docs = spark.createDataFrame([(0, "é ghp_" + "z9" * 18 + " -----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    found = find_secrets(docs).head().found
    assert [(x.kind, x.start, x.end) for x in found] == [("git_token", 2, 42), ("private_key", 43, 74)]


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "token=abcdef"), (1, "nothing"), (1, "token=abcdef")], "doc_id long, text string")
    assert sorted(len(r.found) for r in find_secrets(docs).collect()) == [0, 1, 1]
    assert find_secrets(docs.limit(0)).count() == 0


def test_queries_never_exclude_a_match():
    draw = random.Random(3)
    for regex in (r"(foo|ba+r)x?yz", r"ab(cd|e)*fgh", r"[abc]de[^q]fghi", r"(?i:Pass)(word)?=", r"x{3}yy+", r"(abc)+d"):
        query = trigram_query(regex)
        for _ in range(3000):
            text = "".join(draw.choices("abcdefghixyzPasword=r fo", k=12)) + draw.choice(["fooyz", "baaarxyz", "abcdefgh", "cdeXfghi", "PASSword=", "xxxyyy", "abcabcd"])
            if re.search(regex, text):
                assert query is None or any(all(g in text.lower() for g in option) for option in query), (regex, text)


def test_candidates_hold_every_trigram(spark):
    docs = spark.createDataFrame([(1, "a token here"), (2, "the tok ken"), (3, "tok oke ken"), (4, "pass word")], "doc_id long, text string")
    rules = (SecretRule("t", "token"), SecretRule("p", "password"))
    got = {r.doc_id: r.rules for r in candidates(trigram_index(docs, rules), rules).collect()}
    assert got == {1: ["t"], 3: ["t"]}
    assert trigram_query(BASE_RULES[2].regex) is None and len({r.kind for r in RULES}) == len(RULES)
    assert "op10_secret_scan" in QUERIES


def test_null_ids_keep_their_candidates(spark):
    texts = ["token=abcdef", None, "nothing", "AKIA" + "A" * 16 + " ghp_" + "z9" * 18]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, "secret: abcdefg"), (2, None)], "doc_id long, text string")
    for limit in ("1000000", "0"):
        spark.conf.set("driftline.broadcastRows", limit)
        got = sorted((r.doc_id or 0, sorted(x.kind for x in r.found)) for r in find_secrets(docs).collect())
        assert got == [(0, []), (0, []), (0, ["access", "git_token"]), (0, ["assign"]), (1, ["assign"]), (2, [])]
    spark.conf.unset("driftline.broadcastRows")


def test_a_text_of_very_many_finds(spark):
    text = "é \U0001F600 " + " ".join(f"{i:032x}" for i in range(150_000)) + " token=abcdef99"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    before = time.time()
    got = [(x.start, x.rank, x.end, x.kind, text[x.start:x.end]) for x in find_secrets(docs).first().found if x.kind in ("assign", "access", "hex")]
    assert time.time() - before < 60
    want = [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]{24,}", text)]
    at = text.index("token=")
    assert got == [*want, (at, 0, len(text), "assign", "token=abcdef99")]
