import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from driftline.llm.language import BUCKETS, STRENGTH, SUFFIXES, TEXT_WEIGHT, count_trigrams, identify, trigram_buckets

EN = "the cat and the dog went with that of this thing. " * 6
FR = "le chat et la souris que vous avez dans une maison. " * 6
DOCS = [(0, EN, "en"), (1, FR, "fr"), (2, None, "en"), (3, "", None), (4, EN.upper(), "en")]
PAGES = [("http://a.example.com/en/1", f'<html lang="en"><script>var le = "chat";</script><p>{EN}</p>'),
         ("http://a.example.com/2", f"<html><p>{EN}</p>"), ("http://b.example.fr/x", f'<html lang="fr"><p>{FR}</p>'),
         ("http://b.example.fr/y", '<html lang="en-GB"><p></p>'), ("http://b.example.fr/fr/z", "<p>le</p>"), (None, None), ("", ""), ("no address", "x"),
         ("http://user@c.d.example.co.uk:80?x", f"<p>{FR}</p>"), ("http://b.example.fr/y", None), ("http://b.example.fr/y", None)]


def plain():
    langs = ["en", "fr"]
    table = np.full((2, BUCKETS), 0.5)
    for _, t, lang in DOCS:
        if lang:
            for k in trigram_buckets(pa.array([t], pa.string()))[0]:
                table[langs.index(lang), k] += 1
    model = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    rows = []
    for url, html in PAGES:
        url, html = url or "", html or ""
        text = re.sub(r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", html)
        text = re.sub(r"&#?\w+;", " ", re.sub(r"(?s)<[^>]*>", " ", text))
        keys = trigram_buckets(pa.array([text]))[0]
        log = [float(model[k][keys].sum(dtype=float)) * min(len(keys), TEXT_WEIGHT) / max(len(keys), 1) for k in range(2)]
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url)
        host = m[1].lower() if m else ""
        m = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html)
        declared = m[1].lower() if m and m[1].lower() in langs else None
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", url)
        suffix = SUFFIXES.get(host.split(".")[-1])
        addressed = m[1].lower() if m and m[1].lower() in langs else suffix if suffix in langs else None
        by_text = langs[int(log[1] > log[0])] if max(log) < 0 else None
        rows.append((log, host, declared, addressed, by_text))
    said = []
    for c in (2, 3):
        n = Counter((r[4], r[c]) for r in rows if r[4] and r[c])
        said.append({(a, b): (n[a, b] + (2 if a == b else 0.2)) / (sum(n[a, x] for x in langs) + 2.2) for a in langs for b in langs})
    own = [[r[0][k] + sum(math.log(said[c - 2][a, r[c]]) for c in (2, 3) if r[c]) for k, a in enumerate(langs)] for r in rows]
    votes = defaultdict(lambda: [0, 0])
    for r, o in zip(rows, own):
        if r[2] or r[3] or r[4]:
            votes[r[1]][int(o[1] > o[0])] += 1
    every = [sum(v[k] for v in votes.values()) for k in range(2)]
    share = [(x + 1) / (sum(every) + 2) for x in every]

    def smooth(n, above):
        return [(n[k] + STRENGTH * above[k]) / (sum(n) + STRENGTH) for k in range(2)]

    def level(cut):
        out = defaultdict(lambda: [0, 0])
        for h, v in votes.items():
            for k in range(2):
                out[".".join(h.split(".")[-cut:])][k] += v[k]
        return out
    tops, domains = level(1), level(2)
    out = []
    for r, o in zip(rows, own):
        s = share
        if r[1] in votes:
            s = smooth(tops[r[1].split(".")[-1]], share)
            s = smooth(votes[r[1]], smooth(domains[".".join(r[1].split(".")[-2:])], s))
        z = [o[k] + math.log(s[k]) for k in range(2)]
        out.append((langs[int(z[1] > z[0])], 1 / sum(math.exp(x - max(z)) for x in z)))
    return out


def test_fusion_equals_a_plain_one(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, *p, "x") for i, p in enumerate(PAGES)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in identify(pages, count_trigrams(docs)).collect()}
    for i, (lang, probability) in enumerate(plain()):
        assert got[i].lang == lang and abs(got[i].probability - probability) < 1e-5, (i, got[i], lang, probability)
    assert len(got) == len(PAGES)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(0, *PAGES[0])], "page_id long, url string, html string")
    assert identify(pages.limit(0), count_trigrams(docs)).count() == 0
    assert identify(pages, count_trigrams(docs.limit(0))).head().lang is None


def test_every_language_is_scored(spark):
    """More language codes than any cap or block; the rarest has the shortest text."""
    codes = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(230)]
    draw = np.random.default_rng(8)
    texts = [" ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30)) for _ in codes]
    docs = [(k, texts[k] if k == 113 else texts[k] * 2, x) for k, x in enumerate(codes)]
    some = (0, 64, 113, 229)
    pages = [(k, f"http://h{k}.example.org/", f'<html lang="{codes[k]}"><p>{texts[k]}</p>') for k in some]
    found = identify(spark.createDataFrame(pages, "page_id long, url string, html string"), count_trigrams(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    assert {r.page_id: (r.lang, r.by_text, r.declared) for r in found.collect()} == {k: (codes[k],) * 3 for k in some}
