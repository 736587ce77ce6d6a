import functools
import re
import textwrap

from driftline.llm.licences import TEMPLATES, THRESHOLD, find_licences, key_words


@functools.cache
def grams(text):
    w = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return {(a, b) for a, b in zip(w, w[1:])} or {tuple(w)}


def plain(text):
    found = {}
    lines = (text or "").split("\n")
    passages = [(i, x) for i, line in enumerate(lines) for x in [line, *re.split(r"(?<=[.!?;])\s+", line)]]
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip(" "):
            passages.append((start, " ".join(lines[start:i])))
            start = i + 1
    for i, p in passages:
        own = grams(p)
        if own == {()}:
            continue
        best = min(((-2 * len(own & grams(t)) / (len(own) + len(grams(t))), k) for k, v in TEMPLATES.items() for t in v))
        if -best[0] >= THRESHOLD - 1e-12:
            found.setdefault(p, (i + 1, best[1], round(-best[0], 6)))
    return {(p, *v) for p, v in found.items()}


TEXTS = [None, "", "\n\n", "prose only here", "Some words.\nReleased under the MIT License.", "x. Licensed under the Apache License, Version 2.0. y",
         "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as\n"
         "published by the Free Software Foundation; either version 2 of the\nLicense, or (at your option) any later version.\n\nrest",
         "all rights RESERVED!\nall rights reserved", "Released under the MIT License.\nReleased under the MIT License.", "word " * 20000,
         "Released under the XYZ License.", "Released under that MIT License, now."]


def test_passages_and_templates(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, size int")
    got = {}
    for r in find_licences(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.passage, r.line, r.licence, round(r.dice, 6)))
    assert got == {i: plain(t) for i, t in enumerate(TEXTS) if plain(t)}


def test_empty_table(spark):
    assert find_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# The licence lines of the documents fixture, and names of families and versions that differ by a word.
LINES = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
         "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "ARR",
         "Licensed under CC BY 4.0.": "CC-BY-4.0", "Released under CC BY-NC-ND 3.0.": "CC-BY-NC-ND-3.0", "Released under the BSD 2-Clause License.": "BSD-2-Clause",
         "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Licensed under the ISC License.": "ISC",
         "Released under the GNU General Public License, version 2.": "GPL-2.0", "This project is licensed under the GPLv3.": "GPL-3.0"}


def test_every_licence_line_is_found(spark):
    docs = spark.createDataFrame([(i, f"prose before\n{t}\nprose behind") for i, t in enumerate(LINES)], "doc_id long, text string")
    got = {(r.passage, r.line, r.licence, r.dice) for r in find_licences(docs).collect()}
    assert got >= {(t, 2, k, 1.0) for t, k in LINES.items()}


def test_key_words_lose_no_passage():
    keys = key_words(TEMPLATES, THRESHOLD)
    for t in (t for v in TEMPLATES.values() for t in v):
        left = {g for g in grams(t) if not set(g) & set(keys)}
        assert len(left) < len(grams(t)) * THRESHOLD / (2 - THRESHOLD)


def test_wrapped_sentences_of_commented_headers(spark):
    gpl = next(t for t in TEMPLATES["GPL-3.0"] if t.startswith("This program is free"))
    apache = next(t for t in TEMPLATES["Apache-2.0"] if "may not use" in t)
    rest = ["You should have received a copy of it along with this program and of other words, many more of them", "than the notice has. If not, see the web."]
    texts, want = [], []
    for k, (notice, name) in enumerate([(gpl, "GPL-3.0"), (apache, "Apache-2.0")]):
        for mark in ("# ", " * ", ""):
            wrapped = textwrap.wrap(notice, 60)
            lines = ["Copyright 2020 A. Uthor.", mark.strip(), "This file is one of many. " + wrapped[0], *wrapped[1:-1], wrapped[-1] + " " + rest[0], rest[1]]
            want.append((len(texts), 3, name))
            texts.append("\n".join(mark + x for x in lines))
    # The notice as lines of one block: the separator lines end its paragraph.
    texts.append("\n".join(["/*", " * Copyright.", " *", *[" * " + x for x in textwrap.wrap(gpl, 60)], " *", *[" * " + x for x in rest], " */"]))
    want.append((len(texts) - 1, 4, "GPL-3.0"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line, r.licence) for r in find_licences(docs).filter("dice > 0.99").collect()}
    assert got >= set(want)


def test_a_long_passage_that_repeats_itself_is_compared_whole(spark):
    line = "Released under the MIT License."
    texts = [" ".join([line[:-1]] * 3000), "\n".join(["Released under the", "MIT License"] * 300), " ".join(["all rights reserved"] * 40000),
             " ".join([line[:-1]] * 400) + " " + " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(50000)) + " " + line[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.passage, r.line, r.licence, round(r.dice, 6)) for r in find_licences(docs).collect()}
    assert got == {(i, *x) for i, t in enumerate(texts) for x in plain(t)}
    assert {x[0] for x in got} == {0, 1, 2}
