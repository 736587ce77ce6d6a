"""Licence scan: passages of a text against licence templates by Dice coefficient.

Text is lower-cased and every run of other characters than letters and digits becomes one
blank. A passage is a line, a sentence within a line, a paragraph (lines up to one without a letter
or digit, as the separators of commented headers are), or a sentence that wraps over lines of a paragraph; a semicolon
ends a sentence in one reading and not in the other. The Dice coefficient of two sets of word bigrams is 2c / (a + b), at most
2 min(a, b) / (a + b), so a passage of ``a`` bigrams can only reach ``threshold`` with templates
of t / (2 - t) * a to (2 - t) / t * a bigrams: passages meet templates in an equi-join on the
sizes that the bound admits, and passages of other sizes are dropped before. Every passage that reaches the threshold
holds one of a few words of the templates (``key_words``), so other texts and passages are passed over. A passage has at
least the bigrams of its first words, so a long one is dropped where those alone are more than any template admits;
a long one that repeats itself is compared whole.

Defined cases: a null or empty text has no passages; a passage of one word is compared by that
word; repeated passages of a document count once, at their first place; equal scores go to
the template earlier by name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What texts and files call each licence; every name meets every wording below.
_WORDINGS = ("Released under {}.", "Licensed under {}.", "Distributed under {}.", "This work is licensed under {}.",
             "This project is licensed under {}.", "This program is distributed under the terms of {}.")
_NAMES = {
    "MIT": ["the MIT License", "MIT"],
    "ISC": ["the ISC License", "ISC"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License", "the 2-clause BSD license"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the BSD license", "the New BSD License", "the 3-clause BSD license"],
    "MPL-1.1": ["the Mozilla Public License, Version 1.1", "the MPL 1.1"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the MPL 2.0"],
    "EPL-1.0": ["the Eclipse Public License v1.0", "the Eclipse Public License, version 1.0"],
    "EPL-2.0": ["the Eclipse Public License v2.0", "the Eclipse Public License, version 2.0"],
    "EUPL-1.2": ["the European Union Public Licence, version 1.2", "the EUPL 1.2"],
    "Artistic-2.0": ["the Artistic License 2.0"],
    "Unlicense": ["the Unlicense"],
    "WTFPL": ["the WTFPL"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1"],
    "ODbL-1.0": ["the Open Database License", "the Open Data Commons Open Database License (ODbL) v1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
for _kind, _full, _versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",)),
                                ("GFDL", "Free Documentation", ("1.2", "1.3"))):
    for _v in _versions:
        _dotted, _long = _v if "." in _v else _v + ".0", "GNU " + _full + ("" if _kind == "GFDL" else " Public") + " License"
        _NAMES[f"{_kind}-{_dotted}"] = list(dict.fromkeys(x for v in (_v, _dotted) for x in (
            f"the {_long}, version {v}", f"the {_long} v{v}", f"the {_kind} version {v}", f"the {_kind} v{v}", f"the {_kind}v{v}", f"{_kind}-{v}")))
_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "Creative Commons " + "-".join(_PARTS[x] for x in _code.split("-"))
    for _v, _where in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _NAMES[f"CC-{_code}-{_v}"] = [f"CC {_code} {_v}", f"a {_long} {_v} {_where} License", f"the {_long} {_v} {_where} License", f"a {_long} {_v} License",
                                      *([f"CC {_code}", f"the {_long} License"] if _v == "4.0" else [])]
# Notices that are no name in a wording.
_NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal.", "This work is dedicated to the public domain."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ARR": ["All rights reserved.", "Copyright. All rights reserved."],
}
TEMPLATES = {k: [w.format(n) for n in _NAMES.get(k, []) for w in _WORDINGS] + _NOTICES.get(k, []) for k in dict.fromkeys([*_NAMES, *_NOTICES])}
THRESHOLD = 0.8
# Taken as key words only where a template has no others.
_COMMON = {"a", "by", "is", "of", "or", "the", "this", "to", "under", "version", "with", "without", "work"}


_GAP = r"[^\p{L}\p{N}]+"


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), _GAP, " "))


def bigrams(words: Column) -> Column:
    """Distinct word bigrams of an array; a lone word stands for itself."""
    def pairs(w):
        n = F.size(w) - 1
        return F.when(n < 1, w).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat(x, F.lit(" "), y))))

    # Bound to a name of its own, the array is made once, however the plan is rewritten.
    return F.transform(F.array(words), pairs)[0]


def key_words(templates: Mapping[str, list[str]], threshold: float) -> list[str]:
    """Words of which every passage that reaches ``threshold`` with some template holds one.

    Such a passage shares t / (2 - t) of the template's bigrams, so words are taken until they touch so many bigrams of
    each template that fewer are left.
    """
    left = []
    for t in (t for v in templates.values() for t in v):
        w = re.findall(r"[^\W_]+", t.lower())
        grams = set(zip(w, w[1:])) or {tuple(w)}
        left.append((grams, len(grams) * threshold / (2 - threshold) - 1e-9))
    taken: list[str] = []
    while left := [(grams, least) for grams, least in left if grams and len(grams) >= least]:
        gain = Counter(x for grams, _ in left for gram in grams for x in set(gram))
        taken.append(max(gain, key=lambda x: (x not in _COMMON and not x.isdigit(), len(x) >= 6, gain[x], x)))
        left = [({g for g in grams if taken[-1] not in g}, least) for grams, least in left]
    return taken


def template_table(spark, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per template and passage size it can match: ``size``, ``licence``, ``template``, ``grams``."""
    rows = spark.createDataFrame([(k, n, t) for k, v in templates.items() for n, t in enumerate(v)],
                                 "licence string, template int, t string")
    rows = rows.select("licence", "template", bigrams(F.split(normal(F.col("t")), " ")).alias("grams"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = F.sequence(F.greatest(F.lit(1), F.ceil(F.size("grams") * low - 1e-9)).cast("int"), F.floor(F.size("grams") * high + 1e-9).cast("int"))
    return rows.select(F.explode(sizes).alias("size"), "licence", "template", "grams")


def find_licences(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``line`` (of the passage, from 1), ``passage``, ``licence``, ``dice``: the best template of each passage.

    The templates are an argument of the program, so their table is small and is broadcast;
    texts and passages are never shuffled.
    """
    table = template_table(docs.sparkSession, templates, threshold)
    most = table.agg(F.max("size")).first()[0] or 0
    first = 2 * most + 2
    # Bigrams are made only of passages that hold a key word: no other reaches the threshold.
    keys = r"(?<![\p{L}\p{N}])(?:" + "|".join(key_words(templates, threshold)) + ")"
    docs = docs.filter(F.lower(F.col(text)).rlike(keys))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    rows = rows.withColumn("full", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    rows = rows.select("doc_id", "lines", F.expr("filter(sequence(1, size(lines)), i -> get(full, i - 1) and "
                                                 "(i = 1 or not get(full, i - 2)))").alias("heads"),
                       F.expr("filter(sequence(1, size(lines)), i -> get(full, i - 1) and "
                              "(i = size(lines) or not get(full, i)))").alias("ends"))
    paragraphs = F.expr("transform(heads, (h, k) -> struct(h as line, concat_ws(' ', slice(lines, h, get(ends, k) + 1 - h)) as passage))")
    sentences = F.expr("""flatten(transform(lines, (x, i) -> transform(
        array_distinct(concat(array(x), split(x, '(?<=[.!?;])\\\\s+'))), y -> struct(i + 1 as line, y as passage))))""")
    # Lines are joined with their numbers between line feeds; a piece that still holds a number wraps and begins before it.
    joined = F.expr("""transform(heads, (h, k) -> array_join(transform(slice(lines, h, get(ends, k) + 1 - h),
        (x, i) -> concat(if(i = 0, '', concat('\\n', h + i - 1, '\\n')), x)), ''))""")
    blanks = r"(?:[^\S\n]+|(?=\n))"
    pieces = [F.flatten(F.transform(joined, lambda x: F.split(x, f"(?<=[{ends}]){blanks}"))) for ends in (".!?;", ".!?")]
    pieces = F.transform(F.array_distinct(F.concat(*pieces)), lambda x: F.regexp_replace(x, r"^(?:\s*\n\d+\n)+", ""))
    wrapped = F.transform(F.filter(pieces, lambda x: x.contains("\n")), lambda x: F.struct(
        F.regexp_extract(x, r"\n(\d+)\n", 1).cast("int").alias("line"), F.regexp_replace(x, r"\n\d+\n", " ").alias("passage")))
    rows = rows.select("doc_id", F.explode(F.concat(sentences, paragraphs, wrapped)).alias("p"))
    rows = rows.select("doc_id", F.col("p.line").alias("line"), F.col("p.passage").alias("passage"))
    rows = rows.filter(F.lower("passage").rlike(keys))
    # Of a passage's bigrams, a template holds t / (2 - t) at least.
    every = [r.g for r in table.select(F.explode("grams").alias("g")).distinct().collect()]
    # The first words, and in the last entry what is behind them.
    cut = F.split(F.regexp_replace(F.lower("passage"), f"^{_GAP}", ""), _GAP, first + 1)
    own = F.transform(F.array(cut), lambda c: F.struct(bigrams(F.filter(F.slice(c, 1, first), lambda x: x != "")).alias("own"),
                                                       (F.size(c) > first).alias("long")))
    own = F.filter(own, lambda p: F.size(p.own).between(1, most))
    own = F.transform(own, lambda p: F.when(p.long, bigrams(F.split(normal(F.col("passage")), " "))).otherwise(p.own))
    own = F.filter(own, lambda o: F.size(F.filter(o, lambda g: g.isin(every))) >= F.size(o) * (threshold / (2 - threshold)) - 1e-9)
    # An explode, behind which no filter moves: bigrams are made once.
    rows = rows.select("doc_id", "line", "passage", F.explode(own).alias("own")).withColumn("size", F.size("own"))
    joined = rows.join(F.broadcast(table), "size")
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.col("size") + F.size("grams"))
    hits = joined.select("doc_id", "line", "passage", "licence", dice.alias("dice")).filter(F.col("dice") >= threshold)
    best = hits.groupBy("doc_id", "line", "passage").agg(F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("licence"),
                                                         F.max("dice").alias("dice"))
    return best.groupBy("doc_id", "passage", "licence", "dice").agg(F.min("line").alias("line"))
