"""Boolean trigram queries from regular expressions.

A query is in disjunctive form: a set of alternatives, each a set of trigrams that a matching
text must all hold (in lower case). ``None`` means that no trigram is mandatory, so that the rule
has to scan every text. Python's own parser gives the expression's tree.
"""

from __future__ import annotations

import itertools
from re import _constants as C
from re import _parser as parser

#: Beyond so many strings an exact set is given up; it then only breaks a run of letters.
_MOST_STRINGS = 16


def _letters(items) -> list[str] | None:
    """The characters of a class, where they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < _MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(found) if len(found) <= _MOST_STRINGS else None


def _runs(tree) -> list[list[str]]:
    """Alternative sequences of literal runs; ``"\\0"`` splits runs where anything may stand."""
    options: list[str] = [""]
    for kind, value in tree:
        if kind is C.LITERAL:
            step = [chr(value).lower()]
        elif kind is C.IN:
            step = _letters(value) or ["\0"]
        elif kind is C.SUBPATTERN:
            step = ["".join(x) for x in _runs(value[-1])]
        elif kind is C.BRANCH:
            step = [y for branch in value[1] for y in ("".join(x) for x in _runs(branch))]
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            once = ["".join(x) for x in _runs(body)]
            if (low, high) == (0, 1):
                step = ["", *once]
            elif low == 0:
                step = ["", "\0"] if once != ["\0"] else ["\0"]
                step = ["\0"] if len(options) * 2 > _MOST_STRINGS else step
            else:
                step = [x * low if low == high and low <= 4 else x + "\0" + x if low > 1 else x + "\0" for x in once]
        else:
            step = ["\0"] if kind is not C.AT else [""]
        if len(options) * len(step) > _MOST_STRINGS:
            step = ["\0"]
        options = list(dict.fromkeys(a + b for a, b in itertools.product(options, step)))
    return [[o] for o in options]


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams, the weaker of two comparable ones only."""
    sets = []
    for (option,) in _runs(parser.parse(regex)):
        grams = {run[i:i + 3] for run in option.split("\0") for i in range(len(run) - 2)}
        if not grams:
            return None
        sets.append(frozenset(grams))
    return sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)
