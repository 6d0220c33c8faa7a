"""Boolean trigram queries that every match of a regular expression must satisfy."""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

# Sets of strings are followed exactly while they stay as small as this.
MOST_STRINGS = 64
MOST_CHOICES = 8

# Any of these sets of trigrams must be in the text, each as a whole. None: no trigram is mandatory.
Query = frozenset[frozenset[str]] | None


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, of the texts that ``pattern`` can match.

    The expression is read part by part. As long as a stretch of it can only be one of a few strings,
    these are spelt out; a match holds one of them, hence all its trigrams. Stretches that follow each
    other are all required, branches are alternatives, and what may repeat zero times requires nothing.
    """
    exact, query = _sequence(sre_parser.parse(pattern))
    return _both(query, _spelt(exact)) if exact is not None else query


def _spelt(strings: frozenset[str]) -> Query:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return _least(sets) if all(sets) else None


def _least(sets: list[frozenset[str]]) -> Query:
    """Without the alternatives that ask for more than another one."""
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return _least([x | y for x, y in product(a, b)])


def _sequence(parts: sre_parser.SubPattern) -> tuple[frozenset[str] | None, Query]:
    """All strings of a sequence if they are few, else None; and what stretches before require."""
    strings: frozenset[str] = frozenset([""])
    query: Query = None
    whole = True
    for part in parts:
        own, required = _part(*part)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, own))
            query = _both(query, required)
            continue
        query = _both(_both(query, _spelt(strings)), required)
        strings, whole = (own, False) if own is not None else (frozenset([""]), False)
    return (strings, query) if whole else (None, _both(query, _spelt(strings)))


def _part(kind: object, value: object) -> tuple[frozenset[str] | None, Query]:
    if kind is sre.LITERAL:
        return frozenset([chr(value).lower()]), None
    if kind is sre.IN:
        return _choices(value), None
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.BRANCH:
        found = [_sequence(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in found):
            return frozenset().union(*(strings for strings, _ in found)), None
        queries = [query if strings is None else _both(query, _spelt(strings)) for strings, query in found]
        return None, None if any(q is None for q in queries) else _least([s for q in queries for s in q])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most <= 3 and sum(len(strings) ** n for n in range(least, most + 1)) <= MOST_STRINGS:
            return frozenset("".join(p) for n in range(least, most + 1) for p in product(strings, repeat=n)), query if least else None
        if strings is not None and least and len(strings) ** min(least, 3) <= MOST_STRINGS:
            query = _both(query, _spelt(frozenset("".join(p) for p in product(strings, repeat=min(least, 3)))))
        return None, query if least else None
    if kind is sre.AT:
        return frozenset([""]), None
    return None, None


def _choices(items: list[tuple[object, object]]) -> frozenset[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST_CHOICES:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= MOST_CHOICES else None
