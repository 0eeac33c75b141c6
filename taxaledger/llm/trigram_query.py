"""Boolean trigram queries of regular expressions.

A query is an OR of ANDs: a set of clauses, each a set of trigrams (folded to
lower case) that a text with a match must hold. The clause without trigrams
holds for every text: such a rule has no mandatory trigram.
"""

from __future__ import annotations

from itertools import product
from re import _constants as c
from re import _parser

Query = frozenset  # of frozensets of trigrams

ANY: Query = frozenset([frozenset()])

#: More alternatives or clauses than this are given up for a weaker query.
MOST = 64


def trigram_query(pattern: str) -> Query:
    exact, query = _sequence(_parser.parse(pattern))
    return _both(query, _of_strings(exact))


def _least(clauses) -> Query:
    """Without clauses that hold a smaller one."""
    clauses = set(clauses)
    return frozenset(x for x in clauses if not any(y < x for y in clauses)) if len(clauses) <= MOST else ANY


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x, y in product(a, b)) if len(a) * len(b) <= MOST * MOST else (a if len(a) < len(b) else b)


def _of_strings(strings: frozenset) -> Query:
    folded = {s.lower() for s in strings}
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in folded)


def _sequence(items) -> tuple[frozenset, Query]:
    """(strings that the end of a match must be, query of what stands before)."""
    exact, query = frozenset([""]), ANY
    for op, value in items:
        here, needs = _item(op, value)
        if here is not None and len(here) * len(exact) <= MOST:
            exact = frozenset(a + b for a, b in product(exact, here))
            continue
        query = _both(query, _of_strings(exact))
        exact = here if here is not None and len(here) <= MOST else frozenset([""])
        query = _both(query, needs)
    return exact, query


def _item(op, value) -> tuple[frozenset | None, Query]:
    """(all strings that the item can match, or None; what it needs otherwise)."""
    if op is c.LITERAL:
        return frozenset([chr(value)]), ANY
    if op is c.IN:
        chars = set()
        for kind, x in value:
            if kind is c.LITERAL:
                chars.add(chr(x))
            elif kind is c.RANGE and x[1] - x[0] < 8:
                chars.update(map(chr, range(x[0], x[1] + 1)))
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is c.SUBPATTERN:
        return _whole(value[3])
    if op is c.BRANCH:
        parts = [_whole(p) for p in value[1]]
        if all(exact is not None for exact, _ in parts):
            return frozenset().union(*(exact for exact, _ in parts)), ANY
        return None, _least(x for exact, query in parts for x in (_both(query, _of_strings(exact)) if exact is not None else query))
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = value
        exact, query = _whole(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if least == most == 1:
            return exact, query
        if least == 0:
            return None, ANY
        return None, query if exact is None else _of_strings(exact)
    return (frozenset([""]), ANY) if op in (c.AT, c.ASSERT, c.ASSERT_NOT) else (None, ANY)


def _whole(items) -> tuple[frozenset | None, Query]:
    exact, query = _sequence(items)
    return (exact, ANY) if query == ANY and _closed(items) else (None, _both(query, _of_strings(exact)))


def _closed(items) -> bool:
    """Whether every item has a list of all its strings."""
    return all(_item(op, value)[0] is not None for op, value in items)


def matches_query(query: Query, text: str) -> bool:
    """For tests: whether ``text`` can hold a match."""
    folded = text.lower()
    return any(all(t in folded for t in clause) for clause in query)


