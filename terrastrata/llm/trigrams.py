"""Boolean trigram queries of regular expressions.

A query is a disjunction of conjunctions: a set of sets of trigrams, in lower case. A text that matches the expression
holds, in lower case, all trigrams of at least one of the sets. The empty set among them means that nothing is mandatory.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
MOST = 64  # strings or conjunctions that one part of an expression may grow to


def absorbed(q: Query) -> Query:
    """Without the conjunctions that another one already implies."""
    return frozenset(c for c in q if not any(d < c for d in q))


def both(a: Query, b: Query) -> Query:
    out = absorbed(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MOST else a


def of_strings(strings: frozenset[str]) -> Query:
    return absorbed(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def chars(items: list) -> frozenset[str] | None:
    """The characters of a class, None if it is negated, has categories or holds more than eight."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 64:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def parts(node: tuple) -> tuple[frozenset[str] | None, Query]:
    """The strings that the node stands for, None if too many; and what any match of it must hold."""
    op, arg = node
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ALL
    if op is C.IN:
        return chars(arg), ALL
    if op is C.AT:
        return frozenset([""]), ALL
    if op is C.SUBPATTERN:
        return sequence(arg[3])
    if op is C.BRANCH:
        strings, query = frozenset(), frozenset()
        for branch in arg[1]:
            s, q = sequence(branch)
            strings = strings | s if strings is not None and s is not None else None
            query |= q
        return strings, absorbed(query)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        s, q = sequence(body)
        if s is not None and most == 1:
            return (s | {""} if least == 0 else s), ALL
        return None, q if least else ALL
    return None, ALL


def sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    query, run, whole = ALL, frozenset([""]), True
    for node in nodes:
        strings, must = parts(node)
        grown = frozenset(a + b for a in run for b in strings) if strings is not None else None
        if grown is not None and len(grown) <= MOST:
            run = grown
            continue
        whole = False
        query = both(both(query, of_strings(run)), must)
        run = strings if strings is not None else frozenset([""])
    return (run, of_strings(run)) if whole else (None, both(query, of_strings(run)))


def query(pattern: str) -> list[list[str]] | None:
    """Conjunctions of trigrams, one of which a matching text holds in lower case; None if none is mandatory."""
    q = sequence(_parser.parse(pattern, re.ASCII))[1]
    return None if frozenset() in q else sorted(sorted(c) for c in q)
