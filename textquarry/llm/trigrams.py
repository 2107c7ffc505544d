"""Boolean trigram queries of regular expressions.

query(pattern) reads the parsed expression and returns what every match holds, of the lower-cased text: True (nothing is known: a
full scan), ("and", parts) or ("or", parts), with trigrams as strings. For each part of the expression it keeps either all strings
that the part can be (while they are few), or the strings that it begins and ends with, and the query of its inside. Joining two
parts adds the trigrams that stand across the seam. Anything not understood counts as any string, so no match is ever lost.
"""

from __future__ import annotations

import re
from itertools import product

_parser = re._parser  # the standard library's own parser of expressions
MOST = 24  #: strings of a part beyond this number are shortened to their ends


def trigrams(word: str) -> list[str]:
    return [word[i : i + 3] for i in range(len(word) - 2)]


def both(*parts):
    flat: list = []
    for p in parts:
        for x in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if x is not True and x not in flat:
                flat.append(x)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(sorted(flat, key=repr)))


def either(*parts):
    flat: list = []
    for p in parts:
        for x in p[1] if isinstance(p, tuple) and p[0] == "or" else [p]:
            if x is True:
                return True
            if x not in flat:
                flat.append(x)
    parts = lambda x: set(x[1]) if isinstance(x, tuple) and x[0] == "and" else {x}
    flat = [x for x in flat if not any(parts(y) < parts(x) for y in flat)]  # "a or (a and b)" is "a"
    return flat[0] if len(flat) == 1 else ("or", tuple(sorted(flat, key=repr)))


def _of(words: set[str]):
    """What a text holds that holds one of the words."""
    return either(*[both(*trigrams(w)) for w in sorted(words)]) if words else True


class Part:
    """exact: all strings of the part, or None; head, tail: what it begins and ends with, one of each; query: of its inside."""

    def __init__(self, exact=None, head=frozenset({""}), tail=frozenset({""}), query=True) -> None:
        self.exact = exact
        self.head, self.tail, self.query = (exact, exact, True) if exact is not None else (head, tail, query)

    def loose(self) -> Part:
        """The same without exact strings: their trigrams go into the query, their ends stay."""
        if self.exact is None:
            head, tail = ({w[:2] for w in self.head} if len(self.head) > MOST else self.head), ({w[-2:] for w in self.tail} if len(self.tail) > MOST else self.tail)
            return Part(None, head if len(head) <= MOST else {""}, tail if len(tail) <= MOST else {""}, both(self.query, _of(self.head), _of(self.tail)))
        head, tail = {w[:2] for w in self.exact}, {w[-2:] for w in self.exact}
        return Part(None, head if len(head) <= MOST else {""}, tail if len(tail) <= MOST else {""}, _of(self.exact))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return Part({a + b for a, b in product(self.exact, other.exact)})
        ends, begins = (self if self.exact is not None else self.loose()), (other if other.exact is not None else other.loose())
        seam = _of({a + b for a, b in product(ends.tail, begins.head)}) if len(ends.tail) * len(begins.head) <= MOST * MOST else True
        head = {a + b for a, b in product(self.exact, begins.head)} if self.exact is not None and len(self.exact) * len(begins.head) <= MOST else ends.loose().head if self.exact is not None else ends.head
        tail = {a + b for a, b in product(ends.tail, other.exact)} if other.exact is not None and len(ends.tail) * len(other.exact) <= MOST else begins.loose().tail if other.exact is not None else begins.tail
        return Part(None, head, tail, both(self.loose().query, other.loose().query, seam))

    def whole(self):
        return self.loose().query


ANY, EMPTY = Part(), Part(frozenset({""}))


def _chars(items) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are many or unknown."""
    out: set[str] = set()
    for op, v in items:
        if op == _parser.LITERAL:
            out.add(_low(chr(v)))
        elif op == _parser.RANGE and v[1] - v[0] < 128:
            out |= {_low(chr(c)) for c in range(v[0], v[1] + 1)}
        else:
            return None
        if len(out) > MOST:
            return None
    return out


def _low(c: str) -> str:
    return c.lower() if c.isascii() else c


def _part(parsed, fold: bool) -> Part:
    whole = EMPTY
    for op, v in parsed:
        if op == _parser.LITERAL:
            # a letter that other than ASCII ones equal when case is ignored counts as unknown
            one = ANY if fold and not chr(v).isascii() else Part(frozenset({_low(chr(v))}))
        elif op == _parser.IN:
            found = _chars(v)
            one = ANY if found is None or (fold and any(not c.isascii() for c in found)) else Part(frozenset(found))
        elif op == _parser.SUBPATTERN:
            one = _part(v[3], fold or bool(v[1] & re.I))
        elif op == _parser.BRANCH:
            parts = [_part(x, fold) for x in v[1]]
            if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
                one = Part(frozenset().union(*[p.exact for p in parts]))
            else:
                parts = [p.loose() for p in parts]
                one = Part(None, frozenset().union(*[p.head for p in parts]), frozenset().union(*[p.tail for p in parts]), either(*[p.query for p in parts]))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            least, most, inner = v[0], v[1], _part(v[2], fold)
            if least == 0:
                one = Part(inner.exact | {""}) if most == 1 and inner.exact is not None and len(inner.exact) < MOST else ANY
            else:
                one = EMPTY
                for _ in range(min(least, 4)):
                    one = one.then(inner)
                if least > 4 or most != least:  # more may stand between
                    one = one.loose().then(ANY).then(inner.loose()) if inner.exact is None or inner.exact != {""} else one
        elif op == _parser.AT:
            one = EMPTY
        else:
            one = ANY
        whole = whole.then(one)
    return whole


def query(pattern: str):
    """The query of a regular expression; True if no trigram is mandatory."""
    parsed = _parser.parse(pattern)
    return _part(parsed, bool(parsed.state.flags & re.I)).whole()


def named(q) -> set[str]:
    """The trigrams of a query."""
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(named, q[1]))
