"""Boolean queries: a line becomes postfix items, those fold to one predicate, and one grouped pass over postings answers it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import stem

LEXER = re.compile(r"(?P<term>[0-9A-Za-z]+)|(?P<op>&&?|\|\|?|!|\(|\))")
BINDS = {"!": 3, "&": 2, "|": 1}


def postfix(line: str) -> list[tuple[str, str]]:
    """Items ('term', stem) and ('op', '&' '|' '!'). Neighbouring values are joined by `&`; unknown characters and unbalanced
    parentheses go; nothing is an error."""
    out, held, before = [], [], None

    def push(op: str) -> None:
        while held and held[-1] != "(" and (BINDS[held[-1]] > BINDS[op] or (BINDS[held[-1]] == BINDS[op] and op != "!")):
            out.append(("op", held.pop()))
        held.append(op)

    for m in LEXER.finditer(line):
        kind = "term" if m["term"] else m["op"][0]
        if before in ("term", ")") and kind in ("term", "(", "!"):
            push("&")
        if kind == "term":
            out.append(("term", stem(m["term"][:255].lower())))
        elif kind == "(":
            held.append(kind)
        elif kind == ")":
            while held and held[-1] != "(":
                out.append(("op", held.pop()))
            if held:
                held.pop()
        else:
            push(kind)
        before = kind
    out += [("op", x) for x in reversed(held) if x != "("]
    return out


def fold(items: list[tuple[str, str]], has, none, both, either, negate):
    """Runs the items on a stack; a missing operand is `none`, the answer is the top."""
    stack: list = []
    pop = lambda: stack.pop() if stack else none
    for kind, x in items:
        if kind == "term":
            stack.append(has(x))
        elif x == "!":
            stack.append(negate(pop()))
        else:
            b, a = pop(), pop()
            stack.append(both(a, b) if x == "&" else either(a, b))
    return stack[-1] if stack else none


def terms(items) -> list[str]:
    return sorted({x for kind, x in items if kind == "term"})


def needs_all(items) -> bool:
    """Whether a document without any of the terms is a hit."""
    return bool(fold(items, lambda _: False, False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a))


def hits(line: str, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id of the documents that meet the query."""
    items = postfix(line)
    names = {t: f"h{k}" for k, t in enumerate(terms(items))}
    condition: Column = fold(items, lambda t: F.col(names[t]), F.lit(False), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    if not names:
        return docs.select("doc_id").where(condition)
    held = postings.where(F.col("term").isin(list(names))).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(h) for t, h in names.items()])
    if needs_all(items):
        held = docs.select("doc_id").join(held, "doc_id", "left").select("doc_id", *[F.coalesce(h, F.lit(False)).alias(h) for h in names.values()])
    return held.where(condition).select("doc_id")


def hits_by_sets(line: str, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """The same by set operators; a second way to hold against the first."""
    every = docs.select("doc_id")
    return fold(postfix(line), lambda t: postings.where(F.col("term") == t).select("doc_id"), every.where(F.lit(False)), lambda a, b: a.intersect(b), lambda a, b: a.union(b).distinct(), lambda a: every.join(a, "doc_id", "left_anti"))


def page(found: DataFrame, docs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """doc_id, title, url of the hits from offset on, ascending."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return docs.join(found.orderBy("doc_id").offset(offset).limit(limit), "doc_id").select("doc_id", "title", "url").orderBy("doc_id")


def lines(shown: DataFrame) -> DataFrame:
    return shown.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "title", "url").alias("line"))


def stats(line: str, found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    n = found.agg(F.count(F.lit(1)).alias("hits"))
    return n.select(F.lit(line).alias("query"), "hits", F.least(F.lit(limit), F.greatest(F.col("hits") - offset, F.lit(0))).cast("long").alias("shown"), F.lit(offset).cast("long").alias("offset"))


def batch(queries: list[str], docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Statistics of several queries; blank lines are skipped."""
    out = None
    for q in queries:
        if q.strip(" \t\r\n"):
            one = stats(q.rstrip("\r\n"), hits(q, docs, postings))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else stats("", docs.select("doc_id")).where(F.lit(False))
