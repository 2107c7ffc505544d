"""English suffix stemmer as a table of rules, used by three back ends: Python, Spark columns and SQL text.

A word first has its consonant y rewritten to Y, so that every condition on the stem is a plain regular expression.
Each stage tries its suffixes in order; the first that the word ends with decides, and its stem is replaced only if the
condition holds. Words of up to two characters or without a letter stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1, MANY = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
CVC = "[^aeiouy][aeiouy][^aeiouwxy]$"
ANY = "^"

# Suffix, replacement, condition on what stands before the suffix.
STEP_1A = [("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)]
STEP_2 = [(a, b, M0) for a, b in [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]]
STEP_3 = [(a, b, M0) for a, b in [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]]
STEP_4 = [(a, "", MANY) for a in ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]]
# End of fixed values.


class _Spark:
    lit = staticmethod(F.lit)
    ends = staticmethod(lambda w, s: F.endswith(w, F.lit(s)))
    cut = staticmethod(lambda w, n: F.substring(w, F.lit(1), F.length(w) - n))
    like = staticmethod(lambda w, p: F.regexp_like(w, F.lit(p)))
    join = staticmethod(lambda w, s: F.concat(w, F.lit(s)))
    both = staticmethod(lambda a, b: a & b)
    last = staticmethod(lambda w, n: F.when(F.length(w) >= n, F.substring(F.substring(w, -n, n), 1, 1)).otherwise(F.lit("")))
    same = staticmethod(lambda a, b: F.lower(a) == F.lower(b))

    @staticmethod
    def case(pairs, other):
        out = None
        for c, v in pairs:
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)


class _Sql:
    lit = staticmethod(lambda s: f"'{s}'")
    ends = staticmethod(lambda w, s: f"ends_with({w}, '{s}')")
    cut = staticmethod(lambda w, n: f"substr({w}, 1, length({w}) - {n})")
    like = staticmethod(lambda w, p: f"regexp_matches({w}, '{p}')")
    join = staticmethod(lambda w, s: f"({w} || '{s}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    last = staticmethod(lambda w, n: f"(CASE WHEN length({w}) >= {n} THEN substr({w}, length({w}) - {n - 1}, 1) ELSE '' END)")
    same = staticmethod(lambda a, b: f"(lower({a}) = lower({b}))")
    case = staticmethod(lambda pairs, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END")


class _Plain:
    lit = staticmethod(lambda s: s)
    ends = staticmethod(lambda w, s: w.endswith(s))
    cut = staticmethod(lambda w, n: w[: max(len(w) - n, 0)])
    like = staticmethod(lambda w, p: re.search(p, w) is not None)
    join = staticmethod(lambda w, s: w + s)
    both = staticmethod(lambda a, b: a and b)
    last = staticmethod(lambda w, n: w[-n] if len(w) >= n else "")
    same = staticmethod(lambda a, b: a.lower() == b.lower())
    case = staticmethod(lambda pairs, other: next((v for c, v in pairs if c), other))


def _suffixes(o, rules):
    def run(w):
        cases = []
        for suffix, new, condition in rules:
            keep = 1 if suffix in ("sion", "tion") and new == "" else 0  # their s or t belongs to the stem
            stem = o.cut(w, len(suffix) - keep)
            cases.append((o.ends(w, suffix), o.case([(o.like(stem, condition), o.join(stem, new))], w)))
        return o.case(cases, w)

    return run


def _double(o, w):
    return o.both(o.same(o.last(w, 1), o.last(w, 2)), o.like(w, "[^aeiouy]$"))


def _step_1b(o):
    """Marks a word whose ed or ing went with a final `+`; the next stage mends its end."""

    def run(w):
        mark = lambda n: o.case([(o.like(o.cut(w, n), VOWEL), o.join(o.cut(w, n), "+"))], w)
        return o.case([(o.ends(w, "eed"), o.case([(o.like(o.cut(w, 3), M0), o.cut(w, 1))], w)), (o.ends(w, "ed"), mark(2)), (o.ends(w, "ing"), mark(3))], w)

    return run


def _mended(o):
    def run(w):
        s = o.cut(w, 1)
        double = o.both(o.both(o.same(o.last(s, 1), o.last(s, 2)), o.like(s, "([^aeiouy]|yY|Yy)$")), o.like(s, "..$"))
        inner = o.case([(o.ends(s, "at"), o.join(s, "e")), (o.ends(s, "bl"), o.join(s, "e")), (o.ends(s, "iz"), o.join(s, "e")), (double, o.case([(o.like(s, "[lsz]$"), s)], o.cut(s, 1))), (o.both(o.like(s, M1), o.like(s, CVC)), o.join(s, "e"))], s)
        return o.case([(o.ends(w, "+"), inner)], w)

    return run


def _step_1c(o):
    return lambda w: o.case([(o.both(o.like(w, "[yY]$"), o.like(o.cut(w, 1), VOWEL)), o.join(o.cut(w, 1), "i"))], w)


def _step_5a(o):
    def run(w):
        s = o.cut(w, 1)
        return o.case([(o.both(o.ends(w, "e"), o.like(s, MANY)), s), (o.both(o.both(o.ends(w, "e"), o.like(s, M1)), o.case([(o.like(s, CVC), o.lit("n"))], o.lit("y")) == o.lit("y") if o is not _Sql else f"NOT {o.like(s, CVC)}"), s)], w)

    return run


def _step_5b(o):
    return lambda w: o.case([(o.both(o.ends(w, "ll"), o.like(w, MANY)), o.cut(w, 1))], w)


def stages(o) -> list:
    return [_suffixes(o, STEP_1A), _step_1b(o), _mended(o), _step_1c(o), _suffixes(o, STEP_2), _suffixes(o, STEP_3), _suffixes(o, STEP_4), _step_5a(o), _step_5b(o)]


def stem(word: str) -> str:
    """The stem of one word."""
    if len(word) <= 2 or not re.search("[a-z]", word):
        return word
    out = re.sub("([aeiou])y", r"\1Y", re.sub("^y", "Y", word))
    out = re.sub("yy", "yY", out)
    for f in stages(_Plain):
        out = f(out)
    return out.lower()


def with_stem(df, column: str = "term", name: str = "stem"):
    """df with the stem of a column, in built-in functions: a projection for each stage."""
    w = F.col(column)
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y"), "yy", "yY")
    df = df.withColumn("_s", marked)
    for f in stages(_Spark):
        df = df.withColumn("_s", f(F.col("_s")))
    plain = (F.length(w) <= 2) | ~F.regexp_like(w, F.lit("[a-z]"))
    return df.withColumn(name, F.when(plain, w).otherwise(F.lower("_s"))).drop("_s")


def stem_sql(source: str) -> str:
    """CTEs `stem_0 ...` over a relation with `term`, ending in `stems(term, stem)`; to stand after WITH."""
    out = [f"stem_0 AS (SELECT term, replace(regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY') AS w FROM {source})"]
    for k, f in enumerate(stages(_Sql)):
        out.append(f"stem_{k + 1} AS (SELECT term, {f('w')} AS w FROM stem_{k})")
    out.append(f"stems AS (SELECT term, CASE WHEN length(term) <= 2 OR NOT regexp_matches(term, '[a-z]') THEN term ELSE lower(w) END AS stem FROM stem_{len(stages(_Sql))})")
    return ",\n".join(out)


def register(spark) -> None:
    """SQL function stem_en for single words."""
    spark.udf.register("stem_en", stem, "string")
