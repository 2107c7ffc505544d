"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and, as licenses are wrapped, all windows of consecutive words over the whole text, across line
breaks, of up to SPAN times a template's words (so a comment mark or a changed word on each line still fits), as sets of words; a
block meets a template if it holds at least THRESHOLD of the template's distinct words. The text as one block holds all others,
so only templates that it meets are sought in lines and windows. Words are ordered by how many documents hold them, rarest first (counted over all documents). Prefix filter: a
block that lacks all of a template's first |T| - need + 1 words cannot meet it. Length filter: a block has at least `need`
words. Positional filter: if the first shared word is at place i of the template, at most |T| - i words can be shared.

Null and empty texts have no word, place or label and score 0. The template list is fixed, so what is sent to tasks is bounded.
Repeated rows give a row each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, table

THRESHOLD = 0.9
SPAN = 2
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
}
#: A-Z to lower case, and every byte that is in no word to a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LINES = bytes(10 if c == 10 else TO_WORDS[c] for c in range(256))


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How many documents hold each word of the templates."""
    words = sorted({w.encode() for t in templates.values() for w in t.split()})

    def held(text: bytes) -> tuple:
        own = set(text.translate(TO_WORDS).split())
        return ([i for i, w in enumerate(words) if w in own],)

    rows = map_texts(docs.select("text"), held, "held array<int>", []).select(F.explode("held").alias("w")).groupBy("w").count().collect()  # a row for each template word
    return {w: 0 for w in words} | {words[r["w"]]: r["count"] for r in rows}


class Scanner:
    def __init__(self, often: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.first: dict[bytes, list[tuple[int, str]]] = {}
        self.sets: dict[str, tuple[list[bytes], int]] = {}
        self.spans = {name: SPAN * len(text.split()) for name, text in templates.items()}
        for name, text in templates.items():
            t = sorted({w.encode() for w in text.split()}, key=lambda w: (often.get(w, 0), w))
            need = -(-round(threshold * 1000) * len(t) // 1000)
            self.sets[name] = (t, need)
            for i, w in enumerate(t[: len(t) - need + 1]):
                self.first.setdefault(w, []).append((i, name))
        self.prefix = self.first.keys()

    def block(self, words: set[bytes]) -> dict[str, float]:
        out, seen = {}, set()
        for i, name in sorted((x for w in self.prefix & words for x in self.first[w])):
            t, need = self.sets[name]
            if name in seen or len(words) < need:
                continue
            seen.add(name)  # i is the place of the first shared word
            if len(t) - i >= need and (n := sum(w in words for w in t[i:])) >= need:
                out[name] = n / len(t)
        return out

    def windows(self, words: list[bytes], name: str) -> float:
        """The largest share of the template that a window of `words` holds; 0 if none meets it."""
        t, need = self.sets[name]
        each, span = set(t), self.spans[name]
        at = [(i, w) for i, w in enumerate(words) if w in each]
        inside, most, lo = dict.fromkeys(t, 0), 0, 0
        held = 0  # words of the template in the window that ends at i
        for i, w in at:
            held += not inside[w]
            inside[w] += 1
            while i - at[lo][0] >= span:
                inside[at[lo][1]] -= 1
                held -= not inside[at[lo][1]]
                lo += 1
            most = max(most, held)
        return most / len(t) if most >= need else 0.0

    def text(self, text: bytes) -> tuple:
        words = text.translate(TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p, at, before, n = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := line.find(p, at + 1)) >= 0:
                n += line.count(b" ", before, at)
                before = at
                places.append(n)
                labels.add(label)
        found: dict[str, float] = {}
        if not self.prefix.isdisjoint(words) and (can := self.block(set(words))):
            for k in can:
                if (v := self.windows(words, k)) > 0:
                    found[k] = v
            for x in text.translate(LINES).split(b"\n"):
                for k, v in self.block(set(x.split())).items():
                    found[k] = max(v, found.get(k, 0.0))
        score = 1.0 if places else max(found.values(), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    scanner = Scanner(frequencies(docs, templates), templates, threshold)
    return map_texts(docs.select("doc_id", "text"), scanner.text, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", ["doc_id"])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
