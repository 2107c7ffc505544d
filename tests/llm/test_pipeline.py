import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from textquarry.llm import mixing, near_dups, secrets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    found = words((text or "").translate(LOW))
    return {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, min(len(found), 1)))}


def brute(texts: dict[int, str | None], percent: int) -> dict[int, int]:
    """The smallest id of each text's component."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s & t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in texts}


def test_dedup_links_from_80(spark):
    """Pairs on both sides of 0.80 and 0.85: the stage keeps what brute force at 80 % keeps, op9's default what it keeps at 85 %."""
    rng, texts = np.random.default_rng(13), {}
    for g in range(60):
        base = [f"w{g}x{k}" for k in range(150)]
        copy = list(base)
        for k in range(g % 10):
            copy[5 + 14 * k] = f"n{rng.integers(1 << 40)}"
        texts |= {2 * g: " ".join(base), 2 * g + 1: " ".join(copy)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    by = {p: {i for i, r in brute(texts, p).items() if i == r} for p in (80, 85)}
    assert by[80] != by[85]
    assert {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()} == by[80]
    assert {r.doc_id for r in near_dups.classes(docs).where("kept").collect()} == by[85]


def workers(plan: str) -> int:
    """How many Python workers a task of a physical plan holds at most: its Python nodes between exchanges, one above the other."""
    above: list[tuple[int, int]] = []
    most = 0
    for line in plan.splitlines():
        depth = re.match(r"[ :+-]*", line).end()
        above = [x for x in above if x[0] < depth]
        name = re.sub(r"^(\*\s*\(\d+\) )?", "", line[depth:])
        n = 0 if "Exchange" in name.split(" ")[0] else (above[-1][1] if above else 0) + bool(re.match(r"\w*(Arrow|Pandas|Python)", name))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_dedup_holds_one_worker_a_task(spark, monkeypatch):
    """Links are confirmed and contracted by one Python node: each worker that a task holds stays with its executor and adds to its memory."""
    assert workers("A\n+- MapInArrow x\n   +- *(1) Project\n      +- MapInArrow y") == 2 and workers("MapInArrow x\n+- Exchange y\n   +- MapInArrow z") == 1
    seen, write = {}, near_dups.materialise

    def noted(df, name):
        seen[name] = max(seen.get(name, 0), workers(df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(near_dups, "materialise", noted)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join([*base, f"n{i}"]), "en", "s", 0) for i in range(6)] + [(9, "alone", "en", "s", 0), (10, None, "en", "s", 0)]
    out = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2), "")
    assert {r.doc_id for r in out.collect()} == {0, 9, 10}
    assert {"signatures", "peeled", "edges", "rest"} <= set(seen) and max(seen.values()) == 1 == seen["edges"], seen


def test_repeated_ids_lose_no_text(spark):
    """A doc_id with several texts: dedup drops just the copy, and the mix takes each row, of either source, with or without words."""
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [(1, text(1), "a"), (5, text(1), "a"), (5, text(2), "a"), (5, text(3), "a"), (5, text(3), "a"), (7, text(3), "a"), (8, "", "a"), (8, None, "a")]
    schema = "doc_id long, text string, source string"
    got = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, text(1)), (5, text(2)), (5, text(3)), (8, ""), (8, "")]
    rows = [(1, text(1), "a"), (1, text(1), "b"), (1, text(1), None), (2, "", "a"), (2, "", "a"), (2, None, "a"), (2, "", "b")]
    docs = spark.createDataFrame(rows, schema)
    mixed, planned = corpus_pipeline.mixture(spark, docs, "").collect(), mixing.plan(docs).collect()
    assert sorted((r.doc_id, r.source or "") for r in mixed) == sorted((r.doc_id, r.source or "") for r in planned for _ in r.positions)
    assert sum(r.doc_id == 2 for r in mixed) == 4 and {r.source for r in mixed if r.doc_id == 1} == {"a", "b", None}
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in planned)


def test_chunks_keep_the_bound():
    assert near_dups.chunked(85)[0] == 19 and near_dups.chunked(80)[0] == 23
    rng = np.random.default_rng(14)
    for percent in (60, 70, 80, 85, 95):
        most, bounds = near_dups.chunked(percent)
        assert bounds[0] == 0 and bounds[-1] == near_dups.K and most == 2 * len(bounds) - 3
        assert ((rng.random((100_000, near_dups.K)) > percent / 100).sum(1) > most).mean() <= 1e-4


def masked(text: str) -> str:
    """The text with overlapping spans of all rules replaced together."""
    spans = sorted((m.start(), m.end()) for _, p, g, least in secrets.RULES for m in re.finditer(p, text) if len(m.group(g)) >= least)
    out, at = "", 0
    for start, stop in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, stop)
    return out + text[at:]


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, held against a plain version: rows kept, masked texts, words taken, ids in sequences."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    odd = [(top + 1, "12 -- 34", "en", "s"), (top + 2, None, None, None), (top + 3, "", "en", "s"), (top + 4, "some words token=0123456789abcdef0123 é " * 9, None, "s")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    columns, before, languages = docs.columns, docs.collect(), {r.lang for r in docs.select("lang").distinct().collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name == "packing":
            after = docs.collect()
        else:
            docs = corpus_pipeline.materialise(docs, name)
            after = docs.collect()
            assert docs.columns == columns
        seen.append(name)
        texts = {r.doc_id: r.text for r in before}
        if name == "language":
            want = [(r.doc_id, r.text, r.source) for r in before if regex.search(r"\p{L}", r.text or "")]
            assert Counter((r.doc_id, r.text, r.source) for r in after) == Counter(want) and len(want) < len(before)
            assert {r.lang for r in after} <= languages - {None}
        elif name == "dedup":
            want = {i for i, root in brute(texts, 80).items() if i == root}
            assert Counter((r.doc_id, r.text) for r in after) == Counter((i, texts[i]) for i in want) and len(want) < len(texts)
        elif name == "secrets":
            assert {r.doc_id: r.text for r in after} == {i: masked(t) for i, t in texts.items()} and len(after) == len(before)
            assert any("[SECRET]" in r.text for r in after)
        elif name == "mixing":
            taken = Counter()
            for r in after:
                some = words(r.text)
                assert some == words(texts[r.doc_id])[: len(some)]
                taken[r.doc_id] += len(some)
            assert taken == Counter({r["doc_id"]: r["taken"] for r in plan}) and sum(taken.values()) > 0
        else:
            tokenizer, want = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), Counter()
            for r in before:
                ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
                want.update((r.doc_id, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after) == want
            ends = {}
            for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= 2048
        if name == "secrets":
            plan = mixing.plan(docs).collect()
        before = after
    assert seen == ["language", "dedup", "secrets", "mixing", "packing"]
