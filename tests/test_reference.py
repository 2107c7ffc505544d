import random

import pytest

import __spark_entry__ as entry
from textquarry.functions import stemmer, tokens
from textquarry.operators import index, search, zipf
from textquarry.plans import registry
from textquarry.sources import corpus

STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall filing file happy happi sky sky relational relat generalization gener running run mathematics mathemat applied appli displaystyle displaystyl adoption adopt controlled control replacement replac hopefulness hope technology technolog geology geologi possibly possibli probably probabl this thi is is 1990s 1990 1990 1990 byyed by function function trivial trivial thes the".split()
QUERIES = {"a b": "a&b", "a | b c": "", "!a b": "", "a &": "", "& a": "", "a |": "", "a & & b": "", "!": "", "a !": "", "a & | b": "", "a | & b": "", "( a": "", ") a": "", "()": "", "a ) b": "", "!!a": ""}
#: Over the documents 0..7, a holds bit 0, b bit 1, c bit 2.
EXPECTED = {"a b": {3, 7}, "a | b c": {1, 3, 5, 6, 7}, "!a b": {2, 6}, "a &": set(), "& a": set(), "a |": {1, 3, 5, 7}, "a & & b": set(), "!": set(range(8)), "a !": set(), "a & | b": {2, 3, 6, 7}, "a | & b": {3, 7}, "( a": {1, 3, 5, 7}, ") a": set(), "()": set(), "a ) b": {3, 7}, "!!a": {1, 3, 5, 7}}


def test_stems(spark):
    words, stems = STEMS[::2], STEMS[1::2]
    assert [stemmer.stem(w) for w in words] == stems
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert {(r.term, r.stem) for r in stemmer.with_stem(df).collect()} == set(zip(words, stems))


def test_stem_forms_agree(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiybwlstd1ngz") for _ in range(rng.randint(1, 9))) + rng.choice(["", "ed", "ing", "ational", "ness", "ll", "e"]) for _ in range(3000)]
    rows = stemmer.with_stem(spark.createDataFrame([(w,) for w in words], "term string")).collect()
    assert all(stemmer.stem(r.term) == r.stem for r in rows)


@pytest.mark.parametrize("text,want", [("Café 1990s a_b", ["caf", "1990s", "a", "b"]), ("Kelvin", ["elvin"]), ("İx", ["x"]), ("state-of-the-art", ["state", "of", "the", "art"]), ("", []), ("AbC", ["abc"]), ("a" * 300, ["a" * 255])])
def test_tokens(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tokens.tokens(df.text)).first()[0] == want


def test_malformed_queries(spark):
    docs = spark.createDataFrame([(i, " ".join(t for k, t in enumerate("abc") if i >> k & 1)) for i in range(8)], "doc_id long, text string").cache()
    p = index.postings(docs).cache()
    for q, want in EXPECTED.items():
        assert {r.doc_id for r in search.hits(q, docs, p).collect()} == want, q
        assert {r.doc_id for r in search.hits_by_sets(q, docs, p).collect()} == want, q


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_crawl_reaches_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(53)] + [("n53", "n0")], "parent string, child string").coalesce(1)
    assert {(r.node, r.level) for r in corpus.crawl_levels(edges, "n0").collect()} == {(f"n{i}", i) for i in range(54)}
    assert corpus.crawl_levels(edges, "n0", most=2).count() == 3


DOCS = [(30, "the quick fox", "Thirty"), (10, "function of an algorithm", None), (20, "a trivial algorithm, the proof", ""), (25, None, "Empty"), (40, "network proof", "Forty")]


def test_written_index_round_trip(spark, tmp_path):
    """Sparse, unsorted keys: documents, postings and pages share one ordinal; the example queries run over a written index."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    index.write(docs, f"{tmp_path}/i")
    found = index.read(spark, f"{tmp_path}/i")
    assert sorted(tuple(r) for r in found["docs"].collect()) == [(0, "10", "10", ""), (1, "20", "20", ""), (2, "25", "Empty", ""), (3, "30", "Thirty", ""), (4, "40", "Forty", "")]
    ask = lambda q: [r.doc_id for r in search.page(search.hits(q, found["docs"], found["postings"]), found["docs"]).collect()]
    assert ask("function") == [0] and ask("(algorithm || proof) !trivial") == [0, 4] and ask("(!network) (algorithm || proof)") == [0, 1]
    assert ask("!the") == [0, 2, 4] and ask("the") == [1, 3]
    page = search.page(search.hits("the", found["docs"], found["postings"]), found["docs"], 1, 1)
    assert [r.line for r in search.lines(page).collect()] == ["3\tThirty\t"]
    got = {(r.query, r.hits, r.shown) for r in search.batch(["the", "  ", "!the\r\n"], found["docs"], found["postings"]).collect()}
    assert got == {("the", 2, 2), ("!the", 3, 3)}
    lists = {r.term: (r.df, r.doc_ids) for r in index.compact(found["postings"]).collect()}
    assert lists["the"] == (2, [1, 3]) and lists["algorithm"] == (2, [0, 1])
    with pytest.raises(ValueError):
        search.page(page, found["docs"], -1)
    found["lexicon"].write.parquet(f"{tmp_path}/j/docs")
    with pytest.raises(ValueError):
        index.read(spark, f"{tmp_path}/j")
    plan = search.hits("the", found["docs"], found["postings"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,the)" in plan


def test_manifest_order_and_files(spark, tmp_path):
    """Ordinals in the order of the manifest, missing files keep theirs, repeated ids have one each, lines without an id none."""
    from pyspark.sql import functions as F

    (tmp_path / "c").mkdir()
    for name, text in (("b", "the proof"), ("a", "an algorithm"), ("_h", "hidden")):
        (tmp_path / "c" / f"{name}.txt").write_text(text)
    (tmp_path / "c" / "sub").mkdir()
    (tmp_path / "c" / "sub" / "d.txt").write_text("deep é")
    (tmp_path / "m.jsonl").write_text('{"doc_id": "b", "title": "B"}\n{"title": "none"}\n{"doc_id": "missing"}\n{"doc_id": "a", "url": "u"}\n{"doc_id": "b"}\n')
    flat, deep = corpus.text_files(spark, f"{tmp_path}/c"), corpus.text_files(spark, f"{tmp_path}/c", True)
    assert {r.doc_key for r in flat.collect()} == {"a", "b"} and {(r.doc_key, r.bytes) for r in deep.collect()} == {("a", 12), ("b", 9), ("d", 7)}
    rows = corpus.with_text(corpus.manifest(spark, f"{tmp_path}/m.jsonl"), flat)
    index.write(rows, f"{tmp_path}/i", order="place")
    found = index.read(spark, f"{tmp_path}/i")
    assert sorted(tuple(r) for r in found["docs"].collect()) == [(0, "b", "B", ""), (1, "missing", "missing", ""), (2, "a", "a", "u"), (3, "b", "b", "")]
    assert {r.doc_id for r in found["postings"].where(F.col("term") == "proof").collect()} == {0, 3}


def test_zipf_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "b a a runs running c"), (1, "a b")], "doc_id long, text string")
    zipf.write(docs, str(tmp_path))
    curve = corpus.rank_curve(spark, f"{tmp_path}/rank_freq", 3)
    assert [tuple(r) for r in curve.collect()] == [(1, 3), (2, 2), (3, 2)]
    assert [(r.rank, r.term, r.freq) for r in zipf.ranked(docs).orderBy("rank").collect()] == [(1, "a", 3), (2, "b", 2), (3, "run", 2), (4, "c", 1)]
    assert [r.value for r in spark.read.text(f"{tmp_path}/summary").collect()] == ["files=2", "bytes_total=23", "tokens_total=8", "unique_terms=4", "topN=20"]


GRAPH = {"root": (["A", "B"], ["p1", "p2"]), "A": (["root", "C"], ["p2", "p3"]), "B": ([], ["Talk:x"]), "C": ([], ["p4", "p5"])}


def fetch(params: dict) -> dict:
    """An API of pages of two members each."""
    if params.get("prop") == "extracts":
        t = params["titles"]
        return {"query": {"pages": {"1": {"pageid": int(t[1:]), "title": t, "extract": "word " * int(t[1:])} if t[0] == "p" else {"title": t, "missing": ""}}}}
    at, names = int(params.get("cmcontinue", 0)), GRAPH[params["cmtitle"]][params["cmtype"] == "page"]
    members = [{"pageid": int(n[1:]) if n[0] == "p" else 900, "title": n, "ns": 0 if n[0] == "p" else 1} for n in names]
    return {"query": {"categorymembers": members[at : at + 2]}} | ({"continue": {"cmcontinue": at + 2}} if at + 2 < len(members) else {})


def test_crawler(spark, tmp_path):
    assert corpus.dry_run_count(fetch, "root") == {"categories_processed": 4, "categories_seen": 4, "unique_pages": 5, "stopped_reason": "done"}
    assert corpus.dry_run_count(fetch, "root", limit_pages=3)["stopped_reason"] == "limit_pages" and corpus.dry_run_count(fetch, "root", limit_cats=2)["categories_processed"] == 2
    rows = corpus.build_corpus(spark, fetch, "root", 10, 3, "https://e/", chunk=2)
    assert [(r.title, r.category_seed, r.word_count, r.url) for r in rows.orderBy("pageid").collect()] == [("p3", "A", 3, "https://e/p3"), ("p4", "C", 4, "https://e/p4"), ("p5", "C", 5, "https://e/p5")]
    assert corpus.build_corpus(spark, fetch, "root", 2, 1, "").count() == 2 and corpus.build_corpus(spark, fetch, "B", 2, 1, "").count() == 0
    corpus.write_files(rows, f"{tmp_path}/out")
    back = corpus.with_text(corpus.manifest(spark, f"{tmp_path}/out/manifest.jsonl"), corpus.text_files(spark, f"{tmp_path}/out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in rows.collect()}


def test_stemmed_postings(spark):
    docs = spark.createDataFrame([(0, "runs running cats"), (1, "cat the")], "doc_id long, text string")
    assert {tuple(r) for r in index.postings(docs, True).select("doc_id", "term").collect()} == {(0, "run"), (0, "cat"), (1, "cat"), (1, "the")}


def test_index_tasks_stay_small(spark, tmp_path, monkeypatch):
    """Tasks follow the size of the table, not spark.sql.shuffle.partitions; texts are shuffled and stored once, as terms."""
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else " ".join(f"w{i * k % 97}" for k in range(1, 21)) + " the THE") for i in range(300, 0, -1)], "doc_id long, text string")
    kept, shuffles = [], []

    def stored(df, name):
        kept.append(df.columns)
        shuffles.append(df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
        return store(df, name)

    store = index.stored
    monkeypatch.setattr(index, "stored", stored)
    monkeypatch.setattr(index, "TASK_POSTINGS", 500, raising=False)
    monkeypatch.setattr(index, "TASK_BYTES", 2000, raising=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    index.write(docs, f"{tmp_path}/i")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    found = index.read(spark, f"{tmp_path}/i")
    rows = [(r.term, r.doc_id) for r in found["postings"].collect()]
    want = {(t, i - 1) for i in range(1, 301) if i % 50 != 7 for t in {f"w{i * k % 97}" for k in range(1, 21)} | {"the"}}
    assert len(rows) == len(want) and set(rows) == want and {r.doc_id for r in found["docs"].collect()} == set(range(300))
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "i" / "postings").glob("part-*")]
    assert len(files) >= len(want) // 500 > 4 and max(files) < 1500
    assert len(kept) == 1 and "text" not in kept[0] and "terms" in kept[0] and shuffles == [1]


def test_bool_not_over_many_small_tasks(spark, monkeypatch):
    """Terms that several files share, and an index written with one copy of the documents, answer as the SQL does."""
    import duckdb

    folder, kept, store = "/root/testdata/sf0.001", [], index.stored
    monkeypatch.setattr(registry, "_INDEXES", {})
    monkeypatch.setattr(index, "stored", lambda df, name: kept.append(name) or store(df, name))
    monkeypatch.setattr(index, "TASK_POSTINGS", 2000, raising=False)
    monkeypatch.setattr(index, "TASK_BYTES", 20_000, raising=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name in ("bool_not", "bool_and", "index_lexicon", "index_postings"):
        got = sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).collect())
        assert got == sorted(con.execute(registry.SQL[name]).fetchall()) and got, name
    assert kept == ["ordered"]


def test_texts_are_cut_into_terms_once(spark, tmp_path, monkeypatch):
    """Range partitions are sampled, which runs what stands below them a second time: texts are cut above the only one that has them."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    frame, sampled = type(docs), []
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: sampled.append(self._jdf.queryExecution().optimizedPlan().toString()) or deal(self, *a))
    index.write(docs, f"{tmp_path}/i")
    found = index.read(spark, f"{tmp_path}/i")
    assert len(sampled) == 3 and not any("regexp_extract_all" in x for x in sampled)
    assert {r.doc_id for r in search.hits("the algorithm", found["docs"], found["postings"]).collect()} == {1}
