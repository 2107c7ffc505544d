"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

Texts with the same shingle set form a class, which its smallest doc_id represents. A signature has 48 components of 16 bits. Two
sets of Jaccard similarity J differ in each component with probability under 1 - J, so at 0.85 more than 19 of 48 differ at most
once in 50,000 pairs, and at 0.80 more than 23. By pigeonhole, signatures that differ in at most 2c - 1 components differ in at
most one component of one of c chunks; each chunk is therefore indexed with each of its components left out, and the join on those
keys finds every such pair. c is the least that keeps to the once in 50,000 (10 at 0.85, 12 at 0.80). Links are confirmed on full
shingle sets.

Keys of at most FEW classes give their pairs as they are. The classes of larger keys are peeled first: with x and y linked, at
least `percent` % of x's shingles are in y, so a class with more shingles that no other class of such keys has links with none of
them and leaves those keys; the next pass counts among those left. The counts that remain bound each pair's intersection, and so
which pairs can link at all. This is exact: no link is lost.

Links are found in two rounds, so that a large group costs no square: first each class meets only its keys' leaders, the
classes that share most keys with others and those with the fewest shingles of their own; then classes that are still in
different components meet under their common keys, in blocks of bounded size, each pair under its first common key alone, and
only pairs that can link and whose signatures are near leave a block. Signatures and texts are joined to pairs, and only texts
of classes that share a key are moved, with those few others that a filter of their ids lets pass. Components come from star contractions on tables in the shared folder; no links or labels
go to the driver.

Null and empty texts have no shingle, link with nothing and are kept. Rows with a null doc_id link with nothing and are kept.
Repeated rows fall in one class; rows that repeat a doc_id with another text are linked by their text. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import dropped, map_texts, materialise, mixed, shingles, table

K, FEW, BLOCK, PEELS = 48, 4, 1024, 2
#: A task contracts so many nodes at once.
TOGETHER = 1 << 19
#: A link at the threshold itself is lost at most once in so many pairs.
LOST = 50_000
#: The shares of an id that comes with several texts: with size 0, it can link with all.
ANY = 1 << 40
#: The filter of ids whose texts are moved: its bits an id, its most bits (16 MB), and the bits of one bitmap of Spark's.
BITS, MOST_BITS, BITMAP = 32, 1 << 27, 1 << 15
SEEDS = mixed(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def chunked(percent: int) -> tuple[int, list[int]]:
    """How many components may differ, and the bounds of the chunks, so that links at `percent` % are lost once in LOST pairs at most."""
    p = 1 - percent / 100
    chunks = next(c for c in range(1, K + 1) if LOST * sum(math.comb(K, i) * p**i * (1 - p) ** (K - i) for i in range(2 * c, K + 1)) <= 1)
    return 2 * chunks - 1, [K * c // chunks for c in range(chunks + 1)]


def signature(s: np.ndarray) -> bytes:
    """The low 16 bits of the mixed minimum of each of K orders of the set: its mixed hashes times odd numbers."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (SEEDS[:, None] * s[i : i + 4096]).min(1))
    return (mixed(least) & np.uint64(65535)).astype("<u2").tobytes()


def _described(text: bytes) -> tuple:
    s = shingles(text)
    if not len(s):
        return 0, None, None
    a, b = int(np.bitwise_xor.reduce(mixed(s))), int(mixed(s ^ np.uint64(0xABCDEF)).sum())
    return len(s), f"{len(s)}:{a:x}:{b:x}", np.frombuffer(signature(s), "<i8").tolist()


def distance(a: Column, b: Column) -> Column:
    """How many of the 16-bit components of two arrays of 12 longs differ."""

    def differing(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + differing(x))


def _keys(sig: Column, bounds: list[int]) -> Column:
    """Hashes of each chunk with each of its components left out, in the order of components; a clash is only one more candidate."""
    part = lambda i: F.shiftrightunsigned(sig[i // 4], 16 * (i % 4)).bitwiseAND(F.lit(65535))
    return F.array(*[F.xxhash64(F.lit(out), *[part(i) for i in range(lo, hi) if i != out]) for lo, hi in zip(bounds, bounds[1:]) for out in range(lo, hi)])


def _near(pairs: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """pairs (a, b) with `far`, the distance of their signatures, where it is at most `most`."""
    x, y = reps.select(F.col("rep").alias("a"), F.col("sig").alias("s")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("t"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", distance(F.col("s"), F.col("t")).alias("far")).where(F.col("far") <= most)


def _contracted(batches):
    """Edges (a, b) of one task as stars: each node with the smallest that it reaches in these edges."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    def stars():
        ends = [(i, find(i)) for i in root]
        root.clear()
        x = np.array([e for e in ends if e[0] != e[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    for x in batches:
        for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist()):
            p, q = find(a), find(b)
            root[a] = root[b] = root[p] = root[q] = min(p, q)
        if len(root) > TOGETHER:
            yield stars()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node that it reaches) for each node of edges (a > b).

    Those of _linked are stars within each task. A round moves every edge from b to the smallest neighbour of b, and
    joins the other smaller neighbours of a to the smallest of them; edges never get more. A large star's centre is the smallest
    node, so it is never a key of the grouped minima, and the joins on it are left sides that Spark splits when skewed. The
    rounds end when no edge moves; each at least halves the depth of the trees, so more than 64 mean an error."""
    e = materialise(edges.select("a", "b"), "edges")
    for _ in range(64):
        down = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = e.join(down, e["b"] == down["u"], "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        least = moved.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        split = moved.join(least, moved["a"] == least["u"]).select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (F.col("moved") | (F.col("b") > F.col("m"))).alias("moved"))
        new = materialise(split, "edges")
        dropped(e)
        e = new
        if not e.where("moved").limit(1).count():
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError("components do not settle")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold, as the stars (a > b) that they make within each task. One function
    does both: with two, a task would hold two Python workers."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("_tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.col("_ta").cast("binary"), F.col("_tb").cast("binary"))

    def confirmed(batches):
        import pyarrow as pa

        @functools.lru_cache(64)
        def of(t: bytes) -> np.ndarray:
            return shingles(t)

        for x in batches:
            keep = []
            for ta, tb in zip(x["_ta"], x["_tb"]):
                s, t = of(ta.as_py()), of(tb.as_py())
                n = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(n > 0 and 100 * n >= percent * (len(s) + len(t) - n))
            yield pa.RecordBatch.from_arrays([x["a"], x["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lambda batches: _contracted(confirmed(batches)), "a long, b long")


def _wanted(docs: DataFrame, hubs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is a rep of hubs, and about one in BITS of the others, so that a join with hubs shuffles few texts
    beside those that it keeps. The ids' hashes are marked in bitmaps, which are broadcast. Where hubs is so large that MOST_BITS bounds
    them, more of the others pass."""
    maps = max(1, math.ceil(min(MOST_BITS, BITS * hubs.count()) / BITMAP))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(maps * BITMAP))
    bit = F.col("_at").bitwiseAND(F.lit(BITMAP - 1))
    marks = hubs.select(at("rep").alias("_at")).groupBy(F.floor(F.col("_at") / BITMAP).alias("_map")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = docs.withColumn("_at", at("doc_id")).withColumn("_map", F.floor(F.col("_at") / BITMAP))
    return placed.join(F.broadcast(marks), "_map").where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*docs.columns)


def _can_link(percent: int, m: Column, n: Column, s: Column, t: Column) -> Column:
    """Whether sets of m and n shingles that share s and t of them with others can reach the threshold with each other."""
    most = F.least(s, t)
    return 100 * most >= percent * (m + n - most)


def peeled(texts: DataFrame, percent: int) -> DataFrame:
    """rep, size, shares (now: how many of its shingles others have too) of those of texts (rep, size, shares, text) that can link."""

    def run(batches):
        import pyarrow as pa

        for x in batches:
            for rep, t in zip(x["rep"].to_pylist(), x["text"]):
                s = shingles(t.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), rep, np.int64)), pa.array(s.view(np.int64))], ["rep", "s"])

    told = None
    for _ in range(PEELS):
        left = texts if told is None else texts.join(told.select("rep"), "rep", "left_semi")
        each = left.select("rep", F.col("text").cast("binary").alias("text")).mapInArrow(run, "rep long, s long")
        own = each.groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
        known = texts.select("rep", "size", F.col("shares").alias("all")).distinct() if told is None else told.drop("shares")
        now = known.join(own, "rep", "left").select("rep", "size", "all", F.when(F.col("all") == ANY, F.col("all")).otherwise(F.col("all") - F.coalesce("own", F.lit(0))).alias("shares"))
        told, before = materialise(now.where(100 * F.col("shares") >= percent * F.col("size")), "peeled"), told
        dropped(before)
    return told


def _block_pairs(x: dict[str, np.ndarray], i: int, j: int, percent: int, limit: int, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of blocks i and j of a key that differ in root, can link, are near, and have the key as their first common one."""
    p, q = np.flatnonzero(x["own"] == i), np.flatnonzero(x["own"] == j)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(p), 64):
        u = p[at : at + 64, None]
        most = np.minimum(x["shares"][u], x["shares"][q])
        can = (x["root"][u] != x["root"][q]) & (100 * most >= percent * (x["size"][u] + x["size"][q] - most))
        if i == j:
            can &= x["rep"][u] < x["rep"][q]
        r, c = np.nonzero(can)
        r, c = p[at : at + 64][r], q[c]
        for k in range(0, len(r), 16384):
            v, w = r[k : k + 16384], c[k : k + 16384]
            far = x["sig"][v] != x["sig"][w]
            near = far.sum(1) <= limit
            v, w, far = v[near], w[near], far[near]
            bad = np.add.reduceat(far, bounds[:-1], axis=1, dtype=np.int64)
            first = np.asarray(bounds)[np.argmax(bad <= 1, axis=1)]
            chunk = np.searchsorted(bounds, first, side="right")
            inside = far & (np.arange(K) >= first[:, None]) & (np.arange(K) < np.asarray(bounds)[chunk][:, None])
            pos = np.where(inside.any(1), inside.argmax(1), first)
            mine = (x["pos"][v] == pos) & (x["pos"][w] == pos)
            found.append((x["rep"][v[mine]], x["rep"][w[mine]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _meetings(part: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of part (key, pos, rep, root, size, shares, sig); a key beyond BLOCK classes is dealt out as pairs of blocks."""
    limit, bounds = chunked(percent)
    blocks = part.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    dealt = part.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "pos", "rep", "root", "size", "shares", "sig")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        import pyarrow as pa

        names = ["key", "i", "j", "own", "pos", "rep", "root", "size", "shares"]

        def columns(x) -> dict[str, np.ndarray]:
            out = {n: x[n].to_numpy() for n in names}
            flat = x["sig"].flatten().to_numpy()
            return out | {"sig": np.ascontiguousarray(flat, "<i8").view("<u2").reshape(-1, K)}

        def pairs(x: dict):
            a, b = _block_pairs(x, int(x["i"][0]), int(x["j"][0]), percent, limit, bounds)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = columns(batch)
            new = np.zeros(len(x["key"]), bool)
            for n in ("key", "i", "j"):
                new[1:] |= x[n][1:] != x[n][:-1]
            new[0] = not held or any(held[-1][n][-1] != x[n][0] for n in ("key", "i", "j"))
            cuts = [0, *np.flatnonzero(new).tolist(), len(new)]
            for lo, hi in zip(cuts, cuts[1:]):
                if new[lo] and held and lo < hi:
                    yield pairs({n: np.concatenate([h[n] for h in held]) for n in x})
                    held = []
                if lo < hi:
                    held.append({n: c[lo:hi] for n, c in x.items()})
        if held:
            yield pairs({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. Ids that are no integers are numbered in their order first."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent).withColumn("component_id", F.col("component_id").cast(kind)).withColumn("doc_id", F.col("doc_id").cast(kind))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = materialise(ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("n", F.monotonically_increasing_id()), "ids")
    told = _classes(docs.join(ids, "doc_id", "left").select(F.col("n").alias("doc_id"), "text"), percent)
    name, component = ids.select(F.col("n").alias("i"), F.col("doc_id").alias("name")), ids.select(F.col("n").alias("j"), F.col("doc_id").alias("of"))
    out = told.join(name, told["doc_id"] == name["i"], "left").join(component, told["component_id"] == component["j"], "left")
    return out.select(F.col("name").alias("doc_id"), "n_shingles", F.col("of").alias("component_id"), "kept")


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    limit, bounds = chunked(percent)
    told = materialise(map_texts(docs, _described, "n_shingles long, print string, sig array<long>", ["doc_id"]), "signatures")
    real = told.where("print is not null and doc_id is not null")
    one = F.count(F.lit(1)) == 1
    reps = materialise(real.groupBy("print").agg(F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").alias("size"), F.min("doc_id").alias("rep")), "classes")
    index = reps.select("rep", F.posexplode(_keys(F.col("sig"), bounds)).alias("pos", "key"))
    often = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = materialise(index.join(often, "key"), "shared")
    sizes = reps.groupBy("rep").agg(F.when(one, F.min("size")).otherwise(0).alias("size"), F.when(one, F.min("size")).otherwise(ANY).alias("shares"))
    hubs = common.groupBy("rep").agg(F.sum("n").alias("degree"), F.max(F.col("n") > FEW).alias("peel"))
    hubs = materialise(hubs.join(sizes, "rep"), "hubs")
    texts = _wanted(docs, hubs).join(hubs, F.col("doc_id") == F.col("rep")).withColumn("_md5", F.md5("text")).dropDuplicates(["rep", "_md5"])
    texts = materialise(texts.select("rep", "size", "shares", "peel", "text"), "texts")
    light = peeled(texts.where("peel"), percent)
    columns = ["key", "pos", "rep", "size", "shares", "degree"]
    now = hubs.select("rep", "degree", F.col("size").alias("_size"), F.col("shares").alias("_shares")).join(light, "rep", "left")
    index = common.join(now, "rep").withColumn("large", F.col("n") > FEW).where(~F.col("large") | F.col("size").isNotNull())
    pick = lambda c: F.when(F.col("large"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    index = materialise(index.select("key", "pos", "rep", pick("size"), pick("shares"), "degree"), "index")
    most = F.max(F.struct("degree", (-F.col("rep")).alias("low"), "rep", "size", "shares"))
    least = F.max(F.struct((F.col("shares") - F.col("size")).alias("own"), (-F.col("rep")).alias("low"), "rep", "size", "shares"))
    named = lambda x: F.struct(x["rep"].alias("b"), x["size"].alias("bn"), x["shares"].alias("bs"))
    lead = index.groupBy("key").agg(F.array_distinct(F.array(named(most), named(least))).alias("leads"))
    met = index.join(lead, "key").select(F.col("rep").alias("a"), "size", "shares", F.explode("leads").alias("lead")).select("a", "size", "shares", "lead.*")
    met = met.where((F.col("a") != F.col("b")) & _can_link(percent, F.col("size"), F.col("bn"), F.col("shares"), F.col("bs"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    met = materialise(_near(met, reps, limit).select("a", "b"), "met")
    some = materialise(components(_linked(met, texts, percent)), "some")
    part = index.join(some, index["rep"] == some["node"], "left").select(*columns, F.coalesce("root", "rep").alias("root"))
    many = part.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    part = materialise(part.join(many, "key", "left_semi").join(reps.select("rep", "sig"), "rep"), "parts")
    rest = materialise(_meetings(part, percent).distinct(), "rest")
    links = _linked(rest, texts, percent).unionByName(some.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = materialise(components(links), "roots")
    ids = reps.join(roots, reps["rep"] == roots["node"], "left").select("print", F.coalesce("root", "rep").alias("root"))
    out = told.join(ids, "print", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    for x in (common, hubs, texts, light, index, met, some, part, rest):
        dropped(x)
    return out


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id. Rows that repeat a doc_id and text go but for one; those
    that repeat a doc_id with another text stand for themselves. Rows are therefore numbered in the order of doc_id, then text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("md5"))
    d = d.repartitionByRange(n, "id", "md5").dropDuplicates(["id", "md5"]).sortWithinPartitions("id", "md5")
    d = materialise(d.select("row", F.monotonically_increasing_id().alias("number")), "numbered")
    told = classes(d.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), percent)
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias("number"))
    named = d.join(gone, "number", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return named.unionByName(docs.where("doc_id is null"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
