"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share all words by weight, but none goes above three
times its size, and what is over is shared again among the others. The closed form: order the sources by cap / weight; the level
is (all words - caps before) / (weights from here on) at the first source whose cap it does not reach.
Positions: each source's weight is a piecewise linear schedule over training time. Its integral is the cumulative demand; a
document copy that starts at the share u of its source's words gets the time at which the integral reaches u, and documents are
range-sorted by that time. Within a source, order is by an md5 key, so reruns agree. A source takes all documents floor(r)
times and then the first of the order, the last one in part, until the target is met to a word.

Prefix sums run in two levels (4096 key ranges a source, then within a range), so a source with a third of all rows is split.
Null text: size 0, taken 0. Null source: a source of its own. Empty table: no rows. Repeated rows: a row each.
Extra columns, of any name, are not read by plan() and pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

CAP = 3
#: Knots (time, weight) of the schedules; sources take them in turn, by code point.
SCHEDULES = [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]]


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key")).withColumn("cell", F.substring("key", 1, 3))


def targets(cells: DataFrame) -> DataFrame:
    """source, source_size, number, target from the sums by source and cell: a row for each source."""
    by = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = by.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", (F.col("number") % 3 + 1).cast("long"))
    ratio = CAP * F.col("source_size") / F.col("weight")
    rising = Window.orderBy("ratio", "number")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("ratio", ratio).withColumn("caps", F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0))).withColumn("left", F.sum("weight").over(onward))
    s = s.withColumn("all", F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("caps")).cast("double") / F.col("left"))
    held = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "number", "level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least((CAP * F.col("source_size")).cast("double"), held["level"] * F.col("weight"))
    return s.select("source", "source_size", "number", F.coalesce(target, (CAP * F.col("source_size")).cast("double")).alias("target"))


def time_of(u: Column, number: Column) -> Column:
    """The time at which the integral of the source's schedule reaches the share u."""
    whole = None
    for k, knots in enumerate(SCHEDULES):
        area = [(a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:])]
        out, done = None, 0.0
        for (t0, w0), (t1, w1), x in zip(knots, knots[1:], area):
            need, slope = u * sum(area) - done, (w1 - w0) / (t1 - t0)
            at = F.lit(t0) + (need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) - w0) / slope)
            out = F.when(u * sum(area) <= done + x + 1e-12, at) if out is None else out.when(u * sum(area) <= done + x + 1e-12, at)
            done += x
        out = out.otherwise(F.lit(1.0))
        whole = F.when(number % len(SCHEDULES) == k, out) if whole is None else whole.when(number % len(SCHEDULES) == k, out)
    return whole


def plan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, source, key, size, source_size, target, taken, rounds, more (words of the last copy, if cut), start,
    nth (its number among the rows of this source and key), and positions: the training time of each copy, rising; none if nothing is taken. A row without words counts as one copy."""
    rows = materialise(sized(docs), "sizes")
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    want = targets(cells.select("source", "words"))
    known = cells.alias("c").join(want.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(F.col("c.source").alias("_source"), F.col("c.cell").alias("_cell"), "ahead", "source_size", "number", "target")
    order = Window.partitionBy("source", "cell").orderBy("key", "size")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("nth", F.row_number().over(order) - F.rank().over(order))
    d = d.join(known, d["source"].eqNullSafe(known["_source"]) & (d["cell"] == known["_cell"])).withColumn("start", F.col("ahead") + F.col("inside"))
    goal = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("rounds", rounds).withColumn("rest", goal - F.col("rounds") * F.col("source_size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    d = d.withColumn("more", more.cast("long"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("rounds") + F.when(F.col("more") > 0, 1).otherwise(0)).cast("int")
    share = lambda c: F.when(F.col("target") > 0, (F.col("start") + c * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    times = F.transform(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0))), lambda c: time_of(F.least(share(c), F.lit(1.0)), F.col("number")))
    positions = F.when(copies > 0, times).otherwise(F.array().cast("array<double>"))
    return d.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("more")).alias("taken"), "rounds", "more", "start", "nth", positions.alias("positions"))


def ranged(df: DataFrame, at: Column, key: str) -> DataFrame:
    """df range-sorted by the time `at`, rows without one last."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, at.asc_nulls_last(), key).sortWithinPartitions(at.asc_nulls_last(), key)


def mix(docs: DataFrame) -> DataFrame:
    """docs repeated as the mix takes them, range-sorted by training position; the copy that meets a target ends there.
    Documents without words are kept once, as they cost no token. Extra columns of any name pass through."""
    of = lambda source, key: F.md5(F.concat(key, F.lit(":"), F.coalesce(F.concat(F.lit("s"), source), F.lit(""))))
    p = plan(docs).select(of(F.col("source"), F.col("key")).alias("same"), F.struct("nth", "size", "rounds", "more", "positions").alias("take"))
    p = p.groupBy("same").agg(F.array_sort(F.collect_list("take")).alias("takes"))  # one, but for repeated rows
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    d = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).withColumn("same", of(F.col("row.source"), F.col("key")))
    j = d.join(p, "same").withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy(F.col("row.text").isNull())) - 1)
    j = j.select("row", "key", F.get("takes", F.col("n")).alias("take")).select("row", "key", "take.size", "take.rounds", "take.more", F.posexplode("take.positions").alias("copy", "at"))
    part = (F.col("copy") == F.col("rounds")) & (F.col("more") < F.col("size")) & (F.col("size") > 0)
    each = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a word and the space before it
    cut = F.array_join(F.slice(each, 1, F.greatest(F.col("more"), F.lit(0)).cast("int")), "")
    text = F.when(part, cut).otherwise(F.col("row.text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return ranged(j, F.col("at"), "key").select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, range-sorted by the position of its first copy (those not taken last); position_1 to position_CAP
    are the training times of its copies, as no source is taken more than CAP times."""
    at = [F.get("positions", F.lit(c)).alias(f"position_{c + 1}") for c in range(CAP)]
    return ranged(plan(table(spark, sf_dir, "documents")), F.get("positions", F.lit(0)), "key").select("doc_id", "size", "source_size", "target", "taken", *at)


def _sql_time(k: int) -> str:
    """The position of copy k in SQL, by each schedule's quadratic written out."""
    start = f"least(CAST(start + CAST({k} AS BIGINT) * source_size AS DOUBLE) / target, CAST(1.0 AS DOUBLE))"
    u = f"(CASE WHEN target > 0 THEN {start} ELSE CAST(0.0 AS DOUBLE) END)"
    e = lambda v: f"CAST('{v}' AS DOUBLE)"
    whole = []
    for number, knots in enumerate(SCHEDULES):
        total, done, cases = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:])), 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            slope, area = (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0)
            need = f"({u} * {e(total)} - {e(done)})"
            at = f"{e(t0)} + {need} / {e(w0)}" if slope == 0 else f"{e(t0)} + (sqrt(greatest({e(0.0)}, {e(w0 * w0)} + {e(2 * slope)} * {need})) - {e(w0)}) / {e(slope)}"
            cases.append(f"WHEN {u} * {e(total)} <= {e(done + area + 1e-12)} THEN {at}")
            done += area
        whole.append(f"WHEN number % {len(SCHEDULES)} = {number} THEN CASE {' '.join(cases)} ELSE {e(1.0)} END")
    return f"CASE WHEN copies > {k} THEN CASE {' '.join(whole)} END END AS position_{k + 1}"


SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(number % 3 + 1 AS BIGINT) AS weight, CAST({CAP} * source_size AS DOUBLE) / (number % 3 + 1) AS ratio FROM s),
k AS (SELECT *, CAST(coalesce(sum({CAP} * source_size) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps, CAST(sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS onward, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
l AS (SELECT *, CAST(total - caps AS DOUBLE) / onward AS level FROM k),
h AS (SELECT level AS held FROM l WHERE ratio >= level ORDER BY ratio, number LIMIT 1),
t AS (SELECT source, source_size, number, least(CAST({CAP} * source_size AS DOUBLE), held * weight) AS target FROM l, h),
p AS (SELECT d.doc_id, size, source_size, number, target, CAST(floor(target) AS BIGINT) AS goal, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds FROM p),
m AS (SELECT *, greatest(0, least(size, goal - rounds * source_size - start)) AS more FROM r),
c AS (SELECT *, CASE WHEN size = 0 THEN 1 ELSE rounds + CASE WHEN more > 0 THEN 1 ELSE 0 END END AS copies FROM m)
SELECT doc_id, size, source_size, target, CAST(rounds * size + more AS BIGINT) AS taken, {", ".join(_sql_time(k) for k in range(CAP))} FROM c"""
