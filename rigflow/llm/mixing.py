"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: its share of attention at training time 0..1, given
at evenly spaced knots and linear between them.  Its target is its part of all words by weight,
no more than ``MOST`` times its own size, what is over being shared again by weight among the
rest.  The integral of the schedule, scaled to the target, is the source's cumulative token
demand D(t).  Its documents lie in hash order along the demand axis, one epoch after another;
a copy that ends at q is wanted when D(t) = q, and is taken if that time is not after the end.
Whole copies leave a gap below the target, as long as the document that crosses it.  A gap over
three times the longest document that fits is filled with those that fit, in hash order and at
the times of the gap (again with used ones if their copies can fill it); else the document of the size nearest to a source's gap is taken once
more; again until none is found.  The mixed stream is the taken copies, range-sorted by time.

The order is by a hash of doc_id, then of the text, then of all columns: rows that this cannot
tell apart are equal, so reruns and other partitionings give the same result.  Rows are range-
sorted by source and order; prefix sums are taken in two levels, over the partitions of a source
and the rows of a partition, so neither a hot source nor a hot id meets in one task.

Defined results: null text has size 0 and is never taken (there is nothing to take); a null
source is a source of its own, after all others; a table without words has target 0 everywhere;
rows that repeat a doc_id, or have none, are separate documents.  Other columns pass through
``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigflow.llm.common import ASCII_SPACE, free_name, numbered
from rigflow.session import materialize

MOST = 3
FILLS = 12             # rounds in the SQL below; here there is no limit
WEIGHTS = (1, 2, 3)
#: Schedules in turn, by the sources' order: fading out, rising, and with its peak in the middle.
SCHEDULES = ((3.0, 1.0, 1.0), (1.0, 1.0, 3.0), (1.0, 3.0, 1.0))


def word_count(text: Column) -> Column:
    """Number of words: the pieces between runs of white space, without empty ones at the ends."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))     # "~" sorts after "="


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (key, source_size) with weight and target.

    Sources are a short list (one row each); the level at which weights are filled up is found
    by sums over them, each round fixing those that are above their limit.
    """
    sources, _ = materialize(sources.withColumn("all", F.lit("")), "sources")
    ranked = numbered(sources, "all", [F.col("key")], "rank").drop("all", "rank_of")
    listed, _ = materialize(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))), "sources")
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        n, used, open_weight = listed.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
                                          F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - used) / open_weight
    return listed.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.lit(float(level)) * F.col("weight")))


def demand_time(q: Column, knots: tuple) -> Column:
    """The time at which the integral of the schedule reaches the part ``q`` of its whole; over 1 for q > 1."""
    n = len(knots) - 1
    areas = [(a + b) / (2 * n) for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, F.lit(2.0)
    pieces = []
    for k, (a, b, area) in enumerate(zip(knots, knots[1:], areas)):
        rest = q * F.lit(whole) - F.lit(before)          # of this piece: a x + (b - a) n x^2 / 2 = rest
        slope = (b - a) * n
        x = rest / F.lit(a) if slope == 0 else (F.sqrt(F.lit(a * a) + F.lit(2 * slope) * rest) - F.lit(a)) / F.lit(slope)
        pieces.append((before + area, F.lit(k / n) + x))
        before += area
    for edge, time in reversed(pieces):
        out = F.when(q * F.lit(whole) <= F.lit(edge) * (1 + 1e-12), F.least(time, F.lit(1.0))).otherwise(out)
    return out


def _fill_wide(timed: DataFrame, gap: DataFrame, fits: Column, bucket: Column, reached) -> DataFrame:
    """``timed`` with the documents that fit into their source's wide gap, least used ones, as far
    as their sums go; in two levels, as in ``plan_mix``."""
    rows = timed.join(gap, "key", "left").withColumn("bucket", bucket)
    rows = rows.withColumn("own", F.when(F.col("wide") & fits & (F.size("times") == F.col("level")), F.col("size")).otherwise(0))
    sums = rows.groupBy("key", "bucket").agg(F.sum("own").alias("words"))
    before = sums.select("key", "bucket", (F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = F.sum("own").over(Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("inside", inside).join(before, ["key", "bucket"])
    stop = F.col("before") + F.col("inside")
    time = F.least(reached((F.col("target") - F.col("gap") + stop) / F.col("target")), F.lit(1.0))
    taken = (F.col("own") > 0) & (stop <= F.col("gap"))
    return rows.withColumn("times", F.when(taken, F.concat("times", F.array(time))).otherwise(F.col("times"))).select(*timed.columns)


def _content(docs: DataFrame) -> dict[str, Column]:
    """Two hashes of all columns of a row."""
    one, two = free_name(docs, "content_a"), free_name(docs, "content_b")
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return {one: F.xxhash64(*columns), two: F.xxhash64(F.lit("b"), *reversed(columns))}


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target,
    times (training time of each copy taken, in order), taken (words)."""
    return _plan(docs, weights, schedules, most).select("doc_id", "size", "source_size", "target", "times", "taken")


def _plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """``plan_mix`` with content (a, b), the hashes of the whole row."""
    order = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    content = F.struct(*[c.alias(n) for n, c in zip("ab", _content(docs).values())]).alias("content")
    sized, _ = materialize(docs.select("doc_id", _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), order.alias("order"), content), "sizes")
    by = ["key", "order", "content", "row"]
    sized = sized.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    sized, _ = materialize(sized.drop("order", "row").withColumn("at", F.monotonically_increasing_id()), "ordered")
    bucket = F.shiftright("at", 33)                                                        # the partition
    sized = sized.withColumn("bucket", bucket)
    sums, _ = materialize(sized.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "bucket-sums")
    sources = targets(sums.groupBy("key").agg(F.sum("words").alias("source_size")), weights, most)
    sources, _ = materialize(sources, "targets")
    before = sums.select("key", "bucket", (F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["key", "bucket"]).join(sources, "key")
    placed, _ = materialize(placed.withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket", "words"), "placed")

    def reached(q: Column) -> Column:
        time = F.lit(2.0)
        for k, knots in enumerate(schedules):
            time = F.when(F.pmod("rank", F.lit(len(schedules))) == k, demand_time(q, knots)).otherwise(time)
        return time

    def wanted(copy: Column) -> Column:
        return reached((copy * F.col("source_size") + F.col("start") + F.col("size")) / F.col("target"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most)), wanted), lambda t: t <= 1.0)
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(F.array().cast("array<double>"))
    timed, _ = materialize(placed.withColumn("times", times), "timed")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.size("times") < most)
    while True:
        worded = timed.where("size > 0")
        gap = worded.groupBy("key").agg((F.first("target") - F.sum(F.size("times") * F.col("size"))).alias("gap"), F.min(F.size("times")).alias("least"))
        open_ = worded.join(gap, "key").where(fits).groupBy("key").agg(F.min(F.size("times")).alias("level"), F.max("size").alias("longest"), F.sum(F.col("size") * (most - F.size("times"))).alias("spare"))
        gap, _ = materialize(gap.join(open_, "key", "left").withColumn("wide", F.coalesce((3 * F.col("longest") < F.col("gap")) & ((F.col("level") == F.col("least")) | (F.col("spare") >= F.col("gap"))), F.lit(False))), "gaps")
        if not gap.where("wide").isEmpty():
            timed, _ = materialize(_fill_wide(timed, gap, fits, bucket, reached), "timed")
            continue
        off = F.abs(F.col("size") - F.col("gap"))
        spare = (F.size("times") == F.col("least")) & (F.size("times") < most) & (off < F.col("gap"))
        fill = worded.join(gap, "key").where(spare).groupBy("key").agg(F.min(F.struct(off.alias("off"), "at")).alias("pick"))
        fill, found = materialize(fill, "fill")
        if not found:
            break
        chosen = F.coalesce(F.col("at") == F.col("pick.at"), F.lit(False))
        timed = timed.join(fill, "key", "left").withColumn("times", F.when(chosen, F.concat("times", F.array(F.lit(1.0)))).otherwise(F.col("times"))).drop("pick")
        timed, _ = materialize(timed, "timed")
    return timed.select("doc_id", "size", "source_size", "target", "times", (F.size("times") * F.col("size")).alias("taken"), "content")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed stream: the rows of ``docs``, each as often as it is taken, in training order.

    Rows meet their times by their content.  Rows that are equal in every column share theirs:
    one of them stands for all, and each time is emitted once.
    """
    plan, content, time = _plan(docs, **options), _content(docs), free_name(docs, "mixed_time")
    a, b = content
    named = plan.select(F.col("content.a").alias(a), F.col("content.b").alias(b), "times")
    repeated, some = materialize(named.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b), "repeated-rows")
    times, _ = materialize(named.select(a, b, F.explode("times").alias(time)), "times")
    rows = docs.withColumns(content)
    if some:
        rows = rows.join(repeated, [a, b], "left_anti").unionByName(rows.join(repeated, [a, b], "left_semi").dropDuplicates([a, b]))
    return rows.join(times, [a, b]).orderBy(time, a, b).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _fill_sql(k: int) -> str:
    before = f"m{k}"
    return f"""
g{k} AS (SELECT key, any_value(target) - sum(n * size) AS gap, min(n) AS least FROM {before} WHERE size > 0 GROUP BY key),
p{k} AS (
  SELECT key, arg_min(o, (off, o)) AS o FROM (
    SELECT {before}.key, o, n, least, gap, size, abs(size - gap) AS off FROM {before} JOIN g{k} USING (key) WHERE size > 0)
  WHERE n = least AND n < 3 AND off < gap GROUP BY key),
m{k + 1} AS (SELECT {before}.* REPLACE (CASE WHEN {before}.o = p{k}.o THEN n + 1 ELSE n END AS n) FROM {before} LEFT JOIN p{k} USING (key)),"""


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS key, md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS o,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS s, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS w FROM sized GROUP BY key),
filled AS (
  SELECT *, sum(3 * s) OVER u AS full_words, sum(w) OVER (ORDER BY 3.0 * s / w DESC, key DESC) - w AS open_w,
         lead(3.0 * s / w) OVER u AS next_ratio, (SELECT sum(s) FROM sources) AS total
  FROM sources WINDOW u AS (ORDER BY 3.0 * s / w, key)),
levels AS (
  SELECT 0 AS full_words, (SELECT sum(w) FROM sources) AS open_w, (SELECT min(3.0 * s / w) FROM sources) AS next_ratio, (SELECT sum(s) FROM sources) AS total
  UNION ALL SELECT full_words, open_w, next_ratio, total FROM filled WHERE open_w > 0),
level AS (
  SELECT arg_min(CAST(total - full_words AS DOUBLE) / open_w, full_words) AS l
  FROM levels WHERE CAST(total - full_words AS DOUBLE) / open_w <= next_ratio),
placed AS (
  SELECT z.*, s.s, least(3.0::DOUBLE * s.s, (SELECT l FROM level) * s.w) AS target,
         sum(z.size) OVER (PARTITION BY z.key ORDER BY o, doc_id) AS stop
  FROM sized z JOIN sources s USING (key)),
m0 AS (
  SELECT *, CASE WHEN size > 0 THEN (SELECT count(*) FROM range(4) c(c) WHERE (c.c * s + stop)::DOUBLE / target <= 1 + 1e-12) ELSE 0 END AS n FROM placed),
""" + "".join(map(_fill_sql, range(FILLS))).rstrip(",") + """
SELECT doc_id, size, s AS source_size, target, CAST(n * size AS BIGINT) AS taken FROM m""" + str(FILLS)
