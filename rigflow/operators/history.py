"""Tables as of any instant, from their change rows.

``as_of_join`` finds, for every question (a key and a time), the version that was valid then.
``validity_intervals`` gives each version its interval. ``table_at`` replays patches up to each
of several instants. A key may hold any share of the rows: versions and questions are ordered
within (key, day), and only one row a day of a key is ordered over its whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carry(keys, order, upto: int, value: str) -> Column:
    """The last value of the rows before (``upto`` -1) or up to (0) each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    return F.last(value, ignorenulls=True).over(w)


def as_of_join(questions: DataFrame, versions: DataFrame, key: str, at: str, version_key: str, ts: str, order: str,
               columns: list[str]) -> DataFrame:
    """``questions`` with ``columns`` of the last version (by ``ts``, then ``order``) of their key
    at or before their time; NULLs where there is none, or the question has no key or time.
    Every question comes back once, repeated ones too. Versions without a key or time, and the
    later of two versions equal in all three, are of no account (the greater by content stays)."""
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    ask = F.struct(*[F.col(f"`{c}`") for c in questions.columns])
    v = versions.where(F.col(version_key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(version_key).cast("string").alias("_k"), F.col(ts).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"),
        F.col(order).alias("_o"), own.alias("_v"), F.lit(None).cast(questions.select(ask.alias("a")).schema["a"].dataType).alias("_q"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    q = questions.where(known).select(
        F.col(key).cast("string").alias("_k"), F.col(at).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(v.schema["_o"].dataType).alias("_o"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), ask.alias("_q"))
    rows = v.unionByName(q).withColumn("_day", F.to_date("_t"))
    # the last version of every day, carried to the days after it
    days = rows.groupBy("_k", "_day").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", "_o", "_v"))).alias("_last"))
    days = days.select(F.col("_k").alias("_dk"), F.col("_day").alias("_dd"), _carry(["_k"], ["_day"], -1, "_last").alias("_before"))
    within = rows.withColumn("_v", _carry(["_k", "_day"], ["_t", "_side", "_o", F.col("_v").asc()], 0, "_v")).where("_side = 1")
    got = within.join(days, (F.col("_k") == F.col("_dk")) & (F.col("_day") == F.col("_dd")))
    value = F.coalesce("_v", "_before")
    out = got.select("_q.*", *[value[c].alias(c) for c in columns])
    absent = questions.where(~known).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in columns])
    return out.unionByName(absent)


def validity_intervals(versions: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """``versions`` with ``valid_from`` (their time) and ``valid_to`` (the time of the key's next
    version, NULL for the last). Of versions at the same time, all but the last by ``order`` get
    an empty interval. Rows without a time get NULLs, those of a NULL key follow each other."""
    rows = versions.withColumn("_day", F.to_date(ts))
    days = rows.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_dk"), F.col("_day").alias("_dd")).agg(F.min(ts).alias("_first"))
    days = days.withColumn("_next", F.lead("_first").over(Window.partitionBy("_dk").orderBy("_dd")))
    inside = F.lead(ts).over(Window.partitionBy(key, "_day").orderBy(ts, order))
    j = rows.withColumn("_in", inside).join(days, F.col(key).eqNullSafe(F.col("_dk")) & (F.col("_day") == F.col("_dd")), "left")
    return j.select(*[F.col(f"`{c}`") for c in versions.columns], F.col(ts).alias("valid_from"),
                    F.when(F.col(ts).isNotNull(), F.coalesce("_in", "_next")).alias("valid_to"))


def table_at(base: DataFrame, patches: DataFrame, instants: list, columns: list[str], key: str = "id",
             patch_key: str = "id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """``base`` as of each instant: ``as_of``, the key, and every column at its last non-NULL patch
    at or before the instant (by time, then ``order``), else at its base value. Patches fold into
    one row per key and span between instants (partial sums of the map tasks, so no key is hot);
    a key meets at most as many rows as there are instants. ``base`` has unique keys; patches of
    unknown or NULL keys, or without a time, change nothing."""
    times = F.array(*[F.lit(t).cast("timestamp_ntz") for t in sorted(instants)])
    at = F.col(ts).cast("timestamp_ntz")
    p = patches.where(F.col(ts).isNotNull()).withColumn("_slot", F.size(F.filter(times, lambda t: t < at)))
    p = p.where(F.col("_slot") < len(instants))
    folds = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(order).alias("o"), F.col(c).alias("v")))).alias(c) for c in columns]
    spans = p.groupBy(F.col(patch_key).alias("_pk"), "_slot").agg(*folds)
    whole = spans.groupBy("_pk").agg(F.collect_list(F.struct("_slot", *columns)).alias("_spans"))
    j = base.join(whole, base[key] == whole["_pk"], "left")
    j = j.select("*", F.posexplode(times).alias("_i", "as_of"))
    past = F.filter("_spans", lambda s: s["_slot"] <= F.col("_i"))
    return j.withColumn("_past", past).select(
        "as_of", F.col(key), *[F.coalesce(F.array_max(F.col("_past")[c])["v"], F.col(c)).alias(c) for c in columns])
