"""Batch cores shared by the streaming jobs and their batch forms.

Each function is a pure DataFrame transformation that works the same on a static frame
and on a streaming frame, so the batch form is the test oracle of the stream form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Request quotas of the source (per client per 15 minutes).
QUOTA_WINDOW = "15 minutes"
QUOTA_ALL = 200
QUOTA_SIGN_IN = 20


def change_rows(events: DataFrame) -> DataFrame:
    """Change events as history rows: event, asset, action and the event's own time."""
    return events.select(
        F.col("event_id").alias("change_id"),
        F.col("user_id").alias("asset_id"),
        F.when(F.col("event_type") == "signup", "Created").otherwise("Updated").alias("action"),
        F.col("ts").alias("changed_at"))


def dedup_changes(rows: DataFrame) -> DataFrame:
    """K1 batch form: events delivered more than once are kept once."""
    return rows.dropDuplicates(["change_id", "changed_at"])


def window_counts(access: DataFrame, window: str = QUOTA_WINDOW, ts: str = "ts") -> DataFrame:
    """K4 core: requests per client per clock-aligned window, overall and for sign-in."""
    g = access.groupBy(F.window(ts, window).alias("w"), "client")
    return g.agg(F.count("*").alias("requests"),
                 F.count_if(F.col("path") == "signup").cast("bigint").alias("sign_ins")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client",
        "requests", "sign_ins")


def quota_breaches(counts: DataFrame, max_all: int = QUOTA_ALL, max_sign_in: int = QUOTA_SIGN_IN) -> DataFrame:
    """Windows in which a client went over a quota."""
    return counts.where((F.col("requests") > max_all) | (F.col("sign_ins") > max_sign_in))


def _next_instants(instants: DataFrame, width: int) -> DataFrame:
    """Per instant (``client``, ``us``) the client's first instant at or after ``us + width``
    (``next``; NULL when there is none). The answer is looked for in the second of that time,
    then in the later seconds of its slot of ``width``, then in the client's later slots, so a
    window holds the instants of one second, the seconds of one slot or the slots of one client:
    never all requests of a client."""
    second, slot = F.floor(F.col("at") / 1_000_000), F.floor(F.col("at") / width)
    own = instants.select("client", F.col("us").alias("at"), "us", F.lit(False).alias("asks"))
    asks = instants.select("client", (F.col("us") + width).alias("at"), "us", F.lit(True).alias("asks"))
    # asking rows come before an instant of the same time, which answers them
    rows = own.unionByName(asks).withColumns({"second": second, "slot": slot})

    def after(keys, order, rows_after):
        return F.first("found", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(*order).rowsBetween(rows_after, Window.unboundedFollowing))

    rows = rows.withColumn("found", F.when(~F.col("asks"), F.col("at")))
    rows = rows.withColumn("in_second", after(["client", "second"], ["at", F.col("asks").desc()], 0))
    seconds = rows.groupBy("client", "slot", "second").agg(F.min("found").alias("found"))
    seconds = seconds.withColumn("in_slot", after(["client", "slot"], ["second"], 1))
    slots = seconds.groupBy("client", "slot").agg(F.min("found").alias("found"))
    slots = slots.withColumn("later", after(["client"], ["slot"], 1))
    s = seconds.select(F.col("client").alias("c1"), F.col("second").alias("k1"), "in_slot")
    t = slots.select(F.col("client").alias("c2"), F.col("slot").alias("k2"), "later")
    asked = rows.where("asks")
    found = (asked.join(s, asked["client"].eqNullSafe(s["c1"]) & (asked["second"] == s["k1"]), "left")
             .join(t, asked["client"].eqNullSafe(t["c2"]) & (asked["slot"] == t["k2"]), "left"))
    return found.select("client", "us", F.coalesce("in_second", "in_slot", "later").alias("next"))


def anchored_windows(access: DataFrame, minutes: int = 15, ts: str = "ts") -> DataFrame:
    """K4, windows that start at a client's first request: a request at or after the end of the
    client's last window starts the next one (the source's request limiter counts so).

    Every instant of a client points to the first instant a window's width later; the starts are
    the chain of pointers from the client's first instant, marked by doubling: after k rounds
    the first 2^k starts are known and pointers jump 2^k windows. Equal times are counted
    together first; requests without a time are left out, those of a NULL client share one
    chain. A slot of the window's width holds one start at most, so a request meets two starts."""
    width = minutes * 60_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    instants, _ = materialize(access.where(F.col(ts).isNotNull()).groupBy("client", us.alias("us")).agg(
        F.count("*").alias("n"), F.count_if(F.col("path") == "signup").cast("bigint").alias("s")), "instants")
    jump, _ = materialize(_next_instants(instants, width).where("next IS NOT NULL"), "jump")
    starts, known = materialize(instants.groupBy("client").agg(F.min("us").alias("us")), "starts")
    while True:
        p = jump.select(F.col("client").alias("c"), F.col("us").alias("from"), "next")
        step = starts.join(p, starts["client"].eqNullSafe(p["c"]) & (starts["us"] == p["from"])).select("client", F.col("next").alias("us"))
        starts, now = materialize(starts.unionByName(step).dropDuplicates(["client", "us"]), "starts")
        if now == known:
            break
        known = now
        jump, _ = materialize(jump.join(p.withColumnRenamed("next", "next2"),
                                        jump["client"].eqNullSafe(F.col("c")) & (jump["next"] == F.col("from")))
                              .select("client", "us", F.col("next2").alias("next")), "jump")
    slot = F.floor(F.col("us") / width)
    marks = starts.select(F.col("client").alias("c"), F.col("us").alias("start"), F.explode(F.array(slot, slot + 1)).alias("k"))
    i = instants.withColumn("slot", slot)
    met = i.join(marks, i["client"].eqNullSafe(marks["c"]) & (i["slot"] == marks["k"])).where(
        (F.col("start") <= F.col("us")) & (F.col("us") < F.col("start") + width))
    at = F.timestamp_micros("start")
    return met.groupBy("client", "start").agg(F.sum("n").alias("requests"), F.sum("s").alias("sign_ins")).select(
        "client", at.cast("timestamp_ntz").alias("window_start"),
        F.timestamp_micros(F.col("start") + width).cast("timestamp_ntz").alias("window_end"), "requests", "sign_ins")
