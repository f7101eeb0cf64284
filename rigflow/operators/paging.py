"""Sorting, paging and top-k.

``page`` is ORDER BY + OFFSET + LIMIT (Spark plans a partial top-(offset+limit) per
partition and a merge, so no full sort is shuffled). ``top_k_per_group`` is
``row_number() <= k`` over a window; Spark inserts a partial group limit before the
shuffle (WindowGroupLimit), so at most k rows per group leave each map task and a hot
group cannot pile up in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import status as S
from ..session import materialize
from . import enrich as E


def page(df: DataFrame, order: list[Column | str], page_no: int = 1, limit: int = 100) -> DataFrame:
    """Rows ``(page_no-1)*limit .. page_no*limit-1`` in ``order`` (order must be total)."""
    off = (int(page_no) - 1) * int(limit)
    out = df.orderBy(*order)
    if off > 0:
        out = out.offset(off)
    return out.limit(int(limit))


def total(df: DataFrame) -> Column:
    """The number of rows of ``df`` as a scalar subquery (partial counts per task, one merge),
    not ``count(*) OVER ()``, which would move every row into a single partition."""
    return df.select(F.count(F.lit(1))).scalar()


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    rank_col: str = "rn") -> DataFrame:
    """The first k rows of every group in ``order`` (order must be total within a group)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


class OrderedPages:
    """Pages of a table at any depth, by order statistics.

    The rows are range-partitioned and sorted by ``order`` once and written with their number in
    their partition; one count for each partition tells in which of them a row of the whole
    order lies. A page reads only the rows of its number range (a filter on a column whose
    Parquet statistics are disjoint between files), so page 10,000 costs what page 1 costs and
    no task sees the rows before it. ``after`` goes on from a row by its sort key, without a
    page number.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        """``order`` must be total; rows it cannot tell apart may swap between two builds."""
        self.columns, self.order = df.columns, order
        at = F.monotonically_increasing_id()
        self.rows, self.total = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ordered")
        counts = self.rows.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("part").collect()   # a row for each partition
        self.parts, start = [], 0
        for r in counts:
            self.parts.append((start, r["first"], r["n"]))
            start += r["n"]

    def _between(self, lo: int, hi: int) -> Column:
        """The rows lo .. hi - 1 of the whole order, as ranges of partitions' numbers."""
        ranges = [(first + max(lo - start, 0), first + min(hi - start, n) - 1) for start, first, n in self.parts if start < hi and start + n > lo]
        return reduce(lambda a, b: a | b, [F.col("_at").between(a, b) for a, b in ranges], F.lit(False))

    def page(self, page_no: int, limit: int) -> DataFrame:
        lo = (int(page_no) - 1) * int(limit)
        return self.rows.where(self._between(lo, lo + int(limit))).orderBy("_at").select(*self.columns)

    def after(self, key: DataFrame, limit: int) -> DataFrame:
        """The page that follows the row ``key`` (one row with the columns that identify it)."""
        one = F.broadcast(key.limit(1).select(*[F.col(c).alias(f"_key_{c}") for c in key.columns]))       # (one row: a proven bound)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key.columns])
        found = self.rows.join(one, same, "left_semi").agg(F.max("_at").alias("at")).first()["at"]
        place = next((start + found - first for start, first, n in self.parts if found is not None and first <= found < first + n), self.total)
        return self.rows.where(self._between(place + 1, place + 1 + int(limit))).orderBy("_at").select(*self.columns)


# ------------------------------------------------------------------ lists with pages
# A page is taken from the base rows, before joins that cannot change which rows it holds;
# only the page's rows are then enriched.
def assets_page(assets: DataFrame, page_no: int = 1, limit: int = 100) -> DataFrame:
    """Asset page ordered by asset code."""
    return page(assets, [F.col("asset_id").asc_nulls_last()], page_no, limit)


def maintenance_page(schedules: DataFrame, as_of=None, page_no: int = 1, limit: int = 100) -> DataFrame:
    """most urgent first (overdue, due soon, rest), then due date, then id."""
    order = [S.urgency_rank(as_of=as_of), F.col("next_due_date").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return page(schedules, order, page_no, limit)


def transfers_page(transfers: DataFrame, page_no: int = 1, limit: int = 50,
                   date_col: str = "request_date", id_col: str = "transfer_id") -> DataFrame:
    """newest request first, then transfer code descending (NULLs first on DESC)."""
    return page(transfers, _newest(date_col, id_col), page_no, limit)


def transfers_sorted(transfers: DataFrame, date_col: str = "request_date", id_col: str = "transfer_id") -> DataFrame:
    """The order of ``transfers_page`` for a page that has been enriched."""
    return transfers.orderBy(*_newest(date_col, id_col))


def _newest(date_col: str, id_col: str) -> list[Column]:
    return [F.col(date_col).desc_nulls_first(), F.col(id_col).desc_nulls_first()]


# ------------------------------------------------------------------ per-key feeds
def history_latest(history: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """the newest k history rows of every asset, with the author's name."""
    top = top_k_per_group(history, ["asset_id"], [F.col("created_at").desc(), F.col("id").desc()], k)
    return E.history_with_author(top, users)


def notification_feed(notifs: DataFrame, users: DataFrame, assets: DataFrame, k: int = 50,
                      only_unread: bool = False) -> DataFrame:
    """F8: the newest k notices visible to each user (own or broadcast), with entity code.

    top-k(own ∪ broadcast) = top-k(top-k(own) ∪ top-k(broadcast)): both are arrays of at most k
    notices with their entity codes, merged in the user's row; so no task sorts a row for each
    user and broadcast notice, and the codes are looked up once for each notice, not for each
    reader. The broadcast array comes as often as ``users`` has the user.
    """
    n = notifs.where(~F.col("is_read")) if only_unread else notifs
    order = [F.col("created_at").desc(), F.col("id").desc()]
    cols = n.columns
    # (all codes of an id in one row, so that looking them up leaves the number of notices as it is)
    codes = assets.select("id", F.struct("asset_id").alias("_c")).groupBy("id").agg(F.collect_list("_c").alias("asset_id"))
    first = ["created_at", "id"]
    notice = F.struct(*first, *[c for c in cols if c not in first], "entity_code")
    own = top_k_per_group(n.where(F.col("user_id").isNotNull()), ["user_id"], order, k).drop("rn")
    own = E.notifications_with_entity(own, codes).groupBy(F.col("user_id").alias("_u")).agg(F.collect_list(notice).alias("_own"))
    bc = E.notifications_with_entity(n.where(F.col("user_id").isNull()).orderBy(*order).limit(k), codes).agg(F.collect_list(notice).alias("b")).scalar()
    viewers = users.groupBy(F.col("id").alias("viewer_id")).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_times"))
    seen = F.concat(F.coalesce("_own", F.array()), F.flatten(F.array_repeat(bc, F.col("_times"))))
    page_ = F.slice(F.sort_array(seen, asc=False), 1, k)
    feed = viewers.join(own, F.col("viewer_id") == F.col("_u"), "left").select("viewer_id", F.explode(page_).alias("n"))
    return feed.select("viewer_id", *[F.col(f"n.{c}") for c in cols], F.explode_outer("n.entity_code").alias("_c")).select("viewer_id", *cols, F.col("_c.asset_id").alias("entity_code"))


def unread_in_page(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Per user the notices of the returned page and the unread ones among them (zero for a
    user with an empty page); not the unread of the whole table, which ``notification_counts`` gives."""
    n = feed.groupBy(F.col("viewer_id").alias("_v")).agg(F.count("*").alias("returned"), F.count_if(~F.col("is_read")).cast("bigint").alias("unread"))
    j = users.select(F.col("id").alias("user_id")).join(n, F.col("user_id") == F.col("_v"), "left")
    return j.select("user_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("returned", "unread")])
