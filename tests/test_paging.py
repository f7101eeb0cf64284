"""Deep pages by order statistics, and substring search through trigrams, against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from rigflow.operators import filters as B
from rigflow.operators import paging as P
from rigflow.operators.search_index import TrigramIndex, grams


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "Rig Alpha", "rig beta", "Site 12", "a%b", "x_y", "Ünïcode Site", "ab", ""]), r.choice([None, "north", "South Site"])) for i in range(3_000)]
    return spark.createDataFrame(rows, "id long, name string, place string").repartition(6)


def test_pages_at_every_depth(table):
    order = [F.col("name").asc_nulls_last(), F.col("id").desc()]
    pages = P.OrderedPages(table, order)
    whole = [tuple(r) for r in table.orderBy(*order).collect()]
    for no, limit in ((1, 10), (2, 700), (150, 20), (3_000, 1), (31, 100), (30, 100), (1, 5_000)):
        assert [tuple(r) for r in pages.page(no, limit).collect()] == whole[(no - 1) * limit:no * limit]
    key = pages.page(2_000, 1).select("id")
    assert [tuple(r) for r in pages.after(key, 50).collect()] == whole[2_000:2_050]
    assert pages.after(table.select("id").where("id < 0"), 5).count() == 0
    assert P.OrderedPages(table.where("id < 0"), order).page(1, 10).count() == 0


def test_a_deep_page_reads_only_its_rows(table):
    pages = P.OrderedPages(table, [F.col("id").asc()])
    page = pages.page(100, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(_at" in plan and "LessThanOrEqual(_at" in plan
    read = pages.rows.where(pages._between(1_980, 2_000))
    assert read.count() == 20 and read.select(F.input_file_name()).distinct().count() <= 2


@pytest.mark.parametrize("term", ["site", "SITE 1", "rig", "Ünï", "a%b", "x_y", "ab", "zzz", "north", "", None, "site 12 and more"])
def test_search_equals_the_scan(spark, table, scratch, term):
    cols = ["name", "place"]
    index = TrigramIndex(spark, f"{scratch}/index", "id", cols)
    for batch in (table.where("id < 1000"), table.where("id BETWEEN 1000 AND 1999"), table.where("id >= 1500")):       # one part twice
        index.add(batch)
    want = sorted(map(str, B.search(table, term, cols).collect()))
    assert sorted(map(str, index.search(table, term).collect())) == want


def test_the_rarest_trigram_is_read(spark, table, scratch):
    index = TrigramIndex(spark, f"{scratch}/index", "id", ["name"])
    index.add(table)
    assert grams("Rig A") == ["g a", "ig ", "rig"] and grams("ab") == [] and grams("a_bc") == []
    alpha = table.where("name = 'Rig Alpha'").count()
    assert index.candidates("rig a").count() == alpha < table.where("name ILIKE 'rig%'").count()
    assert index.candidates("rig zeta").count() == 0


def test_feed_merges_in_the_users_row(spark):
    """Users, assets and notices that come twice; no window runs over a row for each user and broadcast notice."""
    import datetime as dt

    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    notices = [(i, None if i % 3 == 0 else i % 4, "asset" if i % 2 else "transfer", i % 5, i % 7 == 0, at(i)) for i in range(40)]
    n = spark.createDataFrame(notices, "id long, user_id long, entity_type string, entity_id long, is_read boolean, created_at timestamp")
    users = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "id long")
    assets = spark.createDataFrame([(1, "A1"), (1, "A1b"), (3, None)], "id long, asset_id string")
    codes = {1: ["A1", "A1b"], 3: [None]}
    feed = P.notification_feed(n, users, assets, k=5)
    want = []
    for u, times in ((1, 1), (2, 2), (9, 1), (None, 1)):
        own = [x for x in notices if x[1] == u and u is not None] + times * [x for x in notices if x[1] is None]
        for x in sorted(own, key=lambda x: x[0], reverse=True)[:5]:
            want += [(u, x[0], c) for c in (codes.get(x[3], [None]) if x[2] == "asset" else [None])]
    assert sorted(map(str, ((r.viewer_id, r.id, r.entity_code) for r in feed.collect()))) == sorted(map(str, want))
    plan = feed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode") < plan.index("Window")
