from pyspark.sql import functions as F

from rigflow.operators import quality as Q


def test_validate_commands_reasons_in_order(spark):
    b = spark.createDataFrame([(1, "AST-1", "Pump", "Other", "Editor"), (2, " ", " ", "Bogus", "Viewer")],
                              "seq long, asset_id string, name string, category string, role string")
    v = Q.validate_commands(b, "asset_create")
    assert [r.seq for r in v["accepted"].collect()] == [1]
    assert v["rejected"].first().reasons == ["role", "asset_id", "name", "category"]


def test_field_rules(spark):
    df = spark.createDataFrame([("2025-01-31", "5", "a@b.co", "1.5"), ("2025-02-30", "0", "nope", "-1")],
                               "d string, i string, e string, f string")
    r = df.select(Q.is_date("d").alias("d"), Q.is_int("i", 1).alias("i"), Q.is_email("e").alias("e"),
                  Q.is_float("f", 0).alias("f")).collect()
    assert tuple(r[0]) == (True, True, True, True) and tuple(r[1]) == (False, False, False, False)


def test_check_violations_null_passes(spark):
    df = spark.createDataFrame([("1", "Other", "Active", None, None, None), ("2", "Bogus", "Active", -1.0, 2000, 1.0)],
                               "id string, category string, status string, value_usd double, year_manufactured int, weight_kg double")
    v = Q.check_violations(df, "assets").collect()
    assert len(v) == 1 and v[0].violations == ["category_allowed", "value_usd_non_negative"]


def test_orphans_and_unique(spark):
    parent = spark.createDataFrame([("P1",)], "id string")
    child = spark.createDataFrame([("C1", "P1"), ("C2", "P9"), ("C3", None)], "id string, pid string")
    assert [r.id for r in Q.orphans(child, "pid", parent).collect()] == ["C2"]
    base = spark.createDataFrame([("K1",)], "code string")
    batch = spark.createDataFrame([(1, "K1"), (2, "K2"), (3, "K2")], "seq long, code string")
    got = {r.seq: r.reason for r in Q.unique_violations(base, batch, "code").collect()}
    assert got == {1: "exists", 3: "duplicate_in_batch"}


def test_absent_fields_and_roles_are_failed_rules(spark):
    bare = spark.createDataFrame([(1, "A-1")], "seq long, asset_id string")
    assert Q.tag_commands(bare, "asset_create").first().reasons == ["role", "name", "category"]
    nums = spark.createDataFrame([("NaN",), ("Infinity",), ("1e400",), ("-1",), ("2.5",), (None,)], "q string")
    from rigflow.functions.validators import is_date, is_float
    assert [r.ok for r in nums.select(is_float("q", 0).alias("ok")).na.fill(False).collect()] == [False, False, False, False, True, False]
    days = spark.createDataFrame([("2025-01-31",), ("2025/01/31",), ("2025-02-30",), ("x",)], "q string")
    assert [r.ok for r in days.select(is_date("q").alias("ok")).collect()] == [True, True, False, False]


def test_value_rules_need_their_columns(spark):
    import pytest
    with pytest.raises(ValueError):
        Q.check_violations(spark.createDataFrame([(1, "Other")], "id long, category string"), "assets")


def test_own_row_rule_and_protected_columns(spark):
    from rigflow.operators import quality as Q
    batch = spark.createDataFrame(
        [(1, "7", 7, "Editor", "A", "Admin", None), (2, "me", 7, "Viewer", "B", "Admin", "Active"), (3, "8", 7, "Editor", "C", None, None),
         (4, "8", 1, "Admin", "D", "Editor", "Inactive"), (5, None, 7, "Editor", "E", None, None), (6, "7", 7, None, "F", "Admin", None)],
        "seq int, user_id string, actor_id long, actor_role string, full_name string, role string, status string")
    out = Q.validate_user_updates(batch)
    assert {(r.seq, r.user_id, r.role, r.status) for r in out["accepted"].collect()} == {(1, "7", None, None), (2, "7", None, None), (4, "8", "Editor", "Inactive"), (6, "7", None, None)}
    assert {(r.seq, tuple(r.reasons)) for r in out["rejected"].collect()} == {(3, ("access_denied",)), (5, ("access_denied",))}


def test_orphan_report_refuses_absent_tables(spark):
    import pytest

    from rigflow.operators import quality as Q
    with pytest.raises(ValueError):
        Q.orphan_report({"a": spark.createDataFrame([(1, 2)], "id long, b_id long")}, [("a", "b_id", "b", "cascade")])


def test_null_keys_are_all_inserted(spark):
    from rigflow.operators import changes as C
    base = spark.createDataFrame([("k", 1)], "code string, v int")
    batch = spark.createDataFrame([(1, "k", 2), (2, None, 3), (3, None, 4), (4, "n", 5), (5, "n", 6)], "seq int, code string, v int")
    assert sorted((str(r.code), r.v) for r in C.insert_ignore(base, batch, "code").collect()) == [("None", 3), ("None", 4), ("k", 1), ("n", 5)]


def test_orphan_report_shuffles_narrow_rows_in_small_tasks(spark, monkeypatch):
    """The join runs in small tasks; names and keys come out as they are."""
    sizes, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: sizes.append((spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), df.columns)) or write(df, name))
    child = spark.createDataFrame([(1, 7), (2, 8), (2, 8), (None, 9), (3, None)], "id long, asset_id long")
    parent = spark.createDataFrame([(7,), (7,), (None,)], "id long")
    out = Q.orphan_report({"certificates": child, "assets": parent}, [("certificates", "asset_id", "assets", "id")])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [("certificates", "asset_id", "assets", "2", "8")] * 2 + [("certificates", "asset_id", "assets", None, "9")]))
    assert sizes == [("4m", ["_n", "child_id", "_ref"])]
