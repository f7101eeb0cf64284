import json
import os

from rigflow.sources import tables as TB
from rigflow.sources.schemas import schema
from rigflow.session import cluster_conf


def test_read_table_uses_declared_schema(spark, scratch):
    df = spark.createDataFrame([("1", "AST-1", "Pump", "Other", None, None, None, "Yard", "Active")],
                               "id string, asset_id string, name string, category string, company_id string, "
                               "rig_id string, contract_id string, location string, status string")
    TB.write_table(df, scratch, "assets")
    back = TB.read_table(spark, scratch, "assets")
    assert back.schema == schema("assets")
    row = back.first()
    assert row.asset_id == "AST-1" and row.value_usd is None


def test_json_document_sink(spark, scratch):
    df = spark.createDataFrame([("kpis", "all", '{"a":1}')], "section string, item_key string, payload string")
    out = TB.write_json_document(df, os.path.join(scratch, "doc"))
    lines = [l for f in os.listdir(out) if f.endswith(".json") for l in open(os.path.join(out, f))]
    assert json.loads(lines[0])["section"] == "kpis"


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(input_tb=100, executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) >= 100 * 1024 * 1024 // 256
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
