import os

import pytest

from rigflow import session as S
from rigflow.operators import hierarchy as H


def _tables(spark):
    root = S.ensure_checkpoint_dir(spark).removeprefix("file:")
    return [x for x in os.listdir(root) if x.startswith("rigflow-")]


def test_scratch_leaves_no_tables(spark):
    before = len(_tables(spark))
    items = spark.createDataFrame([("a", "A", None, "n"), ("b", "A", "a", "m")], "id string, asset_id string, parent_id string, name string")
    with S.scratch(spark):
        assert H.bom_tree(items).count() == 2
        assert len(_tables(spark)) > before
    assert len(_tables(spark)) == before


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Session())


def test_small_tasks_follow_the_rows_and_put_settings_back(spark):
    from rigflow.session import small_tasks

    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(first, None), spark.conf.get(size, None)
    with pytest.raises(ValueError), small_tasks(spark, 60_000_000):
        assert spark.conf.get(first) == "300" and spark.conf.get(size) == "4m"
        raise ValueError
    assert (spark.conf.get(first, None), spark.conf.get(size, None)) == before
