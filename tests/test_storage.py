from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.storage import measured, shared_folder, written


def session(setting, master, chosen=None):
    """A stand-in with only what the folder depends on."""
    folders = [chosen]
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: folders[-1],
        setCheckpointDir=folders.append,
    )
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: setting), sparkContext=context
    )


def test_the_setting_decides():
    assert shared_folder(session("s3a://bucket/ckpt/", "spark://m:7077")) == "s3a://bucket/ckpt"
    assert shared_folder(session(None, "yarn", "hdfs:/ckpt")) == "hdfs:/ckpt"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "yarn"))


def test_a_local_session_gets_a_folder():
    assert "tidemark-" in shared_folder(session(None, "local[2]"))


def test_written_table_is_pinned(spark):
    table = written(spark.range(50).withColumn("x", F.rand()), "test")
    assert sorted(table.collect()) == sorted(table.collect())
    assert "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()


def test_measures_come_with_the_write(spark):
    table, found = measured(
        spark.range(50), "test", n=F.count(F.lit(1)), big=F.count_if(F.col("id") > 40)
    )
    assert found == {"n": 50, "big": 9} and table.count() == 50
