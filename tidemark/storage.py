"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back.

    Cuts the lineage, pins the content for every later reader and gives
    Catalyst the true size, so a join with it is broadcast only when it is
    small enough.
    """
    return measured(df, label)[0]


def measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """Like :func:`written`, with aggregates of ``df`` taken by the same job."""
    path = new_path(df.sparkSession, label)
    observation = Observation()
    observed = df.observe(observation, *[c.alias(n) for n, c in measures.items()]) if measures else df
    observed.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table, observation.get if measures else {}


@contextmanager
def scratch(df: DataFrame, label: str, **measures: Column) -> Iterator[tuple[DataFrame, dict[str, Any]]]:
    """Like :func:`measured`; the files go when the block ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    observation = Observation()
    df.observe(observation, *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path), observation.get
    finally:
        delete(spark, path)


# Small files of the driver, on any file system that Spark can reach.


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds; nothing happens if it is not there."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``, none if it does not exist."""
    files, place = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _file_system(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with ``text``, there whole or not at all; False if there is one already."""
    files, place = _file_system(spark, path)
    if files.exists(place):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{place.getParent().toString()}/.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.rename(draft, place):
        return True
    files.delete(draft, False)
    return False
