"""Choosing topics in a topic-tagged frame, and putting topics together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_topics(df: DataFrame, names: Iterable[str], topic_column: str = "topic") -> DataFrame:
    """Rows of the named topics. The predicate reaches the scan."""
    return df.where(F.col(topic_column).isin(list(names)))


def exclude_topics(df: DataFrame, names: Iterable[str], topic_column: str = "topic") -> DataFrame:
    """Rows of all topics but the named ones."""
    return df.where(~F.col(topic_column).isin(list(names)))


def match_topics(df: DataFrame, regex: str, topic_column: str = "topic") -> DataFrame:
    """Rows of the topics whose whole name matches ``regex``.

    On a table partitioned by topic Spark evaluates this on the partition
    values only.
    """
    return df.where(F.col(topic_column).rlike(f"^(?:{regex})$"))


def union_topics(frames: Mapping[str, DataFrame], topic_column: str = "topic") -> DataFrame:
    """One frame of several topics, tagged with the topic name.

    A field missing from a topic is null there.
    """
    if not frames:
        raise ValueError("union_topics needs at least one topic.")
    taken = [name for name, df in frames.items() if topic_column in df.columns]
    if taken:
        raise ValueError(f"These topics have a field called {topic_column!r} already: {taken}")
    tagged = [df.withColumn(topic_column, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
