"""What a streaming aggregation holds and what it leaves out: open windows, late and timeless messages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.eventtime import epoch_seconds

# Name of the metrics that aggregations observe on their source.
LEFT_OUT = "left_out"


def state_of(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state of one operator of a query, as of its last committed batch: ``key``, ``value``.

    Fields of the value are called ``v0, v1, ...``: Spark names them after the functions of the
    aggregation, which repeat themselves. The session's state store provider must be the
    query's own.
    """
    state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    fields = state.schema["value"].dataType.fields
    renamed = T.StructType([T.StructField(f"v{i}", f.dataType) for i, f in enumerate(fields)])
    return state.select("key", F.col("value").cast(renamed).alias("value"))


def open_windows(spark: SparkSession, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """Windows that a query of an aggregated topic still holds open: ``keys, time, window_size, count``.

    ``count`` is the number of messages so far. ``keys`` names the grouping columns besides the
    window, in their order; a query that keeps its messages (quartiles) has the columns of the
    messages there, and those left out of ``keys`` are summed over.
    """
    state = state_of(spark, checkpoint)
    key = state.schema["key"].dataType.fields
    # The first field is the window, and the first value the number of messages.
    named = T.StructType([T.StructField("window", key[0].dataType), *[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(key[1:])]])
    places = {f.name: f"k{i}" for i, f in enumerate(key[1:])}
    columns = [
        F.col(f"key.{places.get(name, f'k{i}')}").alias(name) for i, name in enumerate(keys)
    ]
    rows = state.select(F.col("key").cast(named).alias("key"), "value").select(
        *columns,
        epoch_seconds(F.col("key.window.start")).alias("start"),
        epoch_seconds(F.col("key.window.end")).alias("end"),
        F.col("value.v0").alias("n"),
    )
    return rows.groupBy(*[F.col(f"`{k}`") for k in keys], "start", "end").agg(F.sum("n").alias("count")).select(
        *[F.col(f"`{k}`") for k in keys], ((F.col("start") + F.col("end")) / 2).alias("time"),
        (F.col("end") - F.col("start")).alias("window_size"), "count",
    )


def observed(messages: DataFrame, time_column: str) -> DataFrame:
    """``messages`` with a count of all of them and of those without an event time, as metrics of each batch."""
    timeless = F.count_if(F.col(f"`{time_column}`").isNull())
    return messages.observe(LEFT_OUT, F.count(F.lit(1)).alias("messages"), timeless.alias("timeless"))


class LeftOut(StreamingQueryListener):
    """Counts, by query name, of messages seen, of those without event time and of those dropped as late.

    Add it with ``spark.streams.addListener`` before the queries start. Spark counts late rows
    where they meet the state: messages of one batch, partition, window and key that were
    aggregated before count as one.
    """

    def __init__(self):
        self._lock = Lock()
        self._counts: dict[str, dict[str, int]] = defaultdict(lambda: {"messages": 0, "timeless": 0, "late": 0})

    def counts(self, name: str) -> dict[str, int]:
        with self._lock:
            return dict(self._counts[name])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            counts = self._counts[progress.name]
            counts["late"] += sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
            if row := progress.observedMetrics.get(LEFT_OUT):
                counts["messages"] += row["messages"]
                counts["timeless"] += row["timeless"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
