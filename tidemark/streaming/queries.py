"""Streaming queries of the aggregated topics, each with its own checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import AggregationConfig, WindowAggregation
from tidemark.functions.eventtime import as_timestamp, tumbling, watermarked
from tidemark.functions.stats import order_operations
from tidemark.plans.aggregated import messages_by_topic, summarize_messages
from tidemark.operators.cogroup import cogroup
from tidemark.sinks.aggregated import writer_id
from tidemark.sources.topics import TopicSource
from tidemark.storage import scratch
from tidemark.streaming.state import observed

# Spark's state store providers under the names used in configurations.
STATE_STORES = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def use_state_store(spark: SparkSession, store: str) -> None:
    """Keep window state in ``memory`` or in ``rocksdb`` (``name://`` is accepted too)."""
    name = store.removesuffix("://")
    if name not in STATE_STORES:
        raise ValueError(f"store must be one of {sorted(STATE_STORES)}, not {store!r}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORES[name])


def start_aggregations(
    config: AggregationConfig,
    source: TopicSource,
    sink,
    checkpoint_root: str,
    trigger: Mapping | None = None,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
    **options,
) -> dict[str, StreamingQuery]:
    """Start every aggregated topic. Rows appear once their window has closed.

    ``trigger`` takes the arguments of ``DataStreamWriter.trigger``. Restarting
    with the same checkpoint root continues where the queries stopped.

    Source topics of one aggregated topic are summarised separately, so each has a
    query and a watermark of its own (``<aggregated topic>/<source topic>`` where there
    are several): one that lags loses nothing, and one that is silent holds back
    nothing but its own rows.

    How many messages came, and how many of them without event time, are metrics of every
    batch; :class:`tidemark.streaming.state.LeftOut` adds them up, late ones too.

    Statistics that merge keep a state row of fixed size for each window. Quartiles
    and median go through :func:`start_on_close`.

    A configuration with patterns is to be resolved against the topics there are.
    """
    if config.patterns:
        raise ValueError("Resolve the patterns of the configuration first.")
    started = {}
    for topic in config.aggregated_topics:
        parts = messages_by_topic(topic, source, time_column, order_by)
        for name, messages in parts.items():
            messages = observed(messages, time_column)
            label = topic.name if len(parts) == 1 else f"{topic.name}/{name}"
            summary = partial(
                summarize_messages, topic, time_column=time_column, order_by=order_by, **options
            )
            if order_operations(topic.window_aggregation.operations):
                started[label] = start_on_close(
                    messages, topic.window_aggregation, summary, sink, topic.name,
                    checkpoint_root, trigger, time_column, label,
                )
            else:
                checkpoint = f"{checkpoint_root}/{label}"
                started[label] = sink.start(
                    summary(messages), topic.name, checkpoint, dict(trigger or {}), label
                )
    return started


def start_on_close(
    messages: DataFrame,
    window: WindowAggregation,
    compute: Callable[[DataFrame], DataFrame],
    sink,
    name: str,
    checkpoint_root: str,
    trigger: Mapping | None = None,
    time_column: str = "timestamp",
    label: str | None = None,
) -> StreamingQuery:
    """Apply the batch plan ``compute`` to the messages of every window that closes.

    The state holds a count for every distinct message of an open window, in rows of
    fixed size spread over all partitions, whatever the window's keys are. ``label``
    names the query and its checkpoint, by default like the aggregated topic.
    """
    label = label or name
    at, copies, keep = "__at", "__copies", messages.columns
    timed = messages.withColumn(at, as_timestamp(messages, time_column))
    closed = (
        watermarked(timed, at, window.window_expiration_seconds)
        .groupBy(tumbling(F.col(at), window.window_size_seconds), *[F.col(f"`{c}`") for c in keep])
        .agg(F.count(F.lit(1)).alias(copies))
    )
    checkpoint = f"{checkpoint_root}/{label}"
    writer = writer_id(checkpoint)

    def emit(batch: DataFrame, batch_id: int) -> None:
        counted = batch.select(*[F.col(f"`{c}`") for c in keep], copies)
        with scratch(counted, "closed", rows=F.count(F.lit(1))) as (rows, found):
            if found["rows"]:
                each = F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("__copy")
                whole = rows.select("*", each).drop(copies, "__copy")
                sink.write_batch(compute(whole), name, batch_id, writer)

    out = closed.writeStream.outputMode("append").queryName(label).foreachBatch(emit)
    out = out.option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def start_cogroup(
    messages: DataFrame,
    window: WindowAggregation,
    sink,
    name: str,
    checkpoint_root: str,
    trigger: Mapping | None = None,
    time_column: str = "timestamp",
    topic_column: str = "topic",
    key: str = "time",
    value: str = "value0",
    order_by: Sequence[str] = (),
    **options,
) -> StreamingQuery:
    """Co-groups of the windows that close, like :func:`cogroup`, without a list in the state."""
    columns = [time_column, topic_column, key, value, *order_by]
    grouped = partial(
        cogroup, window_size_seconds=window.window_size_seconds, time_column=time_column,
        topic_column=topic_column, key=key, value=value, order_by=order_by, **options,
    )
    chosen = messages.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])
    return start_on_close(chosen, window, grouped, sink, name, checkpoint_root, trigger, time_column)


def start_passthrough(
    messages: DataFrame, name: str, sink, checkpoint_root: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Send the unchanged source messages on to a sink of their own."""
    return sink.start(messages, name, f"{checkpoint_root}/{name}", dict(trigger or {}))
