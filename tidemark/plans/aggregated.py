"""Aggregated topics as DataFrames, batch or streaming depending on the source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import (
    DEFAULT_NAME_FORMAT,
    AggregatedTopic,
    AggregationConfig,
    SourceTopic,
    WindowAggregation,
)
from tidemark.functions.eventtime import as_timestamp, watermarked
from tidemark.operators.project import project_topic
from tidemark.operators.rollup import can_roll_up, roll_up
from tidemark.operators.summarize import summarize
from tidemark.operators.topics import exclude_topics, match_topics
from tidemark.sources.topics import TopicSource


def aggregate_topic(
    topic: AggregatedTopic,
    source: TopicSource,
    *,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Summary rows of one aggregated topic.

    With one source topic the window alone is the group. With several, the rows
    carry a ``topic`` column and each topic is summarised on its own. ``options``
    are those of :func:`summarize`.
    """
    messages = source_messages(topic, source, time_column, order_by)
    return summarize_messages(topic, messages, time_column, order_by, **options)


def summarize_messages(
    topic: AggregatedTopic,
    messages: DataFrame,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
    exclude: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Summary rows of messages taken by :func:`source_messages`."""
    return summarize(
        messages,
        topic.window_aggregation,
        time_column=time_column,
        keys=_keys(topic),
        order_by=order_by,
        exclude=["topic", *topic.excluded_fields, *exclude],
        **options,
    )


def source_messages(
    topic: AggregatedTopic,
    source: TopicSource,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Kept and renamed messages of all source topics of ``topic``.

    In batch, topics with the same projection are read together, in one scan.
    On a stream every topic is a source with a watermark of its own.
    """
    carry = [time_column, *_keys(topic), *order_by]

    def read(same: Sequence[SourceTopic]) -> DataFrame:
        return project_topic(source([one.name for one in same]), same[0], carry)

    first = read(topic.source_topics[:1])
    if first.isStreaming:
        delay = topic.window_aggregation.window_expiration_seconds
        parts = [first, *[read([one]) for one in topic.source_topics[1:]]]
        parts = [
            watermarked(
                part.withColumn(time_column, as_timestamp(part, time_column)), time_column, delay
            )
            for part in parts
        ]
    else:
        together: dict[tuple, list[SourceTopic]] = {}
        for one in topic.source_topics:
            together.setdefault((one.fields, tuple(sorted(one.map.items()))), []).append(one)
        parts = [read(same) for same in together.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def messages_by_topic(
    topic: AggregatedTopic,
    source: TopicSource,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The same, a frame for each source topic; all have the columns of the whole."""
    whole = source_messages(topic, source, time_column, order_by).schema
    parts = {}
    for one in topic.source_topics:
        alone = replace(topic, source_topics=(one,))
        carry = [time_column, *_keys(topic), *order_by]
        part = project_topic(source([one.name]), alone.source_topics[0], carry)
        if part.isStreaming:
            part = part.withColumn(time_column, as_timestamp(part, time_column))
        parts[one.name] = part.select(
            *[
                (F.col(f"`{f.name}`") if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in whole.fields
            ]
        )
    return parts


def _keys(topic: AggregatedTopic) -> list[str]:
    return ["topic"] if len(topic.source_topics) > 1 else []


def aggregate_all(
    config: AggregationConfig,
    source: TopicSource,
    available: Sequence[str] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """All aggregated topics of a configuration, by name.

    A configuration with patterns needs the names of the ``available`` topics. In batch, entries
    over the same messages whose windows are multiples of the smallest one share one pass
    (:func:`roll_up`), as far as their statistics merge.
    """
    if config.patterns:
        if available is None:
            raise ValueError("The configuration has patterns: say which topics there are.")
        config = config.resolve(available)
    together: dict[tuple, list[AggregatedTopic]] = {}
    for topic in config.aggregated_topics:
        same = tuple((one.name, one.fields, tuple(sorted(one.map.items()))) for one in topic.source_topics)
        together.setdefault((same, topic.excluded_fields), []).append(topic)
    frames = {}
    for topics in together.values():
        frames |= _same_messages(topics, source, **options)
    return {name: frames[name] for name in config.aggregated_topic_names}


def _same_messages(
    topics: Sequence[AggregatedTopic],
    source: TopicSource,
    time_column: str = "timestamp",
    order_by: Sequence[str] = (),
    exclude: Sequence[str] = (),
    **options,
) -> dict[str, DataFrame]:
    """Aggregated topics of the same messages: in batch read once, where their windows go together."""
    rolled, seen = [], {topic.name: topic.window_aggregation for topic in topics}
    mergeable = [t for t in topics if can_roll_up([seen[t.name]])]
    if mergeable:
        least = min(seen[t.name].window_size_seconds for t in mergeable)
        rolled = [t for t in mergeable if seen[t.name].window_size_seconds % least == 0]
    messages = source_messages(topics[0], source, time_column, order_by)
    if messages.isStreaming or len(rolled) < 2:
        rolled = []
    frames = {}
    if rolled:
        # Options of large groups and of order statistics have no meaning here.
        allowed = {k: v for k, v in options.items() if k in ("numeric", "on_error", "fields")}
        frames = roll_up(
            messages,
            {t.name: t.window_aggregation for t in rolled},
            time_column=time_column,
            keys=_keys(topics[0]),
            order_by=order_by,
            exclude=["topic", *topics[0].excluded_fields, *exclude],
            **allowed,
        )
    for topic in topics:
        if topic.name not in frames:
            frames[topic.name] = summarize_messages(
                topic, messages, time_column, order_by, exclude, **options
            )
    return frames


def aggregate_matching(
    messages: DataFrame,
    window: WindowAggregation,
    *,
    topic_regex: str = ".*",
    excluded_topics: Sequence[str] = (),
    name_format: str = DEFAULT_NAME_FORMAT,
    exclude: Sequence[str] = (),
    topics: Sequence[str] | None = None,
    lag_seconds: int | None = None,
    **options,
) -> DataFrame:
    """Summary rows of every topic of a tagged frame that matches and is not excluded.

    All topics are summarised in one go, however many there are. The column
    ``aggregated_topic`` names the topic the row belongs to after aggregation.

    On a stream, topics that lag behind others would lose messages to a common
    watermark, so one of two things must be said: ``topics``, all names there may be,
    each of which gets a watermark of its own (the slowest holds the windows open), or
    ``lag_seconds``, by how much a topic may be behind the one furthest ahead.
    """
    chosen = match_topics(messages, topic_regex)
    if excluded_topics:
        chosen = exclude_topics(chosen, excluded_topics)
    if messages.isStreaming:
        time_column = options.get("time_column", "timestamp")
        if topics is not None:
            timed = chosen.withColumn(time_column, as_timestamp(chosen, time_column))
            delay = window.window_expiration_seconds
            each = [watermarked(timed.where(F.col("topic") == t), time_column, delay) for t in topics]
            chosen = reduce(DataFrame.unionByName, each)
        elif lag_seconds is not None:
            window = replace(
                window, window_expiration_seconds=window.window_expiration_seconds + lag_seconds
            )
        else:
            raise ValueError("On a stream, name the topics or say how far a topic may lag behind.")
    rows = summarize(chosen, window, keys=["topic"], exclude=exclude, **options)
    name = F.replace(F.lit(name_format), F.lit("{source_topic_name}"), F.col("topic"))
    return rows.select(name.alias("aggregated_topic"), *[F.col(f"`{c}`") for c in rows.columns])
