"""Queries over the test tables, each with the SQL that must give the same rows.

The ``events`` table stands for a stream: ``ts`` is the message time and
``event_type`` the topic. ``orders`` is a second stream, ``lineitem`` one with
many numeric fields. Floating-point results are rounded to six places on both
sides.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import (  # noqa: E402
    AggregatedTopic,
    AggregationConfig,
    SourceTopic,
    WindowAggregation,
    aggregate_all,
    aggregate_matching,
    aggregate_topic,
    cogroup,
    join_wide,
    summarize,
)
from tidemark.config import aggregated_name  # noqa: E402
from tidemark.functions.eventtime import as_timestamp, epoch_seconds  # noqa: E402
from tidemark.functions.measures import reduction_factor, standard_error  # noqa: E402
from tidemark.functions.stats import OPERATIONS  # noqa: E402
from tidemark.operators.cogroup import join_messages  # noqa: E402
from tidemark.operators.project import numeric_fields  # noqa: E402
from tidemark.operators.topics import (  # noqa: E402
    exclude_topics,
    keep_topics,
    match_topics,
    union_topics,
)
from tidemark.sinks.aggregated import FileSink  # noqa: E402
from tidemark.sources.topics import decode_messages, frames_source, tagged_source  # noqa: E402
from tidemark.storage import new_path  # noqa: E402
from tidemark.streaming.queries import (  # noqa: E402
    start_aggregations,
    start_cogroup,
    start_passthrough,
    use_state_store,
)
from tidemark.streaming.state import open_windows  # noqa: E402
from tidemark.streaming.timed import start_by_topic_clock  # noqa: E402

try:  # the corpus operators are a part that can be left out
    import corpus_pipeline as _pipeline  # noqa: E402
    from tidemark.llm import queries as _corpus  # noqa: E402
except ImportError:  # left out, or one of the packages that they need is not here
    _corpus = _pipeline = None

HOUR = 3_600
DAY = 86_400
MONTH = 30 * DAY
# Ten years: every shipping date falls into one window.
DECADE = 3_650 * DAY

ROLLED = {"events-minutes": 60, "events-hours": HOUR, "events-days": DAY}

LINEITEM_ALL = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM_STRICT = [name for name in LINEITEM_ALL if name != "l_linenumber"]
LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_IDS = ["l_orderkey", "l_partkey", "l_suppkey"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumnRenamed("event_type", "topic")


def _rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        *[f"round(`{n}`, 6) AS `{n}`" if kind == "double" else f"`{n}`" for n, kind in df.dtypes]
    )


def _hourly(operations=OPERATIONS, **window) -> WindowAggregation:
    return WindowAggregation(window_size_seconds=HOUR, operations=operations, **window)


def _event_summary(operations=OPERATIONS, keys=(), size=HOUR, min_sample_size=2, **options) -> Query:
    window = WindowAggregation(
        window_size_seconds=size, operations=operations, min_sample_size=min_sample_size
    )

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = _events(spark, sf_dir)
        return _rounded(
            summarize(events, window, time_column="ts", keys=keys, fields=["value"], **options)
        )

    return run


def _tumbling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(_events(spark, sf_dir), _hourly(), time_column="ts", fields=[])


def _lineitem_summary(size: int, operations=OPERATIONS, **options) -> Query:
    window = WindowAggregation(window_size_seconds=size, operations=operations)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = _table(spark, sf_dir, "lineitem")
        return _rounded(summarize(items, window, time_column="l_shipdate", **options))

    return run


def _numeric_fields(mode: str) -> Query:
    window = WindowAggregation(window_size_seconds=MONTH, operations=("min", "mean", "max"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = _table(spark, sf_dir, "lineitem")
        expected = LINEITEM_ALL if mode == "all" else LINEITEM_STRICT
        assert numeric_fields(items.schema, mode) == expected
        return _rounded(summarize(items, window, time_column="l_shipdate", numeric=mode))

    return run


def _configured(fields, renames=None) -> Query:
    """All events as one topic, through a configured aggregated topic."""
    topic = AggregatedTopic(
        name="aggregated_events",
        source_topics=(SourceTopic("events", fields, renames or {}),),
        window_aggregation=_hourly(("min", "mean", "max")),
    )

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = frames_source({"events": _events(spark, sf_dir)})
        return _rounded(aggregate_topic(topic, source, time_column="ts"))

    return run


def _source_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = AggregatedTopic(
        name="aggregated_traffic",
        source_topics=(SourceTopic("view", ("value",)), SourceTopic("click", ("value",))),
        window_aggregation=_hourly(),
    )
    source = tagged_source(_event_topics(spark, sf_dir))
    return _rounded(aggregate_topic(topic, source, time_column="ts"))


def _by_topic(choose: Callable[[DataFrame], DataFrame]) -> Query:
    window = _hourly(("mean", "stdev"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = choose(_event_topics(spark, sf_dir))
        return _rounded(
            summarize(chosen, window, time_column="ts", keys=["topic"], fields=["value"])
        )

    return run


def _aggregate_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        aggregate_matching(
            _event_topics(spark, sf_dir).select("ts", "topic", "value"),
            _hourly(),
            topic_regex="(click|error|view)",
            excluded_topics=["error"],
            time_column="ts",
        )
    )


def _multi_topic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = AggregatedTopic(
        name="aggregated_amounts",
        source_topics=(
            SourceTopic("events", ("value", "user_id"), {"value": "amount"}),
            SourceTopic("orders", ("o_totalprice",), {"o_totalprice": "amount"}),
        ),
        window_aggregation=WindowAggregation(window_size_seconds=DAY, operations=OPERATIONS),
    )
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts")
    source = frames_source({"events": _events(spark, sf_dir), "orders": orders})
    return _rounded(aggregate_topic(topic, source, time_column="ts"))


def _multi_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entry_for(name, source, size, operations):
        return {
            "name": name,
            "window_aggregation": {"window_size_seconds": size, "operations": operations},
            "filter": {"source_topics": [{"name": source, "fields": ["value"]}]},
        }

    config = AggregationConfig.from_mapping(
        {
            "aggregated_topics": [
                entry_for(None, "purchase", HOUR, ["mean"]),
                entry_for("purchase-daily", "purchase", DAY, ["mean", "stdev"]),
                entry_for(None, "error", DAY, ["q1", "median", "q3"]),
            ]
        }
    )
    source = tagged_source(_event_topics(spark, sf_dir))
    frames = aggregate_all(config, source, time_column="ts")
    return _rounded(union_topics(frames, "aggregated_topic"))


def _multi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes, hours and days of one topic, from one pass."""
    operations = ["min", "mean", "stdev", "max"]
    config = AggregationConfig.from_mapping(
        {
            "aggregated_topics": [
                {
                    "name": name,
                    "window_aggregation": {"window_size_seconds": size, "operations": operations},
                    "filter": {"source_topics": [{"name": "events", "fields": ["value", "user_id"]}]},
                }
                for name, size in ROLLED.items()
            ]
        }
    )
    frames = aggregate_all(config, frames_source({"events": _events(spark, sf_dir)}), time_column="ts")
    return _rounded(union_topics(frames, "aggregated_topic"))


def _half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click and view topics whose payload ``time`` is the half hour."""
    events = keep_topics(_event_topics(spark, sf_dir), ["click", "view"])
    seconds = epoch_seconds(as_timestamp(events, "ts"))
    return events.withColumn("time", F.floor(seconds / 1800) * F.lit(1800.0))


def _cogrouped(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = cogroup(
            _half_hours(spark, sf_dir),
            window_size_seconds=HOUR, time_column="ts", value="value", order_by=["event_id"], **options,
        )
        return _listed(groups)

    return run


def _listed(groups: DataFrame) -> DataFrame:
    """Co-groups with their records as one text."""

    def text(record: Column) -> Column:
        cents = F.round(record["value"] * 100).cast("bigint").cast("string")
        return F.concat(record["field"], F.lit("="), cents)

    listed = F.concat_ws(",", F.transform("records", text))
    return groups.select("time", "window_start", "part", "parts", listed.alias("records"))


def _config_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = AggregationConfig.from_mapping(
        {
            "aggregated_topics": [
                {
                    "window_aggregation": {"window_size_seconds": HOUR, "operations": ["mean", "max"]},
                    "filter": {
                        "topic_regex": "(click|error|view)",
                        "excluded_topics": ["error"],
                        "excluded_field_names": ["event_id", "user_id"],
                    },
                    "name_format": "{source_topic_name}-hourly",
                }
            ]
        }
    )
    events = _event_topics(spark, sf_dir)
    names = [r["topic"] for r in events.select("topic").distinct().collect()]
    frames = aggregate_all(config, tagged_source(events), available=names, time_column="ts")
    labelled = [f.select(F.lit(n).alias("aggregated_topic"), "*") for n, f in frames.items()]
    return _rounded(functools.reduce(DataFrame.unionByName, labelled))


def _passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out = new_path(spark, "copy")
    sink = FileSink(f"{out}/data")
    start_passthrough(
        stream.select("event_id", "user_id", "event_type"), "events", sink, f"{out}/checkpoints", {"availableNow": True}
    ).awaitTermination()
    return sink.read(spark, "events")


def _join_topics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        join_wide(
            _half_hours(spark, sf_dir), ["click", "view"],
            window_size_seconds=HOUR, time_column="ts", value="value", order_by=["event_id"],
        )
    )


def _standard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = _hourly(("mean", "stdev"))
    summary = summarize(_events(spark, sf_dir), window, time_column="ts", fields=["value"])
    return _rounded(
        summary.select("time", "count", "mean_value", standard_error("value").alias("se_value"))
    )


def _reduction_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = _hourly(("min", "mean", "median", "stdev", "max"))
    summary = summarize(
        _events(spark, sf_dir), window, time_column="ts", keys=["event_type"], fields=["value"]
    )
    return _rounded(reduction_factor(summary, len(window.operations), ("event_type",)))


def _message_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages, as a Kafka topic holds them, decoded and summarised."""
    events = _events(spark, sf_dir)
    payload = events.select("event_id", "user_id", "value")
    messages = events.select(
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        as_timestamp(events, "ts").alias("timestamp"),
        F.to_json(F.struct(*payload.columns)).cast("binary").alias("value"),
    )
    decoded = decode_messages(messages, payload.schema)
    window = _hourly(("min", "mean", "max"))
    return _rounded(summarize(decoded, window, fields=["user_id", "value"], order_by=["offset"]))


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly summary as a streaming query; the last window is still open."""
    schema = _events(spark, sf_dir).schema
    # A streaming file source takes a folder or a glob, and the table may be one file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    config = AggregationConfig(
        (AggregatedTopic("stream_summary", (SourceTopic("events", ("value",)),), _hourly()),)
    )
    out = new_path(spark, "stream")
    sink = FileSink(f"{out}/data")
    started = start_aggregations(
        config,
        frames_source({"events": stream}),
        sink,
        f"{out}/checkpoints",
        {"availableNow": True},
        time_column="ts",
    )
    for query in started.values():
        query.awaitTermination()
    return _rounded(sink.read(spark, "stream_summary"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A streaming file source takes a folder or a glob, and the table may be one file.
    return spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")


def _run_stream(spark, stream, window, out, keys=(), **options) -> FileSink:
    """Run one aggregated topic over what there is, and give its sink."""
    topic = AggregatedTopic("streamed", (SourceTopic("events", ("value",)),), window)
    sink = FileSink(f"{out}/data")
    started = start_aggregations(
        AggregationConfig((topic,)), frames_source({"events": stream}), sink, f"{out}/checkpoints",
        {"availableNow": True}, time_column="ts", **options,
    )
    for query in started.values():
        query.awaitTermination()
    return sink


def _stream_expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows stay open for two hours after their end; state in RocksDB."""
    window = _hourly(("min", "mean", "max"), window_expiration_seconds=2 * HOUR)
    with _state_store(spark, "rocksdb"):
        sink = _run_stream(spark, _event_stream(spark, sf_dir), window, new_path(spark, "stream"))
    return _rounded(sink.read(spark, "streamed"))


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event comes after all others: too late but for the windows still open."""
    out = new_path(spark, "late")
    events, window = _events(spark, sf_dir), _hourly(("mean", "max"), window_expiration_seconds=DAY)
    for late in (False, True):
        part = events.where((F.col("event_id") % 10 == 0) == F.lit(late)).coalesce(1)
        part.write.mode("append").parquet(f"{out}/source")
        sink = _run_stream(spark, spark.readStream.schema(events.schema).parquet(f"{out}/source"), window, out)
    return _rounded(sink.read(spark, "streamed"))


def _stream_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quartiles as a stream, by distributed ranks when a window closes."""
    window = WindowAggregation(window_size_seconds=DAY, operations=("q1", "median", "q3"))
    sink = _run_stream(spark, _event_stream(spark, sf_dir), window, new_path(spark, "stream"), max_group_values=100)
    return _rounded(sink.read(spark, "streamed"))


def _stream_half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).withColumnRenamed("event_type", "topic")
    seconds = epoch_seconds(as_timestamp(events, "ts"))
    half_hours = events.withColumn("time", F.floor(seconds / 1800) * F.lit(1800.0))
    return keep_topics(half_hours, ["click", "view"])


def _stream_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "stream")
    sink = FileSink(f"{out}/data")
    start_cogroup(
        _stream_half_hours(spark, sf_dir), WindowAggregation(window_size_seconds=HOUR), sink, "groups",
        f"{out}/checkpoints", {"availableNow": True}, time_column="ts", value="value", order_by=["event_id"],
    ).awaitTermination()
    return _listed(sink.read(spark, "groups"))


def _stream_join_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of the same half hour, joined as two streams."""
    out = new_path(spark, "stream")
    sides = [keep_topics(_stream_half_hours(spark, sf_dir), [topic]) for topic in ("click", "view")]
    joined = join_messages(
        *sides, names=["click", "view"], window_size_seconds=HOUR, time_column="ts", value="value"
    )
    sink = FileSink(f"{out}/data")
    sink.start(joined, "joined", f"{out}/checkpoints/joined", {"availableNow": True}).awaitTermination()
    # Of the numbers only the values may have fractions.
    values = [F.round(name, 6).alias(name) for name in ("click_value", "view_value")]
    return sink.read(spark, "joined").select("time", "window_start", *values)


def _stream_topics_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event types in one query, each by its own clock: errors come after all others, signups stop early."""
    out = new_path(spark, "timed")
    events = _event_topics(spark, sf_dir).where("topic <> 'signup' OR ts < timestamp_ntz'2024-01-10 12:30:00'")
    sink, window = FileSink(f"{out}/data"), _hourly(("min", "mean", "stdev", "max"))
    with _state_store(spark, "rocksdb"):
        for lagging in (False, True):
            part = events.where((F.col("topic") == "error") == F.lit(lagging)).coalesce(1)
            part.write.mode("append").parquet(f"{out}/source")
            stream = spark.readStream.schema(events.schema).parquet(f"{out}/source")
            start_by_topic_clock(
                stream, window, sink, "timed", f"{out}/checkpoints", {"availableNow": True}, time_column="ts", fields=["value"]
            ).awaitTermination()
    return _rounded(sink.read(spark, "timed"))


def _open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the state store holds after a stream has read all events."""
    out = new_path(spark, "stream")
    window = _hourly(("mean", "stdev"), window_expiration_seconds=DAY)
    _run_stream(spark, _event_stream(spark, sf_dir), window, out)
    return open_windows(spark, f"{out}/checkpoints/streamed")


@contextmanager
def _state_store(spark: SparkSession, store: str):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_state_store(spark, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def entry(spark: SparkSession) -> DataFrame:
    """Hourly summary of the events: all seven statistics of every window."""
    return queries()["summary_all"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "tumbling_count": _tumbling_count,
        **{f"stat_{op}": _event_summary((op,)) for op in OPERATIONS},
        "summary_all": _event_summary(),
        "stats_by_key": _event_summary(keys=("event_type",)),
        "min_sample_fallback": _event_summary(
            keys=("event_type",), min_sample_size=4, order_by=["event_id"]
        ),
        "min_sample_fallback_ordered": _event_summary(
            ("mean", "max"), keys=("event_type",), min_sample_size=4, order_by=["event_id"]
        ),
        "summary_lineitem": _lineitem_summary(MONTH),
        "summary_one_window": _lineitem_summary(DECADE, fields=LINEITEM_MEASURES),
        "quartiles_ranked": _event_summary(("q1", "median", "q3"), size=DAY, max_group_values=100),
        "summary_hot_cold": _event_summary(keys=("event_type",), size=DAY, max_group_values=60),
        "project_fields": _configured(("value", "user_id")),
        "rename_fields": _configured(("value", "user_id"), {"value": "amount"}),
        "numeric_fields": _numeric_fields("all"),
        "numeric_fields_strict": _numeric_fields("strict"),
        "exclude_fields": _lineitem_summary(MONTH, ("mean",), exclude=LINEITEM_IDS),
        "source_topic_filter": _source_topic_filter,
        "topic_regex_select": _by_topic(lambda df: match_topics(df, "(click|view|err)")),
        "topic_exclude": _by_topic(lambda df: exclude_topics(df, ["error", "signup"])),
        "aggregate_matching": _aggregate_matching,
        "multi_topic_union": _multi_topic_union,
        "multi_config": _multi_config,
        "multi_rollup": _multi_rollup,
        "cogroup_topics": _cogrouped(),
        "cogroup_parts": _cogrouped(part_rows=2),
        "config_regex": _config_regex,
        "undefined_statistic": _event_summary(("stdev", "q1"), keys=("event_type",), min_sample_size=1),
        "passthrough": _passthrough,
        "join_topics_wide": _join_topics_wide,
        "standard_error": _standard_error,
        "reduction_factor": _reduction_factor,
        "message_round_trip": _message_round_trip,
        "stream_summary": _stream_summary,
        "stream_expiration": _stream_expiration,
        "stream_late": _stream_late,
        "stream_large": _stream_large,
        "stream_cogroup": _stream_cogroup,
        "stream_join_wide": _stream_join_wide,
        "stream_topics_timed": _stream_topics_timed,
        "state_open_windows": _open_windows,
        **({**_corpus.queries(), "pipeline": _pipeline.run} if _corpus else {}),
    }


def oracle_sql() -> dict[str, str]:
    events = ("events", "ts")
    value = {"value": "value"}
    month = {"relation": "lineitem", "time": "l_shipdate", "size": MONTH}
    by_topic = {"keys": {"topic": "event_type"}}
    all_events = {"relation": "events", "time": "ts", "size": HOUR}
    light = ("min", "mean", "max")

    def events_sql(operations, size=HOUR, fields=value, **options):
        return _summary_sql(*events, size, fields, operations, **options)

    def same(names):
        return {name: name for name in names}

    def month_sql(names, operations):
        return _summary_sql(**month, fields=same(names), operations=operations)

    amounts = """(
        SELECT 'events' AS topic, ts, value AS amount, user_id FROM events
        UNION ALL
        SELECT 'orders', o_orderdate, o_totalprice, NULL FROM orders)"""
    purchases = "(SELECT * FROM events WHERE event_type = 'purchase')"
    errors = "(SELECT * FROM events WHERE event_type = 'error')"
    half_hours = f"""
        SELECT event_id, ts, event_type AS topic, value,
               floor(epoch_us(ts) / 1800000000) * 1800.0 AS time,
               floor(epoch_us(ts) / {HOUR}000000) * {HOUR}.0 AS window_start
        FROM events WHERE event_type IN ('click', 'view')"""

    return {
        "tumbling_count": events_sql((), fields={}),
        **{f"stat_{op}": events_sql((op,)) for op in OPERATIONS},
        "summary_all": events_sql(OPERATIONS),
        "stats_by_key": events_sql(OPERATIONS, keys={"event_type": "event_type"}),
        "min_sample_fallback": events_sql(
            OPERATIONS, keys={"event_type": "event_type"}, min_sample_size=4, order="(ts, event_id)"
        ),
        "min_sample_fallback_ordered": events_sql(
            ("mean", "max"), keys={"event_type": "event_type"}, min_sample_size=4, order="(ts, event_id)"
        ),
        "summary_lineitem": month_sql(LINEITEM_ALL, OPERATIONS),
        "summary_one_window": _summary_sql(
            "lineitem", "l_shipdate", DECADE, same(LINEITEM_MEASURES), OPERATIONS
        ),
        "quartiles_ranked": events_sql(("q1", "median", "q3"), size=DAY),
        "summary_hot_cold": events_sql(OPERATIONS, size=DAY, keys={"event_type": "event_type"}),
        "project_fields": events_sql(light, fields={"value": "value", "user_id": "user_id"}),
        "rename_fields": events_sql(light, fields={"amount": "value", "user_id": "user_id"}),
        "numeric_fields": month_sql(LINEITEM_ALL, light),
        "numeric_fields_strict": month_sql(LINEITEM_STRICT, light),
        "exclude_fields": month_sql(["l_linenumber", *LINEITEM_MEASURES], ("mean",)),
        "source_topic_filter": _summary_sql(
            **all_events, fields=value, operations=OPERATIONS, **by_topic,
            where="event_type IN ('view', 'click')",
        ),
        "topic_regex_select": _summary_sql(
            **all_events, fields=value, operations=("mean", "stdev"), **by_topic,
            where="regexp_full_match(event_type, '(click|view|err)')",
        ),
        "topic_exclude": _summary_sql(
            **all_events, fields=value, operations=("mean", "stdev"), **by_topic,
            where="event_type NOT IN ('error', 'signup')",
        ),
        "aggregate_matching": f"""
            SELECT topic || '-aggregated' AS aggregated_topic, * FROM ({_summary_sql(
                **all_events, fields=value, operations=OPERATIONS, **by_topic,
                where="event_type IN ('click', 'view')",
            )})""",
        "multi_topic_union": _summary_sql(
            amounts, "ts", DAY, same(["amount", "user_id"]), OPERATIONS, keys={"topic": "topic"}
        ),
        "multi_config": f"""
            SELECT '{aggregated_name("purchase")}' AS aggregated_topic, *,
                   NULL::DOUBLE AS stdev_value, NULL::DOUBLE AS q1_value,
                   NULL::DOUBLE AS median_value, NULL::DOUBLE AS q3_value
            FROM ({_summary_sql(purchases, "ts", HOUR, value, ("mean",))})
            UNION ALL BY NAME
            SELECT 'purchase-daily' AS aggregated_topic, *
            FROM ({_summary_sql(purchases, "ts", DAY, value, ("mean", "stdev"))})
            UNION ALL BY NAME
            SELECT '{aggregated_name("error")}' AS aggregated_topic, *
            FROM ({_summary_sql(errors, "ts", DAY, value, ("q1", "median", "q3"))})""",
        "multi_rollup": " UNION ALL ".join(
            f"SELECT '{name}' AS aggregated_topic, * FROM ({events_sql(('min', 'mean', 'stdev', 'max'), size, same(['value', 'user_id']))})"
            for name, size in ROLLED.items()
        ),
        "cogroup_topics": _cogroup_sql(half_hours, 50_000),
        "cogroup_parts": _cogroup_sql(half_hours, 2),
        "config_regex": f"""
            SELECT topic || '-hourly' AS aggregated_topic, * EXCLUDE (topic) FROM ({_summary_sql(
                **all_events, fields=value, operations=("mean", "max"), **by_topic,
                where="event_type IN ('click', 'view')",
            )})""",
        "undefined_statistic": events_sql(
            ("stdev", "q1"), keys={"event_type": "event_type"}, min_sample_size=1
        ),
        "passthrough": "SELECT event_id, user_id, event_type FROM events",
        "join_topics_wide": f"""
            SELECT time, window_start,
                   round(arg_max(value, (ts, event_id)) FILTER (topic = 'click'), 6) AS click_value,
                   round(arg_max(value, (ts, event_id)) FILTER (topic = 'view'), 6) AS view_value
            FROM ({half_hours}) GROUP BY time, window_start""",
        "standard_error": f"""
            SELECT time, count, round(mean_value, 6) AS mean_value,
                   round(stdev_value / sqrt(count), 6) AS se_value
            FROM ({_summary_sql(*events, HOUR, value, ("mean", "stdev"), digits=None)})""",
        "reduction_factor": f"""
            SELECT event_type, round(sum(count) / (count(*) * 5.0), 6) AS reduction_factor
            FROM ({events_sql((), fields={}, keys={"event_type": "event_type"})})
            GROUP BY event_type""",
        "message_round_trip": events_sql(light, fields={"user_id": "user_id", "value": "value"}),
        "stream_summary": f"""
            SELECT * FROM ({events_sql(OPERATIONS)})
            WHERE time + {HOUR / 2} <= (SELECT epoch_us(max(ts)) / 1e6 FROM events)""",
        "stream_expiration": f"""
            SELECT * FROM ({events_sql(light)})
            WHERE time + {HOUR / 2} + {2 * HOUR} <= (SELECT epoch_us(max(ts)) / 1e6 FROM events)""",
        "stream_late": f"""
            SELECT * FROM ({_summary_sql(
                **all_events, fields=value, operations=("mean", "max"),
                where=f"""event_id % 10 <> 0 OR (floor(epoch_us(ts) / {HOUR}000000) + 1) * {HOUR} + {DAY}
                          > (SELECT floor(epoch_us(max(ts)) / 1e3) / 1e3 FROM events WHERE event_id % 10 <> 0)""",
            )}) WHERE time + {HOUR / 2} + {DAY} <= (SELECT epoch_us(max(ts)) / 1e6 FROM events)""",
        "stream_large": f"""
            SELECT * FROM ({events_sql(("q1", "median", "q3"), size=DAY)})
            WHERE time + {DAY / 2} <= (SELECT epoch_us(max(ts)) / 1e6 FROM events)""",
        "stream_cogroup": f"""
            SELECT * FROM ({_cogroup_sql(half_hours, 50_000)})
            WHERE window_start + {HOUR} <= (SELECT max(epoch_us(ts)) / 1e6 FROM ({half_hours}))""",
        "stream_join_wide": f"""
            WITH h AS ({half_hours}),
            closed AS (SELECT min(last) AS at FROM (SELECT max(epoch_us(ts)) / 1e6 AS last FROM h GROUP BY topic))
            SELECT coalesce(c.time, v.time) AS time, coalesce(c.window_start, v.window_start) AS window_start,
                   round(c.value, 6) AS click_value, round(v.value, 6) AS view_value
            FROM (SELECT * FROM h WHERE topic = 'click') c
            FULL OUTER JOIN (SELECT * FROM h WHERE topic = 'view') v USING (time, window_start), closed
            WHERE (c.value IS NOT NULL AND v.value IS NOT NULL)
               OR coalesce(c.window_start, v.window_start) + {HOUR} <= closed.at""",
        "stream_topics_timed": f"""
            WITH e AS (SELECT * FROM events WHERE event_type <> 'signup' OR ts < TIMESTAMP '2024-01-10 12:30:00'),
            clocks AS (SELECT event_type AS topic, max(epoch_us(ts)) / 1e6 AS at FROM e GROUP BY event_type)
            SELECT s.* FROM ({_summary_sql(
                "e", "ts", HOUR, value, ("min", "mean", "stdev", "max"), **by_topic
            )}) s JOIN clocks USING (topic) WHERE s.time + {HOUR / 2} <= clocks.at""",
        "state_open_windows": f"""
            SELECT time, window_size, count FROM ({events_sql((), fields={})})
            WHERE time + {HOUR / 2} + {DAY} > (SELECT epoch_us(max(ts)) / 1e6 FROM events)""",
        **(_corpus.oracle_sql() if _corpus else {}),
    }


def _cogroup_sql(relation: str, part_rows: int) -> str:
    return f"""
        SELECT time, window_start, part, CAST(ceil(any_value(n) / {part_rows}.0) AS BIGINT) AS parts,
               string_agg(topic || '.value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR),
                          ',' ORDER BY ts, event_id) AS records
        FROM (SELECT *, count(*) OVER (PARTITION BY time, window_start) AS n,
                     (row_number() OVER (PARTITION BY time, window_start ORDER BY ts, event_id) - 1)
                         // {part_rows} AS part
              FROM ({relation}))
        GROUP BY time, window_start, part"""


def _summary_sql(
    relation, time, size, fields, operations,
    keys=None, min_sample_size=2, order=None, where="true", digits=6,
) -> str:
    """Summary per window in SQL; ``fields`` and ``keys`` map output names to columns."""
    keys = keys or {}

    def quartile(name: str, k: int) -> str:
        j = f"greatest(least(CAST(floor({k} * (n_{name} + 1) / 4) AS BIGINT), n_{name} - 1), 1)"
        d = f"({k} * (n_{name} + 1) - 4 * {j})"
        return f"(sorted_{name}[{j}] * (4 - {d}) + sorted_{name}[{j} + 1] * {d}) / 4"

    def statistic(op: str, name: str) -> str:
        value = quartile(name, {"q1": 1, "q3": 3}[op]) if op in ("q1", "q3") else f"{op}_{name}"
        chosen = f"CASE WHEN n_{name} >= {min_sample_size} THEN {value} ELSE first_{name} END"
        return chosen if digits is None else f"round({chosen}, {digits})"

    sql_name = {"mean": "avg", "stdev": "stddev_samp"}
    aggregates = ["count(*) AS n_rows"]
    outputs = [f"start + {size / 2} AS time", f"CAST({size} AS DOUBLE) AS window_size", "n_rows AS count"]
    for name in fields:
        first = f"arg_min({name}, {order})" if order else f"min({name})"
        aggregates.append(f"count({name}) AS n_{name}")
        aggregates.append(f"{first} FILTER ({name} IS NOT NULL) AS first_{name}")
        if {"q1", "q3"} & set(operations):
            aggregates.append(
                f"list_sort(list({name}) FILTER ({name} IS NOT NULL)) AS sorted_{name}"
            )
        for op in operations:
            if op not in ("q1", "q3"):
                aggregates.append(f"{sql_name.get(op, op)}({name}) AS {op}_{name}")
            outputs.append(f"{statistic(op, name)} AS {op}_{name}")
    extra = f", {order[1:-1]}" if order else ""
    columns = "".join(f", CAST({column} AS DOUBLE) AS {name}" for name, column in fields.items())
    columns += "".join(f", {column} AS {name}" for name, column in keys.items())
    key_list = "".join(f", {name}" for name in keys)
    return f"""
        SELECT {", ".join([*keys, *outputs])}
        FROM (SELECT start{key_list}, {", ".join(aggregates)}
              FROM (SELECT floor(epoch_us({time}) / {size}000000) * {size} AS start{columns}{extra}
                    FROM {relation} WHERE {where})
              GROUP BY start{key_list})"""
