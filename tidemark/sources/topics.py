"""Topic sources: callables from topic names to one frame with a ``topic`` column.

All of them give one frame for all the names, so several topics are one scan
wherever the storage allows it, and the same plans run on any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.topics import keep_topics, union_topics
from tidemark.sources.schema import schema_from_avro

TopicSource = Callable[[Sequence[str]], DataFrame]

# Fixed names: message columns of the Kafka source.
KAFKA_COLUMNS = ("topic", "partition", "offset", "timestamp")


def frames_source(frames: Mapping[str, DataFrame]) -> TopicSource:
    """Topics that are separate frames."""
    return lambda names: union_topics({name: frames[name] for name in names})


def tagged_source(df: DataFrame, topic_column: str = "topic") -> TopicSource:
    """Topics that share a frame and are told apart by a column."""

    def read(names: Sequence[str]) -> DataFrame:
        chosen = keep_topics(df, names, topic_column)
        return chosen.withColumnRenamed(topic_column, "topic")

    return read


def files_source(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    file_format: str = "parquet",
    streaming: bool = False,
    **options: str,
) -> TopicSource:
    """Topics stored as folders ``<root>/<topic>`` of files."""

    def read(names: Sequence[str]) -> DataFrame:
        reader = spark.readStream if streaming else spark.read
        reader = reader.schema(schema).format(file_format).options(**options)
        return union_topics({name: reader.load(f"{root}/{name}") for name in names})

    return read


def kafka_source(
    spark: SparkSession,
    servers: str,
    schema: T.StructType | str,
    value_format: str = "json",
    schema_id_header: bool = True,
    streaming: bool = True,
    on_malformed: str = "keep",
    prefix: str = "",
    **options: str,
) -> TopicSource:
    """Kafka topics; needs Spark's Kafka package on the class path.

    ``schema`` is the schema of the message value: a ``StructType`` for JSON, an
    Avro schema (JSON text) for Avro, which needs Spark's Avro package too. The
    event time is the message timestamp. ``offset`` and ``partition`` identify a
    message and serve as ``order_by``. ``on_malformed`` and ``prefix`` are those of
    :func:`decode_messages`; the topic's name stays in ``topic``.

    A batch read (``streaming=False``) may be scanned several times and must give
    the same messages every time, so its end has to be fixed with one of Spark's
    ``ending...`` options.
    """

    def read(names: Sequence[str]) -> DataFrame:
        raw = _kafka(spark, servers, {"subscribe": ",".join(names)}, streaming, options)
        decoded = decode_messages(raw, schema, value_format, schema_id_header, on_malformed, prefix)
        # Topics are told apart by this column, unless it is the payload's.
        return decoded if "topic" in decoded.columns else decoded.withColumnRenamed(f"{prefix}topic", "topic")

    return read


def kafka_pattern(
    spark: SparkSession,
    servers: str,
    topic_regex: str,
    schema: T.StructType | str,
    value_format: str = "json",
    schema_id_header: bool = True,
    streaming: bool = True,
    on_malformed: str = "keep",
    prefix: str = "",
    **options: str,
) -> DataFrame:
    """All Kafka topics whose name matches ``topic_regex``, as one frame."""
    raw = _kafka(spark, servers, {"subscribePattern": topic_regex}, streaming, options)
    return decode_messages(raw, schema, value_format, schema_id_header, on_malformed, prefix)


def decode_messages(
    raw: DataFrame,
    schema: T.StructType | str,
    value_format: str = "json",
    schema_id_header: bool = True,
    on_malformed: str = "keep",
    prefix: str = "",
) -> DataFrame:
    """Message columns and decoded payload fields from raw Kafka rows.

    ``schema_id_header`` skips the five bytes (marker and schema id) that schema
    registry clients put before an Avro value.

    A value that cannot be read gives a row of nulls, which ``count`` counts, or an error
    with ``on_malformed="raise"``. ``prefix`` is put before the names of the message
    columns (timestamp, offset, partition, topic), so that a payload may have fields of
    these names.
    """
    if on_malformed not in ("keep", "raise"):
        raise ValueError(f"on_malformed must be 'keep' or 'raise', not {on_malformed!r}")
    mode = {"mode": "FAILFAST" if on_malformed == "raise" else "PERMISSIVE"}
    if value_format == "json":
        fields = schema.fieldNames()
        payload = F.from_json(F.col("value").cast("string"), schema, mode)
    elif value_format == "avro":
        from pyspark.sql.avro.functions import from_avro

        fields = schema_from_avro(schema).fieldNames()
        body = F.expr("substring(value, 6)") if schema_id_header else F.col("value")
        payload = from_avro(body, schema, mode)
    else:
        raise ValueError(f"value_format must be 'json' or 'avro', not {value_format!r}")
    names = [prefix + column for column in KAFKA_COLUMNS]
    clashes = sorted(set(fields) & set(names))
    if clashes:
        raise ValueError(f"The payload has fields named like message columns: {clashes}; set a prefix.")
    columns = [F.col(column).alias(name) for column, name in zip(KAFKA_COLUMNS, names)]
    return raw.select(*columns, payload.alias("payload")).select(*names, "payload.*")


def check_fixed_end(options: Mapping[str, str]) -> None:
    """Raise unless the options of a batch read say where it ends."""
    ends = {name.lower(): str(value) for name, value in options.items()}
    ends = {name: value for name, value in ends.items() if name.startswith("ending")}
    if not ends or "latest" in ends.values():
        raise ValueError("Fix the end of a batch read: endingTimestamp or endingOffsets.")


def _kafka(spark, servers, subscription, streaming, options) -> DataFrame:
    if not streaming:
        check_fixed_end(options)
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .options(**subscription, **options)
        .load()
    )
