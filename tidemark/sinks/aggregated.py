"""Writing an aggregated topic, after its schema has been settled with the sink.

Every sink writes a frame (``write``), starts a stream (``start``) or takes one
micro-batch of a stream (``write_batch``). A micro-batch that is repeated replaces what it
wrote before. Tables are partitioned by who wrote (``_writer``) and by micro-batch
(``_batch``); files lie in folders that a manifest names (:mod:`tidemark.sinks.manifest`).
Read with ``read``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.quoting import quoted, text
from tidemark.sinks import manifest
from tidemark.sinks.schemas import SchemaMismatch, SchemaStore, with_header
from tidemark.sources.schema import avro_from_schema
from tidemark.storage import delete, exists, names_in


# Partition columns of files and tables.
WRITER, BATCH = "_writer", "_batch"


class _Batches:
    """Streams into ``write_batch``; the writer is known by its checkpoint."""

    def start(
        self, df: DataFrame, name: str, checkpoint: str, trigger: dict, label: str | None = None
    ) -> StreamingQuery:
        self._register(df, name)
        writer = writer_id(checkpoint)

        def emit(batch: DataFrame, batch_id: int) -> None:
            self.write_batch(batch, name, batch_id, writer)

        return _start(df.writeStream.foreachBatch(emit), label or name, checkpoint, trigger).start()

    def write(self, df: DataFrame, name: str) -> None:
        """Add the rows of ``df``."""
        self.write_batch(df, name, 0, uuid.uuid4().hex)


def writer_id(checkpoint: str) -> str:
    """The name under which a stream writes, the same after a restart."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


# Sinks of this process whose schema has been settled: a stream need not look it up for every batch.
_settled: set[tuple[str, str]] = set()


@dataclass(frozen=True)
class FileSink(_Batches):
    """Files below ``<root>/<aggregated topic>``; schemas are kept in ``<root>/_schemas``.

    ``<aggregated topic>/_commits/<writer>`` holds the manifest of each writer. Empty
    micro-batches leave nothing behind.
    """

    root: str
    file_format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def write_batch(self, df: DataFrame, name: str, batch_id: int, writer: str = "batches") -> None:
        """Commit the rows of one micro-batch, in place of what an earlier attempt at it wrote."""
        self._register(df, name)
        spark = df.sparkSession
        commits = self._commits(name, writer)
        if manifest.is_merged(manifest.latest(spark, commits), batch_id):
            return
        folder = f"{self.root}/{name}/{writer}/{batch_id}-{uuid.uuid4().hex}"
        rows = Observation()
        self._save(df.observe(rows, F.count(F.lit(1)).alias("n")), folder)
        if not rows.get["n"]:
            delete(spark, folder)
            return
        manifest.add(spark, commits, manifest.Folder(folder, batch_id, batch_id))
        fields = self._schema(spark, name)
        manifest.compact(
            spark, commits, f"{self.root}/{name}/{writer}", lambda paths: self._load(spark, fields, paths), self._save
        )

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """All committed rows of an aggregated topic, whoever wrote them."""
        fields = self._schema(spark, name)
        folders = [folder.path for writer in self.writers(spark, name) for folder in self.folders(spark, name, writer)]
        return self._load(spark, fields, folders) if folders else spark.createDataFrame([], fields)

    def writers(self, spark: SparkSession, name: str) -> list[str]:
        return names_in(spark, self._commits(name))

    def folders(self, spark: SparkSession, name: str, writer: str) -> list[manifest.Folder]:
        """The folders that are read."""
        return list(manifest.latest(spark, self._commits(name, writer)).folders)

    def _commits(self, name: str, writer: str = "") -> str:
        return f"{self.root}/{name}/_commits" + (f"/{writer}" if writer else "")

    def _schema(self, spark: SparkSession, name: str) -> T.StructType:
        return _file_schemas(spark, f"{self.root}/_schemas/{name}")[0]

    def _load(self, spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).format(self.file_format).options(**self.options).load(paths)

    def _save(self, df: DataFrame, path: str) -> None:
        df.write.format(self.file_format).options(**self.options).save(path)

    def _register(self, df: DataFrame, name: str) -> None:
        settled = f"{self.root}/{name}", str(_shape(df.schema))
        if settled in _settled:
            return
        spark = df.sparkSession
        if exists(spark, f"{self.root}/{name}/_spark_metadata"):
            raise ValueError(
                f"{self.root}/{name} has the log of a file stream, which hides files written otherwise."
            )
        register_file_schema(spark, f"{self.root}/_schemas/{name}", df.schema, name)
        _settled.add(settled)


@dataclass(frozen=True)
class TableSink(_Batches):
    """Catalog tables named after the aggregated topic, created when absent."""

    database: str = "default"
    file_format: str = "parquet"

    def table(self, name: str) -> str:
        return f"{quoted(self.database)}.{quoted(name)}"

    def write_batch(self, df: DataFrame, name: str, batch_id: int, writer: str = "batches") -> None:
        """Replace what an earlier attempt at this micro-batch wrote, if anything."""
        self._register(df, name)
        into = f"{self.table(name)} PARTITION ({WRITER} = {text(writer)}, {BATCH} = {batch_id})"
        columns = ", ".join(map(quoted, df.columns))
        df.sparkSession.sql(f"INSERT OVERWRITE {into} SELECT {columns} FROM {{rows}}", rows=df)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of an aggregated topic, whoever wrote them."""
        return spark.table(self.table(name)).drop(WRITER, BATCH)

    def _register(self, df: DataFrame, name: str) -> None:
        parts = {WRITER: "string", BATCH: "bigint"}
        register_schema(df.sparkSession, self.table(name), df.schema, self.file_format, parts)


@dataclass(frozen=True)
class KafkaSink:
    """Kafka topics named after the aggregated topic; needs Spark's Kafka package.

    With ``topic_column`` every row goes to the topic named there instead. ``value_format`` is
    ``json`` or ``avro``; Avro needs Spark's Avro package and ``schemas``, whose ids stand in the
    header of each value. Where ``schemas`` is given, the schema of the rows is registered as
    ``<aggregated topic>-value`` before anything is sent, and another one is refused.
    """

    servers: str
    topic_column: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    value_format: str = "json"
    schemas: SchemaStore | None = None

    def __post_init__(self) -> None:
        if self.value_format not in ("json", "avro"):
            raise ValueError(f"value_format must be 'json' or 'avro', not {self.value_format!r}")
        if self.value_format == "avro" and self.schemas is None:
            raise ValueError("Avro values need a schema store.")

    def _settings(self, name: str) -> dict[str, str]:
        target = {} if self.topic_column else {"topic": name}
        return {"kafka.bootstrap.servers": self.servers, **target, **self.options}

    def messages(self, df: DataFrame, name: str) -> DataFrame:
        """What is sent for ``df``, its schema settled."""
        if self.schemas is None:
            return as_messages(df, self.topic_column)
        fields = T.StructType([f for f in df.schema.fields if f.name != self.topic_column])
        schema = avro_from_schema(fields, name)
        number = self.schemas.register(df.sparkSession, f"{name}-value", schema)
        if self.value_format == "json":
            return as_messages(df, self.topic_column)
        from pyspark.sql.avro.functions import to_avro

        return as_messages(df, self.topic_column, lambda row: with_header(to_avro(row, schema), number))

    def write(self, df: DataFrame, name: str) -> None:
        self.messages(df, name).write.format("kafka").options(**self._settings(name)).save()

    def write_batch(self, df: DataFrame, name: str, batch_id: int, writer: str = "batches") -> None:
        """Send; a repeated micro-batch is sent again."""
        self.write(df, name)

    def start(
        self, df: DataFrame, name: str, checkpoint: str, trigger: dict, label: str | None = None
    ) -> StreamingQuery:
        messages = self.messages(df, name)
        writer = messages.writeStream.format("kafka").options(**self._settings(name))
        return _start(writer, label or name, checkpoint, trigger).start()


def as_messages(
    df: DataFrame, topic_column: str | None = None, encode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Rows in a ``value`` column, and their ``topic`` if it is a column.

    ``encode`` turns a struct of the other columns into the value: JSON by default, nulls included.
    """
    row = F.struct(*[quoted(name) for name in df.columns if name != topic_column])
    value = encode(row) if encode else F.to_json(row, {"ignoreNullFields": "false"})
    topic = [F.col(quoted(topic_column)).alias("topic")] if topic_column else []
    return df.select(*topic, value.alias("value"))


def register_schema(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    file_format: str = "parquet",
    partitions: dict[str, str] | None = None,
) -> bool:
    """Create ``table`` with ``schema`` unless it is there; True if it was created.

    An existing table must have the same column names and types in the same
    order, else :class:`SchemaMismatch` is raised. ``partitions`` are columns of the
    table alone.
    """
    partitions = partitions or {}
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        columns += "".join(f", {quoted(name)} {kind}" for name, kind in partitions.items())
        by = f" PARTITIONED BY ({', '.join(map(quoted, partitions))})" if partitions else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING {file_format}{by}")
        return True
    present = [f for f in spark.table(table).schema.fields if f.name not in partitions]
    _require_same(table, T.StructType(present), schema)
    return False


def register_file_schema(spark: SparkSession, path: str, schema: T.StructType, name: str) -> bool:
    """The same for a folder of files, whose schema is kept as a line of JSON below ``path``.

    Every first writer has a folder of its own there. The line is added and then compared with all lines there are, so two first
    writers at once find out about one another.
    """
    known = _file_schemas(spark, path)
    if not known:
        line = spark.createDataFrame([(schema.json(),)], "value string")
        line.coalesce(1).write.text(f"{path}/{uuid.uuid4().hex}")
    for present in known or _file_schemas(spark, path):
        _require_same(name, present, schema)
    return not known


def _file_schemas(spark: SparkSession, path: str) -> list[T.StructType]:
    if not exists(spark, path):
        return []
    lines = spark.read.option("recursiveFileLookup", "true").text(path).distinct().collect()
    return [T.StructType.fromJson(json.loads(line["value"])) for line in lines]


def _require_same(name: str, present: T.StructType, schema: T.StructType) -> None:
    if _shape(present) != _shape(schema):
        raise SchemaMismatch(
            f"{name} has {present.simpleString()}, the aggregated topic has {schema.simpleString()}"
        )


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(field.name, field.dataType.simpleString()) for field in schema.fields]


def _start(writer, name: str, checkpoint: str, trigger: dict):
    writer = writer.outputMode("append").queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger) if trigger else writer
