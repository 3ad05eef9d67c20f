"""The schema store, the header of message values, and what a Kafka sink checks before it sends."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import WindowAggregation, summarize

from tidemark.sinks.aggregated import KafkaSink, SchemaMismatch, as_messages
from tidemark.sinks.schemas import SchemaStore, header_id, schema_id, with_header
from tidemark.sources import topics
from tidemark.sources.schema import avro_from_schema, schema_from_avro
from tidemark.sources.topics import decode_messages, kafka_pattern, kafka_source


@pytest.fixture
def store(tmp_path):
    return SchemaStore(str(tmp_path / "schemas"))


@pytest.fixture
def summary(messages):
    df = messages([(0.1, 1.0), (0.2, 2.0), (1.5, None)], "value double")
    return summarize(df, WindowAggregation(operations=("mean", "max")))


def schema_of(*names):
    return json.dumps({"type": "record", "name": "r", "fields": [{"name": n, "type": "double"} for n in names]})


def test_registration(spark, store):
    first = store.register(spark, "t-value", schema_of("a"))
    assert store.register(spark, "t-value", schema_of("a")) == first == schema_id(schema_of("a"))
    assert store.register(spark, "t-value", json.dumps(json.loads(schema_of("a")), indent=2)) == first
    assert 0 <= first < 2**31 and [v[:2] for v in store.versions(spark, "t-value")] == [(1, first)]
    assert store.register(spark, "other-value", schema_of("a")) == first
    with pytest.raises(SchemaMismatch, match="t-value has"):
        store.register(spark, "t-value", schema_of("a", "b"))
    second = store.register(spark, "t-value", schema_of("a", "b"), evolve=True)
    assert [v[:2] for v in store.versions(spark, "t-value")] == [(1, first), (2, second)]
    assert store.latest(spark, "t-value") == schema_of("a", "b") and store.by_id(spark, "t-value", first) == schema_of("a")
    for missing in (lambda: store.latest(spark, "none"), lambda: store.by_id(spark, "t-value", 5)):
        with pytest.raises(KeyError):
            missing()


def test_two_first_writers_find_out(spark, store, monkeypatch):
    """Both see an empty subject and write."""
    versions, seen = SchemaStore.versions, []

    def late(self, spark, subject):
        seen.append(subject)
        return [] if len(seen) == 1 else versions(self, spark, subject)

    store.register(spark, "t-value", schema_of("a"))
    monkeypatch.setattr(SchemaStore, "versions", late)
    with pytest.raises(SchemaMismatch, match="same time"):
        store.register(spark, "t-value", schema_of("b"))


def test_header(spark):
    df = spark.createDataFrame([(b"body",), (b"",)], "body binary")
    for number in (0, 1, 258, 2**31 - 1):
        rows = df.select(with_header(F.col("body"), number).alias("value")).select("value", header_id(F.col("value"))).collect()
        assert [(bytes(r[0]), r[1]) for r in rows] == [(b"\0" + number.to_bytes(4, "big") + b, number) for b in (b"body", b"")]
    bare = spark.createDataFrame([(b"{}",), (b"{12345",), (None,)], "value binary")
    assert [r[0] for r in bare.select(header_id(F.col("value"))).collect()] == [None] * 3


def test_avro_schema_of_a_summary(summary):
    text = avro_from_schema(summary.schema, "x-aggregated")
    assert json.loads(text)["name"] == "x_aggregated"
    back = schema_from_avro(text)
    assert [(f.name, f.dataType) for f in back] == [(f.name, f.dataType) for f in summary.schema]
    assert [f.nullable for f in back] == [f.nullable for f in summary.schema]
    for bad in (T.StructType().add("a", T.ArrayType(T.IntegerType())), T.StructType().add("a-b", "integer")):
        with pytest.raises(ValueError, match="no place"):
            avro_from_schema(bad, "t")


def test_sink_settles_the_schema_before_it_sends(spark, store, summary):
    sink = KafkaSink("nowhere:9092", schemas=store)
    assert json.loads(sink.messages(summary, "t").first()["value"])["count"] in (1, 2)
    assert schema_from_avro(store.latest(spark, "t-value")).names == summary.columns
    changed = summary.drop("max_value")
    for send in (lambda: sink.write(changed, "t"), lambda: sink.start(changed, "t", "nowhere", {})):
        with pytest.raises(SchemaMismatch):
            send()
    KafkaSink("nowhere:9092", topic_column="topic", schemas=store).messages(summary.withColumn("topic", F.lit("x")), "t")
    with pytest.raises(ValueError, match="store"):
        KafkaSink("nowhere:9092", value_format="avro")
    with pytest.raises(ValueError, match="xml"):
        KafkaSink("nowhere:9092", value_format="xml")


def test_avro_values_as_kafka_holds_them(spark, store, summary, monkeypatch):
    """With a stand-in for the codec, which is not installed here: header, schema and body."""
    from pyspark.sql.avro import functions as codec

    given = []
    monkeypatch.setattr(codec, "to_avro", lambda row, schema: given.append(schema) or F.to_json(row).cast("binary"))
    monkeypatch.setattr(codec, "from_avro", lambda body, schema, options: F.from_json(body.cast("string"), schema_from_avro(schema)))
    sent = KafkaSink("nowhere:9092", value_format="avro", schemas=store).messages(summary, "t")
    schema = store.latest(spark, "t-value")
    assert given == [schema]
    raw = sent.select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(1).alias("offset"),
        F.timestamp_seconds(F.lit(5)).alias("timestamp"), "value",
    )
    assert {r[0] for r in raw.select(header_id(F.col("value"))).collect()} == {schema_id(schema)}
    back = decode_messages(raw, schema, "avro").select(*summary.columns)
    assert sorted(back.collect()) == sorted(summary.collect())


def test_encoded_values_go_with_their_topic(summary):
    rows = as_messages(summary.withColumn("to", F.lit("a")), "to", lambda row: F.to_csv(row)).collect()
    assert {r["topic"] for r in rows} == {"a"} and sorted(r["value"] for r in rows)[0].startswith("0.5,1.0,2")


def test_kafka_sources_pass_their_options_on(spark, monkeypatch):
    raw = spark.createDataFrame(
        [("t", 0, 7, b'{"offset": 2.5, "x": 1.0}'), ("t", 0, 8, b"broken")], "topic string, partition int, offset long, value binary"
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(9)))
    monkeypatch.setattr(topics, "_kafka", lambda *a: raw)
    schema = T.StructType().add("offset", "double").add("x", "double")
    rows = kafka_source(spark, "nowhere", schema, prefix="message_")(["t"]).orderBy("message_offset").collect()
    assert [(r["topic"], r["message_offset"], r["offset"]) for r in rows] == [("t", 7, 2.5), ("t", 8, None)]
    assert "message_topic" in kafka_pattern(spark, "nowhere", ".*", schema, prefix="message_").columns
    for read in (lambda **o: kafka_source(spark, "nowhere", schema, **o)(["t"]), lambda **o: kafka_pattern(spark, "nowhere", ".*", schema, **o)):
        with pytest.raises(Exception, match="MALFORMED"):
            read(prefix="m_", on_malformed="raise").collect()
