"""Joined streams, open windows in the state store, and what is left out."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark import WindowAggregation, cogroup, join_messages
from tidemark.sinks.aggregated import FileSink
from tidemark.streaming.queries import start_cogroup, use_state_store
from tidemark.streaming.state import LeftOut, open_windows

from test_streaming import ONCE, config_of, run, topics  # noqa: F401

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(params=["memory", "rocksdb"])
def store(spark, request):
    before = spark.conf.get(PROVIDER)
    use_state_store(spark, request.param)
    yield request.param
    spark.conf.set(PROVIDER, before)


def joined(spark, topics, tmp_path, **options):
    left, right = (topics.source()([name]) for name in ("x", "y"))
    rows = join_messages(left, right, names=["x", "y"], **options)
    sink = FileSink(str(tmp_path / "out"))
    sink.start(rows, "j", str(tmp_path / "ckpt"), ONCE).awaitTermination()
    return sink.read(spark, "j")


def test_messages_without_partner_appear_when_none_can_come(spark, topics, tmp_path, store):  # noqa: F811
    topics("x", (0.1, 1.0, 10.0), (0.2, 2.0, 20.0), (0.3, None, 30.0), (1.5, 1.0, 40.0))
    topics("y", (0.4, 1.0, 100.0), (0.5, 1.0, 200.0), (0.6, 3.0, 300.0), (1.2, 9.0, 400.0))
    columns = ["time", "window_start", "x_value", "y_value"]
    first = joined(spark, topics, tmp_path, window_size_seconds=1)
    pairs = {(1.0, 0.0, 10.0, 100.0), (1.0, 0.0, 10.0, 200.0)}
    alone = {(2.0, 0.0, 20.0, None), (None, 0.0, 30.0, None), (3.0, 0.0, None, 300.0)}
    assert {tuple(r) for r in first.select(columns).collect()} == pairs | alone
    # The second window is still open: it gets a pair and, once both topics have gone on, the rest.
    topics("y", (1.6, 1.0, 500.0), (5.0, 0.0, 0.0))
    topics("x", (5.0, 7.0, 0.0))
    second = joined(spark, topics, tmp_path, window_size_seconds=1)
    later = {(1.0, 1.0, 40.0, 500.0), (9.0, 1.0, None, 400.0)}
    got = [tuple(r) for r in second.select(columns).collect()]
    assert set(got) == pairs | alone | later and len(got) == 7
    batch = join_messages(topics.batch(["x"]), topics.batch(["y"]), names=["x", "y"], window_size_seconds=1)
    closed = batch.where("window_start < 5").select(columns).collect()
    assert {tuple(r) for r in closed} == set(got) and len(closed) == 7


def test_messages_at_most_so_far_apart(spark, topics, tmp_path):  # noqa: F811
    topics("x", (1.0, 1.0, 10.0), (4.0, 1.0, 20.0), (50.0, 0.0, 0.0))
    topics("y", (3.0, 1.0, 100.0), (10.0, 1.0, 200.0), (50.0, 5.0, 0.0))
    options = {"names": ["x", "y"], "within_seconds": 2}
    got = joined(spark, topics, tmp_path, within_seconds=2).where("time = 1").collect()
    want = {(1.0, 1.0, 10.0, 3.0, 100.0), (1.0, 4.0, 20.0, 3.0, 100.0), (1.0, None, None, 10.0, 200.0)}
    assert {tuple(r) for r in got} == want and len(got) == 3
    batch = join_messages(topics.batch(["x"]), topics.batch(["y"]), **options).where("time = 1")
    assert {tuple(r) for r in batch.collect()} == want


@pytest.fixture
def sides(spark, tmp_path):
    """Append messages ``(at, key, value0)`` to x and y; streams and tables of them."""

    def send(kind, **topics):  # noqa: F811
        key = F.struct("n") if kind.startswith("struct") else F.col("n").cast(kind)
        for name, rows in topics.items():
            df = spark.createDataFrame(rows, "at double, n double, value0 double").coalesce(1)
            when = F.timestamp_micros((F.col("at") * 1e6).cast("bigint")).alias("timestamp")
            df.select(when, key.alias("time"), "value0").write.mode("append").parquet(str(tmp_path / "in" / name))

    send.tables = lambda: [spark.read.parquet(str(tmp_path / "in" / name)) for name in ("x", "y")]
    send.streams = lambda: [
        spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / name)) for name, table in zip("xy", send.tables())
    ]
    return send


def rows_of(df):
    return sorted(repr(tuple(row)) for row in df.collect())


@pytest.mark.parametrize("kind, held", [("double", 10), ("string", 10), ("struct<n:double>", 54)])
def test_join_state_holds_blocks_of_messages(sides, spark, tmp_path, monkeypatch, kind, held):
    monkeypatch.setattr("tidemark.operators.cogroup.BLOCK_ROWS", 10)
    x = [(0.01 * i, 1.0, float(i)) for i in range(25)] + [(0.5, 2.0, 1.0), (0.6, 2.0, None), (0.7, None, 3.0)]
    y = [(0.02 * i, 1.0, 100.0 + i) for i in range(19)] + [(0.8, 3.0, float(i)) for i in range(5)]
    sides(kind, x=[*x, (9.0, 1.0, 0.0)], y=[*y, (9.5, 7.0, 0.0)])
    options = {"names": ["x", "y"], "window_size_seconds": 1}
    sink = FileSink(str(tmp_path / "out"))
    query = sink.start(join_messages(*sides.streams(), **options), "j", str(tmp_path / "ckpt"), ONCE)
    query.awaitTermination()
    # x: 3 blocks of key 1, one of 2, one without key, one of the last window. y: 2 of 1, one of 3, one of the last.
    assert query.recentProgress[0].stateOperators[0].numRowsTotal == held
    got = sink.read(spark, "j")
    assert rows_of(got) == rows_of(join_messages(*sides.tables(), **options).where("window_start < 9"))
    assert got.count() == 25 * 19 + 2 + 1 + 5


def test_blocks_keep_unlike_messages_apart(sides, spark, tmp_path, monkeypatch):
    """Signs of zero, NaN, no key or value; blocks of several rounds, batches and runs; late messages."""
    monkeypatch.setattr("tidemark.operators.cogroup.BLOCK_ROWS", 3)
    monkeypatch.setattr("tidemark.operators.cogroup.HELD_BYTES", 300)
    options = {"names": ["x", "y"], "window_size_seconds": 2, "window_expiration_seconds": 10}
    sink, records, nan = FileSink(str(tmp_path / "out")), "spark.sql.execution.arrow.maxRecordsPerBatch", float("nan")

    def step(**topics):  # noqa: F811
        sides("double", **topics)
        rows = join_messages(*sides.streams(), **options)
        sink.start(rows, "j", str(tmp_path / "ckpt"), ONCE).awaitTermination()

    before = spark.conf.get(records)
    spark.conf.set(records, 4)
    try:
        x, y = (0.0, -0.0, nan, 1.0), (0.0, -0.0, nan)
        step(
            x=[(0.1 * i, x[i % 4], None if i % 5 == 0 else float(i)) for i in range(40)] + [(0.2, nan, nan)],
            y=[(0.1 * i, y[i % 3], 100.0 + i) for i in range(40)] + [(1.2, None, 5.0)],
        )
        step(x=[(3.0, 2.0, 7.0), (31.0, 6.0, 0.0)], y=[(3.1, 2.0, 8.0), (3.2, 1.0, 9.0), (30.0, 5.0, 0.0)])
        want = rows_of(join_messages(*sides.tables(), **options).where("window_start < 4"))
        step(x=[(1.0, 1.0, 1.0)], y=[(1.1, 1.0, 2.0)])
    finally:
        spark.conf.set(records, before)
    assert rows_of(sink.read(spark, "j")) == want


def test_join_needs_one_condition(topics):  # noqa: F811
    topics("x", (0.0, 1.0, 1.0))
    x = topics.batch(["x"])
    for options in ({}, {"window_size_seconds": 1, "within_seconds": 1}):
        with pytest.raises(ValueError, match="Either"):
            join_messages(x, x, names=["a", "b"], **options)


@pytest.mark.parametrize("operations", [("mean", "stdev"), ("median",)])
def test_open_windows_are_those_not_yet_written(spark, topics, tmp_path, store, operations):  # noqa: F811
    topics("x", *[(i / 10, 0.0, float(i % 3)) for i in range(95)])
    run(config_of("x", size=2, expiration=3, operations=operations), topics.source(), FileSink(str(tmp_path / "out")), tmp_path / "ckpt")
    held = open_windows(spark, str(tmp_path / "ckpt/agg")).orderBy("time").collect()
    # The watermark is 9.4 - 3: windows that end at 6 have closed.
    assert [tuple(r) for r in held] == [(7.0, 2.0, 20), (9.0, 2.0, 15)]
    written = FileSink(str(tmp_path / "out")).read(spark, "agg")
    assert sorted(r["time"] for r in written.collect()) == [1.0, 3.0, 5.0]


def test_open_windows_by_key(spark, topics, tmp_path):  # noqa: F811
    topics("x", *[(i / 10, float(i % 2), 1.0) for i in range(15)])
    from tidemark import summarize

    messages = topics.source()(["x"])
    out = summarize(messages, WindowAggregation(1, operations=("max",)), keys=["time"], fields=["value0"])
    # A key called like an output column stays apart in the state.
    out.toDF(*[f"c{i}" for i in range(len(out.columns))]).writeStream.outputMode("append").format("noop").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    held = open_windows(spark, str(tmp_path / "c"), ["parity"])
    assert sorted(tuple(r) for r in held.collect()) == [(0.0, 1.5, 1.0, 3), (1.0, 1.5, 1.0, 2)]


def test_late_and_timeless_messages_are_counted(spark, topics, tmp_path):  # noqa: F811
    counts = LeftOut()
    spark.streams.addListener(counts)
    try:
        out, config = FileSink(str(tmp_path / "out")), config_of("x", operations=("mean",))
        topics("x", (0.5, 0.0, 1.0), (None, 0.0, 5.0), (9.5, 0.0, 2.0))
        run(config, topics.source(), out, tmp_path / "ckpt")
        topics("x", (0.6, 0.0, 100.0), (None, 0.0, 5.0), (None, 0.0, 5.0), (9.6, 0.0, 3.0))
        run(config, topics.source(), out, tmp_path / "ckpt")
        deadline = time.time() + 20
        while time.time() < deadline and counts.counts("agg")["messages"] < 7:
            time.sleep(0.2)
        assert counts.counts("agg") == {"messages": 7, "timeless": 3, "late": 1}
    finally:
        spark.streams.removeListener(counts)
    assert [tuple(r)[:3] for r in out.read(spark, "agg").collect()] == [(0.5, 1.0, 1)]


def test_streamed_cogroups_keep_no_list(spark, topics, tmp_path, store):  # noqa: F811
    topics("x", *[(i / 100, float(i % 2), float(i)) for i in range(150)])
    topics("y", (0.5, 1.0, -1.0), (1.45, 3.0, -2.0))
    messages = topics.source()(["x", "y"])
    sink, window = FileSink(str(tmp_path / "out")), WindowAggregation(1)
    query = start_cogroup(messages, window, sink, "groups", str(tmp_path / "ckpt"), ONCE, part_rows=20)
    query.awaitTermination()
    got = sink.read(spark, "groups")
    want = cogroup(topics.batch(["x", "y"]), window_size_seconds=1, part_rows=20).where("window_start < 1")
    key = ["time", "window_start", "part"]
    assert got.orderBy(key).collect() == want.orderBy(key).collect() and got.count() == 6
    # One state row for each distinct message of the open window, none of them a list.
    state = spark.read.format("statestore").load(str(tmp_path / "ckpt/groups"))
    assert state.count() == 51 and "array" not in str(state.schema)
