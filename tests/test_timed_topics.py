"""Topics of one streaming query, each by its own clock."""

import random
import time

import numpy as np
import pytest

from tidemark import WindowAggregation, summarize
from tidemark.sinks.aggregated import FileSink
from tidemark.streaming.queries import use_state_store
from tidemark.streaming.timed import _merged, _reduced, start_by_topic_clock, summarize_by_topic_clock

from test_streaming import ONCE, topics  # noqa: F401

MERGEABLE = ("min", "mean", "stdev", "max")


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_state_store(spark, "rocksdb")
    yield
    spark.conf.set(key, before)


def run(topics, tmp_path, names, window, trigger=ONCE, **options):  # noqa: F811
    sink = FileSink(str(tmp_path / "out"))
    query = start_by_topic_clock(
        topics.source()(names), window, sink, "t", str(tmp_path / "ckpt"), trigger, fields=["value0"], **options
    )
    return sink, query


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_lagging_topic_loses_nothing_and_a_silent_one_holds_nothing_back(spark, topics, tmp_path):  # noqa: F811
    window = WindowAggregation(2, 1, operations=MERGEABLE)
    topics("ahead", *[(float(i), 0.0, float(i)) for i in range(100, 120)])
    topics("silent", (3.0, 0.0, 1.0), (5.5, 0.0, 2.0), (6.5, 0.0, 3.0))
    topics("behind", (50.5, 0.0, 5.0), (None, 0.0, 1.0))
    sink, query = run(topics, tmp_path, ["ahead", "silent", "behind"], window)
    query.awaitTermination()
    # Far behind the others, in two more batches; the last message of each topic holds its window open.
    topics("behind", (51.0, 0.0, 7.0), (52.0, 0.0, 9.0), (54.9, 0.0, None))
    topics("ahead", (100.5, 0.0, -1.0), (121.0, 0.0, 1.0))  # the first of them is late by its own clock
    sink, query = run(topics, tmp_path, ["ahead", "silent", "behind"], window)
    query.awaitTermination()
    got = sink.read(spark, "t")
    assert got.columns[:4] == ["topic", "time", "window_size", "count"]
    assert rows_of(got.where("topic = 'behind'")) == [("behind", 51.0, 2.0, 2, 5.0, 6.0, pytest.approx(2**0.5), 7.0)]
    assert rows_of(got.where("topic = 'silent'").select("time", "count")) == [(3.0, 1)]
    ahead = got.where("topic = 'ahead'")
    assert sorted(r["time"] for r in ahead.collect()) == [float(t) for t in range(101, 121, 2)]
    assert ahead.agg({"min_value0": "min"}).first()[0] == 100.0
    # The state holds a clock for each topic and its open windows.
    held = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "ckpt/t"))
    assert sorted((r["key"]["topic"], r["user_map_key"]["start"] // 1_000_000) for r in held.collect()) == [
        ("ahead", 120), ("behind", 52), ("behind", 54), ("silent", 4), ("silent", 6)
    ]


def test_same_rows_as_batch(spark, topics, tmp_path):  # noqa: F811
    rng = random.Random(6)
    for part in range(3):
        for name in ("x", "y"):
            rows = [(part * 20 + rng.random() * 20, 0.0, rng.choice([None, 1e9 + rng.random()])) for _ in range(200)]
            topics(name, *rows)
    window = WindowAggregation(5, 20, operations=MERGEABLE)
    sink, query = run(topics, tmp_path, ["x", "y"], window)
    query.awaitTermination()
    got = {(r["topic"], r["time"]): r for r in sink.read(spark, "t").collect()}
    want = summarize(topics.batch(["x", "y"]), window, keys=["topic"], fields=["value0"]).where("time < 37").collect()
    assert len(want) >= 14 and {(r["topic"], r["time"]) for r in want} <= set(got)
    for r in want:
        assert list(got[r["topic"], r["time"]])[2:] == pytest.approx(list(r)[2:], rel=1e-9, abs=1e-7, nan_ok=True)


def test_an_idle_topic_closes(spark, topics, tmp_path):  # noqa: F811
    topics("x", (1.0, 0.0, 4.0), (1.5, 0.0, 6.0))
    window = WindowAggregation(2, operations=("mean",))
    sink, query = run(topics, tmp_path, ["x"], window, {"processingTime": "500 milliseconds"}, idle_seconds=1)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not query.exception():
            if sink.writers(spark, "t") and sink.read(spark, "t").count():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert rows_of(sink.read(spark, "t")) == [("x", 1.0, 2.0, 2, 5.0)]


def test_states_merge_like_one():
    rng = np.random.default_rng(1)
    v = 1e9 + rng.random((500, 2))
    v[rng.random((500, 2)) < 0.2] = np.nan
    starts = np.zeros(500, np.int64)
    whole = _reduced(starts, v)[0]
    a, b = _reduced(starts[:123], v[:123])[0], _reduced(starts[123:], v[123:])[0]
    assert _merged(a, b) == pytest.approx(whole, rel=1e-6)
    assert whole[3] == pytest.approx(np.nanvar(v[:, 0]) * np.isfinite(v[:, 0]).sum(), rel=1e-6)


def test_other_statistics_are_refused(topics):  # noqa: F811
    topics("x", (1.0, 0.0, 4.0))
    for window in (WindowAggregation(1, operations=("median",)), WindowAggregation(1, min_sample_size=3)):
        with pytest.raises(ValueError, match="merge"):
            summarize_by_topic_clock(topics.source()(["x"]), window)
