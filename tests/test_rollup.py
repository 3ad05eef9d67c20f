import random

import pytest

from tidemark import AggregatedTopic, AggregationConfig, SourceTopic, WindowAggregation, aggregate_all, summarize
from tidemark.operators import rollup
from tidemark.operators.rollup import can_roll_up, roll_up
from tidemark.sources.topics import frames_source

OPERATIONS = ("min", "mean", "stdev", "max")


def windows(*sizes, operations=OPERATIONS, **settings):
    return {str(n): WindowAggregation(window_size_seconds=n, operations=operations, **settings) for n in sizes}


def noisy(messages, n=3_000):
    rng = random.Random(4)
    # Large values that differ little: moments about zero would cancel.
    rows = [
        (rng.uniform(-500, 5_000), rng.choice(["a", "b", None]), 1e9 + rng.random() if rng.random() < 0.9 else None, None)
        for _ in range(n)
    ]
    return messages(rows, "key string, value double, nothing double")


def close(got, want):
    assert got.columns == want.columns
    order = ["key", "time"] if "key" in got.columns else ["time"]
    rows = list(zip(got.orderBy(*order).collect(), want.orderBy(*order).collect(), strict=True))
    assert rows
    for x, y in rows:
        assert x["count"] == y["count"]
        for a, b in zip(x, y):
            assert a == b if a is None or b is None or isinstance(a, str) else a == pytest.approx(b, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_rolled_up_like_summarized(messages, keys):
    df = noisy(messages)
    chosen = windows(10, 60, 3_600)
    for name, frame in roll_up(df, chosen, keys=keys, fields=["value", "nothing"]).items():
        close(frame, summarize(df, chosen[name], keys=keys, fields=["value", "nothing"]))


def test_minimum_of_one_and_undefined(messages):
    df = messages([(0.0, 1.0), (70.0, 2.0), (71.0, 3.0)], "value double")
    frames = roll_up(df, windows(1, 60, min_sample_size=1))
    assert [r["stdev_value"] for r in frames["1"].collect()] == [None] * 3
    assert sorted((r["time"], r["stdev_value"]) for r in frames["60"].collect()) == [(30.0, None), (90.0, pytest.approx(0.5**0.5))]


def test_what_goes_together():
    assert can_roll_up(list(windows(60, 3_600).values()))
    assert not can_roll_up(list(windows(60, 90).values()))
    assert not can_roll_up(list(windows(60, operations=("median",)).values()))
    assert not can_roll_up(list(windows(60, min_sample_size=3).values()))


def test_one_pass_over_the_messages(spark, messages, tmp_path, monkeypatch):
    noisy(messages).write.parquet(str(tmp_path / "t"))
    passes = []
    states = rollup.window_states
    monkeypatch.setattr(rollup, "window_states", lambda rows, *rest: passes.append(rows) or states(rows, *rest))
    entries = [
        AggregatedTopic(name, (SourceTopic("t", ("value",)),), window)
        for name, window in {**windows(60, 120, 3_600), "90": WindowAggregation(90, operations=("mean",)),
                             "q": WindowAggregation(60, operations=("median",))}.items()
    ]
    source = frames_source({"t": spark.read.parquet(str(tmp_path / "t"))})
    frames = aggregate_all(AggregationConfig(tuple(entries)), source)
    assert list(frames) == ["60", "120", "3600", "90", "q"]
    assert len(passes) == 1
    assert passes[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for name, frame in frames.items():
        reads_messages = str(tmp_path) in " ".join(frame.inputFiles())
        assert reads_messages == (name in ("90", "q"))
        alone = AggregationConfig((next(e for e in entries if e.name == name),))
        close(frame, aggregate_all(alone, source)[name])
