import pytest

from tidemark import AggregatedTopic, AggregationConfig, SourceTopic, WindowAggregation
from tidemark.plans.aggregated import aggregate_all, aggregate_matching, aggregate_topic
from tidemark.sources.topics import frames_source, tagged_source


@pytest.fixture
def frames(messages):
    return {
        "example0": messages([(0.0, 1.0, 5.0, 0.0), (0.5, 3.0, 7.0, 0.0)], "spam double, ham double, eggs double"),
        "example1": messages([(0.2, 10), (1.2, 20)], "level int"),
    }


def values(df, *columns):
    return sorted(tuple(row[c] for c in columns) for row in df.collect())


def test_projected_and_renamed(frames):
    topic = AggregatedTopic("agg", (SourceTopic("example0", ("ham", "spam"), {"spam": "foo"}),))
    out = aggregate_topic(topic, frames_source(frames))
    assert out.columns == ["time", "window_size", "count", "mean_ham", "mean_foo"]
    assert values(out, "time", "count", "mean_ham", "mean_foo") == [(0.5, 2, 6.0, 2.0)]


def test_several_topics_stay_apart(frames):
    topic = AggregatedTopic(
        "agg",
        (
            SourceTopic("example0", ("spam",), {"spam": "x"}),
            SourceTopic("example1", ("level",), {"level": "x"}),
        ),
        WindowAggregation(operations=("mean", "median")),
    )
    out = aggregate_topic(topic, frames_source(frames))
    assert out.columns[:4] == ["topic", "time", "window_size", "count"]
    assert values(out, "topic", "time", "mean_x") == [
        ("example0", 0.5, 2.0), ("example1", 0.5, 10.0), ("example1", 1.5, 20.0),
    ]


def test_same_projection_is_one_scan(spark, frames, tmp_path):
    path = str(tmp_path / "t")
    frames_source(frames)(["example0", "example1"]).write.parquet(path)
    same = ("spam", "ham")
    topic = AggregatedTopic("agg", (SourceTopic("example0", same), SourceTopic("example1", same)))
    out = aggregate_topic(topic, tagged_source(spark.read.parquet(path)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "eggs" not in plan and "PushedFilters: [In(topic" in plan


def test_all_entries_of_a_configuration(frames):
    def topic(name, size, source, *fields):
        return AggregatedTopic(
            name, (SourceTopic(source, fields),), WindowAggregation(window_size_seconds=size)
        )

    config = AggregationConfig(
        (topic("a", 1, "example0", "spam"), topic("b", 2, "example0", "ham"), topic("c", 1, "example1", "level"))
    )
    out = aggregate_all(config, frames_source(frames))
    assert list(out) == ["a", "b", "c"]
    assert values(out["a"], "time", "window_size", "mean_spam") == [(0.5, 1.0, 2.0)]
    assert values(out["b"], "time", "window_size", "mean_ham") == [(1.0, 2.0, 6.0)]
    assert values(out["c"], "time", "count", "mean_level") == [(0.5, 1, 10.0), (1.5, 1, 20.0)]


def test_unknown_topic_raises(frames):
    with pytest.raises(KeyError):
        aggregate_topic(AggregatedTopic("a", (SourceTopic("nope", ("x",)),)), frames_source(frames))


def test_matching_topics(messages):
    rows = [(0.1 * i, name, float(i)) for i in range(4) for name in ("lab.a", "lab.b", "hall", "lab.c")]
    df = messages(rows, "topic string, value double")
    out = aggregate_matching(
        df, WindowAggregation(), topic_regex=r"lab\..", excluded_topics=["lab.b"],
        name_format="agg.{source_topic_name}.1s",
    )
    assert out.columns == ["aggregated_topic", "topic", "time", "window_size", "count", "mean_value"]
    assert values(out, "aggregated_topic", "topic", "count", "mean_value") == [
        ("agg.lab.a.1s", "lab.a", 4, 1.5), ("agg.lab.c.1s", "lab.c", 4, 1.5),
    ]
    assert aggregate_matching(df, WindowAggregation()).count() == 4
