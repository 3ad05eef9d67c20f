import pytest

from tidemark.config import SourceTopic
from tidemark.operators.project import numeric_fields, project_topic
from tidemark.operators.topics import exclude_topics, keep_topics, match_topics, union_topics


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, 2, 3, 4)], "timestamp int, spam int, ham int, eggs int")


def test_keeps_and_renames(df):
    source = SourceTopic("t", ("eggs", "spam"), {"spam": "foo"})
    assert project_topic(df, source, ["timestamp"]).columns == ["timestamp", "eggs", "foo"]


def test_keeps_everything_by_default(df):
    out = project_topic(df, SourceTopic("t", map={"spam": "foo"}), ["timestamp"])
    assert out.columns == ["timestamp", "foo", "ham", "eggs"]


def test_swapped_names(df):
    out = project_topic(df, SourceTopic("t", ("spam", "ham"), {"spam": "ham", "ham": "spam"}))
    assert out.collect() == [(2, 3)] and out.columns == ["ham", "spam"]


@pytest.mark.parametrize(
    "source",
    [
        SourceTopic("t", ("spam", "nope")),
        SourceTopic("t", None, {"nope": "foo"}),
        SourceTopic("t", None, {"spam": "ham"}),
        SourceTopic("t", ("spam",), {"spam": "timestamp"}),
    ],
)
def test_wrong_fields_raise(df, source):
    with pytest.raises(ValueError):
        project_topic(df, source, ["timestamp"])


def test_carried_column_may_be_a_field_too(df):
    out = project_topic(df, SourceTopic("t", ("spam", "timestamp")), ["timestamp"])
    assert out.columns == ["spam", "timestamp"]
    out = project_topic(df, SourceTopic("t", ("timestamp",), {"timestamp": "t0"}), ["timestamp"])
    assert out.columns == ["timestamp", "t0"]


def test_numeric_fields(spark):
    schema = spark.createDataFrame(
        [],
        "time double, count long, window_size double, i int, l long, f float, d double,"
        "b binary, s string, flag boolean, m decimal(9,2), t timestamp",
    ).schema
    assert numeric_fields(schema) == ["i", "l", "f", "d", "m"]
    assert numeric_fields(schema, "strict") == ["l", "d"]
    assert numeric_fields(schema, exclude=["l", "m"]) == ["i", "f", "d"]


@pytest.fixture
def tagged(spark):
    names = ["lab.a", "lab.ab", "hall.a", "lab"]
    return spark.createDataFrame([(name, 1.0) for name in names], "topic string, v double")


def topics(df):
    return sorted(row["topic"] for row in df.select("topic").collect())


def test_topic_selection(tagged):
    assert topics(keep_topics(tagged, ["lab", "hall.a", "none"])) == ["hall.a", "lab"]
    assert topics(exclude_topics(tagged, ["lab"])) == ["hall.a", "lab.a", "lab.ab"]


def test_regex_matches_whole_names(tagged):
    assert topics(match_topics(tagged, "lab")) == ["lab"]
    assert topics(match_topics(tagged, r"lab\.a|hall.*")) == ["hall.a", "lab.a"]
    assert topics(match_topics(tagged, ".*")) == ["hall.a", "lab", "lab.a", "lab.ab"]


def test_topic_predicate_reaches_the_scan(tagged, tmp_path):
    tagged.write.parquet(str(tmp_path / "t"))
    stored = tagged.sparkSession.read.parquet(str(tmp_path / "t"))
    plan = keep_topics(stored, ["lab", "hall.a"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(topic" in plan


def test_union_fills_missing_fields(spark):
    a = spark.createDataFrame([(1.0,)], "x double")
    b = spark.createDataFrame([(2.0, 3)], "x double, y int")
    rows = union_topics({"a": a, "b": b}).select("topic", "x", "y").collect()
    assert sorted(map(tuple, rows)) == [("a", 1.0, None), ("b", 2.0, 3)]
    with pytest.raises(ValueError):
        union_topics({})
    with pytest.raises(ValueError, match="'x'"):
        union_topics({"a": a}, "x")
