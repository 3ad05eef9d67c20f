import pytest

from tidemark.config import (
    AggregatedTopic,
    AggregationConfig,
    SourceTopic,
    WindowAggregation,
    aggregated_name,
)

YAML = """
aggregated_topics:
- name: aggregated_example0
  window_aggregation:
    window_size_seconds: 1
    min_sample_size: 10
    operations:
    - mean
  filter:
    source_topics:
    - name: example0
      fields: [spam, ham, eggs]
      map:
        spam: foo
        ham: bar
- name: aggregated_example1
  filter:
    source_topics:
    - name: example0
      fields: [spam]
    - name: example1
      fields: [spam]
"""


@pytest.fixture
def config(tmp_path):
    path = tmp_path / "aggregator.yaml"
    path.write_text(YAML)
    return AggregationConfig.from_yaml(path)


def test_reads_yaml(config):
    topic = config.get("aggregated_example0")
    assert config.aggregated_topic_names == ["aggregated_example0", "aggregated_example1"]
    assert topic.window_aggregation == WindowAggregation(1, 0, 10, ("mean",))
    assert topic.get("example0").fields == ("spam", "ham", "eggs")
    assert topic.get("example0").map == {"spam": "foo", "ham": "bar"}


def test_defaults(config):
    assert config.get("aggregated_example1").window_aggregation == WindowAggregation(
        window_size_seconds=1,
        window_expiration_seconds=0,
        min_sample_size=2,
        operations=("mean",),
    )


def test_several_source_topics(config):
    assert config.get("aggregated_example1").source_topic_names == ["example0", "example1"]


def test_unknown_names_raise(config):
    with pytest.raises(KeyError):
        config.get("nothing")
    with pytest.raises(KeyError):
        config.get("aggregated_example0").get("nothing")


def test_default_name():
    assert aggregated_name("example0") == "example0-aggregated"
    entry = {"filter": {"source_topics": [{"name": "example0", "fields": ["a"]}]}}
    config = AggregationConfig.from_mapping(
        {"aggregated_topics": [entry]}, name_format="agg.{source_topic_name}"
    )
    assert config.aggregated_topic_names == ["agg.example0"]


def test_unknown_operation_raises():
    with pytest.raises(ValueError, match="maximum"):
        WindowAggregation(operations=("mean", "maximum"))


@pytest.mark.parametrize(
    "bad",
    [
        {"window_size_seconds": 0},
        {"window_expiration_seconds": -1},
        {"min_sample_size": 0},
        {"operations": ("mean", "mean")},
        {"operations": "mean"},
    ],
)
def test_bad_window_settings_raise(bad):
    with pytest.raises(ValueError):
        WindowAggregation(**bad)


def test_rename_of_a_dropped_field_raises():
    with pytest.raises(ValueError, match="eggs"):
        SourceTopic("example0", ("spam",), {"eggs": "foo"})


def test_colliding_renames_raise():
    with pytest.raises(ValueError, match="foo"):
        SourceTopic("example0", ("spam", "ham"), {"spam": "foo", "ham": "foo"})
    with pytest.raises(ValueError, match="ham"):
        SourceTopic("example0", ("spam", "ham"), {"spam": "ham"})


def test_repeated_topics_raise():
    with pytest.raises(ValueError):
        AggregatedTopic("a", (SourceTopic("x"), SourceTopic("x")))
    one = AggregatedTopic("a", (SourceTopic("x"),))
    with pytest.raises(ValueError):
        AggregationConfig((one, one))
    with pytest.raises(ValueError):
        AggregatedTopic("a", ())


def test_patterns_take_the_topics_there_are():
    config = AggregationConfig.from_mapping({"aggregated_topics": [
        {"filter": {"topic_regex": "pump_.*", "excluded_topics": ["pump_b"], "excluded_field_names": ["id"]},
         "window_aggregation": {"window_size_seconds": 60}, "name_format": "{source_topic_name}-minutely"},
        {"name": "tank", "filter": {"source_topics": [{"name": "tank", "fields": ["depth"]}]}},
    ]})
    resolved = config.resolve(["pump_a", "pump_b", "pump_c", "a_pump_x", "tank"])
    assert resolved.aggregated_topic_names == ["tank", "pump_a-minutely", "pump_c-minutely"]
    pump = resolved.get("pump_a-minutely")
    assert pump.excluded_fields == ("id",) and pump.window_aggregation.window_size_seconds == 60
    assert pump.source_topics[0].fields is None


def test_a_pattern_has_no_name_of_its_own():
    with pytest.raises(ValueError):
        AggregationConfig.from_mapping({"aggregated_topics": [{"name": "x", "filter": {"topic_regex": "a"}}]})
