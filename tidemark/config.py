"""Declarative description of aggregated topics, validated on the driver.

The YAML layout (fixed names, so existing files keep working)::

    aggregated_topics:
    - name: tank_levels_hourly
      window_aggregation:
        window_size_seconds: 1
        window_expiration_seconds: 0
        min_sample_size: 2
        operations: [mean]
      filter:
        source_topics:
        - name: tank_levels
          fields: [depth, volume, inflow]
          map: {depth: depth_m}
        excluded_field_names: [volume]
    - filter:
        topic_regex: pump_.*
        excluded_topics: [pump_test]
      name_format: "{source_topic_name}-minutely"

An entry with ``topic_regex`` stands for all topics whose whole name matches; see
:meth:`AggregationConfig.resolve`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from tidemark.functions.stats import check_operations

DEFAULT_NAME_FORMAT = "{source_topic_name}-aggregated"


@dataclass(frozen=True)
class SourceTopic:
    """A source topic, the fields kept from it and their new names.

    ``fields=None`` keeps every field.
    """

    name: str
    fields: tuple[str, ...] | None = None
    map: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("A source topic needs a name.")
        object.__setattr__(self, "map", dict(self.map or {}))
        if self.fields is None:
            return
        object.__setattr__(self, "fields", tuple(self.fields))
        stray = sorted(set(self.map) - set(self.fields))
        if stray:
            raise ValueError(f"Topic {self.name!r} renames fields it does not keep: {stray}")
        _reject_duplicates(self.output_fields(self.fields), f"fields of topic {self.name!r}")

    def output_fields(self, available: Iterable[str]) -> list[str]:
        """Names after renaming, in input order."""
        return [self.map.get(name, name) for name in available]


@dataclass(frozen=True)
class WindowAggregation:
    """Tumbling window, its expiration and the statistics to compute in it."""

    window_size_seconds: int = 1
    window_expiration_seconds: int = 0
    min_sample_size: int = 2
    operations: tuple[str, ...] = ("mean",)

    def __post_init__(self) -> None:
        object.__setattr__(self, "operations", tuple(check_operations(self.operations)))
        if self.window_size_seconds < 1:
            raise ValueError("window_size_seconds must be at least 1.")
        if self.window_expiration_seconds < 0:
            raise ValueError("window_expiration_seconds cannot be negative.")
        if self.min_sample_size < 1:
            raise ValueError("min_sample_size must be at least 1.")


@dataclass(frozen=True)
class AggregatedTopic:
    """One aggregated topic: where its records come from and what is computed."""

    name: str
    source_topics: tuple[SourceTopic, ...]
    window_aggregation: WindowAggregation = field(default_factory=WindowAggregation)
    excluded_fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "source_topics", tuple(self.source_topics))
        object.__setattr__(self, "excluded_fields", tuple(self.excluded_fields))
        if not self.source_topics:
            raise ValueError(f"Aggregated topic {self.name!r} has no source topic.")
        _reject_duplicates(self.source_topic_names, f"source topics of {self.name!r}")

    @property
    def source_topic_names(self) -> list[str]:
        return [topic.name for topic in self.source_topics]

    def get(self, source_topic: str) -> SourceTopic:
        """Look a source topic up; ``KeyError`` if it is not declared."""
        return {topic.name: topic for topic in self.source_topics}[source_topic]


@dataclass(frozen=True)
class TopicPattern:
    """An aggregated topic for each topic whose whole name matches and is not excluded."""

    topic_regex: str = ".*"
    excluded_topics: tuple[str, ...] = ()
    excluded_fields: tuple[str, ...] = ()
    window_aggregation: WindowAggregation = field(default_factory=WindowAggregation)
    name_format: str = DEFAULT_NAME_FORMAT

    def __post_init__(self) -> None:
        re.compile(self.topic_regex)
        object.__setattr__(self, "excluded_topics", tuple(self.excluded_topics))
        object.__setattr__(self, "excluded_fields", tuple(self.excluded_fields))

    def resolve(self, available: Iterable[str]) -> list[AggregatedTopic]:
        return [
            AggregatedTopic(
                aggregated_name(name, self.name_format), (SourceTopic(name),), self.window_aggregation, self.excluded_fields
            )
            for name in sorted(set(available))
            if re.fullmatch(self.topic_regex, name) and name not in self.excluded_topics
        ]


@dataclass(frozen=True)
class AggregationConfig:
    """All aggregated topics of one deployment."""

    aggregated_topics: tuple[AggregatedTopic, ...]
    patterns: tuple[TopicPattern, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "aggregated_topics", tuple(self.aggregated_topics))
        object.__setattr__(self, "patterns", tuple(self.patterns))
        _reject_duplicates(self.aggregated_topic_names, "aggregated topics")

    @property
    def aggregated_topic_names(self) -> list[str]:
        return [topic.name for topic in self.aggregated_topics]

    def get(self, aggregated_topic: str) -> AggregatedTopic:
        """Look an aggregated topic up; ``KeyError`` if it is not declared."""
        return {topic.name: topic for topic in self.aggregated_topics}[aggregated_topic]

    @classmethod
    def from_mapping(
        cls, tree: Mapping[str, Any], name_format: str = DEFAULT_NAME_FORMAT
    ) -> AggregationConfig:
        """Build from parsed YAML or JSON.

        An entry without a name is called after its first source topic, using
        ``name_format``.
        """
        read = [_read_entry(entry, name_format) for entry in tree["aggregated_topics"]]
        return cls(
            tuple(entry for entry in read if isinstance(entry, AggregatedTopic)),
            tuple(entry for entry in read if isinstance(entry, TopicPattern)),
        )

    def resolve(self, available: Iterable[str]) -> AggregationConfig:
        """The same with an entry for each of the ``available`` topics that a pattern takes.

        A topic that several entries take belongs to each of them; their names must differ.
        """
        available = list(available)
        matched = [topic for pattern in self.patterns for topic in pattern.resolve(available)]
        return AggregationConfig((*self.aggregated_topics, *matched))

    @classmethod
    def from_yaml(
        cls, path: str | Path, name_format: str = DEFAULT_NAME_FORMAT
    ) -> AggregationConfig:
        import yaml

        return cls.from_mapping(yaml.safe_load(Path(path).read_text()), name_format)


def aggregated_name(source_topic: str, name_format: str = DEFAULT_NAME_FORMAT) -> str:
    """Default name of the topic aggregated from ``source_topic``."""
    return name_format.format(source_topic_name=source_topic)


def _read_entry(entry: Mapping[str, Any], name_format: str) -> AggregatedTopic | TopicPattern:
    chosen = entry["filter"]
    window = WindowAggregation(**(entry.get("window_aggregation") or {}))
    excluded = tuple(chosen.get("excluded_field_names") or ())
    if "topic_regex" in chosen:
        if chosen.get("source_topics") or entry.get("name"):
            raise ValueError("An entry has either topic_regex or source topics and a name.")
        return TopicPattern(
            chosen["topic_regex"], tuple(chosen.get("excluded_topics") or ()), excluded, window,
            entry.get("name_format", name_format),
        )
    gone = set(chosen.get("excluded_topics") or ())
    sources = tuple(SourceTopic(**source) for source in chosen["source_topics"] if source["name"] not in gone)
    if not sources:
        raise ValueError("An aggregated topic has no source topic.")
    name = entry.get("name") or aggregated_name(sources[0].name, entry.get("name_format", name_format))
    return AggregatedTopic(name, sources, window, excluded)


def _reject_duplicates(names: Iterable[str], what: str) -> None:
    names = list(names)
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"Repeated names among the {what}: {repeated}")
