"""Windowed summary statistics over record streams, as PySpark DataFrames."""

from tidemark.config import (
    AggregatedTopic,
    AggregationConfig,
    SourceTopic,
    WindowAggregation,
)
from tidemark.operators.cogroup import cogroup, join_messages, join_wide
from tidemark.operators.rollup import roll_up
from tidemark.operators.summarize import summarize
from tidemark.plans.aggregated import aggregate_all, aggregate_matching, aggregate_topic

__all__ = [
    "AggregatedTopic",
    "AggregationConfig",
    "SourceTopic",
    "WindowAggregation",
    "aggregate_all",
    "aggregate_matching",
    "aggregate_topic",
    "cogroup",
    "join_messages",
    "join_wide",
    "roll_up",
    "summarize",
]
