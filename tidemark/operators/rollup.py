"""Summaries of one stream over several window sizes, from one pass over its messages.

Windows are aligned to the epoch, so a window is made up of whole windows of any size
that divides its own. The messages are reduced once to a state for each of the smallest
windows: count, mean, centred second moment, minimum and maximum of every field. States of
larger windows are merged from these, with the same result as from the messages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import WindowAggregation
from tidemark.functions.eventtime import tumbling
from tidemark.functions.stats import order_operations
from tidemark.operators.summarize import _COUNT, _START, _TIME, _Plan, _prepared
from tidemark.storage import written


def can_roll_up(windows: Sequence[WindowAggregation]) -> bool:
    """Whether summaries over these windows can come from states of the smallest one.

    Their statistics must be mergeable, their first value the least one (a minimum sample
    of 2 at most), and the smallest window must divide the others.
    """
    least = min(w.window_size_seconds for w in windows)
    return all(
        w.min_sample_size <= 2 and not order_operations(w.operations) and w.window_size_seconds % least == 0
        for w in windows
    )


def window_states(rows: DataFrame, plan: _Plan, size_seconds: int) -> DataFrame:
    """A state for each window and key: ``__count`` and, for each field, a state of its values."""
    columns = [f"count(1) AS {_COUNT}"]
    for i in range(len(plan.names)):
        columns += [
            f"count(__v_{i}) AS __n_{i}", f"avg(__v_{i}) AS __mean_{i}",
            f"var_pop(__v_{i}) * count(__v_{i}) AS __moment_{i}",
            f"min(__v_{i}) AS __min_{i}", f"max(__v_{i}) AS __max_{i}",
        ]
    started = rows.withColumn(_START, tumbling(F.col(_TIME), size_seconds)["start"])
    return started.groupBy(*plan.group).agg(*[F.expr(c) for c in columns])


def merged(states: DataFrame, plan: _Plan) -> DataFrame:
    """States of the windows of ``plan`` as its aggregates.

    Second moments are merged about the common mean, so nothing cancels; for that a window
    holds the means of its parts, as many as it is larger than they are.
    """
    moved = "stdev" in plan.window.operations
    columns = [f"sum({_COUNT}) AS {_COUNT}"]
    for i in range(len(plan.names)):
        columns += [
            f"sum(__n_{i}) AS __n_{i}", f"sum(__mean_{i} * __n_{i}) / sum(__n_{i}) AS __mean_{i}",
            f"min(__min_{i}) AS __min_{i}", f"max(__max_{i}) AS __max_{i}",
        ]
        if moved:
            columns += [
                f"sum(__moment_{i}) AS __moment_{i}",
                f"collect_list(CASE WHEN __n_{i} > 0 THEN struct(__n_{i} AS n, __mean_{i} AS mean) END) AS __parts_{i}",
            ]
    grouped = states.withColumn(_START, tumbling(F.col(_START), plan.window.window_size_seconds)["start"])
    sums = grouped.groupBy(*plan.group).agg(*[F.expr(c) for c in columns])
    read = [*plan.group, _COUNT]
    for i in range(len(plan.names)):
        read += [f"__n_{i}", f"__mean_{i}", f"__min_{i}", f"__max_{i}", f"__min_{i} AS __first_{i}"]
        if moved:
            between = f"aggregate(__parts_{i}, 0D, (a, x) -> a + x.n * (x.mean - __mean_{i}) * (x.mean - __mean_{i}))"
            read.append(f"CASE WHEN __n_{i} > 1 THEN sqrt((__moment_{i} + {between}) / (__n_{i} - 1)) END AS __stdev_{i}")
    return sums.selectExpr(*read)


def roll_up(
    df: DataFrame, windows: Mapping[str, WindowAggregation], *, time_column: str = "timestamp", **options
) -> dict[str, DataFrame]:
    """The summary of ``df`` for each of ``windows``, like ``summarize`` with the same options.

    The messages are read once, when this is called, and shuffled as one state for each
    window of the smallest size, key and task. Raises if the windows do not go together
    (:func:`can_roll_up`).
    """
    if df.isStreaming or not can_roll_up(list(windows.values())):
        raise ValueError("These windows cannot be rolled up: see can_roll_up; streams have a query for each.")
    plans = {name: _prepared(df, window, time_column, **options) for name, window in windows.items()}
    least = min(w.window_size_seconds for w in windows.values())
    rows, plan = next(iter(plans.values()))
    states = written(window_states(rows, plan, least), "states")
    return {name: plan.output(merged(states, plan), lambda i, op: []) for name, (_, plan) in plans.items()}
