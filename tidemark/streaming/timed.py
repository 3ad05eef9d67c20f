"""Summaries of many topics in one streaming query, each topic by its own clock.

Spark's watermark belongs to a query: topics read together share one, and a topic that
lags loses messages to it. Here the clock of a topic is the latest event time it has
shown. A window closes when its own topic's clock has passed it by the expiration, so a
topic that lags loses nothing and a silent one holds back only its own rows. With
``idle_seconds`` the open windows of a topic that has been silent for so long close too.

The state of a topic is its clock and a state of fixed size for each open window; messages
are reduced to such states batch by batch, in NumPy, before they touch it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.config import WindowAggregation
from tidemark.operators.rollup import can_roll_up
from tidemark.operators.summarize import _COUNT, _START, _prepared

if TYPE_CHECKING:
    import pandas as pd

# Executors get this module with the query; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MICROS = 1_000_000


def _columns(n_fields: int) -> list[str]:
    kinds = {"n": "bigint", "mean": "double", "moment": "double", "low": "double", "high": "double"}
    return ["count bigint", *[f"{name}_{i} {kind}" for i in range(n_fields) for name, kind in kinds.items()]]


def _reduced(starts: np.ndarray, values: np.ndarray) -> dict[int, tuple]:
    """A state for each window start: count and, per field, number, mean, centred moment, least, greatest."""
    distinct, which = np.unique(starts, return_inverse=True)
    size = len(distinct)
    columns = [np.bincount(which, minlength=size)]
    for i in range(values.shape[1]):
        there = ~np.isnan(values[:, i])
        group, v = which[there], values[there, i]
        n = np.bincount(group, minlength=size)
        mean = np.bincount(group, v, size) / np.maximum(n, 1)
        moment = np.bincount(group, (v - mean[group]) ** 2, size)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(low, group, v)
        np.maximum.at(high, group, v)
        columns += [n, mean, moment, low, high]
    return dict(zip(distinct.tolist(), zip(*(c.tolist() for c in columns))))


def _merged(a: tuple, b: tuple) -> tuple:
    """The state of both; second moments are merged about the common mean."""
    out = [a[0] + b[0]]
    for i in range(1, len(a), 5):
        (n, mean, moment, low, high), (n2, mean2, moment2, low2, high2) = a[i : i + 5], b[i : i + 5]
        both = n + n2
        apart = mean2 - mean
        out += [
            both, mean + apart * n2 / both if both else 0.0,
            moment + moment2 + apart * apart * n * n2 / both if both else 0.0, min(low, low2), max(high, high2),
        ]
    return tuple(out)


class _TopicWindows(StatefulProcessor):
    """The open windows of one topic."""

    def __init__(self, size: int, expiration: int, n_fields: int, idle: int | None):
        self.size, self.expiration, self.n_fields = size * _MICROS, expiration * _MICROS, n_fields
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "micros bigint")
        self.open = handle.getMapState("open", "start bigint", ", ".join(_columns(self.n_fields)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else None
        states: dict[int, tuple] = {}
        latest = clock
        for frame in rows:
            at = frame["at"].to_numpy(np.int64)
            start = at - at % self.size
            if clock is not None:  # windows that closed in an earlier batch take nothing any more
                timely = start + self.size + self.expiration > clock
                at, start, frame = at[timely], start[timely], frame[timely]
            if not len(at):
                continue
            latest = max(int(at.max()), latest if latest is not None else int(at.max()))
            values = frame[[f"v{i}" for i in range(self.n_fields)]].to_numpy(float)
            for window, state in _reduced(start, values).items():
                states[window] = _merged(states[window], state) if window in states else state
        if latest is None:
            return
        self.clock.update((latest,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle)
        yield from self._closed(key, latest, states)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Silent for so long: as if the topic's clock had passed all its windows."""
        ends = [start + self.size for (start,) in self.open.keys()]
        if ends:
            clock = max(ends) + self.expiration
            self.clock.update((clock,))
            yield from self._closed(key, clock, {})

    def _closed(self, key, clock: int, fresh: dict[int, tuple]) -> Iterator[pd.DataFrame]:
        """Add the states of a batch to those held, and give up what has closed."""
        import pandas as pd

        held = {start: state for (start,), state in self.open.iterator()}
        out = []
        for start in sorted({*held, *fresh}):
            state = fresh.get(start, held.get(start))
            if start in held and start in fresh:
                state = _merged(held[start], fresh[start])
            if start + self.size + self.expiration <= clock:
                out.append((*key, start, *state))
                if start in held:
                    self.open.removeKey((start,))
            elif start in fresh:
                self.open.updateValue((start,), state)
        if out:
            names = [c.split()[0] for c in _columns(self.n_fields)]
            yield pd.DataFrame(out, columns=["topic", "start", *names])

    def close(self) -> None:
        pass


def summarize_by_topic_clock(
    messages: DataFrame,
    window: WindowAggregation,
    *,
    time_column: str = "timestamp",
    topic_column: str = "topic",
    fields: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    idle_seconds: int | None = None,
) -> DataFrame:
    """Summary rows of a stream of many topics: ``topic, time, window_size, count, {op}_{field}...``.

    For statistics that merge and a minimum sample of 2 at most; NaN counts as a missing value.
    Needs RocksDB state (``use_state_store``). All messages of a topic in a micro-batch pass through one task, a batch
    of rows at a time. Messages without event time or topic belong to no window.
    """
    if not messages.isStreaming or not can_roll_up([window]):
        raise ValueError("For streams, statistics that merge and a minimum sample of 2 at most.")
    rows, plan = _prepared(
        messages, window, time_column, [topic_column], fields, exclude
    )
    n = len(plan.names)
    input_rows = rows.select(
        F.col("__key_0").cast("string").alias("topic"), F.unix_micros("__time").alias("at"),
        *[F.col(f"__v_{i}").alias(f"v{i}") for i in range(n)],
    ).where("at is not null and topic is not null")
    states = input_rows.groupBy("topic").transformWithStateInPandas(
        _TopicWindows(window.window_size_seconds, window.window_expiration_seconds, n, idle_seconds),
        outputStructType=f"topic string, start bigint, {', '.join(_columns(n))}",
        outputMode="Append",
        timeMode="None" if idle_seconds is None else "ProcessingTime",
    )
    read = ["topic AS __key_0", f"timestamp_micros(start) AS {_START}", f"count AS {_COUNT}"]
    for i in range(n):
        some = f"n_{i} > 0"
        read += [
            f"n_{i} AS __n_{i}", f"CASE WHEN {some} THEN mean_{i} END AS __mean_{i}",
            f"CASE WHEN {some} THEN low_{i} END AS __min_{i}", f"CASE WHEN {some} THEN high_{i} END AS __max_{i}",
            f"CASE WHEN {some} THEN low_{i} END AS __first_{i}",
            f"CASE WHEN n_{i} > 1 THEN sqrt(moment_{i} / (n_{i} - 1)) END AS __stdev_{i}",
        ]
    return plan.output(states.selectExpr(*read), lambda i, op: [])


def start_by_topic_clock(
    messages: DataFrame,
    window: WindowAggregation,
    sink,
    name: str,
    checkpoint_root: str,
    trigger: Mapping | None = None,
    **options,
) -> StreamingQuery:
    """One query for all topics of ``messages``; ``options`` are those of :func:`summarize_by_topic_clock`."""
    out = summarize_by_topic_clock(messages, window, **options)
    return sink.start(out, name, f"{checkpoint_root}/{name}", dict(trigger or {}))
