"""Summary statistics per tumbling window: the same definition for batch and streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.config import WindowAggregation
from tidemark.functions.eventtime import (
    as_timestamp,
    epoch_seconds,
    event_time,
    has_zone,
    tumbling,
    watermarked,
)
from tidemark.functions.quoting import quoted, text
from tidemark.functions.stats import STATISTICS, mergeable_operations, order_operations
from tidemark.operators.matching import among, join_on
from tidemark.operators.project import numeric_fields
from tidemark.operators.ranks import values_at_ranks
from tidemark.storage import measured, written

# A group with more values than this (messages x fields) is never gathered in one
# task. A task holds up to 128 groups at a time before it falls back to sorting.
MAX_GROUP_VALUES = 100_000

_TIME, _WINDOW, _START, _COUNT = "__time", "__window", "__start", "__count"

# (position of the field, operation) -> SQL of the values at the operation's ranks
Picks = Callable[[int, str], Sequence[str]]


def summarize(
    df: DataFrame,
    window: WindowAggregation,
    *,
    time_column: str = "timestamp",
    keys: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    order_by: Sequence[str] = (),
    numeric: str = "all",
    on_error: str = "null",
    max_group_values: int | None = MAX_GROUP_VALUES,
) -> DataFrame:
    """One row per window and key: ``keys, time, window_size, count, {op}_{field}...``.

    A batch frame may be read several times and must give the same rows each time.

    Parameters
    ----------
    time_column
        Event time. On a stream it also drives the watermark, with the window
        expiration as the delay, unless the frame brings a watermark on it.
    keys
        Grouping columns besides the window.
    fields
        Fields to aggregate, in this order; the non-numeric ones are left out.
        By default all fields but the keys, the event time, ``order_by``,
        ``exclude`` and the reserved names.
    order_by
        Tie-break columns for the arrival order, such as ``partition, offset``.
        Used only where the first value of a window is needed.
    on_error
        ``null``, or ``raise`` to fail when a statistic is undefined for the
        values there are (the standard deviation of one value).
    max_group_values
        Batch only. Groups with more values (messages times fields) get their
        quartiles and median by distributed selection instead of a sorted array,
        with the same result. ``None`` promises that all groups fit in a task and
        saves the counting job.
    """
    rows, plan = _prepared(df, window, time_column, keys, fields, exclude, order_by, numeric, on_error)
    in_window = tumbling(F.col(_TIME), window.window_size_seconds)

    if df.isStreaming:
        rows = watermarked(rows, _TIME, window.window_expiration_seconds)
        sums = plan.gathered(rows, [in_window.alias(_WINDOW), *plan.group[1:]])
        sums = sums.withColumn(_START, F.col(_WINDOW)["start"])
        return plan.output(sums, plan.picks_from_array)

    rows = rows.withColumn(_START, in_window["start"])
    return _summarize_batch(rows, plan, max_group_values)


def _prepared(
    df, window, time_column, keys=(), fields=None, exclude=(), order_by=(), numeric="all", on_error="null"
) -> tuple[DataFrame, _Plan]:
    """The columns of ``df`` that a summary needs, under names of their own, and its expressions."""
    if on_error not in ("null", "raise"):
        raise ValueError(f"on_error must be 'null' or 'raise', not {on_error!r}")
    left_out = {*exclude, *keys, time_column}
    if fields is None:
        names = numeric_fields(df.schema, numeric, {*left_out, *order_by})
    else:
        unknown = [name for name in fields if name not in df.columns]
        if unknown:
            raise ValueError(f"No field {unknown}; there are {df.columns}")
        eligible = set(numeric_fields(df.schema, numeric, left_out))
        names = [name for name in fields if name in eligible]

    zoned = df.isStreaming or has_zone(df, time_column)
    plan = _Plan(tuple(names), window, tuple(keys), len(order_by), on_error == "raise", zoned)
    by = [f"{quoted(key)} AS __key_{i}" for i, key in enumerate(keys)]
    values = [f"CAST({quoted(name)} AS DOUBLE) AS __v_{i}" for i, name in enumerate(names)]
    order = [f"{quoted(column)} AS __order_{i}" for i, column in enumerate(order_by)]
    rows = df.select(
        (as_timestamp if df.isStreaming else event_time)(df, time_column).alias(_TIME),
        *[F.expr(column) for column in [*by, *order, *values]],
    )
    return rows, plan


@dataclass(frozen=True)
class _Plan:
    """Expressions of one summary. Keys and fields are addressed by position."""

    names: tuple[str, ...]
    window: WindowAggregation
    keys: tuple[str, ...]
    n_order: int
    strict: bool
    zoned: bool

    @property
    def group(self) -> list[str]:
        return [_START, *[f"__key_{i}" for i in range(len(self.keys))]]

    @property
    def order_ops(self) -> list[str]:
        return order_operations(self.window.operations)

    @property
    def mergeable_ops(self) -> list[str]:
        return mergeable_operations(self.window.operations)

    def summed(self, rows: DataFrame) -> DataFrame:
        """Mergeable aggregates of every group: number of values, first value, statistics."""
        if self._first_is_lowest or not self.n_order or rows.isStreaming:
            return self._aggregated(rows, self.group, self._sums())
        return self._with_first(rows)

    def _with_first(self, rows: DataFrame) -> DataFrame:
        """The same in two steps: Spark cannot aggregate by hash where the first value has tie-breaks.

        The hash aggregate finds the least event time of every field. Only the messages that have
        it, in groups that need their first value, are then looked at for their tie-breaks; a
        filter over group, field and time finds them, so no other message moves.
        """
        fields = range(len(self.names))
        least = [f"min(CASE WHEN __v_{i} IS NOT NULL THEN {_TIME} END) AS __least_{i}" for i in fields]
        sums = written(self._aggregated(rows, self.group, [*self._sums(first=False), *least]), "sums")
        wanted = ", ".join(f"struct({i} AS __field, __n_{i} AS n, __least_{i} AS {_TIME})" for i in fields)
        needy = sums.selectExpr(*self.group, f"inline(array({wanted}))").where(
            f"n BETWEEN 1 AND {self.window.min_sample_size - 1}"
        ).drop("n")
        at = [*self.group, "__field", _TIME]
        needy, found = measured(needy, "needy", n=F.count(F.lit(1)))
        if not found["n"]:
            return sums.select("*", *[F.lit(None).cast("double").alias(f"__first_{i}") for i in fields])
        ties = [f"__order_{k}" for k in range(self.n_order)]
        each = ", ".join(f"struct({i} AS __field, __v_{i} AS __value)" for i in fields)
        values = rows.selectExpr(*self.group, _TIME, *ties, f"inline(array({each}))").where("__value IS NOT NULL")
        firsts = join_on(values.where(among(needy, at, found["n"])), needy, at, "left_semi")
        # Fewer messages than the minimum sample, for each group and field.
        first = f"array_min(collect_list(struct({', '.join(ties)}, __value)))"
        firsts = firsts.groupBy(*self.group, "__field").agg(F.expr(first).alias("first"))
        picked = firsts.groupBy(*self.group).agg(
            *[F.max(F.when(F.col("__field") == i, F.col("first.__value"))).alias(f"__first_{i}") for i in fields]
        )
        return join_on(sums, picked, self.group, "left")

    def gathered(self, rows: DataFrame, group: Sequence) -> DataFrame:
        """The same with the sorted values of every group, from which most of it is read."""
        if not self.order_ops:
            return self._aggregated(rows, group, self._sums()) if rows.isStreaming else self.summed(rows)
        ranked = {
            op: STATISTICS[op].rank for op in self.mergeable_ops if STATISTICS[op].rank is not None
        }
        columns, read = [], ["*"]
        for i in range(len(self.names)):
            columns.append(f"sort_array(collect_list(__v_{i})) AS __sorted_{i}")
            columns += [
                f"{STATISTICS[op].aggregate(f'__v_{i}')} AS __{op}_{i}"
                for op in self.mergeable_ops
                if op not in ranked
            ]
            n = f"size(__sorted_{i})"
            read.append(f"CAST({n} AS BIGINT) AS __n_{i}")
            read += [f"{self._at(i, rank(n))} AS __{op}_{i}" for op, rank in ranked.items()]
            if self._first_is_lowest:
                read.append(f"{self._at(i, '1')} AS __first_{i}")
            else:
                columns.append(f"{self._first(i)} AS __first_{i}")
        return self._aggregated(rows, group, columns).selectExpr(*read)

    def _aggregated(self, rows: DataFrame, group: Sequence, columns: list[str]) -> DataFrame:
        everything = [f"count(1) AS {_COUNT}", *columns]
        return rows.groupBy(*group).agg(*[F.expr(column) for column in everything])

    def _sums(self, first: bool = True) -> list[str]:
        columns = []
        for i in range(len(self.names)):
            columns.append(f"count(__v_{i}) AS __n_{i}")
            if first:
                columns.append(f"{self._first(i)} AS __first_{i}")
            columns += [
                f"{STATISTICS[op].aggregate(f'__v_{i}')} AS __{op}_{i}" for op in self.mergeable_ops
            ]
        return columns

    @property
    def _first_is_lowest(self) -> bool:
        """With a minimum of 2, a group that needs its first value has a single one."""
        return self.window.min_sample_size <= 2

    def _first(self, i: int) -> str:
        """Value used by groups of fewer than ``min_sample_size`` values."""
        if self._first_is_lowest:
            return f"min(__v_{i})"
        ties = [f"__order_{k}" for k in range(self.n_order)]
        arrival = f"struct({', '.join([_TIME, *ties])})" if ties else _TIME
        return f"min_by(__v_{i}, CASE WHEN __v_{i} IS NOT NULL THEN {arrival} END)"

    def _at(self, i: int, rank: str) -> str:
        return f"get(__sorted_{i}, CAST({rank} - 1 AS INT))"

    def picks_from_array(self, i: int, op: str) -> list[str]:
        return [self._at(i, rank) for rank in STATISTICS[op].ranks(f"__n_{i}")]

    def output(self, sums: DataFrame, picks: Picks) -> DataFrame:
        """Final columns from the aggregates."""
        size = float(self.window.window_size_seconds)
        statistics = [
            f"{self._statistic(i, op, picks)} AS {quoted(f'{op}_{name}')}"
            for i, name in enumerate(self.names)
            for op in self.window.operations
        ]
        middle = epoch_seconds(F.col(_START), self.zoned) + F.lit(size / 2)
        return sums.withColumn(_START, middle).selectExpr(
            *[f"__key_{i} AS {quoted(key)}" for i, key in enumerate(self.keys)],
            f"{_START} AS time",
            f"DOUBLE({size}) AS window_size",
            f"{_COUNT} AS count",
            *statistics,
        )

    def _statistic(self, i: int, op: str, picks: Picks) -> str:
        value = f"__{op}_{i}"
        if op in self.order_ops:
            value = STATISTICS[op].combine(f"__n_{i}", picks(i, op))
        if self.strict:
            message = text(f"Cannot compute {op} of {self.names[i]} in a window.")
            value = f"coalesce({value}, raise_error({message}))"
        minimum = self.window.min_sample_size
        return f"CASE WHEN __n_{i} >= {minimum} THEN {value} ELSE __first_{i} END"


def _summarize_batch(rows: DataFrame, plan: _Plan, max_group_values: int | None) -> DataFrame:
    def gathered(part: DataFrame) -> DataFrame:
        return plan.output(plan.gathered(part, plan.group), plan.picks_from_array)

    if not plan.order_ops or not plan.names or max_group_values is None:
        return gathered(rows)
    max_group_rows = max(1, max_group_values // len(plan.names))

    sizes = rows.groupBy(*plan.group).agg(F.count(F.lit(1)).alias(_COUNT))
    everything = Observation()
    hot, found = measured(
        sizes.observe(everything, F.sum(_COUNT).alias("rows"))
        .where(F.col(_COUNT) > max_group_rows)
        .select(*plan.group, _COUNT),
        "hot",
        groups=F.count(F.lit(1)),
        rows=F.sum(_COUNT),
    )
    if not found["groups"]:
        return gathered(rows)
    n_values = found["rows"] * len(plan.names)
    if found["rows"] == everything.get["rows"]:
        return _summarize_hot(rows, plan, n_values)
    # Whole groups on either side; a few small ones may come with the large ones, and are right there too.
    is_hot = among(hot, plan.group, found["groups"])
    return gathered(rows.where(~is_hot)).unionByName(_summarize_hot(rows.where(is_hot), plan, n_values))


def _summarize_hot(rows: DataFrame, plan: _Plan, n_values: int) -> DataFrame:
    """Groups too large for one task: mergeable aggregates plus selected ranks."""
    fields = range(len(plan.names))
    each = ", ".join(f"struct({i} AS field, __v_{i} AS value)" for i in fields)
    values = rows.selectExpr(*plan.group, f"inline(array({each}))").where("value IS NOT NULL")
    slots = [(op, k) for op in plan.order_ops for k in (0, 1)]
    ranks = {f"{op}_{k}": lambda n, op=op, k=k: STATISTICS[op].ranks(n)[k] for op, k in slots}
    found = values_at_ranks(values, [*plan.group, "field"], ranks, n_values)
    picked = found.groupBy(*plan.group).agg(
        *[
            F.expr(f"max(value) FILTER (WHERE field = {i} AND slot = '{op}_{k}') AS __{op}_{k}_{i}")
            for i in fields
            for op, k in slots
        ]
    )
    return plan.output(
        join_on(plan.summed(rows), picked, plan.group, "left"),
        lambda i, op: [f"__{op}_{k}_{i}" for k in (0, 1)],
    )
