"""The statistics, each described once and evaluated in two ways.

A *mergeable* statistic is a built-in aggregate: Spark combines it map-side, so
a window of any size costs one small buffer per task.

An *order* statistic needs the values at a few ranks of the sorted group. It
says which ranks it wants for a group of ``n`` values and how to combine the
values found there. Small groups read them from a sorted array; large groups
get them from :mod:`tidemark.operators.ranks` without ever being gathered.

Everything here is SQL text over the names or expressions handed in: a topic may
have hundreds of fields, and parsing text is much cheaper than building the same
expressions call by call from Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Mergeable:
    """Statistic given by one built-in aggregate function.

    ``rank`` tells where its value stands among the sorted values, if it does;
    where those are at hand anyway, it is read there.
    """

    function: str
    rank: Callable[[str], str] | None = None

    def aggregate(self, value: str) -> str:
        return f"{self.function}({value})"


@dataclass(frozen=True)
class OrderStatistic:
    """Statistic given by the values at two 1-based ranks."""

    ranks: Callable[[str], tuple[str, str]]
    combine: Callable[[str, Sequence[str]], str]


def _quartile(k: int) -> OrderStatistic:
    """k-th quartile, exclusive method: position k(n+1)/4 of the sorted values.

    The lower of the two neighbours is kept inside 1..n-1, so very small groups
    extrapolate; a single value has no quartile (NULL).
    """

    def lower(n: str) -> str:
        return f"greatest(least(({k} * ({n} + 1)) div 4, {n} - 1), 1L)"

    def ranks(n: str) -> tuple[str, str]:
        return lower(n), f"{lower(n)} + 1"

    def combine(n: str, values: Sequence[str]) -> str:
        weight = f"({k} * ({n} + 1) - 4 * {lower(n)})"
        return f"({values[0]} * (4 - {weight}) + {values[1]} * {weight}) / 4"

    return OrderStatistic(ranks, combine)


def _median() -> OrderStatistic:
    """Middle value, or the mean of the two middle values."""

    def ranks(n: str) -> tuple[str, str]:
        return f"({n} + 1) div 2", f"{n} + 1 - ({n} + 1) div 2"

    def combine(n: str, values: Sequence[str]) -> str:
        return f"({values[0]} + {values[1]}) / 2"

    return OrderStatistic(ranks, combine)


STATISTICS: dict[str, Mergeable | OrderStatistic] = {
    "min": Mergeable("min", rank=lambda n: "1"),
    "q1": _quartile(1),
    "mean": Mergeable("avg"),
    "median": _median(),
    "q3": _quartile(3),
    "stdev": Mergeable("stddev_samp"),
    "max": Mergeable("max", rank=lambda n: n),
}

OPERATIONS: tuple[str, ...] = tuple(STATISTICS)


def check_operations(operations: Iterable[str]) -> list[str]:
    """Return ``operations`` as a list, or raise ``ValueError`` on an unknown or repeated name."""
    if isinstance(operations, str):
        raise ValueError("operations must be a list of names.")
    names = list(operations)
    for name in names:
        if name not in STATISTICS:
            raise ValueError(
                f"Unknown operation {name!r}; known operations: {', '.join(STATISTICS)}"
            )
    if len(set(names)) != len(names):
        raise ValueError(f"Repeated operation in {names}")
    return names


def order_operations(operations: Iterable[str]) -> list[str]:
    """The operations that need ranks of the sorted group."""
    return [name for name in operations if isinstance(STATISTICS[name], OrderStatistic)]


def mergeable_operations(operations: Iterable[str]) -> list[str]:
    """The operations that are built-in aggregates."""
    return [name for name in operations if isinstance(STATISTICS[name], Mergeable)]
