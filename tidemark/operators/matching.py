"""Null-safe equi-joins on grouping columns, and rows of chosen groups without a join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the largest filter; 128 kB, whatever the number of groups.
MAX_BITS = 2**20


def join_on(
    left: DataFrame,
    right: DataFrame,
    names: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join on ``names``, a null matching a null, keeping ``left``'s copy of them.

    A grouping key may be null, and a group of nulls is a group like any other.
    ``condition`` may refer to the remaining columns of both sides.
    """
    renamed = {name: f"__right_{name}" for name in names}
    pairs = [F.col(f"`{name}`").eqNullSafe(F.col(f"`{other}`")) for name, other in renamed.items()]
    if condition is not None:
        pairs.append(condition)
    joined = left.join(right.withColumnsRenamed(renamed), reduce(Column.__and__, pairs), how)
    return joined.drop(*renamed.values())


def among(groups: DataFrame, names: Sequence[str], n_groups: int) -> Column:
    """Whether a row belongs to one of ``groups``, as a filter that moves no row.

    The filter is a bitmap over hashes of the groups, part of the plan. It is true for every
    row of these groups and, now and then, for all rows of another group: rows of one group
    always agree, so it divides the rows into whole groups. About one other group in
    sixteen is let through, or more once ``n_groups`` passes ``MAX_BITS`` / 16.
    """
    bits = 64
    while bits < min(16 * n_groups, MAX_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in names]), F.lit(bits))
    word = F.floor(place / 64).cast("int")
    bit = (place % 64).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    filled = groups.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).collect()
    words = [0] * (bits // 64)
    for row in filled:
        words[row["word"]] = row["mask"]
    bitmap = F.from_json(F.lit(str(words)), "array<bigint>")  # a constant once the plan is optimized
    return F.call_function("bit_get", F.get(bitmap, word), bit) == 1
