"""Exact values at given ranks of groups of any size, by prefix counts.

Sorting one group means one task; a group holding a third of all rows cannot be
sorted that way. Instead

1. equal values of a group are counted (map-side first), so a value repeated in a third
   of the rows is one row;
2. the distinct values are range-partitioned on group *and* value, into parts of bounded
   size, so a large group lies in as many parts as it needs, in order;
3. the number of values in each part, summed over the parts before it, says in which
   part of its group every wanted rank lies, and only there a running count finds it.

The number of passes does not depend on the data, and every step spills.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import join_on
from tidemark.storage import written

# Distinct values in one part.
PART_VALUES = 500_000


def values_at_ranks(
    values: DataFrame,
    group: Sequence[str],
    ranks: Mapping[str, Callable[[str], str]],
    n_values: int,
    part_values: int = PART_VALUES,
) -> DataFrame:
    """Values at 1-based ranks of each group, as ``group, slot, value``.

    ``values`` has the columns ``group`` and a non-null ``value``, some ``n_values`` of them.
    ``ranks`` maps slots to SQL for a rank, given SQL for the number of values of a group;
    a rank that a group does not have gives no row.
    """
    group = list(group)
    counted = values.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("copies"))
    n_parts = -(-n_values // part_values) or 1
    dealt = counted.repartitionByRange(n_parts, *group, "value")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "ranks")

    # A row for each group and part; a group has as many parts as its size asks for.
    totals = dealt.groupBy(*group, "part").agg(F.sum("copies").alias("inside"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *group, "part", "inside",
        F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"),
        F.sum("inside").over(whole).alias("n"),
    )
    slots = ", ".join(f"struct('{slot}' AS slot, {rank('n')} - before AS place)" for slot, rank in ranks.items())
    wanted = totals.selectExpr(
        *group, "part", f"filter(array({slots}), x -> x.place BETWEEN 1 AND inside) AS wanted"
    ).where("size(wanted) > 0")

    running = Window.partitionBy(*group, "part").orderBy("value")
    there = join_on(dealt, wanted, [*group, "part"]).withColumn("upto", F.sum("copies").over(running))
    return there.selectExpr(
        *group, "value", "inline(filter(wanted, x -> x.place > upto - copies AND x.place <= upto))"
    ).select(*group, "slot", "value")
