import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.matching import among
from tidemark.operators.ranks import values_at_ranks


@pytest.mark.parametrize("part_values", [3, 50, 10_000])
def test_every_rank(spark, part_values):
    rng = random.Random(2)
    groups = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(300)],
        "copies": [float(rng.randint(0, 4)) for _ in range(300)],
        "tiny": [2.0],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(200)],
        None: [float("inf"), float("-inf"), 0.0, 1.5],
    }
    values = spark.createDataFrame(
        [(key, v) for key, vs in groups.items() for v in vs], "key string, value double"
    )
    slots = {f"r{k}": lambda n, k=k: str(k) for k in [1, 2, 3, 4, 5, 24, 150, 151, 200, 299, 300]}
    slots |= {"last": lambda n: n, "none": lambda n: f"{n} + 1"}
    found = values_at_ranks(values, ["key"], slots, values.count(), part_values).collect()
    want = {
        (key, slot): sorted(vs)[int(rank(str(len(vs))).replace(" + 1", "")) - 1]
        for key, vs in groups.items()
        for slot, rank in slots.items()
        if slot != "none" and int(rank(str(len(vs)))) <= len(vs)
    }
    assert {(r["key"], r["slot"]): r["value"] for r in found} == want and len(found) == len(want)


def test_nan_is_the_largest(spark):
    values = spark.range(200).select(
        F.lit("k").alias("key"),
        F.when(F.col("id") < 50, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("value"),
    )
    found = values_at_ranks(values, ["key"], {"a": lambda n: "150", "b": lambda n: "151"}, 200, 10)
    found = {r["slot"]: r["value"] for r in found.collect()}
    assert found["a"] == 199.0 and found["b"] != found["b"]


@pytest.mark.parametrize("n_groups", [1, 700])
def test_filter_of_groups(spark, n_groups):
    rows = spark.range(60_000).select(
        (F.col("id") % 3000).cast("double").alias("a"), F.when(F.col("id") % 3000 > 5, F.lit("x")).alias("b")
    ).withColumn("a", F.when(F.col("a") == 0, F.lit(-0.0)).otherwise(F.col("a")))
    chosen = rows.where(F.col("a") < n_groups).withColumn("a", F.col("a") + 0.0).distinct()
    marked = rows.withColumn("hit", among(chosen, ["a", "b"], n_groups).cast("int"))
    by_group = marked.groupBy("a", "b").agg(F.min("hit").alias("lo"), F.max("hit").alias("hi")).collect()
    assert all(r["lo"] == r["hi"] for r in by_group)  # whole groups
    assert all(r["hi"] for r in by_group if r["a"] < n_groups)
    assert sum(r["hi"] for r in by_group if r["a"] >= n_groups) < 0.15 * len(by_group)
