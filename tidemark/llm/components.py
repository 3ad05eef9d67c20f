"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import join_counted
from tidemark.storage import measured, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node.

    Links may repeat and point either way; nodes are never null. No links give
    no rows. Each round writes its links, so a lost executor costs a part of one
    round, and neighbours of one node never meet in a list.
    """
    pair = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    stars, seen = measured(
        links.select(*pair).where("low < high").distinct(), "links", **_state()
    )
    while seen["n"]:
        both = stars.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            stars.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        # Large star: larger neighbours go to the smallest one around.
        near = _least(both)
        large = written(
            join_counted(both, near, ["u"], "n", 2 * seen["n"])
            .where("v > u")
            .select(F.least("u", "least").alias("low"), F.col("v").alias("high"))
            .distinct(),
            "links",
        )
        # Small star: a node and its smaller neighbours go to the smallest of these.
        down = large.select(F.col("high").alias("u"), F.col("low").alias("v"))
        near = _least(down)
        moved = join_counted(down, near, ["u"], "n", seen["n"]).select(
            F.col("least").alias("low"), F.col("v").alias("high")
        )
        own = near.select(F.col("least").alias("low"), F.col("u").alias("high"))
        stars, now = measured(
            moved.unionByName(own).where("low < high").distinct(), "links", **_state()
        )
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _state() -> dict:
    key = F.xxhash64("low", "high")
    return {"n": F.count("*"), "sum": F.sum(key.cast("decimal(38,0)"))}


def _least(pairs: DataFrame) -> DataFrame:
    return written(
        pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")), "stars"
    )
