"""Groups of equal documents by radix partitioning of their bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import join_counted, own_id, texts
from tidemark.storage import measured

# Bytes looked at in each round; after the last, each round looks at four times as many.
WIDTHS = (128, 512, 2048, 8192, 32768)


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    widths: tuple[int, ...] = WIDTHS,
) -> DataFrame:
    """Of equal texts, the row with the largest id stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of
    ``docs``. A null text equals the empty one. A null id comes after all others
    (``keep_id`` is null where it stays). Of rows with equal text and id exactly
    one stays. Empty input gives no rows.

    Documents are split by their next bytes, most significant first. A group
    with one document is settled; one whose documents have ended holds equal
    texts; all others go on with the bytes that follow. The bytes themselves are
    the keys, so equality rests on no digest (``text_sha256`` is only reported).
    Only documents that still share all bytes so far are written for the next
    round, without the bytes that were compared. Widths grow, so the number of rounds is
    that of the digits of the longest shared beginning.
    """
    base = texts(docs, id_column, text_column).select(
        "did", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("rest")
    )
    settled = []
    # Rows get a number once they are written; until then all belong to group 0.
    rows = base.withColumn("digit", F.substring("rest", 1, widths[0]))
    groups, counts = measured(
        rows.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1"),
        "radix", total=F.sum("n"),
    )
    limit_rows = counts["total"] or 0
    singles = rows.join(groups, "digit", "left_anti") if limit_rows else rows
    settled.append(
        singles.select(
            "did", F.col("did").alias("keep"), F.lit(1).cast("bigint").alias("n"),
            F.lit(True).alias("kept"), "sha",
        )
    )
    if not limit_rows:
        return _result(settled)
    # Documents that end here keep an empty rest, which the next round finds short.
    active, _ = measured(
        join_counted(rows, groups, ["digit"], "n", limit_rows).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("digit").alias("group_bytes"), "did", "sha",
            F.expr(f"substring(rest, {widths[0] + 1})").alias("rest"),
        ),
        "radix",
    )
    group_keys = ["group_bytes"]
    place = 1
    while limit_rows:
        width = widths[place] if place < len(widths) else widths[-1] * 4 ** (place - len(widths) + 1)
        place += 1
        rows = active.withColumn("digit", F.substring("rest", 1, width))
        keys = [*group_keys, "digit"]
        groups, counts = measured(
            rows.groupBy(*keys).agg(
                F.count("*").alias("n"), F.min("row").alias("next_group"),
                F.max(F.struct("did", "row")).alias("last"),
            ),
            "radix", total=F.sum("n"),
        )
        ended = (F.col("n") == 1) | (F.length("digit") < width)
        split, counts = measured(
            join_counted(rows, groups, keys, "n", counts["total"] or 0).select(
                "row", "did", "sha", F.col("last.did").alias("keep"), "n", "next_group",
                (F.col("last.row") == F.col("row")).alias("kept"), ended.alias("ended"),
                F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            ),
            "radix", active=F.count_if(~F.col("ended")),
        )
        settled.append(split.where("ended").select("did", "keep", "n", "kept", "sha"))
        active = split.where("not ended").select(
            "row", "did", "sha", F.col("next_group").alias("group_row"), "rest"
        )
        group_keys = ["group_row"]
        limit_rows = counts["active"] or 0
    return _result(settled)


def _result(settled: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, settled).select(
        own_id("did").alias("doc_id"),
        own_id("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.col("sha").alias("text_sha256"),
    )
