"""Lines that several documents share, kept only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import join_counted, own_id, texts
from tidemark.storage import measured

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the one with the smallest id.

    Returns ``doc_id, n_lines, n_dropped, kept``: one row per row of ``docs``.
    Lines are compared by :func:`line_key`; keys shorter than ``min_chars`` code
    points always stay. A null or empty text is one empty line. Rows with one id
    are one document. A null id comes after all others, and rows without id are
    one document. Empty input gives no rows.

    Lines become 128-bit hashes next to their place, so the text itself moves
    once, to meet the places of its dropped lines.
    """
    base = texts(docs, id_column, text_column)
    lines = (
        base.select("did", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("did", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            "did", "th", "pos",
            F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"),
        )
    )
    found = [F.min("did").alias("first"), F.count("*").alias("n")]
    if min_docs == 2:  # two different documents: the least and the largest id differ
        shared = lines.groupBy("h1", "h2").agg(*found, F.max("did").alias("last"))
        shared = shared.where("first < last")
    else:
        by_doc = lines.groupBy("h1", "h2", "did").agg(F.count("*").alias("n"))
        shared = by_doc.groupBy("h1", "h2").agg(
            F.min("did").alias("first"), F.sum("n").alias("n"), F.count("*").alias("docs")
        ).where(F.col("docs") >= min_docs)
    shared, counts = measured(
        shared.select("h1", "h2", "first", "n"), "lines", total=F.sum("n")
    )
    dropped = (
        join_counted(lines, shared, ["h1", "h2"], "n", counts["total"] or 0)
        .where("did <> first")
        .groupBy("did", "th")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept_lines = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.transform(kept, lambda i: F.get("lines", i))
    )
    return (
        base.select("did", "th", F.split("text", "\n", -1).alias("lines"))
        .join(dropped, ["did", "th"], "left")
        .select(
            own_id("did").alias("doc_id"),
            F.size("lines").cast("bigint").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.array_join(kept_lines, "\n").alias("kept"),
        )
    )
