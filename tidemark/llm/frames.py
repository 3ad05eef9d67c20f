"""What the operators share: uniform inputs, and joins that stand hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A missing id counts as this one: after all others.
NO_ID = 2**63 - 1
# A key is heavy if it holds more than one row in so many; there are at most so many heavy keys.
HEAVY_SHARE = 500

# A table of row keys up to this size (16 bytes each) is sent to the rows instead of moving them.
SENT_KEYS = 500_000


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``did`` (never null), ``th`` (hash of the text) and ``text`` (never null).

    ``did`` and ``th`` together stand for a row: rows that agree in both are
    repeats of one another and get the same result. All other columns are left
    behind, so none can clash.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs[id_column].cast("bigint"), F.lit(NO_ID)).alias("did"), text.alias("text")
    ).select("did", F.xxhash64("text").alias("th"), "text")


def own_id(column: str | Column) -> Column:
    """The id as it was given, null where there was none."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def join_counted(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], count: str, total: int
) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key.

    ``count`` names the column of ``groups`` with the number of rows of the key
    and ``total`` is the number of all rows. Heavy keys are at most
    ``HEAVY_SHARE``, so these alone are broadcast and their rows never move;
    every other key is too small to make a task stand out.
    """
    limit = total // HEAVY_SHARE
    heavy = F.broadcast(groups.where(F.col(count) > limit))
    return rows.join(heavy, list(keys)).unionByName(
        rows.join(groups.where(F.col(count) <= limit), list(keys))
    )


def matched(rows: DataFrame, keys: DataFrame, on: Sequence[str], n_keys: int, how: str) -> DataFrame:
    """Semi or anti join of ``rows``, which hold whole texts, with ``n_keys`` keys.

    Few keys are broadcast, so the texts stay where they are; many are joined by a shuffle.
    """
    return rows.join(F.broadcast(keys) if n_keys <= SENT_KEYS else keys, list(on), how)
