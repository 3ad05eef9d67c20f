"""A corpus made ready for training, stage by stage.

Each stage takes the documents that the one before kept, written as Parquet, and
returns documents again; the last one returns the token table.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.llm.decontaminate import decontaminate  # noqa: E402
from tidemark.llm.frames import NO_ID, matched  # noqa: E402
from tidemark.llm.language_id import language_id  # noqa: E402
from tidemark.llm.mixing import mix  # noqa: E402
from tidemark.llm.ngram_join import ngram_join  # noqa: E402
from tidemark.llm.queries import MIX_ANCHOR, MIX_WEIGHTS, tokens  # noqa: E402
from tidemark.llm.shipping import small_batches  # noqa: E402
from tidemark.storage import measured, written  # noqa: E402


def _key(docs: DataFrame) -> list[Column]:
    """What stands for a row of ``docs`` in the decisions of a stage."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return [F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("__did"), F.xxhash64(text).alias("__th")]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``dropped(did, th)``."""
    did, th = _key(docs)
    keys = dropped.select(F.col("did").alias("__did"), F.col("th").alias("__th")).distinct()
    gone, size = measured(keys, "dropped", n=F.count("*"))
    marked = docs.withColumns({"__did": did, "__th": th})
    return matched(marked, gone, ["__did", "__th"], size["n"] or 0, "left_anti").select(*docs.columns)


def _decided(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("did", F.coalesce("doc_id", F.lit(NO_ID)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages."""
    small_batches(spark)
    found = language_id(docs, declared=F.col("lang"), address=F.col("source"))
    return _without(docs, _decided(found).where("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Of rows that repeat one another entirely one stays too.
    """
    small_batches(spark)
    found = _decided(ngram_join(docs))
    gone = found.where("not first")
    stays = found.where("first").select("did", "th")
    kept = _without(docs, gone.join(stays, ["did", "th"], "left_anti"))
    # A row that stays may have repeats with the same id and text.
    repeats = written(gone.join(stays, ["did", "th"], "left_semi").select("did", "th").distinct(), "repeats")
    if repeats.isEmpty():
        return kept
    did, th = _key(docs)
    marked = kept.withColumns({"__did": did, "__th": th})
    keys = repeats.select(F.col("did").alias("__did"), F.col("th").alias("__th"))
    one = marked.join(keys, ["__did", "__th"], "left_semi").dropDuplicates(["__did", "__th"])
    return marked.join(keys, ["__did", "__th"], "left_anti").unionByName(one).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, _decided(decontaminate(docs, items)).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their rates; rates are 1 at most here, so none comes twice."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mix(docs, labels, MIX_WEIGHTS, MIX_ANCHOR)
    return _without(docs, _decided(rates).where("copies = 0"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards, and where each document stands in them."""
    small_batches(spark)
    return tokens(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix_sources),
    ("token_output", write_token_ids),
]

# Similarity, alignment and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
