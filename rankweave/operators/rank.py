"""Rankings: top k, shards and their merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are ranked as they are shown, so that engines agree on ties; ties go to the smaller doc_id.
DIGITS = 6


def rounded(run: DataFrame, digits: int = DIGITS) -> DataFrame:
    return run.withColumn("score", F.round("score", digits))


def ranked(run: DataFrame, by: tuple[str, ...] = ("qid",), descending_ids: bool = False) -> DataFrame:
    """Adds rank, from 1, within each query."""
    tie = F.col("doc_id").desc() if descending_ids else F.col("doc_id").asc()
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), tie)))


def top_k(run: DataFrame, k: int, by: tuple[str, ...] = ("qid",), descending_ids: bool = False) -> DataFrame:
    """The k best of each query; Spark keeps no more than k of a partition before it shuffles."""
    return ranked(run, by, descending_ids).where(F.col("rank") <= k)


def split_and_shard(key: Column, n_splits: int, n_shards: int) -> tuple[Column, Column]:
    """A lossless deal into splits by hash; ceil(n_splits / n_shards) consecutive splits make a shard."""
    split = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long"), F.lit(n_splits))
    return split.cast("int").alias("split"), F.floor(split / math.ceil(n_splits / n_shards)).cast("int").alias("shard")


def shards(docs: DataFrame, n_splits: int, n_shards: int, key: str = "doc_id") -> DataFrame:
    """(key, split, shard) of each row."""
    return docs.select(key, *split_and_shard(F.col(key), n_splits, n_shards))


def shard_top_k(run: DataFrame, shard_of: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each shard."""
    return top_k(run.join(shard_of, "doc_id"), k, ("shard", "qid"))


def merged(parts: DataFrame, k: int | None = None) -> DataFrame:
    """One ranking of all parts; a document that several parts have for a query gets the sum."""
    run = rounded(parts.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")))
    return ranked(run) if k is None else top_k(run, k)


def sample(run: DataFrame, n: int = 1, seed: int = 0, k: int = 10) -> DataFrame:
    """The k best documents of n queries taken at random: those whose ids hash least under the seed; the same ones each time."""
    key = F.xxhash64(F.lit(seed), F.col("qid").cast("string"))
    taken = run.select("qid").distinct().orderBy(key, "qid").limit(n)
    return top_k(run.select("qid", "doc_id", "score").join(taken, "qid", "left_semi"), k)


def as_maps(run: DataFrame) -> DataFrame:
    """(qid, docs): a JSON object {doc_id: score} per query, ids in order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("key"), F.col("score").alias("value"))))
    return run.groupBy("qid").agg(F.to_json(F.map_from_entries(entries)).alias("docs"))
