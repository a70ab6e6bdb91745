"""The index of token vectors: layout, packs and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def posting_counts(vectors: DataFrame) -> DataFrame:
    """(term, n): token vectors of each term."""
    return vectors.groupBy("term").agg(F.count("*").alias("n"))


def pack_queries(stream: DataFrame) -> DataFrame:
    """(qid, n, tokens array<struct<pos, term>>): one row per query, tokens in order."""
    return stream.groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("tokens"))


def scatter_maps(stream: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(term, doc_id, run, n): postings of a term in the order of doc_id; run numbers its documents from 0.

    A running sum in two steps, over blocks of `width` consecutive numbers and
    within a block, so that no task orders all documents of a term.
    """
    counts = stream.groupBy("term", "doc_id").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("doc_id") / width))
    ahead = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("term", "block").agg(F.count("*").alias("docs")).select("term", "block", F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("term", "block").orderBy("doc_id"))
    rows = counts.withColumn("at", inner).join(blocks, ["term", "block"])
    return rows.select("term", "doc_id", (F.col("before") + F.col("at") - 1).cast("int").alias("run"), "n")


def scatter_max(stream: DataFrame, target: tuple[str, ...], value: str = "value") -> DataFrame:
    """(target..., value): the largest positive value of each target."""
    return stream.where(F.col(value) > 0).groupBy(*target).agg(F.max(value).alias(value))


def invariants(stream: DataFrame, arrays: DataFrame) -> DataFrame:
    """One row: tokens in the index and in the texts, documents in both, and whether they agree."""
    own = stream.agg(F.count("*").alias("n_vectors"), F.countDistinct("doc_id").alias("n_indexed"))
    whole = arrays.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("n_tokens"), F.count(F.when(F.size("tokens") > 0, 1)).alias("n_nonempty"))
    return own.crossJoin(whole).withColumn("ok", (F.col("n_vectors") == F.col("n_tokens")) & (F.col("n_indexed") == F.col("n_nonempty")))


def write(vectors: DataFrame, path: str, shard: str = "shard") -> None:
    """Index of (shard, term, doc_id, pos, vec): a folder per shard, rows by term, document and position.

    Files are ranges of (shard, term, doc_id) from a sample of the rows, so a
    term in most documents is split over many; row groups carry the range of
    their terms, and a reader that asks for one reads no others.
    """
    laid = vectors.repartitionByRange(shard, "term", "doc_id").sortWithinPartitions(shard, "term", "doc_id", "pos")
    laid.write.partitionBy(shard).mode("overwrite").parquet(path)
