"""Fusion of two rankings (qid, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import rank

#: What a missing score lies below the smallest of its query.
DISCOUNT = 1e-3
#: Fused scores keep more digits than their sides: weights have digits of their own.
DIGITS = 9


def _sides(one: DataFrame, two: DataFrame) -> DataFrame:
    """Full outer join with s1, s2 and each query's smallest scores m1, m2."""
    low = lambda run, name: run.groupBy("qid").agg(F.min("score").alias(name))
    both = one.select("qid", "doc_id", F.col("score").alias("s1")).join(two.select("qid", "doc_id", F.col("score").alias("s2")), ["qid", "doc_id"], "full_outer")
    return both.join(low(one, "m1"), "qid", "left").join(low(two, "m2"), "qid", "left")


def weighted_min_fill(one: DataFrame, two: DataFrame, weights: DataFrame | float = 0.5) -> DataFrame:
    """w s1 + (1 - w) s2; a missing score is the smallest of its query less DISCOUNT.

    A query that one side alone has is scaled by that side's weight, and
    absent if the weight is 0. weights: a number, or rows (w) for a sweep, in
    which case the result has a column w.
    """
    rows = _sides(one, two)
    if isinstance(weights, DataFrame):
        rows = rows.crossJoin(F.broadcast(weights.select("w")))
    else:
        rows = rows.withColumn("w", F.lit(float(weights)))
    s1 = F.coalesce("s1", F.col("m1") - DISCOUNT)
    s2 = F.coalesce("s2", F.col("m2") - DISCOUNT)
    w = F.col("w")
    score = F.when(F.col("m1").isNull(), (1 - w) * s2).when(F.col("m2").isNull(), w * s1).otherwise(w * s1 + (1 - w) * s2)
    gone = (F.col("m1").isNull() & (w == 1)) | (F.col("m2").isNull() & (w == 0))
    keys = ["w", "qid", "doc_id"] if isinstance(weights, DataFrame) else ["qid", "doc_id"]
    return rank.rounded(rows.where(~gone).select(*keys, score.alias("score")), DIGITS)


def weighted_second_driven(one: DataFrame, two: DataFrame, weight: float = 0.5) -> DataFrame:
    """(1 - w) s2 + w s1 over all documents of the second ranking, and the first's with the second's smallest score.

    Documents of the second alone get (1 - w) s2; queries without the second are absent.
    """
    rows = _sides(one, two).where("m2 is not null")
    w = float(weight)
    score = (1 - w) * F.coalesce("s2", "m2") + F.coalesce(w * F.col("s1"), F.lit(0.0))
    return rank.rounded(rows.select("qid", "doc_id", score.alias("score")), DIGITS)


def top_k_added(one: DataFrame, two: DataFrame, k: int, weight: float | None = None) -> DataFrame:
    """Both cut to the k best, then added; a missing score is the smallest of its side; weighted if a weight is given."""
    rows = _sides(rank.top_k(one, k).drop("rank"), rank.top_k(two, k).drop("rank"))
    a, b = (1.0, 1.0) if weight is None else (float(weight), 1 - float(weight))
    score = a * F.coalesce("s1", "m1", F.lit(0.0)) + b * F.coalesce("s2", "m2", F.lit(0.0))
    return rank.rounded(rows.select("qid", "doc_id", score.alias("score")), DIGITS)


def outer_sum(one: DataFrame, two: DataFrame) -> DataFrame:
    """s1 + s2, missing scores 0."""
    rows = _sides(one, two)
    return rank.rounded(rows.select("qid", "doc_id", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score")), DIGITS)


def added_where_present(one: DataFrame, two: DataFrame) -> DataFrame:
    """The first's documents, with s2 added where the second has them."""
    rows = one.select("qid", "doc_id", F.col("score").alias("s1")).join(two.select("qid", "doc_id", F.col("score").alias("s2")), ["qid", "doc_id"], "left")
    return rank.rounded(rows.select("qid", "doc_id", (F.col("s1") + F.coalesce("s2", F.lit(0.0))).alias("score")), DIGITS)
