"""Rank quality of runs (qid, doc_id, score) against judgements (qid, doc_id, rel)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators import rank

METRICS = ("ndcg", "map", "recall", "precision", "mrr", "rcap", "hole")


def per_query(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 100), metrics: tuple[str, ...] = METRICS, by: tuple[str, ...] = (), descending_ids: bool = False) -> DataFrame:
    """(by..., qid, k, metrics...): one row per judged query and cut-off; a query that the run lacks has zeros.

    ndcg: gain rel, discount log2(rank + 1), ideal over all judged documents;
    map over the relevant documents of the query; rcap: hits over the lesser of
    k and the number of relevant documents; hole: unjudged share of the k ranks.
    One ranking and one join serve all cut-offs.
    """
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    keys = [*by, "qid"]
    spark = run.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(k,) for k in cutoffs], "k int"))
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("place", F.row_number().over(best))
    ideal = ideal.crossJoin(cuts).groupBy("qid", "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), F.col("rel") / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"), F.count("*").alias("n_rel"))
    rows = rank.top_k(run.select(*keys, "doc_id", "score"), max(cutoffs), tuple(keys), descending_ids)
    rows = rows.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
    hit = F.coalesce(F.col("rel") > 0, F.lit(False)).cast("int")
    rows = rows.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    within = rows.crossJoin(cuts).where("rank <= k").groupBy(*keys, "k").agg(
        F.sum(F.coalesce("rel", F.lit(0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum("hit").alias("n_hit"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel").isNull().cast("int")).alias("unjudged"),
    )
    judged = ideal
    if by:
        judged = ideal.crossJoin(F.broadcast(run.select(*by).distinct()))
    all_ = judged.join(within, [*keys, "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = {
        "ndcg": zero(F.col("dcg") / F.col("idcg")),
        "map": zero(F.col("ap") / F.col("n_rel")),
        "recall": zero(F.col("n_hit") / F.col("n_rel")),
        "precision": zero(F.col("n_hit") / F.col("k")),
        "mrr": zero(1.0 / F.col("first")),
        "rcap": zero(F.col("n_hit") / F.least("k", "n_rel")),
        "hole": zero(F.col("unjudged") / F.col("k")),
    }
    return all_.select(*keys, "k", *(F.round(of[m], rank.DIGITS).alias(m) for m in metrics))


def mean(per_query_rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., k, metrics...): means over queries."""
    return per_query_rows.groupBy(*by, "k").agg(*(F.round(F.avg(m), rank.DIGITS).alias(m) for m in metrics))


def long_form(rows: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """(keys..., metric, value)."""
    return rows.unpivot(list(keys), list(metrics), "metric", "value")


def score_gap(run: DataFrame, k: int) -> DataFrame:
    """(qid, gap): the best score less the k-th, or the last where there are fewer."""
    rows = rank.top_k(run, k)
    return rows.groupBy("qid").agg(F.round(F.max("score") - F.min("score"), rank.DIGITS).alias("gap"))


def tied_ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg): the nDCG that averages over all orders of documents with equal scores, as a check on `per_query`.

    Gains and the ideal are those of the run's own documents, unjudged ones
    with gain 0; a query without gain in its run has 0.
    """
    discounts = [1 / math.log2(place + 1) for place in range(1, k + 1)]
    upto = F.array(*[F.lit(sum(discounts[:n])) for n in range(k + 1)])
    at = lambda n: F.element_at(upto, (F.least(n, F.lit(k)) + 1).cast("int"))

    def gained(rows: DataFrame, by: str, name: str) -> DataFrame:
        groups = rows.groupBy("qid", by).agg(F.count("*").alias("n"), F.avg("gain").alias("mean"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = groups.withColumn("ahead", ahead)
        return groups.groupBy("qid").agg(F.sum(F.col("mean") * (at(F.col("ahead") + F.col("n")) - at(F.col("ahead")))).alias(name))

    rows = run.select("qid", "doc_id", "score").join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
    rows = rows.select("qid", "score", F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)).cast("double").alias("gain"))
    both = gained(rows, "score", "dcg").join(gained(rows.withColumn("own", F.col("gain")), "own", "idcg"), "qid")
    return both.select("qid", F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg"))
