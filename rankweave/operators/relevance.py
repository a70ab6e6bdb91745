"""Relevance weights of query terms, their change under a run, and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import weights
from rankweave.operators import rank


def term_weights(postings: DataFrame, query_terms: DataFrame, relevant: DataFrame, n_docs: DataFrame, n_term: DataFrame | None = None) -> DataFrame:
    """(qid, term, n_rel, n_term, n_rel_term, rsj).

    postings (doc_id, term), one row each; query_terms (qid, term), one row
    each; relevant (qid, doc_id). Queries without relevant documents are absent.
    n_term (term, n_term), where documents are counted already: postings may
    then be those of relevant documents alone.
    """
    if n_term is None:
        wanted = postings.join(query_terms.select("term").distinct(), "term", "left_semi")
        n_term = wanted.groupBy("term").agg(F.count("*").alias("n_term"))
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    both = relevant.join(postings, "doc_id").join(query_terms, ["qid", "term"], "left_semi").groupBy("qid", "term").agg(F.count("*").alias("n_rel_term"))
    rows = query_terms.join(n_rel, "qid").join(n_term, "term", "left").join(both, ["qid", "term"], "left")
    rows = rows.na.fill(0, ["n_term", "n_rel_term"]).crossJoin(F.broadcast(n_docs.select("n_docs")))
    value = weights.relevance_weight(F.col("n_docs"), F.col("n_rel"), F.col("n_term"), F.col("n_rel_term"))
    return rows.select("qid", "term", "n_rel", "n_term", "n_rel_term", F.round(value, rank.DIGITS).alias("rsj"))


def run_as_relevant(run: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id): the k best of a run with a score above 0."""
    return rank.top_k(run.where("score > 0"), k).select("qid", "doc_id")


def change(of_run: DataFrame, of_qrels: DataFrame) -> DataFrame:
    """(qid, term, rsj, delta): weight by the run less weight by the judgements, rsj being the latter."""
    rows = of_run.select("qid", "term", F.col("rsj").alias("by_run")).join(of_qrels.select("qid", "term", "rsj"), ["qid", "term"])
    return rows.select("qid", "term", "rsj", F.round(F.col("by_run") - F.col("rsj"), rank.DIGITS).alias("delta"))


THRESHOLDS = {"median": 0.5, "q75": 0.75}


def _quantile(rows: DataFrame, column: str, kind: str, name: str) -> DataFrame:
    if kind not in THRESHOLDS:
        raise ValueError(f"unknown threshold: {kind}")
    return F.broadcast(rows.agg(F.percentile(column, F.lit(THRESHOLDS[kind])).alias(name)))


def threshold_bins(rows: DataFrame, kind: str = "median") -> DataFrame:
    """Adds bin: HighRSJ from the threshold of rsj on, else LowRSJ."""
    cut = rows.crossJoin(_quantile(rows, "rsj", kind, "limit"))
    return cut.withColumn("bin", F.when(F.col("rsj") >= F.col("limit"), "HighRSJ").otherwise("LowRSJ")).drop("limit")


def quadrant_bins(rows: DataFrame, term_idf: DataFrame, kind: str = "median") -> DataFrame:
    """Adds bin by rsj > its threshold and idf < the threshold over query terms; OOV without idf."""
    terms = rows.select("term").distinct().join(term_idf.select("term", "idf"), "term")
    cut = rows.join(term_idf.select("term", "idf"), "term", "left")
    cut = cut.crossJoin(_quantile(rows, "rsj", kind, "limit")).crossJoin(_quantile(terms, "idf", kind, "idf_limit"))
    label = F.concat(F.when(F.col("rsj") > F.col("limit"), "HighRSJ").otherwise("LowRSJ"), F.lit("-"), F.when(F.col("idf") < F.col("idf_limit"), "LowIDF").otherwise("HighIDF"))
    return cut.withColumn("bin", F.when(F.col("idf").isNull(), "OOV").otherwise(label)).drop("limit", "idf_limit", "idf")


def equal_width_bins(rows: DataFrame, edges: int = 4) -> DataFrame:
    """Adds bin, from 1: edges - 1 bins of equal width over [min, max], open to the right but for the last."""
    if edges < 2:
        raise ValueError("bins have two edges at least")
    cut = rows.crossJoin(F.broadcast(rows.agg(F.min("rsj").alias("low"), F.max("rsj").alias("high"))))
    width = (F.col("high") - F.col("low")) / (edges - 1)
    number = F.least(F.floor((F.col("rsj") - F.col("low")) / F.when(width == 0, 1.0).otherwise(width)) + 1, F.lit(edges - 1))
    return cut.withColumn("bin", number.cast("int")).drop("low", "high")
