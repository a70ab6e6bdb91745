"""Why a document has its score: values per query term, and cases where systems differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators import rank


def best_matches(pairs: DataFrame, query_stream: DataFrame, matches: DataFrame) -> DataFrame:
    """(qid, doc_id, term, best): for each term of the query the best dot product in the document, without relu; 0 where it is absent."""
    terms = query_stream.select("qid", "term").distinct()
    rows = pairs.select("qid", "doc_id").join(terms, "qid").join(matches.select("qid", "doc_id", "term", "best"), ["qid", "doc_id", "term"], "left")
    return rows.select("qid", "doc_id", "term", F.round(F.coalesce("best", F.lit(0.0)), rank.DIGITS).alias("best"))


def term_line(pairs: DataFrame, query_stream: DataFrame, postings: DataFrame, digits: int = 2) -> DataFrame:
    """(qid, doc_id, line): "term: weight" of every query token in order, 0 where the document lacks it."""
    rows = pairs.select("qid", "doc_id").join(query_stream, "qid").join(postings.select("doc_id", "term", "weight"), ["doc_id", "term"], "left")
    part = F.concat("term", F.lit(": "), F.format_string(f"%.{digits}f", F.round(F.coalesce("weight", F.lit(0.0)), digits)))
    grouped = rows.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return grouped.select("qid", "doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), ", ").alias("line"))


def metric_change(source: DataFrame, target: DataFrame, metric: str) -> DataFrame:
    """(qid, diff): source less target where they differ; a query that the target lacks counts 0 there."""
    rows = source.select("qid", F.col(metric).alias("x")).join(target.select("qid", F.col(metric).alias("y")), "qid", "left")
    return rows.select("qid", F.round(F.col("x") - F.coalesce("y", F.lit(0.0)), rank.DIGITS).alias("diff")).where("diff <> 0")


def against_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """(qid, d1, d2): two changes side by side, 0 where a query has none."""
    both = one.withColumnRenamed("diff", "d1").join(two.withColumnRenamed("diff", "d2"), "qid", "full_outer")
    return both.na.fill(0.0, ["d1", "d2"])


def all_above(changes: DataFrame, limit: float = 0.2) -> DataFrame:
    """Queries that gain more than limit over every system compared with."""
    return changes.where(_every(changes, lambda d: d > limit))


def all_below(changes: DataFrame, limit: float = -0.01) -> DataFrame:
    """Queries that fall below limit against every system compared with."""
    return changes.where(_every(changes, lambda d: d < limit))


def _every(changes: DataFrame, holds) -> Column:
    return reduce(lambda a, b: a & b, (holds(F.col(c)) for c in changes.columns if c != "qid"))


def top_cases(systems: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """(qid, then for each system its best document and whether that is relevant)."""
    right = qrels.where("rel > 0").select("qid", "doc_id", F.lit(True).alias("right"))
    out = None
    for name, run in systems.items():
        best = run.groupBy("qid").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("b")).select("qid", (-F.col("b.minus")).alias("doc_id"))
        case = best.join(right, ["qid", "doc_id"], "left").select("qid", F.col("doc_id").alias(f"{name}_top"), F.coalesce("right", F.lit(False)).alias(f"{name}_right"))
        out = case if out is None else out.join(case, "qid", "full_outer")
    return out
