"""Sparse vocabulary vectors from token logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.vectors import log_saturation
from rankweave.operators import encode, stats


def max_pooled(logits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): largest ln(1 + relu(logit)) over positions of (key, pos, term, logit)."""
    return logits.groupBy(key, "term").agg(F.max(log_saturation(F.col("logit"))).alias("weight"))


def mean_pooled(logits: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): sum of ln(1 + relu(logit)) over the true length (key, doc_len)."""
    sums = logits.groupBy(key, "term").agg(F.sum(log_saturation(F.col("logit"))).alias("total"))
    return sums.join(lengths, key).select(key, "term", (F.col("total") / F.col("doc_len")).alias("weight"))


def document_weights(arrays: DataFrame, encoder: encode.Encoder, how: str = "max", window: int = 3, repeated: bool = True, gathered: bool = False) -> DataFrame:
    """(doc_id, term, weight) of texts (doc_id, tokens), pooled by max or mean; gathered: a row a document, with arrays of terms and weights.

    A text is whole in its row, so its weights are found where it is read and
    nothing is shuffled, unless a doc_id may have several rows (repeated).
    """
    if how not in ("max", "mean"):
        raise ValueError(f"unknown pooling: {how}")
    if not repeated:
        return encode.document_terms(arrays, encoder, how, window=window, gathered=gathered)
    logits = encode.token_logits(arrays, encoder, window=window)
    rows = max_pooled(logits) if how == "max" else mean_pooled(logits, stats.lengths(arrays))
    return gathered_weights(rows) if gathered else rows


def gathered_weights(rows: DataFrame) -> DataFrame:
    """(doc_id, term, weight), arrays, a row a document, of rows (doc_id, term, weight)."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("own")).select("doc_id", "own.term", "own.weight")


def reweighted(weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Weights times the root of the term's vocabulary weight (term, w); 1 for terms that are not listed."""
    return weights.join(vocabulary.select("term", "w"), "term", "left").withColumn("weight", F.col("weight") * F.sqrt(F.coalesce("w", F.lit(1.0)))).drop("w")


def flops(weights: DataFrame, n_texts: DataFrame) -> DataFrame:
    """One row, flops: sum over terms of the squared mean of |weight| over texts; n_texts has one row, n_docs."""
    means = weights.groupBy("term").agg(F.sum(F.abs("weight")).alias("total")).crossJoin(F.broadcast(n_texts.select("n_docs")))
    return means.agg(F.sum(F.pow(F.col("total") / F.col("n_docs"), 2)).alias("flops"))
