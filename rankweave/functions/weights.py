"""Term weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of the first stage and of the contextual re-ranker.
FIRST_STAGE, RERANK = (0.9, 0.4), (0.82, 0.65)


def plain_idf(n_docs: Column, df: Column) -> Column:
    """ln(N / df)."""
    return F.log(n_docs.cast("double") / df)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturated_tf(tf: Column, doc_len: Column, mean_len: Column, k1: float, b: float, numerator: bool = True) -> Column:
    """tf (1 + k1) / (tf + k1 (1 - b + b len / mean)); without the factor 1 + k1 if numerator is False."""
    below = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / mean_len)
    return tf * F.lit(1 + k1 if numerator else 1.0) / below


def relevance_weight(n: Column, n_rel: Column, n_term: Column, n_rel_term: Column) -> Column:
    """Robertson-Sparck-Jones weight with one half added to each count."""
    half = F.lit(0.5)
    above = (n_rel_term + half) * (n - n_term - n_rel + n_rel_term + half)
    return F.log(above / ((n_rel - n_rel_term + half) * (n_term - n_rel_term + half)))
