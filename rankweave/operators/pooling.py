"""Documents as means of their terms' vectors by BM25 weight.

The idf of the most frequent terms travel to the documents, where their part of
a mean is summed at once; only postings of the other terms, which few documents
have, meet their idf by a join and come back, gathered by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import weights
from rankweave.functions.batches import slices, token_lists
from rankweave.operators import stats
from rankweave.operators.encode import Encoder, lists_of, mean_vectors
from rankweave.sources.folders import kept

#: Terms whose idf travel with a task.
FREQUENT = 1 << 17


def bm25_means(arrays: DataFrame, encoder: Encoder, k1: float = 0.9, b: float = 0.4, repeated: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, vec): mean of a document's token vectors by BM25 weight times tf; zero without weight. Texts without tokens are absent.

    repeated: a doc_id may have several rows, whose postings are then put
    together by a shuffle of all of them.
    """
    if repeated:
        w = stats.posting_weights(arrays, k1, b)
        terms = w.groupBy("doc_id").agg(F.collect_list(F.struct("term", (F.col("weight") * F.col("tf")).alias("w"))).alias("terms"))
        return mean_vectors(terms, encoder)
    spark, doc = arrays.sparkSession, arrays.schema["doc_id"].dataType.simpleString()
    n_docs, _, mean = stats.summary(arrays).first()
    df = kept(stats.document_frequency(arrays.select(F.explode(F.array_distinct("tokens")).alias("term"))), "frequencies")
    common = df.orderBy(F.col("df").desc(), "term").limit(frequent).toArrow()  # bounded by frequent
    known = spark.sparkContext.broadcast(dict(zip(common["term"].to_pylist(), np.log(n_docs / common["df"].to_numpy()).tolist())))
    texts = arrays.where("size(tokens) > 0").select("doc_id", "tokens")

    def saturated(tf: np.ndarray, n: int) -> np.ndarray:
        return tf * (1 + k1) / (tf + k1 * (1 - b + b * n / mean))

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, sums = np.zeros(batch.num_rows), np.zeros((batch.num_rows, encoder.dim))
            for row, tokens in enumerate(token_lists(batch.column(1))):
                own = {t: n for t, n in Counter(tokens).items() if t in known.value}
                if own:
                    tf = np.array(list(own.values()), np.float64)
                    w = np.array([known.value[t] for t in own]) * saturated(tf, len(tokens)) * tf
                    totals[row], sums[row] = w.sum(), w @ encoder.encode(list(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals), lists_of(sums)], ["doc_id", "total", "vec"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, lens, terms, counts = [], [], [], []
            for row, tokens in enumerate(token_lists(batch.column(1))):
                for term, n in Counter(t for t in tokens if t not in known.value).items():
                    rows.append(row), lens.append(len(tokens)), terms.append(term), counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lens, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "doc_len", "term", "tf"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array(batch.column(2).to_pylist(), np.float64)
            totals = batch.column(1).to_numpy().copy()
            for row, (terms, own) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if terms:
                    out[row] += np.array(own) @ encoder.encode(terms)
                    totals[row] += sum(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(np.divide(out, totals[:, None], out=np.zeros_like(out), where=totals[:, None] != 0))], ["doc_id", "vec"])

    parts = texts.mapInArrow(partly, f"doc_id {doc}, total double, vec array<double>")
    if len(common) < frequent:
        parts = parts.select("*", F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<double>").alias("own"))
    else:
        rare = texts.mapInArrow(others, f"doc_id {doc}, doc_len long, term string, tf long").join(df, "term")
        value = F.log(F.lit(float(n_docs)) / F.col("df")) * weights.saturated_tf(F.col("tf"), F.col("doc_len"), F.lit(float(mean)), k1, b) * F.col("tf")
        rare = rare.groupBy("doc_id").agg(F.collect_list(F.struct("term", value.alias("w"))).alias("held"))
        parts = parts.join(rare.select("doc_id", F.col("held.term").alias("terms"), F.col("held.w").alias("own")), "doc_id", "left")
    return parts.select("doc_id", "total", "vec", "terms", "own").mapInArrow(whole, f"doc_id {doc}, vec array<double>")
