"""Corpus statistics: term and document frequency, idf, lengths, posting weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import text as text_functions
from rankweave.functions import weights
from rankweave.functions.batches import slices, term_counts_of


def token_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, tokens): one row per text, its tokens in order."""
    words = text_functions.tokens(F.col(text))
    return docs.select(key, (text_functions.truncated(words, most) if most else words).alias("tokens"))


def joined(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line): the tokens in one string, which takes a third of the room of an array. Tokens hold no space."""
    return arrays.select(key, F.array_join("tokens", " ").alias("line"))


def parted(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens) of joined."""
    none = F.array().cast("array<string>")
    return lines.select(key, F.when(F.col("line") == "", none).otherwise(F.split("line", " ")).alias("tokens"))


def token_stream(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, term): one row per token, pos from 0."""
    return arrays.select(key, F.posexplode("tokens").alias("pos", "term"))


def segments(arrays: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """(key, segment, start, tokens): windows of `length` tokens, encoded on their own."""
    starts = F.explode(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(length)))
    rows = arrays.where("size(tokens) > 0").select(key, "tokens", starts.alias("start"))
    return rows.select(key, (F.col("start") / length).cast("int").alias("segment"), "start", F.expr(f"slice(tokens, start + 1, {int(length)})").alias("tokens"))


def term_frequency(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf)."""
    return arrays.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df) from one row per document and term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def lengths(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    return arrays.select(key, F.size("tokens").cast("long").alias("doc_len"))


def repeated(rows: DataFrame, key: str = "doc_id") -> bool:
    """Whether a key has several rows."""
    return rows.groupBy(key).count().where("count > 1").limit(1).count() > 0


def summary(arrays: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, mean_len."""
    return arrays.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("n_tokens"), F.avg(F.size("tokens").cast("double")).alias("mean_len"))


def idf(df: DataFrame, summary_row: DataFrame, kind: str = "plain") -> DataFrame:
    """(term, df, idf)."""
    if kind not in ("plain", "smooth"):
        raise ValueError(f"unknown idf: {kind}")
    formula = weights.plain_idf if kind == "plain" else weights.smooth_idf
    return df.crossJoin(F.broadcast(summary_row.select("n_docs"))).select("term", "df", formula(F.col("n_docs"), F.col("df")).alias("idf"))


def posting_weights(arrays: DataFrame, k1: float, b: float, kind: str = "plain", terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, idf, weight): BM25 weight of every posting.

    terms, where given, limits the postings to some terms before they are
    weighted; statistics are those of the whole corpus. Lengths travel with
    the arrays, so only (doc_id, term, tf, doc_len) is grouped.
    """
    rows = arrays.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))
    known = idf(document_frequency(tf), summary(arrays), kind)
    weighted = tf.join(known, "term").crossJoin(F.broadcast(summary(arrays).select("mean_len")))
    saturated = weights.saturated_tf(F.col("tf"), F.col("doc_len"), F.col("mean_len"), k1, b, numerator=kind == "plain")
    return weighted.select("doc_id", "term", "tf", "idf", (F.col("idf") * saturated).alias("weight"))


def posting_blocks(tf: DataFrame, width: int = 4096) -> DataFrame:
    """(term, block, n, first, gaps): a term's documents in blocks of `width` consecutive numbers.

    gaps: from each document to the next, 0 for the first. No list is longer
    than a block, whatever the term; doc_id is a number.
    """
    blocks = tf.groupBy("term", F.floor(F.col("doc_id") / width).alias("block")).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    gaps = F.transform("docs", lambda d, i: d - F.when(i == 0, d).otherwise(F.get("docs", i - 1)))
    return blocks.select("term", "block", F.size("docs").alias("n"), F.get("docs", F.lit(0)).alias("first"), gaps.alias("gaps"))


def documents_of(blocks: DataFrame) -> DataFrame:
    """(term, doc_id) of posting_blocks."""
    ids = F.transform("gaps", lambda g, i: F.col("first") + F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return blocks.select("term", F.explode(ids).alias("doc_id"))


def offsets(counts: DataFrame) -> DataFrame:
    """(term, offset, n): where each term's rows begin if they are laid out by term.

    A running sum in two steps, by the first character and within it, so that
    no task orders the whole vocabulary.
    """
    rows = counts.withColumn("head", F.substring("term", 1, 2))
    heads = rows.groupBy("head").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("head", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    inner = Window.partitionBy("head").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(heads, "head")
    return rows.select("term", (F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("offset"), "n")


def term_counts(doc_arrays: DataFrame, terms: dict[str, int]) -> tuple[int, int, np.ndarray]:
    """(documents, tokens, documents with each of the terms), in one pass that sends a number per term and task; terms are numbered from 0."""
    names = pa.array(sorted(terms, key=terms.__getitem__), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, tokens = np.zeros(len(terms), np.int64), 0, 0
        for batch in slices(batches):
            lists = batch.column(0)
            docs, tokens = docs + len(lists), tokens + len(lists.flatten())
            counts += np.bincount(term_counts_of(lists, names)[1], minlength=len(terms))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()], pa.int64()), pa.array([docs, tokens, *counts[used].tolist()], pa.int64())], ["at", "n"])

    counts, total = np.zeros(len(terms), np.int64), {-2: 0, -1: 0}
    for row in doc_arrays.select("tokens").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if row["at"] < 0:
            total[row["at"]] = row.n
        else:
            counts[row["at"]] = row.n
    return total[-2], total[-1], counts
