"""Residual vector quantisation: centroids, codes, bucketed residuals."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import vectors
from rankweave.operators import quantiles


#: Components of centroids that are broadcast at a time, at most.
HELD = 1 << 23
#: Centroids and vectors that are multiplied at once; how far below the best a bound still counts, for products are rounded.
BLOCK, ROWS, SLACK = 1024, 1024, 1e-8


def check(dim: int, nbits: int) -> None:
    if dim * nbits % 8 or dim % (nbits * 8):
        raise ValueError(f"vectors of {dim} components do not pack at {nbits} bits")


def mean_by(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, centroid): component-wise mean of array<double> vectors of a key."""
    parts = rows.select(key, F.posexplode(vec).alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centroid"))


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds code: the centroid (code, centroid) with the largest dot product, the smallest code of equals, -1 without centroids.

    Centroids go to the vectors, longest first, HELD components at a time (one
    pass over the vectors for each such part, counted before). A part is
    multiplied in blocks, and a block whose longest centroid cannot reach a
    vector's best product so far, by the lengths of both, is left out for that
    vector. However many the centroids are, none is lost.
    """
    n, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    by_length = centroids.select(F.col("code").cast("long").alias("code"), "centroid").orderBy(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x).desc(), "code")
    out = rows.withColumns({"best score": F.lit(float("-inf")), "code": F.lit(-1).cast("long")})
    held, most = by_length.toLocalIterator(), max(1, HELD // max(1, dim or 1))
    for _ in range(-(-n // most)):
        part = list(islice(held, most))
        out = _best_of(out, np.array([r.code for r in part], np.int64), np.array([r.centroid for r in part], np.float64))
    return out.drop("best score")


def _best_of(rows: DataFrame, codes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """rows with `best score` and code improved by these centroids, which are sorted by falling length."""
    sent = rows.sparkSession.sparkContext.broadcast((codes, matrix, np.linalg.norm(matrix, axis=1)))
    names = rows.columns
    vec, best_at, code_at = (names.index(x) for x in ("vec", "best score", "code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, matrix, lengths = sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                lists = batch.column(vec)
                vectors = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
                size = np.linalg.norm(vectors, axis=1)
                best = batch.column(best_at).to_numpy().copy()
                code = batch.column(code_at).to_numpy().copy()
                for start in range(0, len(codes), BLOCK):
                    live = np.flatnonzero(size * lengths[start] >= best - SLACK)
                    if not len(live):
                        break  # later centroids are shorter still
                    scores = np.round(vectors[live] @ matrix[start : start + BLOCK].T, 9)
                    top = scores.max(axis=1)
                    least = np.where(scores == top[:, None], codes[start : start + BLOCK], np.iinfo(np.int64).max).min(axis=1)
                    wins = (top > best[live]) | ((top == best[live]) & (least < code[live]))
                    best[live[wins]], code[live[wins]] = top[wins], least[wins]
                columns = list(batch.columns)
                columns[best_at], columns[code_at] = pa.array(best), pa.array(code)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def residuals(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds residual: the vector less its code's centroid."""
    return rows.join(centroids.select("code", "centroid"), "code").withColumn("residual", F.zip_with("vec", "centroid", lambda x, c: x.cast("double") - c)).drop("centroid")


def buckets(residual_rows: DataFrame, nbits: int) -> DataFrame:
    """One row: cutoffs at i / 2^b, weights at (i + 1/2) / 2^b of all residual components, and their mean size.

    The quantiles are exact and taken by passes over the rows when this is
    called; no task holds the components.
    """
    n = 2**nbits
    flat = residual_rows.select(F.explode("residual").alias("x"))
    found = quantiles.percentiles(flat, "x", [i / (2 * n) for i in range(1, 2 * n)])
    mean = flat.agg(F.avg(F.abs("x"))).first()[0]
    row = (found[1::2], found[::2], mean) if mean is not None else (None, None, None)
    return residual_rows.sparkSession.createDataFrame([row], "cutoffs array<double>, weights array<double>, avg_residual double")


def bucketed(residual: Column, cutoffs: Column) -> Column:
    """For each component the number of cutoffs strictly below it."""
    return F.transform(residual, lambda x: F.aggregate(cutoffs, F.lit(0), lambda n, c: n + (x > c).cast("int")))


def packed(codes: Column, nbits: int) -> Column:
    """Bits of the codes, lowest bit of each first, filled into bytes from the highest bit, as hexadecimal digits."""

    def digits(bits: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(bits) - 4, F.lit(4)), lambda i: F.substring(F.lit("0123456789ABCDEF"), (F.get(bits, i) * 8 + F.get(bits, i + 1) * 4 + F.get(bits, i + 2) * 2 + F.get(bits, i + 3) + 1).cast("int"), F.lit(1))), "")

    return vectors.once(F.flatten(F.transform(codes, lambda c: F.array(*[F.shiftright(c, i).bitwiseAND(1) for i in range(nbits)]))), digits)


def unpacked(held: Column, nbits: int) -> Column:
    """The codes that `packed` wrote, as many as the digits hold."""

    def codes(bits: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(bits) - nbits + 1, F.lit(nbits))
        return F.when(F.length(bits) == 0, F.array().cast("array<int>")).otherwise(F.transform(starts, lambda at: F.conv(F.reverse(F.substring(bits, at, F.lit(nbits))), 2, 10).cast("int")))

    found = F.array_join(F.transform(F.split(held, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return vectors.once(F.when(F.length(held) == 0, F.lit("")).otherwise(found), codes)


def compressed(rows: DataFrame, centroids: DataFrame, bucket_row: DataFrame) -> DataFrame:
    """rows with code and levels (array<int>, one per component) in place of vec."""
    cut = residuals(assign(rows, centroids), centroids).crossJoin(F.broadcast(bucket_row.select("cutoffs")))
    return cut.withColumn("levels", bucketed(F.col("residual"), F.col("cutoffs"))).drop("vec", "residual", "cutoffs")


def decompressed(rows: DataFrame, centroids: DataFrame, bucket_row: DataFrame) -> DataFrame:
    """rows with vec: centroid plus the weights of the levels, at unit length."""
    held = rows.join(centroids.select("code", "centroid"), "code").crossJoin(F.broadcast(bucket_row.select("weights")))
    raw = F.zip_with("centroid", "levels", lambda c, n: c + F.get("weights", n))
    return held.withColumn("vec", vectors.normalized(raw)).drop("centroid", "weights", "levels")
