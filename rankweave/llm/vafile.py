"""Codes for vectors: codebooks of a part each, their entries found through a vector-approximation file.

A vector's components become integers and are cut into parts; each part has a
codebook of integer entries. To find the entry nearest to a part, the entries'
coordinates are first quantised: in each dimension their values are cut into
2^BITS cells of equal population, and a cell keeps its least and greatest value.
For a query, a table per dimension gives the least and the greatest squared
difference to each cell; summed along an entry's cells they bound its distance
from both sides. An entry whose lower bound lies above the least upper bound of
all is out; the others are refined with integer distances, which alone decide.
Bounds are in single precision with a margin beyond its rounding, so nothing is
lost and the result is exact.

Codebooks are improved in rounds: each task adds up, by part and entry, its
parts and their number, Spark adds up the tasks, and the entries (a number that
no input makes larger) come to the driver and go out again.

Defined cases: rows whose vector is null or holds null or non-finite components
are left out; an empty vector and shorter ones are filled with zeros to the
longest, and all to a multiple of the parts; scaled components beyond the
largest at which squared distances fit 64 bits (2^27 for parts of 16) count as
that; rows without vec_id are encoded, and start no entry unless there are too
few others; of equal vec_ids the least vector comes first; with fewer rows than
entries the codebook is as short as the rows; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a coordinate's cell; queries times components of a codebook that are compared at once.
BITS, AT_ONCE = 3, 1 << 23


def usable(embedding: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(embedding.isNotNull() & F.forall(embedding, value), F.lit(False))


def integers(vectors: pa.Array, width: int, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of lists of numbers as rows x parts x (width / parts)."""
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    most = math.isqrt((1 << 61) // max(1, width // parts)) // 2
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -most, most).astype(np.int64).reshape(len(sizes), parts, width // parts)


class Approximation:
    """A codebook's entries, approximated by the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        self.cells = min(1 << bits, n)
        #: Of each dimension and cell, the least and the greatest coordinate in it.
        self.low, self.high = np.zeros((width, self.cells), np.float32), np.zeros((width, self.cells), np.float32)
        member = np.zeros((n, width, self.cells), np.float32)
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            for cell, own in enumerate(np.array_split(order, self.cells)):
                member[own, d, cell] = 1
                self.low[d, cell], self.high[d, cell] = entries[own, d].min(), entries[own, d].max()
        self.member = np.ascontiguousarray(member.reshape(n, -1).T)
        self.margin = np.float32((width * self.cells + 8) * 2.0**-22)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, queries x entries: tables by query, summed along the cells."""
        points = queries.astype(np.float32)[:, :, None]
        below, above = self.low - points, points - self.high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(-below, -above)
        lower = (least * least).reshape(len(queries), -1) @ self.member
        upper = (most * most).reshape(len(queries), -1) @ self.member
        # integers beyond 2^24 are rounded on their way to single precision
        slack = np.float32(2.0**-22) * (np.abs(queries).max(axis=1) + np.abs(self.entries).max()).astype(np.float32)[:, None]
        slack = np.where(slack < 2, np.float32(0), slack)
        lower = np.maximum(np.sqrt(lower) * (1 - self.margin) - slack * len(self.low), 0)
        upper = np.sqrt(upper) * (1 + self.margin) + slack * len(self.low)
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the nearest entry (the first of equals), its squared distance, and how many entries were refined."""
        lower, upper = self.bounds(queries)
        rows, columns = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        apart = queries[rows] - self.entries[columns]
        distances = np.einsum("ij,ij->i", apart, apart)
        refined = np.bincount(rows, minlength=len(queries))
        starts = np.cumsum(refined) - refined
        least = np.minimum.reduceat(distances, starts)
        hits = np.flatnonzero(distances == least[rows])
        first = hits[np.searchsorted(rows[hits], np.arange(len(queries)))]
        return columns[first], least, refined


def assigned(points: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, refined entries), rows x parts, of points (rows x parts x width)."""
    codes, errors, refined = (np.zeros(points.shape[:2], np.int64) for _ in range(3))
    for part, entries in enumerate(codebooks):
        file = Approximation(entries)
        step = max(1, AT_ONCE // max(1, entries.size))
        for low in range(0, len(points), step):
            rows = slice(low, low + step)
            codes[rows, part], errors[rows, part], refined[rows, part] = file.nearest(points[rows, part])
    return codes, errors, refined


def trained(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width / parts) after the rounds, from kept vectors."""
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()
    codebooks = np.ascontiguousarray(integers(start, width, parts).swapaxes(0, 1))
    size = width // parts
    for _ in range(rounds):
        now = codebooks

        def added(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            totals, counts = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                points = integers(batch["embedding"], width, parts)
                codes, _, _ = assigned(points, now)
                for part in range(parts):
                    order = np.argsort(codes[:, part], kind="stable")
                    own, starts, n = np.unique(codes[order, part], return_index=True, return_counts=True)
                    totals[part, own] += np.add.reduceat(points[order, part], starts, axis=0)
                    counts[part, own] += n
            part, entry = np.nonzero(counts)
            of = np.repeat(np.arange(len(part)), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[of], pa.int32()), pa.array(entry[of], pa.int32()), pa.array(np.tile(np.arange(size), len(part)), pa.int32()), pa.array(totals[part, entry].reshape(-1)), pa.array(counts[part, entry][of])],
                ["part", "entry", "place", "total", "n"],
            )

        sums = kept.select("embedding").mapInArrow(added, "part int, entry int, place int, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # parts x entries x width rows at most
        codebooks = now.copy()
        at = tuple(sums[name].to_numpy() for name in ("part", "entry", "place"))
        codebooks[at] = np.floor_divide(sums["total"].to_numpy(), sums["n"].to_numpy())
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, refined) of each kept row, the codebooks); entries at most 256."""
    kept = vectors.select("vec_id", "embedding", "label").where(usable(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    codebooks = trained(kept, width, parts, entries, rounds)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, refined = assigned(integers(batch["embedding"], width, parts), codebooks)
            text = ["".join(row) for row in digits[codes].tolist()]
            columns = [batch["vec_id"], batch["label"], pa.array(text, pa.string()), pa.array(errors.sum(axis=1)), pa.array(refined.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "refined"])

    kinds = {name: kept.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    named = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, refined long"
    return written(kept.select("vec_id", "label", "embedding").mapInArrow(coded, named), "codes"), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the error summed over equal labels, nulls together.

    Sums meet each row again by label; Catalyst sees the size of both written
    tables, sends the smaller one where it is small, and splits a hot label's
    rows elsewhere.
    """
    own = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("own", own).drop("label"), "label-errors")
    return codes.withColumn("own", own).join(sums, "own").drop("own")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, codebooks = encoded(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """Every part against every entry, in each round."""
    nearest = "arg_min(e, struct_pack(d := dot(pq, pq) - 2 * dot(pq, eq) + dot(eq, eq), e := e))".replace("dot(", "list_inner_product(")
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, p, any_value(pq) AS pq, {nearest} AS e FROM x JOIN c{r} USING (p) GROUP BY i, p)")
        steps.append(f"s{r} AS (SELECT p, e, j, floor(sum(pq[j]) / count(*)) AS m FROM a{r}, range(1, 17) t(j) GROUP BY p, e, j)")
        steps.append(f"n{r} AS (SELECT p, e, list(m ORDER BY j) AS eq FROM s{r} GROUP BY p, e)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.eq, c.eq) AS eq FROM c{r} c LEFT JOIN n{r} n USING (p, e))")
    distance = "list_inner_product(pq, pq) - 2 * list_inner_product(pq, eq) + list_inner_product(eq, eq)"
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: floor({SCALE} * v)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM k),
x AS MATERIALIZED (SELECT i, p, q[p * 16 + 1 : p * 16 + 16] AS pq FROM o, range({PARTS}) t(p)),
c0 AS (SELECT p, i AS e, pq AS eq FROM x WHERE i < {ENTRIES}),
{", ".join(steps)},
f AS (SELECT i, p, {nearest} AS e, min({distance}) AS d FROM x JOIN c{ROUNDS} USING (p) GROUP BY i, p),
g AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY i),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, j, eq[j] AS v FROM c{ROUNDS}, range(1, 17) t(j)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g JOIN o USING (i), h
"""


ORACLE_SQL = _sql()
