"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within a cell.

Two unit vectors at cosine >= t lie at most sqrt(2 - 2t) apart. If x has its
home in cell c, then x.c >= x.h for the home h of any y, so a y that links with
x has y.(h - c) <= |y - x| |h - c|: y visits every cell c within that margin,
and x meets all its links in its home cell. No link is lost, however the cells
fall; k-means, fitted on a bounded sample, only decides how much is compared.

Equal vectors are counted once, as a class, known by two hashes of 64 bits, so a
vector is a key nowhere. Cells are as many as the vectors ask for, up to a
quarter of the sample; beyond that they grow. A cell's rows are dealt into
blocks of about `BLOCK`, and pairs of blocks are compared by one matrix product
each. A block puts out how many vectors each row links with, and only so many
links as connect what is linked in it.

Defined cases: a vector that is null, empty, zero, or has null or non-finite
components, or a null label, links with nothing and stands alone; vectors of
different length never link, however long they are; repeated rows are vectors of
their own; a null vec_id counts as a vector but gives no id to its component; a
cosine of exactly the threshold links; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.graph import connected_components
from rankweave.llm.shared import table, written

THRESHOLD = 0.98
#: Vectors that k-means is fitted on at most, and for one cell at least; its rounds; vectors of a label wanted in a cell.
SAMPLE, OF_A_CELL, ROUNDS, CELL = 20_000, 4, 8, 1000
#: Rows of a block, about.
BLOCK = 2048


def unit(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of unit length in double precision, filled up with zeros to the width."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        out = values.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell restarts at the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), size=min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        scores = vectors @ centroids.T
        home, fit = scores.argmax(axis=1), scores.max(axis=1)
        for cell in range(len(centroids)):
            own = vectors[home == cell].sum(axis=0)
            if np.linalg.norm(own) < 1e-12:
                own = vectors[fit.argmin()]
                fit[fit.argmin()] = 2
            centroids[cell] = own / np.linalg.norm(own)
    return centroids


def usable(embedding: Column, label: Column) -> Column:
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & F.forall(embedding, value) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def compare(home: np.ndarray, others: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(vectors that each home row links with, links that connect what is linked)."""
    linked = (home @ others.T >= threshold) & (home_ids[:, None] != other_ids[None, :])
    counts = linked @ copies
    links: list[tuple[int, int]] = []
    rows = np.flatnonzero(linked.any(axis=1)).tolist()
    open_rows, open_columns = linked.any(axis=1), linked.any(axis=0)
    for start in rows:
        if not open_rows[start]:
            continue
        open_rows[start] = False
        queue, head = [(start, True)], int(home_ids[start])
        while queue:
            at, is_row = queue.pop()
            if is_row:
                new = np.flatnonzero(linked[at] & open_columns)
                open_columns[new] = False
                links += [(head, x) for x in other_ids[new].tolist() if x != head]
            else:
                new = np.flatnonzero(linked[:, at] & open_rows)
                open_rows[new] = False
                links += [(head, x) for x in home_ids[new].tolist() if x != head]
            queue += [(x, not is_row) for x in new.tolist()]
    return counts, links


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    rows = vectors.select("vec_id", "embedding", "label").withColumn("usable", usable(F.col("embedding"), F.col("label")))
    same = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.reverse("embedding"), "label").alias("k2")]
    keys = ["k1", "k2"]
    distinct = rows.where("usable").select("vec_id", "label", "embedding", *same).groupBy(*keys)
    distinct = distinct.agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).alias("width")).first()
    width = size.width or 0
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()  # bounded by SAMPLE
    k = max(1, min(len(sample) // OF_A_CELL, round(size.n / max(1, size.labels) / cell)))
    centroids = spherical_kmeans(unit(sample, width), k) if len(sample) else np.zeros((1, 1))
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))  # of unit vectors
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) * apart + 1e-7

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                scores = unit(batch.column(batch.schema.get_field_index("embedding")), width) @ centroids.T
                home = scores.argmax(axis=1)
                at, cells = np.nonzero(scores[np.arange(len(home)), home][:, None] - scores <= margin[home])
                placed = batch.take(pa.array(at))
                columns = [*placed.columns, pa.array(cells, pa.int32()), pa.array(cells == home[at])]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "home"])

    carried = classes.select("label", F.size("embedding").alias("dims"), "cls", "copies", "embedding")
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema.fields) + ", cell int, home boolean"
    key = ["label", "dims", "cell"]
    placed = written(carried.mapInArrow(assign, named), "placed")
    blocks = placed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    homes = placed.where("home").select(*key, F.col("own").alias("row"), every.alias("column"), F.lit(True).alias("side"), "cls", "copies", "embedding")
    others = placed.select(*key, every.alias("row"), F.col("own").alias("column"), F.lit(False).alias("side"), "cls", "copies", "embedding")

    def within(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        ids, copies = group["cls"].to_numpy(), group["copies"].to_numpy()
        a = b = n = np.zeros(0, np.int64)
        if side.any():
            points = unit(group["embedding"].combine_chunks(), group["dims"][0].as_py())
            counts, links = compare(points[side], points[~side], ids[side], ids[~side], copies[~side], threshold)
            pairs, own = np.array(links, dtype=np.int64).reshape(-1, 2), ids[side][counts > 0]
            a, b = np.concatenate([own, pairs[:, 0]]), np.concatenate([own, pairs[:, 1]])
            n = np.concatenate([counts[counts > 0], np.zeros(len(pairs), np.int64)])
        return pa.table({"a": a, "b": b, "n": n.astype(np.int64)})

    found = written(homes.union(others).groupBy(*key, "row", "column").applyInArrow(within, "a long, b long, n long"), "links")
    members = connected_components(found.where("a <> b").select("a", "b"))
    linked = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cls")
    roots = classes.select(*keys, "cls", "least", "copies").join(members.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left")
    roots = roots.withColumn("root", F.coalesce("component", "cls"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    result = roots.join(least, "root").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("usable").select("vec_id", *same).join(result, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Brute force; pairs of one label are few enough for SQL on the test tables only.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
