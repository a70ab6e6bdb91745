"""Search on packed codes of token vectors, which are never read back.

A document's token vector is kept as its centroid's number, a level of nbits
for each component of the rest, packed into bytes, and the length of what these
stand for. For a query vector q, the product with such a vector is q . centroid
plus, for each byte, an entry of a table that holds q's products with the
weights of all 256 values of that byte; over the length, it is the cosine. A
search adds table entries; no component is unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.functions import weights
from rankweave.functions.batches import token_lists
from rankweave.operators import codec, interact, stats
from rankweave.operators.encode import Encoder, TwoTowers, pooled, sides

#: Components of all centroids that travel with a task at most.
MOST = 1 << 24
POSTINGS = "doc_id {doc}, doc_len long, term string, codes array<int>, packed binary, sizes array<double>"


@dataclass(frozen=True)
class Codec:
    """Centroids by number, cut-offs and weights of levels."""

    centroids: np.ndarray
    cutoffs: np.ndarray
    weights: np.ndarray
    nbits: int

    @staticmethod
    def of(centroids: DataFrame, bucket_row: DataFrame, nbits: int) -> Codec:
        """From (code, centroid) and the row of codec.buckets; an error where the centroids are too many to travel."""
        n, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
        codec.check(dim, nbits)
        if n * dim > MOST:
            raise ValueError(f"{n} centroids of {dim} components are more than {MOST}")
        held = [r.centroid for r in centroids.orderBy("code").collect()]
        row = bucket_row.first()
        return Codec(np.array(held, np.float64), np.array(row.cutoffs), np.array(row.weights), nbits)

    def packed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of centroids, bytes, lengths) of vectors; of equal products the first centroid counts."""
        codes = np.round(vectors @ self.centroids.T, 9).argmax(axis=1)
        rest, levels = vectors - self.centroids[codes], np.zeros(vectors.shape, np.uint8)
        for cutoff in self.cutoffs:
            levels += rest > cutoff
        bits = np.stack([(levels >> n) & 1 for n in range(self.nbits)], axis=2)
        sizes = np.linalg.norm(self.centroids[codes] + self.weights[levels], axis=1)
        return codes, np.packbits(bits.reshape(len(vectors), -1), axis=1), np.where(sizes > 0, sizes, 1.0)

    def byte_weights(self) -> np.ndarray:
        """256 x components of a byte: the weights that each value stands for."""
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, -1, self.nbits)
        return self.weights[(bits << np.arange(self.nbits)).sum(axis=2)]

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query its products with the centroids, and with the values of each byte."""
        own = self.byte_weights()
        return queries @ self.centroids.T, queries.reshape(len(queries), -1, own.shape[1]) @ own.T

    @staticmethod
    def products(tables: tuple[np.ndarray, np.ndarray], codes: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """queries x vectors: sums of table entries over the vectors' lengths."""
        by_centroid, by_byte = tables
        total = by_centroid[:, codes]
        for place in range(data.shape[1]):
            total = total + by_byte[:, place, data[:, place]]
        return total / sizes


def postings(doc_arrays: DataFrame, encoder: Encoder | TwoTowers, own: Codec, pooler: str = "local_average", window: int = 3) -> DataFrame:
    """(doc_id, doc_len, term, codes, packed, sizes): a row per document and term, with all its positions in order."""
    doc = doc_arrays.schema["doc_id"].dataType.simpleString()
    encoder = sides(encoder)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                at, lens, terms, counts, codes, data, sizes = [], [], [], [], [], [], []
                for row, tokens in enumerate(token_lists(part.column(1))):
                    if not tokens:
                        continue
                    found = own.packed(pooled(encoder, tokens, pooler, window))
                    places: dict[str, int] = {}
                    term = np.array([places.setdefault(t, len(places)) for t in tokens])
                    order = np.argsort(term, kind="stable")
                    at.append(np.full(len(places), row)), lens.append(np.full(len(places), len(tokens))), terms.extend(places), counts.append(np.bincount(term))
                    for column, values in zip((codes, data, sizes), found, strict=True):
                        column.append(values[order])
                if not at:
                    continue
                ends = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
                held = np.concatenate(data)
                packs = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * np.int32(held.shape[1])), pa.py_buffer(held.tobytes())])
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(t))) for x, t in ((codes, np.int32), (sizes, np.float64))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(lens)), pa.array(terms, pa.string()), lists[0], packs, lists[1]],
                    ["doc_id", "doc_len", "term", "codes", "packed", "sizes"],
                )

    return doc_arrays.select("doc_id", "tokens").mapInArrow(run, POSTINGS.format(doc=doc))


def matches(posting_rows: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, own: Codec, candidates: DataFrame | None = None, pooler: str = "local_average", window: int = 3) -> DataFrame:
    """What interact.exact_matches puts out, from postings: only those of the queries' terms, and of candidates where they are given."""
    kind, doc = query_arrays.schema["qid"].dataType.simpleString(), posting_rows.schema["doc_id"].dataType.simpleString()
    asking = sides(encoder)[0]
    qid_type = to_arrow_type(query_arrays.schema["qid"].dataType)
    schema = interact.MATCH.format(kind=kind, doc=doc)
    names = [x.split()[0] for x in schema.split(", ")]
    rows = posting_rows
    if candidates is not None:
        rows = interact.asked_for(rows, candidates)
    else:
        rows = rows.withColumn("wanted", F.lit(None).cast(f"array<{kind}>"))
    rows = rows.select("doc_id", "doc_len", "term", "codes", "packed", "sizes", "wanted")
    out = None
    for group in interact.query_groups(query_arrays):
        pack = interact.QueryPack(group, asking, pooler, window)
        terms = posting_rows.sparkSession.createDataFrame([(t,) for t in pack.by_term], "term string")
        asked = rows.join(F.broadcast(terms), "term", "left_semi").select(rows.columns)

        def run(batches: Iterator[pa.RecordBatch], pack: interact.QueryPack = pack) -> Iterator[pa.RecordBatch]:
            tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            owners = {term: [pack.qids[n] for n in numbers] for term, (numbers, _, _) in pack.by_term.items()}
            for batch in batches:
                found: list[list] = [[] for _ in names]
                terms = batch.column(2).to_pylist()
                all_codes, edges = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
                all_sizes, lens, edges = batch.column(5).flatten().to_numpy(), batch.column(1).to_pylist(), edges - edges[0]
                for row, term in enumerate(terms):
                    if term not in pack.by_term:
                        continue
                    numbers, starts, queries = pack.by_term[term]
                    if term not in tables:
                        tables[term] = own.tables(queries)
                    wanted = batch.column(6)[row].as_py()
                    allowed = None if wanted is None else set(wanted)
                    if allowed is not None and allowed.isdisjoint(owners[term]):
                        continue
                    codes, sizes = (x[edges[row] : edges[row + 1]] for x in (all_codes, all_sizes))
                    data = np.frombuffer(batch.column(4)[row].as_py(), np.uint8).reshape(len(codes), -1)
                    most = own.products(tables[term], codes, data, sizes).max(axis=1)
                    totals, bests = np.add.reduceat(np.maximum(most, 0), starts), np.maximum.reduceat(most, starts)
                    counts = np.diff(np.append(starts, len(most)))
                    for number, n, total, best in zip(numbers.tolist(), counts.tolist(), totals.tolist(), bests.tolist(), strict=True):
                        if allowed is None or pack.qids[number] in allowed:
                            for column, value in zip(found, (pack.qids[number], row, lens[row], term, len(codes), n, total, best), strict=True):
                                column.append(value)
                types = [qid_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                arrays[1] = batch.column(0).take(arrays[1])
                yield pa.RecordBatch.from_arrays(arrays, names)

        part = asked.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else posting_rows.sparkSession.createDataFrame([], schema)


def cbm25(posting_rows: DataFrame, doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, own: Codec, candidates: DataFrame | None = None, k1: float = weights.RERANK[0], b: float = weights.RERANK[1], window: int = 3) -> DataFrame:
    """(qid, doc_id, score): contextual BM25 over packed token vectors."""
    found = matches(posting_rows, query_arrays, encoder, own, candidates, window=window)
    scores = interact.scored(found, interact.query_term_idf(doc_arrays, query_arrays), stats.summary(doc_arrays), k1=k1, b=b)
    return scores.withColumnRenamed("maxsim_bm25_qtf", "score")
