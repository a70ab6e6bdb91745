"""Dense vectors: exact search by dot product or cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.functions import vectors
from rankweave.operators import rank

#: Query vectors that travel to a task together; more are searched for in groups.
MOST_QUERIES = 20_000
#: Products of queries and documents that a task holds at a time.
HELD = 1 << 20
#: Scores that a task collects beside twice the k best of each query before it cuts them.
SPARE = 1 << 18
SIMILARITIES = ("cosine", "dot")


def search(docs: DataFrame, queries: DataFrame, k: int | None, similarity: str = "cosine", drop_self: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): queries (qid, vec) against all docs (doc_id, vec).

    Each task multiplies its documents with the queries in blocks and keeps
    the k best of each query as it goes, so that no more than these are
    shuffled, whatever the number of blocks.
    """
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity: {similarity}")
    doc, kind = docs.schema["doc_id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    schema, doc_type = f"qid {kind}, doc_id {doc}, score double", to_arrow_type(docs.schema["doc_id"].dataType)
    out = None
    for group in _groups(queries):
        qids = pa.array([q for q, _ in group])
        matrix = _prepared([v for _, v in group], similarity)

        def run(batches: Iterator[pa.RecordBatch], qids: pa.Array = qids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            step, best = max(16, HELD // max(1, len(matrix))), Best(qids, doc_type, k)
            for whole in batches:
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    scores = np.round(matrix @ _prepared(_matrix(batch.column(1)), similarity).T, rank.DIGITS)
                    if drop_self:
                        ids = batch.column(0).to_numpy(zero_copy_only=False)
                        scores[qids.to_numpy(zero_copy_only=False)[:, None] == ids[None, :]] = -np.inf
                    yield from best.add(scores, batch.column(0))
            yield from best.rest()

        part = docs.select("doc_id", "vec").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    run_ = out if out is not None else docs.sparkSession.createDataFrame([], schema)
    return rank.ranked(run_) if k is None else rank.top_k(run_, k)


class Best:
    """The k best scores of each query that a task has seen; ties go to the smaller id. Without k all finite scores go on at once.

    A block's scores are taken in where they reach the k-th best of their query
    in the block and so far; what is held is cut to k a query again and again,
    so memory is bounded by queries * k, and so is what a task puts out.
    """

    def __init__(self, qids: pa.Array, doc_type: pa.DataType, k: int | None):
        self.qids, self.k, self.doc_type = qids, k, doc_type
        self.floor = np.full(len(qids), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """scores [queries, documents]; -inf leaves a document out."""
        floor = self.floor
        if self.k is not None and scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        rows, columns = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        self.parts.append((rows, scores[rows, columns], doc_ids.take(pa.array(columns))))
        self.held += len(rows)
        if self.k is None:
            yield from self.rest()
        elif self.held > 2 * len(self.qids) * self.k + SPARE:
            self._cut()

    def _cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        rows = np.concatenate([r for r, _, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        values = np.concatenate([v for _, v, _ in self.parts]) if self.parts else np.zeros(0)
        ids = pa.concat_arrays([i for _, _, i in self.parts]) if self.parts else pa.array([], self.doc_type)
        if self.k is not None and len(rows):
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            order = order[np.lexsort((-values[order], rows[order]))]
            starts = np.searchsorted(rows[order], rows[order])
            order = order[np.arange(len(order)) - starts < self.k]
            rows, values, ids = rows[order], values[order], ids.take(pa.array(order))
            size = np.bincount(rows, minlength=len(self.qids))
            full = np.flatnonzero(size >= self.k)
            self.floor[full] = values[np.cumsum(size)[full] - 1]
        self.parts, self.held = [(rows, values, ids)], len(rows)
        return rows, values, ids

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held, as rows (qid, doc_id, score)."""
        rows, values, ids = self._cut()
        self.parts, self.held = [], 0
        if len(rows):
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(rows)), ids, pa.array(values)], ["qid", "doc_id", "score"])


def _groups(queries: DataFrame) -> Iterator[list[tuple]]:
    group = []
    for row in queries.select("qid", "vec").orderBy("qid").toLocalIterator():
        group.append((row.qid, row.vec))
        if len(group) == MOST_QUERIES:
            yield group
            group = []
    if group:
        yield group


def _matrix(lists: pa.Array) -> np.ndarray | list:
    """A row for each list, without Python's numbers where all lists are of one length."""
    values, ends = lists.flatten(), lists.offsets.to_numpy()
    if lists.null_count or values.null_count or not len(lists) or len(np.unique(np.diff(ends))) > 1:
        return lists.to_pylist()
    return values.to_numpy().reshape(len(lists), -1)


def _prepared(rows: list | np.ndarray, similarity: str) -> np.ndarray:
    matrix = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    if similarity == "cosine":
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
    return matrix


def pair_scores(pairs: DataFrame, similarity: str = "cosine") -> DataFrame:
    """(qid, doc_id, score) of rows (qid, doc_id, q_vec, vec), by column expressions."""
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity: {similarity}")
    of = vectors.cosine if similarity == "cosine" else vectors.dot
    return pairs.select("qid", "doc_id", of(F.col("q_vec"), F.col("vec")).alias("score"))


def score_pairs(pairs: DataFrame, score) -> DataFrame:
    """(qid, doc_id, score) of candidate rows (qid, doc_id, query, text) by a model: score(queries, texts) -> floats, a batch at a time."""
    kind, doc = (pairs.schema[c].dataType.simpleString() for c in ("qid", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["qid", "doc_id", "score"])

    return pairs.select("qid", "doc_id", "query", "text").mapInArrow(run, f"qid {kind}, doc_id {doc}, score double")


def token_overlap(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a pair model: share of the query's distinct words that the text has."""
    out = []
    for query, text in zip(queries, texts):
        words = set((query or "").lower().split())
        out.append(len(words & set((text or "").lower().split())) / len(words) if words else 0.0)
    return out
