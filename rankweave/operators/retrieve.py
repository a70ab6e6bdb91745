"""First-stage lexical retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.functions.batches import SLICE, slices, term_counts_of
from rankweave.operators import rank, sparse, stats
from rankweave.operators.dense import Best
from rankweave.operators.interact import MOST_QUERY_TOKENS, query_groups

METHODS = ("kernel", "relational")
#: Scores that a task holds at a time.
HELD = 1 << 22
#: Pairs of a text's term and a query with it that a task weighs at a time, about.
PAIRS = 1 << 20


def bm25(doc_arrays: DataFrame, query_arrays: DataFrame, k: int | None, k1: float = 0.9, b: float = 0.4, kind: str = "plain", method: str = "kernel", shard: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): sum of posting weights over query tokens, repeats counted.

    shard names a column of doc_arrays whose values are ranked apart and stand
    first in the result; statistics are those of all documents.

    Documents without any query term are absent. kernel: the queries, in
    groups of bounded size, travel to the documents, which are read twice, for
    the frequencies of the query terms and for the scores; each task puts out its
    k best of each query, and shard. relational: postings of the query terms are joined with the
    queries, so every scored pair is exchanged.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if kind not in ("plain", "smooth"):
        raise ValueError(f"unknown idf: {kind}")
    by = ("qid",) if shard is None else (shard, "qid")
    if method == "relational":
        run = _relational(doc_arrays, query_arrays, k1, b, kind)
        if shard is not None:
            run = run.join(doc_arrays.select("doc_id", shard), "doc_id").select(*by, "doc_id", "score")
    else:
        run = _by_kernel(doc_arrays, query_arrays, k, k1, b, kind, shard)
    return rank.ranked(run, by) if k is None else rank.top_k(run, k, by)


def _relational(doc_arrays: DataFrame, query_arrays: DataFrame, k1: float, b: float, kind: str) -> DataFrame:
    query_tf = stats.term_frequency(query_arrays, "qid").withColumnRenamed("tf", "qtf")
    postings = stats.posting_weights(doc_arrays, k1, b, kind, terms=query_tf)
    run = postings.join(query_tf, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))
    return rank.rounded(run)


def _by_kernel(doc_arrays: DataFrame, query_arrays: DataFrame, k: int | None, k1: float, b: float, kind: str, shard: str | None) -> DataFrame:
    doc_type = to_arrow_type(doc_arrays.schema["doc_id"].dataType)
    qid_kind, doc = query_arrays.schema["qid"].dataType.simpleString(), doc_arrays.schema["doc_id"].dataType.simpleString()
    schema = f"qid {qid_kind}, doc_id {doc}, score double"
    if shard is not None:
        schema = f"`{shard}` {doc_arrays.schema[shard].dataType.simpleString()}, {schema}"
    shard_type = None if shard is None else to_arrow_type(doc_arrays.schema[shard].dataType)
    out = None
    for group in query_groups(query_arrays):
        terms: dict[str, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for q, (_, tokens) in enumerate(group):
            for token in tokens:
                key = terms.setdefault(token, len(terms)), q
                pairs[key] = pairs.get(key, 0) + 1
        order = sorted(pairs)
        owner = np.array([q for _, q in order], np.int64)
        repeats = np.array([pairs[x] for x in order], np.float64)
        bounds = np.searchsorted(np.array([t for t, _ in order], np.int64), np.arange(len(terms) + 1))
        n_docs, n_tokens, df = stats.term_counts(doc_arrays, terms)
        df = np.maximum(df, 1)
        idf = np.log(n_docs / df) if kind == "plain" else np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        gain, mean = (1 + k1 if kind == "plain" else 1.0), n_tokens / max(n_docs, 1)
        qids, names = pa.array([q for q, _ in group]), pa.array(list(terms), pa.string())
        n = len(group)

        def run(batches: Iterator[pa.RecordBatch], names=names, owner=owner, repeats=repeats, bounds=bounds, idf=idf, gain=gain, mean=mean, qids=qids, n=n) -> Iterator[pa.RecordBatch]:
            step, kept = max(16, HELD // max(n, 1)), {}

            def told(part: Any, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for found in rows:
                    own = [] if shard is None else [pa.array([part] * found.num_rows, shard_type)]
                    yield pa.RecordBatch.from_arrays([*own, *found.columns], [*([] if shard is None else [shard]), *found.schema.names])

            for whole in slices(batches, 4 * SLICE):
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    scores, lists = np.full((batch.num_rows, n), -np.inf), batch.column(1)
                    rows, own, tf = term_counts_of(lists, names)
                    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[rows]
                    weight, size = idf[own] * (tf * gain / (tf + k1 * (1 - b + b * lens / mean))), bounds[own + 1] - bounds[own]
                    upto, edges = np.cumsum(size), np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
                    low_edge = 0
                    while low_edge < len(edges) - 1:  # texts with up to PAIRS pairs of a term and a query, or one text
                        start = edges[low_edge]
                        most = (upto[start - 1] if start else 0) + PAIRS
                        high_edge = max(low_edge + 1, int(np.searchsorted(upto[edges[1:] - 1], most, "right")))
                        part = slice(start, edges[high_edge])
                        size_, first, last = size[part], rows[start], rows[edges[high_edge] - 1]
                        at = np.repeat(bounds[own[part]] - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
                        cell = np.repeat((rows[part] - first) * n, size_) + owner[at]
                        cells = (last - first + 1) * n
                        total = np.bincount(cell, np.repeat(weight[part], size_) * repeats[at], minlength=cells)
                        hit = np.zeros(cells, bool)
                        hit[cell] = True
                        scores[first : last + 1].reshape(-1)[hit] = total[hit]
                        low_edge = high_edge
                    scores = scores.T
                    scores, parts = np.round(scores, rank.DIGITS), batch.column(2).to_pylist()
                    for part in set(parts):
                        best = kept.setdefault(part, Best(qids, doc_type, k))
                        own = np.array([x == part for x in parts])
                        yield from told(part, best.add(scores[:, own], batch.column(0).filter(pa.array(own))))
            for part, best in kept.items():
                yield from told(part, best.rest())

        of = F.lit(0) if shard is None else F.col(shard)
        part = doc_arrays.select("doc_id", "tokens", of.alias("part")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else doc_arrays.sparkSession.createDataFrame([], schema)


def postings_score(postings: DataFrame, query_weights: DataFrame) -> DataFrame:
    """(qid, doc_id, score): sparse dot product of document (term, weight) and query (term, q_weight) rows."""
    return postings.join(query_weights, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))


def vector_groups(query_weights: DataFrame, most: int = MOST_QUERY_TOKENS) -> Iterator[list[tuple[Any, list[str], list[float]]]]:
    """Sparse queries (qid, term, q_weight) as (qid, terms, weights), in groups of at most `most` terms (or one query)."""
    rows = query_weights.groupBy("qid").agg(F.collect_list(F.struct("term", "q_weight")).alias("own")).orderBy("qid")
    group, held = [], 0
    for row in rows.toLocalIterator():
        if group and held + len(row.own) > most:
            yield group
            group, held = [], 0
        group.append((row.qid, [t for t, _ in row.own], [w for _, w in row.own]))
        held += len(row.own)
    if group:
        yield group


def sparse_top_k(doc_weights: DataFrame, query_weights: DataFrame, k: int) -> DataFrame:
    """sparse_vectors_top_k of documents (doc_id, term, weight), a row a term, which are gathered first."""
    return sparse_vectors_top_k(sparse.gathered_weights(doc_weights), query_weights, k)


def sparse_vectors_top_k(vectors: DataFrame, query_weights: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): the k best sparse dot products of documents (doc_id, term, weight), arrays, and queries (qid, term, q_weight).

    A document's terms are in one row, and queries travel to the
    documents in groups of bounded size, so a term in all documents and many
    queries meets nowhere in one task, and a task puts out no more than k
    documents a query. Documents that share no term with a query are absent.
    """
    kind, doc = query_weights.schema["qid"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()
    doc_type, schema = to_arrow_type(vectors.schema["doc_id"].dataType), f"qid {kind}, doc_id {doc}, score double"
    out = None
    for group in vector_groups(query_weights):
        terms: dict[str, int] = {}
        triples = sorted((terms.setdefault(t, len(terms)), q, w) for q, (_, own, weights) in enumerate(group) for t, w in zip(own, weights, strict=True))
        owner, share = np.array([q for _, q, _ in triples], np.int64), np.array([w for _, _, w in triples], np.float64)
        bounds = np.searchsorted(np.array([t for t, _, _ in triples], np.int64), np.arange(len(terms) + 1))
        qids, n = pa.array([q for q, _, _ in group]), len(group)

        def run(batches: Iterator[pa.RecordBatch], terms=terms, owner=owner, share=share, bounds=bounds, qids=qids, n=n) -> Iterator[pa.RecordBatch]:
            step, best = max(16, HELD // max(n, 1)), Best(qids, doc_type, k)
            for whole in slices(batches, 4 * SLICE):
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    scores = np.full((n, batch.num_rows), -np.inf)
                    for row, (own, weights) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                        both = [(terms[t], w) for t, w in zip(own, weights, strict=True) if t in terms]
                        if not both:
                            continue
                        at = np.array([t for t, _ in both], np.int64)
                        size = bounds[at + 1] - bounds[at]
                        places = np.repeat(bounds[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        to = owner[places]
                        total = np.bincount(to, np.repeat(np.array([w for _, w in both]), size) * share[places], minlength=n)
                        hit = np.zeros(n, bool)
                        hit[to] = True
                        scores[hit, row] = total[hit]
                    yield from best.add(np.round(scores, rank.DIGITS), batch.column(0))
            yield from best.rest()

        part = vectors.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return rank.top_k(out if out is not None else vectors.sparkSession.createDataFrame([], schema), k)
