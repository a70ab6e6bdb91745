"""A BM25 index kept as Parquet: postings in blocks of documents, with the most that each block can give.

Documents are laid out by length, in blocks of `block_docs`; a term's postings
in a block are one row: its documents, their saturated frequencies and the
largest of these. The rows are range-partitioned by term and block from a
sample, so a term in most documents is split over many files, and sorted, so a
file's row groups carry the terms they hold.

A search deals the postings of its terms by block; the queries, in groups of
bounded size, travel to them. A task bounds a block for each query from above by
the largest values of its rows, and a block whose bound is below the k-th best
score that the task has seen is not scored for that query. A task puts out its
k best of each query, so neither what is dealt nor what is put out grows with
queries times documents.

The relational search, for few terms, reads the heads of its terms' blocks (term, block, largest)
and scores the blocks that promise most: the k-th best score there is a floor.
A block whose bound is below the floor is never joined with its documents. In the others, the terms that even
together stay below the floor decide nothing: a document without any other term
cannot enter, so only the other terms' postings are read, and of the rest those
of the blocks in which a document can still reach the floor. The result is that
of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.operators import rank, stats
from rankweave.operators.dense import Best
from rankweave.operators.retrieve import METHODS, vector_groups
from rankweave.sources.folders import kept

BLOCK_DOCS = 128
#: Shares of queries in a block's terms that are multiplied at a time.
SHARES = 1 << 22
#: Terms of all queries that are pushed down to the files as a list, at most; beyond, the join alone selects.
PUSHED_TERMS = 5000
#: Queries whose floors, a number each, are broadcast at most.
MOST_FLOORS = 100_000
#: Bounds this far below the k-th score are kept, for scores are rounded.
MARGIN = 10.0 ** -rank.DIGITS


def block_rows(doc_arrays: DataFrame, n_docs: int, n_tokens: int, k1: float, b: float, kind: str, block_docs: int) -> DataFrame:
    """(term, block, n, top, docs, gains): one row per term and block of documents.

    A block's documents are neighbours in one task, so no posting is exchanged
    before its block is complete.
    """
    doc = doc_arrays.schema["doc_id"].dataType.simpleString()
    factor, mean = (1 + k1 if kind == "plain" else 1.0), n_tokens / max(n_docs, 1)
    laid = doc_arrays.select("doc_id", "tokens", F.size("tokens").alias("doc_len")).repartitionByRange(F.col("doc_len"), F.col("doc_id"))
    laid = laid.sortWithinPartitions("doc_len", "doc_id").select("doc_id", "tokens", F.floor(F.monotonically_increasing_id() / block_docs).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches):
            ids, lists, n = block.column("doc_id"), block.column("tokens"), block.num_rows
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            words = lists.flatten().dictionary_encode("encode")
            keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
            if not len(keys):
                continue
            term, at = keys // n, keys % n
            gain = tf * factor / (tf + k1 * (1 - b + b * lens[at] / mean))
            sizes = np.bincount(term)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            top, now = np.maximum.reduceat(gain, offsets[:-1]), block.column("block")[0].as_py()
            columns = [words.dictionary, pa.array(np.full(len(sizes), now, np.int64)), pa.array(sizes), pa.array(top), pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(at))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(gain))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "top", "docs", "gains"])

    return laid.mapInArrow(run, f"term string, block long, n long, top double, docs array<{doc}>, gains array<double>")


def build(doc_arrays: DataFrame, path: str, k1: float = 0.9, b: float = 0.4, kind: str = "plain", block_docs: int = BLOCK_DOCS) -> Index:
    """Writes the index of (doc_id, tokens) to a folder, which must not exist: blocks, terms and a row of statistics."""
    if kind not in ("plain", "smooth"):
        raise ValueError(f"unknown idf: {kind}")
    spark = doc_arrays.sparkSession
    whole = stats.summary(doc_arrays).first()
    rows = kept(block_rows(doc_arrays, whole.n_docs, whole.n_tokens, k1, b, kind, block_docs), "block-rows")  # a range partition reads its rows twice
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    counts = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_blocks"))
    known = F.lit(float(whole.n_docs)) / F.col("df") if kind == "plain" else 1 + (F.lit(whole.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    counts.withColumn("idf", F.log(known)).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spark.createDataFrame([(whole.n_docs, whole.n_tokens, k1, b, kind, block_docs)], "n_docs long, n_tokens long, k1 double, b double, kind string, block_docs int").coalesce(1).write.parquet(f"{path}/stats")
    return Index(spark, path)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)).tolist()
        for low, high in zip(starts, [*starts[1:], len(block)]):
            if held and held[0].column("block")[0].as_py() != block[low]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


class BlockScorer:
    """Scores blocks for queries (qid, terms, shares of the terms) that a block's bound does not rule out."""

    def __init__(self, group: list[tuple]):
        terms: dict[str, int] = {}
        triples = sorted((terms.setdefault(t, len(terms)), q, w) for q, (_, own, shares) in enumerate(group) for t, w in zip(own, shares, strict=True))
        self.qids, self.terms = pa.array([q for q, _, _ in group]), pa.array(list(terms), pa.string())
        self.owner, self.share = np.array([q for _, q, _ in triples], np.int64), np.array([w for _, _, w in triples], np.float64)
        self.bounds = np.searchsorted(np.array([t for t, _, _ in triples], np.int64), np.arange(len(terms) + 1))
        self.scored = 0

    def add(self, block: pa.RecordBatch, best: Best, k: int) -> Iterator[pa.RecordBatch]:
        """Takes a block's (term, top, docs, gains) into the best; self.scored counts pairs of a query and a block."""
        at = pc.fill_null(pc.index_in(block.column("term"), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        rows, n = np.flatnonzero(at >= 0), len(self.qids)
        if not len(rows):
            return
        at, block = at[rows].astype(np.int64), block.take(pa.array(rows))
        size = self.bounds[at + 1] - self.bounds[at]
        places = np.repeat(self.bounds[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner, share, row = self.owner[places], self.share[places], np.repeat(np.arange(len(at)), size)
        most = np.bincount(owner, share * block.column("top").to_numpy()[row], n)
        asked = np.bincount(owner, minlength=n) > 0
        live = np.flatnonzero(asked & (most >= best.floor - MARGIN))
        self.scored += len(live)
        if not len(live):
            return
        lists = block.column("docs")
        docs = lists.flatten().dictionary_encode("encode")
        cell = np.repeat(np.arange(len(at)) * len(docs.dictionary), pc.list_value_length(lists).to_numpy()) + docs.indices.to_numpy()
        gains = np.bincount(cell, block.column("gains").flatten().to_numpy(), len(at) * len(docs.dictionary)).reshape(len(at), -1)
        scores = np.full((n, gains.shape[1]), -np.inf)
        step, number = max(1, SHARES // len(at)), np.full(n, -1)
        number[live] = np.arange(len(live))
        number = number[owner]
        for low in range(0, len(live), step):
            some, own = live[low : low + step], (number >= low) & (number < low + step)
            shares, marks = np.zeros((len(some), len(at))), share[own]
            shares[number[own] - low, row[own]] = marks
            total = shares @ gains
            if not marks.all():  # a term of no share makes a document found all the same
                shares[number[own] - low, row[own]] = 1
                hit = shares @ (gains > 0) > 0
            else:
                hit = total > 0
            scores[some] = np.where(hit, np.round(total, rank.DIGITS), -np.inf)
        yield from best.add(scores, docs.dictionary)
        if best.held > 3 * n * k:  # for the floor
            best._cut()


@dataclass(frozen=True)
class Index:
    """An index that `build` wrote."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def wanted(self, query_arrays: DataFrame) -> DataFrame:
        """(qid, term, share): what a unit of a posting's gain adds to a query's score."""
        asked = stats.term_frequency(query_arrays, "qid")
        return asked.join(self.read("terms"), "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("share"))

    def _of_terms(self, wanted: DataFrame) -> DataFrame:
        """The blocks, by the terms that are asked for where a list of them is short."""
        terms = [r.term for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        blocks = self.read("blocks")
        return blocks.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else blocks

    def heads(self, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
        """(qid, block, term, share, upto, most): upto adds up what this and the weaker terms can give, most all of them."""
        rows = blocks.select("term", "block", "top").join(wanted, "term").withColumn("gives", F.col("share") * F.col("top"))
        weakest = Window.partitionBy("qid", "block").orderBy("gives", "term")
        upto = F.sum("gives").over(weakest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        whole = weakest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.select("qid", "block", "term", "share", upto.alias("upto"), F.sum("gives").over(whole).alias("most"))

    def partial(self, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        """(qid, block, doc_id, score) from the postings of rows (qid, block, term, share)."""
        rows = blocks.select("term", "block", "docs", "gains").join(pairs.select("qid", "block", "term", "share"), ["term", "block"])
        each = rows.select("qid", "block", "share", F.explode(F.arrays_zip("docs", "gains")).alias("p"))
        return each.groupBy("qid", "block", F.col("p.docs").alias("doc_id")).agg(F.sum(F.col("share") * F.col("p.gains")).alias("score"))

    def _steps(self, query_arrays: DataFrame, k: int, seeds: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """(heads, those of the deciding terms, documents that can reach the floor, heads of their blocks, the blocks)."""
        wanted = kept(self.wanted(query_arrays), "wanted")
        blocks = self._of_terms(wanted)
        heads = kept(self.heads(wanted, blocks), "heads")
        if seeds is None:
            seeds = 1 + -(-4 * k // self.read("stats").first().block_docs)
        best = rank.top_k(heads.groupBy("qid", F.col("block").alias("doc_id")).agg(F.max("most").alias("score")), seeds)
        first = heads.join(best.select("qid", F.col("doc_id").alias("block")), ["qid", "block"])
        found = rank.top_k(rank.rounded(self.partial(first, blocks).drop("block")), k)
        floor = found.where(F.col("rank") == k).select("qid", (F.col("score") - MARGIN).alias("floor"))
        live = heads.join(F.broadcast(floor) if query_arrays.count() <= MOST_FLOORS else floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        live = kept(live.where("most >= floor"), "live")
        deciding = live.where("upto >= floor")
        rest = live.where("upto < floor").groupBy("qid", "block").agg(F.max("upto").alias("rest"))
        floors = live.select("qid", "floor").distinct()
        able = self.partial(deciding, blocks).join(rest, ["qid", "block"], "left").join(floors, "qid")
        able = kept(able.where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")).select("qid", "block", "doc_id"), "able")
        return heads, deciding, able, live.join(able.select("qid", "block").distinct(), ["qid", "block"]), blocks

    def search(self, query_arrays: DataFrame, k: int, seeds: int | None = None, method: str = "kernel") -> DataFrame:
        """(qid, doc_id, score, rank): the k best of each query, repeats of its terms counted.

        seeds, of the relational search: blocks of each query that are scored
        first; by default as many as hold 4 k documents.
        """
        if method not in METHODS:
            raise ValueError(f"unknown method: {method}")
        if method == "kernel":
            return rank.top_k(self._by_kernel(query_arrays, k), k)
        _, _, able, last, blocks = self._steps(query_arrays, k, seeds)
        scores = self.partial(last, blocks).join(able, ["qid", "block", "doc_id"], "left_semi")
        return rank.top_k(rank.rounded(scores.select("qid", "doc_id", "score")), k)

    def _by_kernel(self, query_arrays: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id, score): each task's k best of each query among its blocks."""
        wanted = kept(self.wanted(query_arrays), "wanted")
        blocks = self._of_terms(wanted).select("term", "block", "top", "docs", "gains")
        kind, doc = wanted.schema["qid"].dataType.simpleString(), blocks.schema["docs"].dataType.elementType
        schema, dealt, out = f"qid {kind}, doc_id {doc.simpleString()}, score double", blocks.repartition("block").sortWithinPartitions("block"), None
        for group in vector_groups(wanted.withColumnRenamed("share", "q_weight")):
            scorer = BlockScorer(group)

            def run(batches: Iterator[pa.RecordBatch], scorer=scorer) -> Iterator[pa.RecordBatch]:
                best = Best(scorer.qids, to_arrow_type(doc), k)
                for block in whole_blocks(batches):
                    yield from scorer.add(block, best, k)
                yield from best.rest()

            part = dealt.mapInArrow(run, schema)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def block_counts(self, query_arrays: DataFrame, k: int, seeds: int | None = None) -> DataFrame:
        """One row: the queries' blocks of postings, and those whose documents a relational search for k reads, for the terms that decide and for whole scores."""
        heads, deciding, _, last, _ = self._steps(query_arrays, k, seeds)
        both = deciding.select("qid", "block", "term").union(last.select("qid", "block", "term")).distinct()
        return heads.agg(F.count("*").alias("blocks")).crossJoin(both.agg(F.count("*").alias("scored")))
