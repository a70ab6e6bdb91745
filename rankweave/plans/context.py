"""The test tables as a retrieval collection.

Corpus: documents; queries: benchmark; judgements: a document that holds a
query's text is relevant; vocabulary of the stand-in encoder: embeddings.
Runs are small (queries times depth), are used by many plans, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import subwords
from rankweave.functions.batches import slices
from rankweave.operators import codec, dense, encode, interact, packed, postings, rank, retrieve, stats
from rankweave.sources.folders import fresh, kept

DEPTH, WINDOW, NBITS = 100, 3, 2


#: An input of fewer bytes a core is dealt anew over all cores; of a larger one that is dealt anew, a task gets about as many.
SMALL = 16 << 20
#: An input is read as it is split unless its largest task has this many times a core's share of the rows.
UNEVEN = 1.25


def spread(rows: DataFrame) -> DataFrame:
    """Deals an input over all cores where its files don't: Parquet is read by row groups, so a file of one is one task, whatever its size.

    How many rows a task would read is known from the files' footers; no column
    is read for it. Equal rows may land in one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SMALL * cores:
        return rows.repartition(cores)
    largest, total = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    if not total or largest * cores <= UNEVEN * total:
        return rows
    return rows.repartition(cores * -(-size // (SMALL * cores)), *rows.columns)


def holding(docs: DataFrame, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """(qid, doc_id): documents whose text holds a query's text; queries travel to the documents, `most` at a time."""
    kind, doc = queries.schema["qid"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema, group, out = f"qid {kind}, doc_id {doc}", [], None

    def part(texts: list[tuple]) -> DataFrame:
        qids = pa.array([q for q, _ in texts])

        owners: dict[str, list[int]] = {}
        for at, (_, wanted) in enumerate(texts):
            owners.setdefault(wanted, []).append(at)
        empty = owners.pop("", [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ahocorasick import Automaton

            search = Automaton()
            for wanted, own in owners.items():
                search.add_word(wanted, own)
            if owners:
                search.make_automaton()
            for batch in slices(batches):
                found = []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    if text:  # read once, whatever the number of queries
                        hits = {q for _, own in (search.iter(text) if owners else ()) for q in own}
                        found += [(q, row) for q in sorted(hits | set(empty))]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array([q for q, _ in found], pa.int64())), batch.column(0).take(pa.array([r for _, r in found], pa.int64()))], ["qid", "doc_id"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    for row in queries.where("text is not null").select("qid", "text").toLocalIterator():
        group.append((row.qid, row.text))
        if len(group) == most:
            out, group = part(group) if out is None else out.union(part(group)), []
    if group:
        out = part(group) if out is None else out.union(part(group))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


class Collection:
    """keep_tokens: whether tokens are kept between the plans that read them, on local disks: they are larger than the texts' files."""

    def __init__(self, spark: SparkSession, folder: str, keep_tokens: bool = True):
        self.spark, self.folder, self.keep_tokens = spark, folder, keep_tokens

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def repeated(self) -> bool:
        """Whether a doc_id has several rows."""
        return stats.repeated(self.docs)

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def read_once(self) -> DataFrame:
        """darr for plans of one pass, which keep nothing."""
        return stats.token_arrays(spread(self.docs.select("doc_id", "text")))

    @cached_property
    def darr(self) -> DataFrame:
        if not self.keep_tokens:
            return self.read_once
        return stats.parted(stats.joined(self.read_once).persist(StorageLevel.DISK_ONLY))

    @cached_property
    def qarr(self) -> DataFrame:
        return stats.token_arrays(self.queries, "qid")

    @cached_property
    def dstream(self) -> DataFrame:
        return stats.token_stream(self.read_once)

    @cached_property
    def qstream(self) -> DataFrame:
        return stats.token_stream(self.qarr, "qid")

    @cached_property
    def tf(self) -> DataFrame:
        return stats.term_frequency(self.darr)

    @cached_property
    def summary(self) -> DataFrame:
        return stats.summary(self.darr)

    @cached_property
    def idf(self) -> DataFrame:
        return stats.idf(stats.document_frequency(self.tf), self.summary)

    @cached_property
    def query_idf(self) -> DataFrame:
        return interact.query_term_idf(self.darr, self.qarr)

    @cached_property
    def encoder(self) -> encode.VocabularyEncoder:
        return encode.VocabularyEncoder.from_table(self.table("embeddings"))

    @cached_property
    def qrels(self) -> DataFrame:
        return holding(spread(self.docs.select("doc_id", "text")), self.queries).select("qid", "doc_id", F.lit(1).alias("rel")).persist()

    @cached_property
    def bm25(self) -> DataFrame:
        return retrieve.bm25(self.darr, self.qarr, DEPTH).persist()

    @cached_property
    def index(self) -> postings.Index:
        """The BM25 index of the documents, written once to the shared folder."""
        return postings.build(self.darr, fresh(self.spark, "index"))

    @cached_property
    def vocabulary(self) -> subwords.Vocabulary:
        """Pieces of a public tokenizer's vocabulary."""
        import public_tokenizers

        return subwords.Vocabulary.from_file(public_tokenizers.path("word_bpe_49k.json"))

    @cached_property
    def dense_docs(self) -> DataFrame:
        return encode.mean_pooled(self.darr, self.encoder)

    def dense_of(self, pairs: DataFrame) -> DataFrame:
        """dense_docs of the documents of pairs (qid, doc_id) alone, the only ones that are encoded."""
        return encode.mean_pooled(interact.asked_for(self.darr, pairs), self.encoder)

    @cached_property
    def dense_queries(self) -> DataFrame:
        return encode.mean_pooled(self.qarr, self.encoder, "qid")

    @cached_property
    def dense(self) -> DataFrame:
        return dense.search(self.dense_docs, self.dense_queries, DEPTH).persist()

    @cached_property
    def candidates(self) -> DataFrame:
        return self.bm25.select("qid", "doc_id")

    @cached_property
    def matches(self) -> DataFrame:
        return interact.exact_matches(self.darr, self.qarr, self.encoder, self.candidates, window=WINDOW).persist()

    @cached_property
    def cbm25(self) -> DataFrame:
        scored = interact.candidate_scores(self.darr, self.qarr, self.encoder, self.candidates, window=WINDOW)
        return rank.ranked(rank.rounded(scored)).persist()

    @cached_property
    def vectors(self) -> DataFrame:
        """(vec_id, code, vec) of embeddings with a label."""
        rows = self.table("embeddings").where("label is not null and embedding is not null")
        return rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    @cached_property
    def centroids(self) -> DataFrame:
        means = codec.mean_by(self.vectors, "label").select(F.col("label").cast("long").alias("code"), "centroid")
        return means.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9))).persist()

    @cached_property
    def coded(self) -> DataFrame:
        return codec.assign(self.vectors.drop("label"), self.centroids).persist()

    @cached_property
    def bucket_row(self) -> DataFrame:
        return codec.buckets(codec.residuals(self.coded, self.centroids), NBITS).persist()

    @cached_property
    def codec(self) -> packed.Codec:
        return packed.Codec.of(self.centroids, self.bucket_row, NBITS)

    @cached_property
    def packed_postings(self) -> DataFrame:
        """Packed token vectors of the documents, written once to the shared folder."""
        return kept(packed.postings(self.darr, self.encoder, self.codec, window=WINDOW), "packed")

    @cached_property
    def compressed(self) -> DataFrame:
        return codec.compressed(self.vectors.drop("label"), self.centroids, self.bucket_row)

    @cached_property
    def ce(self) -> DataFrame:
        """Pair scores that mining takes as those of a cross-encoder."""
        return self.cbm25.select("qid", F.col("doc_id").alias("pid"), F.col("score").alias("ce"))

    @cached_property
    def lists(self) -> DataFrame:
        """(qid, system, rank, pid, ce): the 30 best of two systems that are not relevant."""
        runs = [(name, run) for name, run in (("bm25", self.bm25), ("dense", self.dense))]
        rows = None
        for name, run in runs:
            part = run.where("rank <= 30").select("qid", F.lit(name).alias("system"), "rank", F.col("doc_id").alias("pid"))
            rows = part if rows is None else rows.union(part)
        rows = rows.join(self.qrels.select("qid", F.col("doc_id").alias("pid")), ["qid", "pid"], "left_anti")
        return rows.join(self.ce, ["qid", "pid"], "left").select("qid", "system", "rank", "pid", "ce")

    @cached_property
    def positives(self) -> DataFrame:
        """(qid, pid, ce) of the relevant documents."""
        return self.qrels.select("qid", F.col("doc_id").alias("pid")).join(self.ce, ["qid", "pid"], "left")


_known: dict[tuple[str, str], Collection] = {}


#: Texts that travel to a Python task at once, unless the session names a number: kernels take 256 or 1,024 at a time,
#: and both sides hold a batch several times over.
TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def collection(spark: SparkSession, folder: str) -> Collection:
    name, rows = TEXTS
    if name not in spark.conf.getAll:
        spark.conf.set(name, rows)
    key = spark.sparkContext.applicationId, folder
    if key not in _known:
        _known[key] = Collection(spark, folder)
    return _known[key]
