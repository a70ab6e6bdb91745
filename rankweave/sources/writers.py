"""Conversions and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import rank
from rankweave.sources import readers


def search_documents(corpus: DataFrame, separate_title: bool = False, separator: str = "", beside: tuple[str, ...] = ()) -> DataFrame:
    """(id, contents), or with a title of its own (id, title, contents); trimmed; columns named in `beside` stay."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    identity = F.col("doc_id").cast("string").alias("id")
    if separate_title:
        return corpus.select(identity, F.trim(title).alias("title"), F.trim(text).alias("contents"), *beside)
    return corpus.select(identity, F.trim(F.concat(title, F.lit(separator), text)).alias("contents"), *beside)


def query_lines(queries: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """(qid, text): trimmed, tabs as spaces; columns named in `beside` stay."""
    return queries.select("qid", F.regexp_replace(F.trim("text"), "\t", " ").alias("text"), *beside)


def judgement_lines(qrels: DataFrame) -> DataFrame:
    """(qid, iteration, doc_id, rel), iteration being 0."""
    return qrels.select("qid", F.lit(0).alias("iteration"), "doc_id", "rel")


def write_search_documents(corpus: DataFrame, path: str, **options) -> None:
    search_documents(corpus, **options).write.mode("overwrite").json(path)


def write_query_lines(queries: DataFrame, path: str) -> None:
    query_lines(queries).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def write_judgement_lines(qrels: DataFrame, path: str) -> None:
    judgement_lines(qrels).write.mode("overwrite").csv(path, sep="\t")


def write_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, split: str = "test") -> None:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv, as folders of parts."""
    corpus.select(F.col("doc_id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{folder}/corpus.jsonl")
    queries.select(F.col("qid").alias("_id"), "text").write.mode("overwrite").json(f"{folder}/queries.jsonl")
    qrels.select(F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score")).write.mode("overwrite").csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)


def convert_tree(spark: SparkSession, source: str, target: str, **options) -> None:
    """Every corpus.jsonl, queries.jsonl and qrels/*.tsv below source, converted, under target by kind and dataset.

    A dataset is the path of its folder below source, so folders of one name
    in two places stay apart. Each kind is one job over all datasets.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")
    below = F.substring(path, F.lit(len(root) + 2), F.length(path))
    dataset = lambda tail: F.regexp_replace(below, rf"/?{tail}$", "").alias("dataset")
    found = lambda names: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)

    corpus = found("corpus.jsonl").schema(readers.CORPUS).json(source).select(F.col("_id").alias("doc_id"), "title", "text", dataset("corpus[.]jsonl"))
    search_documents(corpus, beside=("dataset",), **options).write.partitionBy("dataset").mode("overwrite").json(f"{target}/corpus")
    queries = found("queries.jsonl").schema(readers.QUERIES).json(source).select(F.col("_id").alias("qid"), "text", dataset("queries[.]jsonl"))
    query_lines(queries, ("dataset",)).write.partitionBy("dataset").mode("overwrite").csv(f"{target}/queries", sep="\t", quote="", escape="")
    qrels = found("*.tsv").schema(readers.QRELS).csv(source, sep="\t", header=True).where(F.col("_metadata.file_path").rlike("/qrels/[^/]+$"))
    split = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)[.]tsv$", 1).alias("split")
    rows = qrels.select("qid", F.lit(0).alias("iteration"), "doc_id", "rel", dataset("qrels/[^/]+"), split)
    rows.write.partitionBy("dataset", "split").mode("overwrite").csv(f"{target}/qrels", sep="\t")


def write_splits(docs: DataFrame, path: str, n_splits: int) -> None:
    """A folder per split; no document is lost or doubled."""
    split = rank.shards(docs, n_splits, 1).select("doc_id", "split")
    docs.join(split, "doc_id").repartition("split").write.partitionBy("split").mode("overwrite").json(path)


def write_run(run: DataFrame, path: str) -> None:
    """A line {qid, docs: {doc_id: score}} per query."""
    rank.as_maps(run).write.mode("overwrite").json(path)


def debug_lines(run: DataFrame) -> DataFrame:
    """qid rising, score falling: (qid, doc_id, score)."""
    return run.select("qid", "doc_id", "score").orderBy("qid", F.col("score").desc(), "doc_id")


def write_stats(idf: DataFrame, summary: DataFrame, path: str) -> None:
    """(term, df, idf) and the row of n_docs, n_tokens, mean_len."""
    idf.write.mode("overwrite").parquet(f"{path}/idf")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def write_codec(centroids: DataFrame, bucket_row: DataFrame, path: str) -> None:
    """Centroids as float, cutoffs, weights and the mean residual."""
    centroids.select("code", F.col("centroid").cast("array<float>").alias("centroid")).write.mode("overwrite").parquet(f"{path}/centroids")
    bucket_row.write.mode("overwrite").parquet(f"{path}/buckets")


def write_compressed(rows: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Codes and levels, a folder per chunk; all chunks read as one table."""
    rows.write.partitionBy(chunk).mode("overwrite").parquet(path)
