"""Readers; every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import joined_text

CORPUS = "_id string, title string, text string, metadata map<string,string>"
QUERIES = "_id string, text string, metadata map<string,string>"
QRELS = "qid string, doc_id string, rel int"
HARD_NEGATIVES_SCORED = "qid string, pos array<struct<pid:string,`ce-score`:double>>, neg map<string,array<struct<pid:string,`ce-score`:double>>>"
HARD_NEGATIVES_PLAIN = "qid long, pos array<long>, neg map<string,array<long>>"


def corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, title, text) from JSON lines with _id, title and text."""
    return spark.read.schema(CORPUS).json(path).select(F.col("_id").alias("doc_id"), "title", "text")


def documents(spark: SparkSession, path: str | list[str], separator: str = " ") -> DataFrame:
    """(doc_id, text): title and text joined."""
    return corpus(spark, path).select("doc_id", joined_text(F.col("title"), F.col("text"), separator).alias("text"))


def queries(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(qid, text) from JSON lines; column names the field to query by, such as a title or a description."""
    schema = f"_id string, `{column}` string"
    return spark.read.schema(schema).json(path).select(F.col("_id").alias("qid"), F.col(column).alias("text"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) from tab-separated lines under a header."""
    return spark.read.schema(QRELS).csv(path, sep="\t", header=True)


def collection(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv; queries are the judged ones."""
    judged = qrels(spark, f"{folder}/qrels/{split}.tsv")
    return corpus(spark, f"{folder}/corpus.jsonl"), judged_only(queries(spark, f"{folder}/queries.jsonl"), judged), judged


def judged_only(query_rows: DataFrame, judged: DataFrame) -> DataFrame:
    return query_rows.join(judged.select("qid"), "qid", "left_semi")


def pairs_tsv(spark: SparkSession, path: str, key: str, value: str, key_type: str = "string") -> DataFrame:
    """Two tab-separated columns without header: passages or queries by id."""
    return spark.read.schema(f"`{key}` {key_type}, `{value}` string").csv(path, sep="\t", quote="")


def hard_negatives(spark: SparkSession, path: str, scored: bool = True, most: int | None = None) -> DataFrame:
    """Records of positives and negatives by system, from JSON lines, compressed or not."""
    rows = spark.read.schema(HARD_NEGATIVES_SCORED if scored else HARD_NEGATIVES_PLAIN).json(path)
    return rows if most is None else rows.limit(most)


def negative_lists(records: DataFrame, scored: bool = True) -> DataFrame:
    """(qid, system, rank, pid, ce) of hard_negatives, rank from 1."""
    each = records.select("qid", F.explode("neg").alias("system", "entries")).select("qid", "system", F.posexplode("entries").alias("at", "e"))
    pid, ce = (F.col("e.pid"), F.col("e.`ce-score`")) if scored else (F.col("e"), F.lit(None).cast("double"))
    return each.select("qid", "system", (F.col("at") + 1).alias("rank"), pid.alias("pid"), ce.alias("ce"))


def positive_list(records: DataFrame, scored: bool = True) -> DataFrame:
    """(qid, pid, ce) of hard_negatives."""
    each = records.select("qid", F.explode("pos").alias("e"))
    return each.select("qid", F.col("e.pid").alias("pid"), F.col("e.`ce-score`").alias("ce")) if scored else each.select("qid", F.col("e").alias("pid"), F.lit(None).cast("double").alias("ce"))


def ce_scores(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, ce) from Parquet; `pickles.ce_pickles` reads their pickles without running them."""
    return spark.read.schema("qid long, pid long, ce double").parquet(path)


def run_json(spark: SparkSession, path: str, by_scorer: bool = False) -> DataFrame:
    """([scorer,] qid, doc_id, score) from a JSON object {qid: {doc_id: score}}, or {scorer: {...}}.

    A file of {qid: {...}} is cut where an inner object ends, so a large one is
    read by several tasks; a key with a brace in it ends the query with an
    error. One by scorer is read whole, a file a task.
    """
    if by_scorer:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.explode(F.from_json("value", "map<string,map<string,map<string,double>>>")).alias("scorer", "run"))
        rows = rows.select("scorer", F.explode("run").alias("qid", "docs"))
        return rows.select("scorer", "qid", F.explode("docs").alias("doc_id", "score"))
    parts = spark.read.text(path, lineSep="}").where(~F.col("value").rlike(r"^[\s{},]*$"))
    begun = F.regexp_replace("value", r"^[\s,]*\{?[\s,]*(?=\")", "")
    member = F.from_json(F.concat(F.lit("{"), begun, F.lit("}}")), "map<string,map<string,double>>", {"mode": "FAILFAST"})
    rows = parts.select(F.explode(member).alias("qid", "docs"))
    return rows.select("qid", F.explode("docs").alias("doc_id", "score"))


def training_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tab-separated lines, JSON lines) of a folder that holds both."""
    lines = spark.read.option("pathGlobFilter", "*.tsv").text(folder)
    return lines, spark.read.option("pathGlobFilter", "*.json").text(folder)


def index(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """(shard, term, doc_id, pos, vec), of one shard alone where it is named: only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)


def codec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(centroids, bucket row) of writers.write_codec."""
    centroids = spark.read.schema("code long, centroid array<float>").parquet(f"{path}/centroids")
    return centroids.withColumn("centroid", F.col("centroid").cast("array<double>")), spark.read.parquet(f"{path}/buckets")


def stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(idf, summary) of writers.write_stats."""
    return spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/summary")
