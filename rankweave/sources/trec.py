"""Topics and documents in TREC markup.

A file is read as text whose records end with the closing tag, so a large file
is split over tasks, and fields are taken by column expressions. Tags count in
either case; older topics open fields without closing them, which then end
where the next field opens. Markup within a field becomes a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels that old topics repeat behind their tags.
LABELS = {"num": "Number:", "title": "Topic:", "desc": "Description:", "narr": "Narrative:"}


def _records(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    rows = spark.read.text(path, lineSep=f"</{tag}>")
    return rows.where(F.col("value").rlike(f"(?i)<{tag}>"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def field(name: str, label: str = "") -> Column:
    """A field's text up to its closing tag or the next field; empty where it is missing."""
    inside = F.regexp_extract("value", rf"(?is)<{name}>\s*(?:{label})?(.*?)(?=</{name}>|<(?:num|title|desc|narr|top)>|$)", 1)
    return _plain(inside)


def topics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, title, description, narrative) of each <top>."""
    rows = _records(spark, path, "top")
    return rows.select(field("num", LABELS["num"]).alias("qid"), field("title", LABELS["title"]).alias("title"), field("desc", LABELS["desc"]).alias("description"), field("narr", LABELS["narr"]).alias("narrative"))


def documents(spark: SparkSession, path: str | list[str], title_tags: tuple[str, ...] = ("HEADLINE", "TITLE", "HL", "TI"), text_tags: tuple[str, ...] = ("TEXT", "GRAPHIC")) -> DataFrame:
    """(doc_id, title, text) of each <DOC>: the first title tag it has, and all its texts in order of the tags."""
    rows = _records(spark, path, "DOC")
    inside = lambda tag: _plain(F.array_join(F.regexp_extract_all("value", F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1)), " "))
    title = F.coalesce(*[F.nullif(inside(tag), F.lit("")) for tag in title_tags], F.lit(""))
    return rows.select(inside("DOCNO").alias("doc_id"), title.alias("title"), F.trim(F.concat_ws(" ", *[F.nullif(inside(tag), F.lit("")) for tag in text_tags])).alias("text"))


def judgements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, doc_id, rel) from lines of topic, iteration, document and relevance, apart by spaces or tabs."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).alias("qid"), F.get(parts, 2).alias("doc_id"), F.get(parts, 3).cast("int").alias("rel"))


def convert(spark: SparkSession, topic_path: str, document_path: str, judgement_path: str, out: str, query_field: str = "title") -> None:
    """Writes a collection of the three files that `readers.collection` reads; query_field: title, description or narrative."""
    from rankweave.sources import writers

    queries = topics(spark, topic_path).select("qid", F.col(query_field).alias("text"))
    writers.write_collection(documents(spark, document_path), queries, judgements(spark, judgement_path), out)
