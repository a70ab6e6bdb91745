"""A corpus made ready for training: rules, near-duplicates, personal data, the mix, packing.

Each stage works on all that the one before it kept, written as Parquet and
read again. All but the last return the columns of documents. Null and empty
texts fail the quality rules; texts of any length are kept whole until they are
packed; of repeated rows one stays as a near-duplicate of the others; an empty
table stays empty; other columns travel with the rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave import ship
from rankweave.llm import mixing, packing, pii, quality, simhash
from rankweave.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.good_documents(docs, quality.references(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.one_of_each_group(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    ship(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each pass over a document."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("personal data", redact),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: No SQL has the field's spans, SimHash or the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
