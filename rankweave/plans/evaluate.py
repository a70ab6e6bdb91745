"""A judged collection in files: first stage, re-ranking by several scorers, fusion, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import joined_text
from rankweave.operators import encode, fuse, interact, metrics, rank, retrieve, stats
from rankweave.plans.context import spread
from rankweave.sources import readers


@dataclass
class Settings:
    """What the plans take where nothing else is said."""

    separator: str = " "
    max_query_tokens: int = 512
    max_doc_tokens: int | None = None
    first_stage: tuple[float, float] = (0.9, 0.4)
    idf: str = "smooth"
    depth: int = 100
    rerank: tuple[float, float] = (0.82, 0.65)
    pooler: str = "local_average"
    window: int = 3
    scorers: tuple[str, ...] = ("maxsim_bm25_qtf",)
    fuse_weight: float = 0.5
    cutoffs: tuple[int, ...] = (1, 3, 5, 10, 100)
    drop_self: bool = True


def rerank_collection(spark: SparkSession, folder: str, encoder: encode.Encoder | encode.TwoTowers, settings: Settings | None = None, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """(runs, means) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv.

    runs: (system, qid, doc_id, score, rank) of the first stage, of each
    scorer over its candidates, and of each scorer fused with the first stage.
    means: (system, k, metrics...) over the judged queries.
    """
    own = settings or Settings()
    corpus, queries, qrels = readers.collection(spark, folder, split)
    whole = spread(corpus.select("doc_id", joined_text(F.col("title"), F.col("text"), own.separator).alias("text")))
    docs = stats.token_arrays(whole, most=own.max_doc_tokens).persist()
    asked = stats.token_arrays(queries, "qid", most=own.max_query_tokens).persist()
    first = retrieve.bm25(docs, asked, own.depth, *own.first_stage, kind=own.idf).persist()
    matches = interact.exact_matches(docs, asked, encoder, first.select("qid", "doc_id"), own.pooler, own.window)
    scored = interact.scored(matches, interact.query_term_idf(docs, asked), stats.summary(docs), own.scorers, *own.rerank, drop_self=own.drop_self)
    again = rank.rounded(scored.unpivot(["qid", "doc_id"], list(own.scorers), "system", "score")).persist()
    label = lambda run, name: run.select(F.lit(name).alias("system"), "qid", "doc_id", "score")
    runs = label(first, "first_stage").unionByName(again.select("system", "qid", "doc_id", "score"))
    for scorer in own.scorers:
        runs = runs.unionByName(label(fuse.weighted_min_fill(first, again.where(F.col("system") == scorer), own.fuse_weight), f"first_stage+{scorer}"))
    runs = rank.ranked(runs, ("system", "qid")).persist()
    rows = metrics.per_query(runs, qrels, own.cutoffs, by=("system",))
    return runs, metrics.mean(rows, metrics.METRICS, ("system",))
