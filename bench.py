"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once to warm up and then `RUNS` times, caches cleared before
each; the median counts. Results are written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from rankweave import ship
    from rankweave.operators import encode, index
    from rankweave.plans import catalog
    from rankweave.plans.context import WINDOW, Collection

    ship(spark)

    def index_build(c: Collection) -> DataFrame:
        vectors = encode.token_vectors(c.darr, c.encoder, window=WINDOW)
        return vectors.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "pos")

    plans = {name: catalog.PLANS[name] for name in ("bm25_topk", "cbm25", "cbm25_full", "dense_cosine_topk", "dense_topk", "weight_sweep", "metric_macro_avg", "rsj_delta", "codec_compress", "hard_neg_margin")}
    plans["index_build"] = index_build
    taken: dict[str, float] = {}
    for name, plan in plans.items():
        times = []
        for _ in range(RUNS + 1):
            spark.catalog.clearCache()
            began = time.time()
            plan(Collection(spark, folder)).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        taken[name] = round(statistics.median(times[1:]), 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").agg(F.count("*")).first()[0]
    queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/")), "docs": docs, "text_queries": queries, "cpus": cpus, "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
