"""Command line: plans over test tables, and re-ranking of a judged collection.

    python -m rankweave plans
    python -m rankweave plan NAME FOLDER OUT
    python -m rankweave rerank FOLDER VECTORS OUT [--depth 100] [--scorers maxsim_bm25_qtf ...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rankweave import ship


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rankweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("plans", help="names of the plans")
    one = commands.add_parser("plan", help="run a plan and write its rows as Parquet")
    for name in ("name", "folder", "out"):
        one.add_argument(name)
    again = commands.add_parser("rerank", help="first stage, re-ranking, fusion and metrics; VECTORS: Parquet of vec_id, embedding")
    for name in ("folder", "vectors", "out"):
        again.add_argument(name)
    again.add_argument("--split", default="test")
    again.add_argument("--depth", type=int, default=100)
    again.add_argument("--window", type=int, default=3)
    again.add_argument("--fuse-weight", type=float, default=0.5)
    again.add_argument("--scorers", nargs="+", default=["maxsim_bm25_qtf"])
    own = parser.parse_args(arguments)

    from rankweave.plans import catalog

    if own.command == "plans":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = SparkSession.builder.appName("rankweave").getOrCreate()
    ship(spark)
    if own.command == "plan":
        catalog.queries()[own.name](spark, own.folder).write.mode("overwrite").parquet(own.out)
        return
    from rankweave.operators.encode import VocabularyEncoder
    from rankweave.plans.evaluate import Settings, rerank_collection

    settings = Settings(depth=own.depth, window=own.window, fuse_weight=own.fuse_weight, scorers=tuple(own.scorers))
    runs, means = rerank_collection(spark, own.folder, VocabularyEncoder.from_table(spark.read.parquet(own.vectors)), settings, own.split)
    runs.write.mode("overwrite").partitionBy("system").parquet(f"{own.out}/runs")
    means.write.mode("overwrite").parquet(f"{own.out}/means")


if __name__ == "__main__":
    main()
