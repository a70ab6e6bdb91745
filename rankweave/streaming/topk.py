"""Top k per query over a stream of (qid, doc_id, score), batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankweave.operators import rank


def keep_top_k(scores: DataFrame, state: str, k: int, checkpoint: str) -> StreamingQuery:
    """Merges each batch with the k best so far and writes them to a new folder, state/batch=<n>; the last one holds.

    A batch that is run again after a failure writes the same folder anew from
    the one before it. A document that comes again counts with its best score.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("qid", "doc_id", "score")
        if number > 0:
            rows = rows.union(spark.read.parquet(f"{state}/batch={number - 1}").select("qid", "doc_id", "score"))
        best = rows.groupBy("qid", "doc_id").agg({"score": "max"}).withColumnRenamed("max(score)", "score")
        rank.top_k(best, k).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return scores.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
