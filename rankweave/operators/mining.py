"""Training data: hard negatives, triples, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_system(lists: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """(qid, pid, place): the first n distinct pids of one system's list (qid, pid, rank); queries with positives only."""
    first = lists.groupBy("qid", "pid").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "pid"))
    return first.join(positives.select("qid").distinct(), "qid", "left_semi").withColumn("place", place).where(F.col("place") <= n).select("qid", "pid", "place")


def all_systems(lists: DataFrame, positives: DataFrame) -> DataFrame:
    """(qid, pid, system, ce): every negative once, as the first system (by name, then rank) has it; lists: (qid, system, rank, pid, ce)."""
    order = Window.partitionBy("qid", "pid").orderBy("system", "rank")
    rows = lists.join(positives.select("qid").distinct(), "qid", "left_semi").withColumn("seen", F.row_number().over(order))
    return rows.where("seen = 1").select("qid", "pid", "system", "ce")


def per_system(lists: DataFrame, positives: DataFrame, n: int, margin: float | None = None) -> DataFrame:
    """(qid, place, system, pid): n negatives per system, systems by name; a pid that was accepted is not taken again.

    Without a margin, pids need a ce score. With one, a pid is left out if its
    ce exceeds the query's least ce of a positive less the margin, and pids
    without ce stay. A pid that a full system leaves may be taken by a later
    one, so the order matters: one fold per query over its lists, which have a
    bounded length. positives: (qid, pid, ce).
    """
    wanted = positives.groupBy("qid").agg(F.min("ce").alias("least"))
    rows = lists.join(wanted, "qid")
    if margin is None:
        rows = rows.where("ce is not null")
    else:
        rows = rows.where(F.col("ce").isNull() | F.col("least").isNull() | (F.col("ce") <= F.col("least") - margin))
    entries = F.array_sort(F.collect_list(F.struct("system", "rank", "pid")))
    grouped = rows.groupBy("qid").agg(entries.alias("entries"))
    kind = lists.schema["pid"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<system:string,pid:{kind}>>")

    def step(taken: Column, entry: Column) -> Column:
        again = F.exists(taken, lambda t: t["pid"] == entry["pid"])
        full = F.size(F.filter(taken, lambda t: t["system"] == entry["system"])) >= n
        return F.when(again | full, taken).otherwise(F.concat(taken, F.array(F.struct(entry["system"].alias("system"), entry["pid"].alias("pid")))))

    taken = grouped.select("qid", F.posexplode(F.aggregate("entries", empty, step)).alias("place", "t"))
    return taken.select("qid", "place", "t.system", "t.pid")


def triples(positives: DataFrame, negatives: DataFrame, epoch: int, seed: int = 0, without_positives: bool = False) -> DataFrame:
    """(qid, pos, neg): element epoch mod size of each query's positives in order, and of its negatives in an order by hash.

    without_positives: a query that has negatives alone takes two of them at
    each epoch, the first in the place of the positive; else it is left out.
    """
    pick = lambda column, at=F.lit(epoch): F.get(column, at % F.size(column))
    pos = positives.groupBy("qid").agg(F.sort_array(F.collect_list("pid")).alias("all_pos"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string")))
    neg = negatives.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "pid"))).alias("all_neg"))
    rows = neg.join(pos, "qid", "left" if without_positives else "inner")
    none = F.col("all_pos").isNull()
    one = F.when(none, pick("all_neg", F.lit(2 * epoch))["pid"]).otherwise(pick("all_pos"))
    two = F.when(none, pick("all_neg", F.lit(2 * epoch + 1))["pid"]).otherwise(pick("all_neg")["pid"])
    return rows.select("qid", one.alias("pos"), two.alias("neg"))


def margins(pairs: DataFrame, ce: DataFrame) -> DataFrame:
    """(qid, pos, neg, label): ce of the positive less that of the negative; pairs (qid, pos, neg) without a score are absent."""
    one = ce.select("qid", F.col("pid").alias("pos"), F.col("ce").alias("ce_pos"))
    two = ce.select("qid", F.col("pid").alias("neg"), F.col("ce").alias("ce_neg"))
    return pairs.join(one, ["qid", "pos"]).join(two, ["qid", "neg"]).select("qid", "pos", "neg", F.round(F.col("ce_pos") - F.col("ce_neg"), 6).alias("label"))


def margin_loss(predicted: DataFrame) -> DataFrame:
    """One row: mean squared difference of (pos_score - neg_score) and label."""
    return predicted.agg(F.avg(F.pow(F.col("pos_score") - F.col("neg_score") - F.col("label"), 2)).alias("loss"))


def ranking_loss(scores: DataFrame) -> DataFrame:
    """(batch, loss): mean cross-entropy of each query's own document among its batch's; scores: (batch, i, j, score)."""
    rows = Window.partitionBy("batch", "i")
    top = scores.withColumn("top", F.max("score").over(rows))
    each = top.groupBy("batch", "i").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("score") - F.col("top"))).alias("total"), F.max(F.when(F.col("i") == F.col("j"), F.col("score"))).alias("own"))
    return each.groupBy("batch").agg(F.round(F.avg(F.col("top") + F.log("total") - F.col("own")), 6).alias("loss"))


def records(positives: DataFrame, negatives: DataFrame, query_arrays: DataFrame, doc_arrays: DataFrame, n: int) -> DataFrame:
    """(qid, pid, record): one JSON record per query and positive, with tokens and the first n negatives (qid, pid, place)."""
    docs = doc_arrays.select(F.col("doc_id").alias("pid"), F.col("tokens").alias("passage"))
    known = positives.select("qid", "pid").distinct()
    usable = negatives.join(known, ["qid", "pid"], "left_anti").where(F.col("place") <= n)
    neg = usable.join(docs, "pid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "pid", "passage"))).alias("neg"))
    rows = known.join(docs, "pid").join(query_arrays, "qid").join(neg, "qid", "left")
    plain = F.transform(F.coalesce("neg", F.array().cast(neg.schema["neg"].dataType)), lambda x: F.struct(x["pid"].alias("pid"), x["passage"].alias("passage")))
    record = F.struct(F.struct("qid", F.col("tokens").alias("query")).alias("qry"), F.array(F.struct("pid", "passage")).alias("pos"), plain.alias("neg"))
    return rows.select("qid", "pid", F.to_json(record).alias("record"), F.size(plain).alias("n_neg"))
