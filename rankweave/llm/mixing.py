"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a random but repeatable order (the MD5 of
id and text) and form one stream of words, which may be passed `max_epochs`
times. The first `target` words of that stream are cut into blocks of
`block_words`: the source's exact block quota. A binary tree over the output
shards splits all quotas at each node by one multivariate-hypergeometric draw,
so each shard gets its exact number of blocks and each source spends its exact
quota. A node's draw depends on the seed and the node alone: any task can walk
to the shards it owns, nothing is sent to it, and reruns agree. A shard then
draws the next blocks of each source from a permutation of that source's blocks
(a Feistel network, so no task holds it), disjoint from those of all other
shards, and shuffles them locally.

Defined cases: a null text has size 0 and takes nothing; null sources are one
source and come last in the order of weights; a text of any length is cut at
block boundaries only; equal rows are counted as one row with a number of
copies until they are placed, then each has its own words of the stream; rows
that share id and text only are ordered by all their columns and keep them; an
empty table gives an empty mix; other columns of the input are ignored by
`mix_counts`, carried by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import WORD, row_key, table, word_count, written

#: Weights by rank of the source, repeating; share of all words to take; passes over a source at most.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Words in a block and in a shard, about; blocks at most in all, for the draws need 32-bit counts.
BLOCK_WORDS, SHARD_WORDS, MOST_BLOCKS = 512, 1 << 20, 1 << 29
#: Documents in a bucket of the order, about.
BUCKET_DOCS = 2048


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, perm, row_key, copies): one row per different row of docs; perm is its place in the random order."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), content_key().alias("perm"), row_key(docs).alias("row_key"))
    return rows.groupBy("doc_id", "source", "size", "perm", "row_key").agg(F.count("*").alias("copies"))


def content_key() -> Column:
    """MD5 of a row's doc_id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, src, source_size, n_docs, target): one row per source, in order of code points, null last.

    Targets are weight * level, at most max_epochs * source_size, where level
    makes them sum to share * all sizes. Sharing the excess by weight until no
    target is above its stop ends at this level: with the sources in order of
    stop / weight, it is the first level that the next source's stop allows.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_docs"))
    stats = stats.withColumn("src", (F.row_number().over(by_name) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    stats = stats.withColumn("weight", weight).withColumn("stop", F.lit(float(max_epochs)) * F.col("source_size"))
    upward = everything.orderBy(F.col("stop") / F.col("weight"), "src")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(0, Window.unboundedFollowing)
    stats = stats.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    stats = stats.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    throughout = upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stats = stats.withColumn("level", F.first(fits, ignorenulls=True).over(throughout))
    target = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return stats.select("source", "src", "source_size", "n_docs", target.alias("target"))


def _in_order(sized: DataFrame, targets: DataFrame, n_docs: int) -> DataFrame:
    """Adds src, target, source_size, and the first word and ordinal of each document in its source's stream, a row per copy.

    A running sum in two steps, so that no task holds a whole source: buckets
    of the order by prefix of perm, then the rows of a bucket.
    """
    digits = min(8, max(0, math.ceil(math.log(max(1, n_docs / BUCKET_DOCS), 16))))
    rows = sized.join(targets.drop("n_docs"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("bucket", F.substring("perm", 1, digits)).withColumn("words", F.col("size") * F.col("copies"))
    buckets = rows.groupBy("src", "bucket").agg(F.sum("words").alias("bucket_size"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    inner = Window.partitionBy("src", "bucket").orderBy("perm", "doc_id", "size", "row_key")
    rows = rows.join(buckets.drop("bucket_size"), ["src", "bucket"])
    rows = rows.withColumn("nth", F.row_number().over(inner))
    upto = F.coalesce(F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", F.col("bucket_start") + upto)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("words", "copies")


def split_quotas(quotas: np.ndarray, n_shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks drawn of each source, blocks that earlier shards drew) for first <= shard < last."""
    total = int(quotas.sum())
    upto = lambda shard: total * shard // n_shards

    def descend(low: int, high: int, own: np.ndarray, before: np.ndarray):
        if low >= last or high <= first:
            return
        if high - low == 1:
            yield low, own, before
            return
        mid = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, upto(mid) - upto(low), method="marginals")
        yield from descend(low, mid, draw, before)
        yield from descend(mid, high, own - draw, before + draw)

    yield from descend(0, n_shards, quotas, np.zeros_like(quotas))


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) sends the places: four rounds of a Feistel network, walked on while beyond n."""
    half = np.uint64(max(1, math.ceil((n - 1).bit_length() / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out, walk = places.astype(np.uint64), np.arange(len(places))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for turn in range(4):
            stirred = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            stirred = (stirred ^ (stirred >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((stirred >> np.uint64(32)) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def shard_blocks(quotas: np.ndarray, n_shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, source of each block, block, place in the shard) for first <= shard < last."""
    for shard, own, before in split_quotas(quotas, n_shards, first, last, seed):
        used = np.nonzero(own)[0]
        drawn = [permuted(before[s] + np.arange(own[s]), int(quotas[s]), seed + int(s)) for s in used]
        blocks = np.concatenate(drawn) if drawn else np.zeros(0, np.int64)
        yield shard, np.repeat(used, own[used]), blocks, np.random.default_rng([seed, shard, n_shards, 1]).permutation(len(blocks))


KEY = ["src", "bucket", "nth", "copy"]


def mix_pieces(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents) of the mix.

    pieces: shard, place of the block in the shard, source, doc_id, first_word,
    n_words, epoch - consecutive words of a document, which the shard emits by
    place, then low; also src, bucket, nth, copy, which name the document's row.
    documents: doc_id, source, size, source_size, target, row_key and these four.
    The list of sources, one row each, goes to the driver.
    """
    spark = docs.sparkSession
    sized = written(sized_documents(docs), "sized")
    targets = written(source_targets(sized, weights, share, max_epochs), "targets")
    sources = targets.orderBy("src").select("target", "n_docs").collect()
    n_docs, words = sum(r.n_docs for r in sources), np.array([int(r.target + 0.5) for r in sources], dtype=np.int64)
    total = int(words.sum())
    block = max(BLOCK_WORDS, -(-total // MOST_BLOCKS))
    quotas = -(-words // block)
    n_shards = max(1, total // SHARD_WORDS)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            for shard, src, blocks, place in shard_blocks(quotas, n_shards, int(batch["id"].min()), int(batch["id"].max()) + 1, seed):
                yield pd.DataFrame({"shard": np.full(len(src), shard), "src": src.astype("int32"), "block": blocks, "place": place})

    tasks = max(1, min(n_shards, 64 + n_shards // 64))
    blocks = spark.range(0, n_shards, 1, tasks).mapInPandas(plan, "shard long, src int, block long, place long")

    rows = _in_order(sized, targets, n_docs).withColumn("quota", F.floor(F.col("target") + 0.5))
    passes = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    passes = passes.withColumn("low", F.col("start") + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("low < high")
    span = F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))
    cut = passes.select("*", F.explode(span).alias("block"))
    left = F.greatest(F.col("low"), F.col("block") * block)
    right = F.least(F.col("high"), (F.col("block") + 1) * block)
    cut = cut.withColumns({"first_word": left - F.col("low"), "n_words": right - left})
    pieces = cut.join(blocks.hint("merge"), ["src", "block"])
    return pieces.select("shard", "place", "source", "doc_id", "first_word", "n_words", "epoch", "low", *KEY), rows.select("doc_id", "source", "size", "source_size", "target", "row_key", *KEY)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken; one row per row of docs."""
    pieces, rows = mix_pieces(docs, **options)
    took = pieces.groupBy(*KEY).agg(F.sum("n_words").alias("taken"))
    out = rows.join(took, KEY, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with all columns of docs: a row for each pass over a document that takes words of it.

    Rows are dealt by shard, and a shard's rows stand in the order in which it
    emits their first words. A document of which a pass takes only the first
    words has those in text, with one space between them; n_chars, where there
    is one, is counted anew.
    """
    pieces, rows = mix_pieces(docs, **options)
    start = F.min_by(F.struct("shard", "place", "low"), "first_word").alias("start of it")
    took = pieces.groupBy(*KEY, "epoch").agg(F.sum("n_words").alias("words to take"), start)
    took = took.join(rows.select(*KEY, "row_key", "size"), KEY)
    took = took.select(F.col("row_key").alias("key of the row"), "words to take", F.col("size").alias("all its words"), "start of it")
    keyed = docs.withColumn("key of the row", row_key(docs)).dropDuplicates(["key of the row"])  # rows equal in all columns
    out = keyed.join(took, "key of the row")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words to take").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("words to take") < F.col("all its words"), first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.repartition(F.col("start of it.shard")).sortWithinPartitions("start of it").select(docs.columns)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS perm
  FROM documents),
stats AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS src FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS stop, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM stats),
levels AS (
  SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY stop / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY stop / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY stop / weight, src) AS nth FROM weighed),
level AS (SELECT level FROM levels WHERE level * weight <= stop ORDER BY nth LIMIT 1),
targets AS (
  SELECT source, source_size, least(stop, coalesce((SELECT level FROM level) * weight, stop)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.perm, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start)
        + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken
FROM placed
"""
