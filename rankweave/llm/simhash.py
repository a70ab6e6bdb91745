"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

Fingerprints at `DISTANCE` = 3 or fewer differing bits share at least 8 - 3 = 5
of their 8 positional bytes. A posting list on one byte would hold a 256th of
the corpus, so the index is keyed by four positions at once. The 14 blocks of
the Steiner system S(3, 4, 8) are enough: whichever three bytes differ, they
lie in one block, and its complement, a block too, is shared. Within a posting
list the shared positional bytes of each pair are tallied, pairs that reach
five are kept and verified bit by bit. Only links that join something new are
put out, so a list of near-copies costs one link per member.

Lists longer than `most` are dealt anew by one more shared byte, which linked
pairs must have; lists that are too long even then, all within 24 free bits,
are joined on every way of leaving out three bits: both steps lose no link.

Defined cases: texts that are null, empty or without words have fingerprint
zero and link with one another; equal texts have equal fingerprints, whatever
their number; a text of any length is read whole; equal rows each get a row; an empty table gives no rows; a
component's id ignores null doc_ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.graph import connected_components
from rankweave.llm.shared import row_key, table, written

SHINGLE, SEED, DISTANCE, BYTES = 3, 42, 3, 8
#: Positional bytes that linked fingerprints share at least.
SHARED = BYTES - DISTANCE
#: Fingerprints of a posting list that one task compares.
MOST = 1 << 16


def quadruples() -> list[tuple[int, ...]]:
    """S(3, 4, 8): four positions whose numbers, in binary, add to zero without carry."""
    return [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: str | None) -> int:
    """64 bits, each the majority over XXH64 of the text's shingles; signed, as Spark keeps it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(SHINGLE)] if len(words) >= SHINGLE else [[b" ".join(words)]]
    n = len(parts[-1])
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*parts))), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, n, 8192):
        some = hashes[low : low + 8192]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp): one row per document, with more columns before fp."""
    known = docs.select("doc_id", *more).schema
    names = [*known.names, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names)

    return docs.select("doc_id", *more, F.col("text").alias("text to print")).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.fields) + ", fp long")


def near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of the others link with one: tally shared positional bytes, then verify."""
    differing = others ^ one
    tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    found = tally >= SHARED
    found[found] = np.bitwise_count(differing[found]) <= DISTANCE
    return found


def joining_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that connect what is linked within one posting list."""
    left, heads, members = fps, [], []
    while len(left) > 1:
        head, left = left[0], left[1:]
        queue = [head]
        while queue and len(left):
            hit = near(queue.pop(), left)
            if hit.any():
                new, left = left[hit], left[~hit]
                queue.extend(new)
                members.append(new)
                heads.append(np.full(len(new), head))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(heads)) if members else (none, none)


def _links_of_lists(lists: DataFrame) -> DataFrame:
    """(a, b) from rows with an array fps of one posting list's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            sizes = np.diff(at)
            first = at[:-1][sizes == 2]
            a, b = values[first], values[first + 1]
            differing = a ^ b
            good = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= SHARED
            good &= np.bitwise_count(differing) <= DISTANCE
            left, right = [a[good]], [b[good]]
            for k in np.flatnonzero(sizes > 2):
                member, head = joining_links(values[at[k] : at[k + 1]])
                left.append(member)
                right.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    return lists.select("fps").mapInArrow(run, "a long, b long")


def _bits(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _shared_lists(postings: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(lists of at most `most` fingerprints, postings of the longer lists)."""
    long = written(postings.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "long")
    short = postings.join(long, keys, "left_anti").groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return short, postings.join(long, keys, "left_semi")


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) over distinct fingerprints fp: enough links to connect all that are within DISTANCE bits."""
    blocks = quadruples()
    keys = F.array(*[F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), q).alias("part")) for i, q in enumerate(blocks)])
    postings = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.part")
    short, rest = _shared_lists(postings, ["block", "part"], most)
    found = _links_of_lists(short)
    if rest.isEmpty():
        return found
    more = F.array(*[F.struct(F.lit(p).alias("at"), _bits(F.col("fp"), (p,)).alias("byte")) for p in range(BYTES)])
    taken = F.element_at(F.array(*[F.array(*[F.lit(p) for p in q]) for q in blocks]), F.col("block") + 1)
    rest = rest.select("fp", "block", "part", taken.alias("taken"), F.explode(more).alias("m")).where("not array_contains(taken, m.at)")
    short, rest = _shared_lists(rest.select("fp", "block", "part", "m.at", "m.byte"), ["block", "part", "at", "byte"], most)
    found = found.union(_links_of_lists(short))
    if rest.isEmpty():
        return found
    free = [[8 * p + b for p in range(BYTES) if p not in q for b in range(8)] for q in blocks]
    masks = written(
        classes.sparkSession.createDataFrame(
            [(i, at, sum(1 << b for b in three) - (1 << 64 if 63 in three else 0)) for i, f in enumerate(free) for at in range(BYTES) if at not in blocks[i] for three in combinations([b for b in f if b // 8 != at], DISTANCE)],
            "block int, at int, mask long",
        ),
        "masks",
    )
    blind = rest.join(masks, ["block", "at"]).select("fp", "block", "at", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("seen"))
    group = blind.groupBy("mask", "seen").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return found.union(group.select(F.explode("fps").alias("a"), "b").where("a <> b"))


def near_duplicates(docs: DataFrame, most: int = MOST, *more: Column) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable by links.

    With more columns of docs, these and root, the same of all that links reach.
    """
    prints = written(fingerprints(docs, *more), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    members = connected_components(links(classes, most))
    roots = classes.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    kept = ["fp", "component_id", *(["root"] if more else [])]
    return prints.join(roots.join(named, "root").select(*kept), "fp")


def one_of_each_group(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest doc_id.

    Rows without doc_id come after all others; of several rows with that doc_id
    the one with the smallest key of all its columns stays, and of rows equal
    in all columns one.
    """
    key = "key of the row"
    found = written(near_duplicates(docs, most, row_key(docs).alias("row_key")), "near")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first"))
    chosen = written(first.select(F.col("first.row_key").alias(key)), "chosen")
    repeated = written(found.groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias(key)), "repeated")
    kept = docs.withColumn(key, row_key(docs)).join(chosen, key, "left_semi")
    single = kept.join(repeated, key, "left_anti")
    several = kept.join(repeated, key, "left_semi").dropDuplicates([key])
    return single.select(docs.columns).union(several.select(docs.columns))


def op10_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
