"""The kept BM25 index, the running best of a task and ranking by shard."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankweave.operators import postings, rank, retrieve
from rankweave.operators.dense import Best


def same(got, want) -> bool:
    """Rows alike in all but the last column, and there to rounding."""
    got, want = sorted(got), sorted(want)
    return [g[:-1] for g in got] == [w[:-1] for w in want] and [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=2e-6)


@pytest.fixture(scope="module")
def texts(spark):
    """Words of very different frequency: "the" in nearly all, some in few documents, one document empty."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, ["the"] * (i % 9 > 0) * rng.randint(1, 5) + rng.choices(words, weights, k=rng.choice([3, 20, 60, 200]))) for i in range(900)]
    rows += [(2000, []), (2001, ["w250"] * 7), (2002, ["w250", "w251"])]
    asked = [(i, rng.choices(words, k=rng.randint(1, 6))) for i in range(25)] + [(30, ["the"]), (31, ["the", "w250", "w250"]), (32, ["unknown"]), (33, [])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(5), spark.createDataFrame(asked, "qid long, tokens array<string>")


@pytest.mark.parametrize(("kind", "k", "block", "seeds"), [("plain", 10, 16, None), ("smooth", 3, 8, 1), ("plain", 1000, 128, None)])
def test_index_finds_what_a_full_search_finds(texts, tmp_path, kind, k, block, seeds):
    docs, queries = texts
    index = postings.build(docs, str(tmp_path / "index"), kind=kind, block_docs=block)
    want = retrieve.bm25(docs, queries, k, kind=kind).collect()
    got = postings.Index(docs.sparkSession, str(tmp_path / "index")).search(queries, k, seeds).collect()
    key = lambda r: (r.qid, r["rank"], r.doc_id, r.score)
    assert len(want) > 20 and same(map(key, got), map(key, want))
    counts = index.block_counts(queries, k, seeds).first()
    assert counts.scored <= counts.blocks
    if k < 100:
        assert counts.scored < counts.blocks


def test_index_search_exchanges_no_pairs_and_leaves_blocks_out(texts, tmp_path):
    docs, queries = texts
    index = postings.build(docs, str(tmp_path / "index"), block_docs=16)
    want = index.search(queries, 4, method="relational").collect()
    got = index.search(queries, 4).collect()
    key = lambda r: (r.qid, r["rank"], r.doc_id, r.score)
    assert len(want) > 20 and same(map(key, got), map(key, want))
    # a task puts out no more than its best, not a row for each query and document or block
    rows = index._by_kernel(queries, 4)
    per_task = rows.groupBy(F.spark_partition_id(), "qid").count().agg(F.max("count")).first()[0]
    assert per_task <= 4
    # rows of a block that are cut by batches come together again, and blocks that cannot enter are not scored
    batch = pa.Table.from_pandas(index.read("blocks").toPandas().sort_values(["block", "term"], kind="stable"), preserve_index=False).combine_chunks().to_batches()[0]
    blocks = list(postings.whole_blocks(batch.slice(low, 7) for low in range(0, batch.num_rows, 7)))
    assert [len(set(b.column("block").to_pylist())) for b in blocks] == [1] * len(set(batch.column("block").to_pylist()))
    wanted = index.wanted(queries).withColumnRenamed("share", "q_weight")
    (group,) = retrieve.vector_groups(wanted)
    scorer, every = postings.BlockScorer(group), postings.BlockScorer(group)
    best = Best(scorer.qids, pa.int64(), 4)
    for block in blocks:
        list(scorer.add(block, best, 4))
        list(every.add(block, Best(scorer.qids, pa.int64(), 4), 4))
    found = [tuple(r.values()) for b in best.rest() for r in b.to_pylist()]
    assert same(found, [(r.qid, r.doc_id, r.score) for r in want]) and scorer.scored < every.scored


def test_blocks_and_files_are_bounded(texts, tmp_path):
    docs, _ = texts
    docs.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # files this small would be one
    try:
        index = postings.build(docs, str(tmp_path / "index"), block_docs=16)
    finally:
        docs.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = index.read("blocks").where("term = 'the'").collect()
    assert len(rows) > 40 and all(r.n == len(r.docs) == len(r.gains) <= 16 and r.top == max(r.gains) for r in rows)
    assert sum(r.n for r in rows) == index.read("terms").where("term = 'the'").first().df
    files = [r["count"] for r in index.read("blocks").selectExpr("input_file_name() AS f").groupBy("f").count().collect()]
    assert len(files) > 2 and max(files) < 0.5 * sum(files)


def test_an_empty_corpus_has_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, tokens array<string>")
    index = postings.build(docs, str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>"), 5).collect() == []


def test_running_best_keeps_what_sorting_all_keeps():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 30, (7, 500)).astype(float)
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[6] = -np.inf
    ids = rng.permutation(500)
    best, out = Best(pa.array(range(7)), pa.int64(), 5), []
    for low in range(0, 500, 37):
        out += best.add(scores[:, low : low + 37], pa.array(ids[low : low + 37]))
        if low % 2:
            best._cut()
    out += best.rest()
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert len(got) == 30
    for q in range(6):
        want = sorted(((-scores[q, i], ids[i]) for i in range(500) if np.isfinite(scores[q, i])))[:5]
        assert sorted((-s, d) for n, d, s in got if n == q) == want


def test_best_of_each_shard(texts):
    docs, queries = texts
    dealt = docs.withColumn("shard", rank.split_and_shard(docs.doc_id, 20, 4)[1])
    got = retrieve.bm25(dealt, queries, 3, shard="shard").collect()
    want = rank.shard_top_k(retrieve.bm25(docs, queries, None).drop("rank"), dealt.select("doc_id", "shard"), 3).collect()
    again = retrieve.bm25(dealt, queries, 3, shard="shard", method="relational").collect()
    key = lambda r: (r.shard, r.qid, r["rank"], r.doc_id, r.score)
    assert same(map(key, got), map(key, want)) and same(map(key, again), map(key, want))


def test_a_task_puts_out_no_more_than_its_best(texts):
    docs, queries = texts
    from rankweave.operators.retrieve import _by_kernel

    rows = _by_kernel(docs.coalesce(1), queries, 4, 0.9, 0.4, "plain", None)
    assert rows.count() <= 4 * queries.count()


@pytest.mark.parametrize("nbits", [1, 2, 4])
def test_tables_of_packed_codes_give_the_products_of_decoded_vectors(nbits):
    from rankweave.operators.packed import Codec

    rng = np.random.default_rng(nbits)
    vectors, queries = rng.normal(size=(90, 32)), rng.normal(size=(11, 32))
    own = Codec(rng.normal(size=(7, 32)), np.sort(rng.normal(size=2**nbits - 1)), np.sort(rng.normal(size=2**nbits)), nbits)
    codes, data, sizes = own.packed(vectors)
    assert data.shape == (90, 32 * nbits // 8)
    levels = ((vectors - own.centroids[codes])[:, :, None] > own.cutoffs).sum(axis=2)
    decoded = own.centroids[codes] + own.weights[levels]
    decoded /= np.linalg.norm(decoded, axis=1, keepdims=True)
    assert np.allclose(own.products(own.tables(queries), codes, data, sizes), queries @ decoded.T)


def test_packed_search_is_that_of_the_decoded_vectors(spark, texts):
    from rankweave.operators import encode, interact, packed

    docs, queries = texts
    docs = docs.where("doc_id < 60")
    rng = np.random.default_rng(5)
    encoder = encode.VocabularyEncoder(rng.normal(size=(50, 16)))
    own = packed.Codec(rng.normal(size=(5, 16)) / 4, np.array([-0.1, 0.0, 0.1]), np.array([-0.2, -0.05, 0.05, 0.2]), 2)
    rows = packed.postings(docs, encoder, own)
    pairs = spark.createDataFrame([(q, d) for q in range(0, 33, 2) for d in range(0, 60, 3)], "qid long, doc_id long")
    for candidates in (None, pairs):
        got = {(r.qid, r.doc_id, r.term): r for r in packed.matches(rows, queries, encoder, own, candidates).collect()}
        want = {(r.qid, r.doc_id, r.term): r for r in interact.exact_matches(docs, queries, encoder, candidates).collect()}
        assert got.keys() == want.keys() and len(got) > 50
        assert all((g.tf, g.qtf, g.doc_len) == (want[k].tf, want[k].qtf, want[k].doc_len) for k, g in got.items())
    asked = {r.qid: r.tokens for r in queries.collect()}
    for d in docs.collect()[:20]:
        if d.tokens:
            codes, data, sizes = own.packed(encode.pooled(encoder, d.tokens))
            levels = ((encode.pooled(encoder, d.tokens) - own.centroids[codes])[:, :, None] > own.cutoffs).sum(axis=2)
            decoded = encode.unit_rows(own.centroids[codes] + own.weights[levels])
            for q in (31, 0, 5):
                vectors = encode.pooled(encoder, asked[q])
                for term in set(asked[q]) & set(d.tokens):
                    best = (vectors[[t == term for t in asked[q]]] @ decoded[[t == term for t in d.tokens]].T).max()
                    found = packed.matches(rows.where(rows.doc_id == d.doc_id), queries.where(queries.qid == q), encoder, own).where(F.col("term") == term).first()
                    assert found.best == pytest.approx(best)
                break


def test_sparse_best_are_those_of_the_join(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(d, t, rng.uniform(0, 3)) for d in range(400) for t in {"the", *(f"w{rng.randrange(80)}" for _ in range(6))} if t != "the" or d % 5]
    queries = [(q, t, rng.uniform(0, 2)) for q in range(30) for t in {"the", *(f"w{rng.randrange(90)}" for _ in range(4))}] + [(99, "none", 1.0)]
    left, right = spark.createDataFrame(docs, "doc_id long, term string, weight double").repartition(3), spark.createDataFrame(queries, "qid long, term string, q_weight double")
    want = rank.top_k(rank.rounded(retrieve.postings_score(left, right)), 7).collect()
    assert len(list(retrieve.vector_groups(right, 20))) > 3
    key = lambda r: (r.qid, r["rank"], r.doc_id, r.score)
    assert same(map(key, retrieve.sparse_top_k(left, right, 7).collect()), map(key, want))


@pytest.mark.parametrize("held", [1 << 23, 200])
def test_the_nearest_of_many_centroids(spark, monkeypatch, held):
    from rankweave.operators import codec

    monkeypatch.setattr(codec, "HELD", held)
    monkeypatch.setattr(codec, "BLOCK", 16)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(150, 8))
    centroids = rng.normal(size=(90, 8)) * rng.exponential(1, (90, 1))
    centroids[40] = centroids[3]
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id int, vec array<double>, more string").repartition(3)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "code long, centroid array<double>")
    got = {r.vec_id: r.code for r in codec.assign(rows, table).collect()}
    assert got == dict(enumerate(np.round(vectors @ centroids.T, 9).argmax(axis=1).tolist()))
    assert codec.assign(rows, table).columns == ["vec_id", "vec", "more", "code"] and codec.assign(rows.limit(0), table).count() == 0
