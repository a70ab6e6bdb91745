"""That work and memory grow no faster than the input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rankweave.functions import batches, vectors
from rankweave.operators import codec, dense, encode, index, interact, pooling, retrieve, sparse, stats
from rankweave.plans import catalog, context


class Counted(dict):
    """A dict that tells how many of its keys were walked through."""

    walked = 0

    def __iter__(self):
        for key in super().__iter__():
            self.walked += 1
            yield key

    def keys(self):
        self.walked += len(self)
        return super().keys()


def test_encoder_does_not_walk_through_what_it_knows():
    own = encode.VocabularyEncoder(np.eye(4))
    own.known = Counted({f"w{i}": i % 4 for i in range(1000)})
    assert np.array_equal(own.encode(["w1", "w5", "w2"]), np.eye(4)[[1, 1, 2]])
    assert own.known.walked == 0


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"x": list(range(10))})
    parts = list(batches.slices(iter([batch, batch.slice(0, 0)]), 4))
    assert [p.num_rows for p in parts] == [4, 4, 2]
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(10))


def sample(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, []), (3, ["b", "d", "b"]), (4, ["x"]), (5, ["c", "a"] * 40)], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(7, ["a", "b", "b"]), (8, ["d", "q"]), (9, [])], "qid long, tokens array<string>")
    return docs, queries, encode.VocabularyEncoder(np.random.default_rng(5).normal(size=(11, 4)))


def test_corpus_scores_of_blocks_are_those_of_matches(spark, monkeypatch):
    docs, queries, own = sample(spark)
    matches = interact.exact_matches(docs, queries, own)
    want = interact.scored(matches, interact.query_term_idf(docs, queries), stats.summary(docs))
    want = {(r.qid, r.doc_id): round(r.maxsim_bm25_qtf, 6) for r in want.collect()}
    for held in (interact.HELD, 8):
        monkeypatch.setattr(interact, "HELD", held)
        got = {(r.qid, r.doc_id): r.score for r in interact.corpus_top_k(docs, queries, own, 10).collect()}
        assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 2e-6 for key in want)


def test_digests_are_those_of_token_vectors(spark):
    docs, _, own = sample(spark)
    for pooler in encode.POOLERS:
        want = {(r.doc_id, r.pos, r.term): np.array(r.vec) for r in encode.token_vectors(docs, own, pooler=pooler).collect()}
        got = {(r.doc_id, r.pos, r.term): (r.total, r.spread, r.square) for r in encode.token_digests(docs, own, pooler=pooler).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[key], (v.sum(), v @ [1, 2, 3, 4], v @ v)) for key, v in want.items())


def test_weights_of_documents_need_no_shuffle(spark):
    docs, _, own = sample(spark)
    for how in ("max", "mean"):
        want = {(r.doc_id, r.term): r.weight for r in sparse.document_weights(docs, own, how).collect()}
        rows = sparse.document_weights(docs, own, how, repeated=False)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        for got in ({(r.doc_id, r.term): r.weight for r in rows.collect()}, {(r.doc_id, t): w for r in sparse.document_weights(docs, own, how, repeated=False, gathered=True).collect() for t, w in zip(r.term, r.weight)}):
            assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-12 for key in want)
    assert stats.repeated(docs.union(docs)) and not stats.repeated(docs)


def test_postings_are_sums_of_token_vectors(spark):
    docs, _, own = sample(spark)
    want: dict = {}
    for r in encode.token_vectors(docs, own).collect():
        n, total = want.get((r.doc_id, r.term), (0, 0.0))
        want[r.doc_id, r.term] = n + 1, total + sum(r.vec)
    got = {(r.doc_id, r.term): (r.n, r.total) for r in encode.document_terms(docs, own, "postings").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[key], want[key]) for key in want)


def test_candidates_travel_to_the_documents(spark):
    docs, _, _ = sample(spark)
    rows = interact.asked_for(docs, spark.createDataFrame([(7, 1), (8, 1), (7, 5)], "qid long, doc_id long"))
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: sorted(r.wanted) for r in rows.collect()} == {1: [7, 8], 5: [7]}


def test_bm25_means_of_frequent_and_rare_terms(spark):
    docs, _, own = sample(spark)
    want = {r.doc_id: r.vec for r in pooling.bm25_means(docs, own).collect()}
    assert want.keys() == {1, 3, 4, 5}
    for frequent in (1, 3, 100):
        got = {r.doc_id: r.vec for r in pooling.bm25_means(docs, own, repeated=False, frequent=frequent).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[key], want[key]) for key in want)


def test_a_file_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(context, "SMALL", 1 << 10)
    rows = pa.table({"doc_id": list(range(4000)), "text": [f"word {i} " * 5 if i % 7 else None for i in range(4000)]})
    pq.write_table(rows, tmp_path / "one.parquet")
    pq.write_table(rows, tmp_path / "many.parquet", row_group_size=100)
    cores = spark.sparkContext.defaultParallelism
    one = context.spread(spark.read.parquet(str(tmp_path / "one.parquet")))
    tasks = [len(part) for part in one.rdd.glom().collect()]
    assert sum(n > 0 for n in tasks) >= cores and max(tasks) * cores < 2 * sum(tasks)
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", (tmp_path / "many.parquet").stat().st_size // (4 * cores))
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert "Exchange" not in context.spread(spark.read.parquet(str(tmp_path / "many.parquet")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lists_of_tokens_without_a_python_string_a_place():
    whole = pa.array([["x"], ["a", "b", "a"], [], ["ß", "b"], ["a"]], pa.list_(pa.string()))
    for lists in (whole, whole.slice(1, 3), whole.slice(2, 1), pa.array([["a", None], None], pa.list_(pa.string()))):
        assert batches.token_lists(lists) == lists.to_pylist()
    first, _, again = batches.token_lists(whole.slice(1, 1))[0]
    assert first is again
    row, term, n = batches.term_counts_of(whole.slice(1, 4), pa.array(["b", "a", "q"]))
    assert list(zip(row.tolist(), term.tolist(), n.tolist())) == [(0, 0, 1), (0, 1, 2), (2, 0, 1), (3, 1, 1)]
    assert not len(batches.term_counts_of(whole, pa.array([], pa.string()))[0])


def test_bm25_of_parts_of_a_block_is_that_of_joins(spark, monkeypatch):
    docs, queries, _ = sample(spark)
    want = {(r.qid, r.doc_id): (r.score, r["rank"]) for r in retrieve.bm25(docs, queries, 10, method="relational").collect()}
    for most in (retrieve.PAIRS, 1, 3):
        monkeypatch.setattr(retrieve, "PAIRS", most)
        assert {(r.qid, r.doc_id): (r.score, r["rank"]) for r in retrieve.bm25(docs, queries, 10).collect()} == want


def test_stems_are_made_on_all_cores(spark):
    rows = catalog.queries()["stemmed_tokens"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


FOLDER = "/root/testdata/sf0.001"


def test_tokens_are_kept_on_disk_in_one_string(spark):
    docs, _, _ = sample(spark)
    back = stats.parted(stats.joined(docs))
    assert back.schema["tokens"].dataType == docs.schema["tokens"].dataType
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    c = context.Collection(spark, FOLDER)
    plan = c.darr._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation [doc_id#" in plan and "line#" in plan and "StorageLevel(disk, 1 replicas)" in plan
    assert sorted(map(tuple, c.darr.collect())) == sorted(map(tuple, c.read_once.collect()))


def test_texts_travel_in_small_batches_unless_the_session_names_a_number(spark):
    name, rows = context.TEXTS
    named = spark.conf.getAll.get(name)
    spark.conf.unset(name)
    try:
        context.collection(spark, FOLDER)
        assert int(spark.conf.get(name)) == rows
        sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= rows
        spark.conf.set(name, 77)
        context.collection(spark, FOLDER)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name) if named is None else spark.conf.set(name, named)


def test_vectors_of_a_local_folder_are_mapped_and_not_held(spark, monkeypatch):
    own = np.random.default_rng(3).normal(size=(50, 4)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<float>").repartition(4)
    words = [f"w{i}" for i in range(200)] + ["w7", "w3"]
    want = encode.VocabularyEncoder(own).encode(words)
    filed = encode.VocabularyEncoder.from_table(table, 10)
    assert np.array_equal(filed.encode(words), want) and not filed.met
    assert filed.encode([]).shape == (0, 4)
    monkeypatch.setattr(encode.fs, "LocalFileSystem", encode.fs.S3FileSystem)
    filed._forget()
    assert np.array_equal(filed.encode(words), want) and filed.met


def test_a_task_cuts_its_best_before_it_holds_many():
    n, k, docs = 1000, 100, 200
    best, most, rng = dense.Best(pa.array(range(n)), pa.int64(), k), 0, np.random.default_rng(2)
    blocks = [np.round(rng.normal(size=(n, docs)) + i, 6) for i in range(10)]
    for i, scores in enumerate(blocks):
        assert not list(best.add(scores, pa.array(range(i * docs, (i + 1) * docs))))
        most = max(most, best.held)
    assert most <= 2 * n * k + dense.SPARE + n * k
    got = pa.Table.from_batches(best.rest())
    whole = np.concatenate(blocks, axis=1)
    assert got.num_rows == n * k
    assert sorted(got.filter(pyarrow.compute.equal(got["qid"], 5))["score"].to_pylist()) == sorted(np.sort(whole[5])[-k:].tolist())


def test_a_plan_of_one_pass_keeps_no_tokens(spark):
    rows = index.scatter_maps(context.Collection(spark, FOLDER).dstream)
    assert "InMemoryRelation" not in rows._jdf.queryExecution().withCachedData().toString()


def test_bits_of_packed_codes_are_made_once_a_row(spark):
    rows = spark.createDataFrame([(1, [0, 3, 1, 2]), (3, None)], "id long, codes array<int>")
    held = rows.select("id", codec.packed(F.col("codes"), 2).alias("held"))
    assert held._jdf.queryExecution().analyzed().toString().count("codes#") == rows._jdf.queryExecution().analyzed().toString().count("codes#") + 1
    back = held.select("id", codec.unpacked(F.col("held"), 2).alias("codes"))
    assert [tuple(r) for r in held.orderBy("id").collect()] == [(1, "39"), (3, None)]
    none = spark.createDataFrame([("",)], "held string").select(codec.unpacked(F.col("held"), 2).alias("codes"))
    assert none.first().codes == []
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, [0, 3, 1, 2]), (3, None)]


def test_a_vector_and_its_length_are_made_once_a_row(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, vec array<float>")
    unit = rows.select("id", vectors.normalized(F.col("vec")).alias("unit"))
    assert unit._jdf.queryExecution().analyzed().toString().count("vec#") == rows._jdf.queryExecution().analyzed().toString().count("vec#") + 1
    assert [tuple(r) for r in unit.orderBy("id").collect()] == [(1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, None)]
