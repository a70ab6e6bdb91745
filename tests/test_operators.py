"""Small inputs with values worked out by hand, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import text, vectors, weights
from rankweave.operators import codec, dense, encode, explain, fuse, index, interact, metrics, mining, rank, relevance, retrieve, significance, sparse, stats


def run_of(spark, rows):
    return spark.createDataFrame([(q, d, float(s)) for q, docs in rows.items() for d, s in docs.items()], "qid string, doc_id string, score double")


def qrels_of(spark, rows):
    return spark.createDataFrame([(q, d, r) for q, docs in rows.items() for d, r in docs.items()], "qid string, doc_id string, rel int")


QRELS = {"q1": {"d1": 0, "d2": 1, "d3": 0}, "q2": {"d2": 1, "d3": 1}}
RUN = {"q1": {"d1": 1.0, "d2": 0.1, "d3": 1.5}, "q2": {"d1": 1.5, "d2": 0.2, "d3": 0.5}}


def ndcg(spark, run, qrels, k):
    return {r.qid: r.ndcg for r in metrics.per_query(run_of(spark, run), qrels_of(spark, qrels), (k,), ("ndcg",)).collect()}


def test_ndcg(spark):
    assert ndcg(spark, RUN, QRELS, 1) == {"q1": 0.0, "q2": 0.0}
    assert ndcg(spark, RUN, QRELS, 10) == {"q1": 0.5, "q2": round((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)), 6)}
    unjudged = {"q1": {**RUN["q1"], "d4": 0.4, "d2": 0.2}, "q2": {**RUN["q2"], "d4": 0.01}}
    assert ndcg(spark, unjudged, QRELS, 10) == {"q1": round(1 / math.log2(5), 6), "q2": ndcg(spark, RUN, QRELS, 10)["q2"]}


def plain_ndcg(gains, ideal, k):
    discounted = lambda rels: sum(g / math.log2(i + 2) for i, g in enumerate(rels[:k]))
    return discounted(gains) / discounted(sorted(ideal, reverse=True))


def test_ndcg_against_a_second_one(spark):
    rng = np.random.default_rng(7)
    qrels = {f"q{q}": {f"d{d}": int(g) for d, g in enumerate(rng.integers(0, 4, 12))} | {"d0": 1} for q in range(20)}
    run = {q: {f"d{d}": float(s) for d, s in enumerate(rng.permutation(15))} for q in qrels}
    for k in (1, 5, 10):
        found = ndcg(spark, run, qrels, k)
        for q, docs in run.items():
            gains = [qrels[q].get(d, 0) for d in sorted(docs, key=docs.get, reverse=True)]
            assert math.isclose(found[q], plain_ndcg(gains, list(qrels[q].values()), k), abs_tol=1e-6)


def test_metrics_of_a_missing_query(spark):
    rows = metrics.per_query(run_of(spark, RUN), qrels_of(spark, {**QRELS, "q3": {"d4": 1}}), (2,)).collect()
    got = {r.qid: r for r in rows}
    assert set(got) == {"q1", "q2", "q3"} and got["q3"].ndcg == got["q3"].map == got["q3"].mrr == 0
    assert (got["q2"].recall, got["q2"].precision, got["q2"].mrr, got["q2"].rcap, got["q2"].hole) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert got["q2"].map == 0.25
    with pytest.raises(ValueError):
        metrics.per_query(run_of(spark, RUN), qrels_of(spark, QRELS), (1,), ("f1",))


def test_tie_rules(spark):
    run = run_of(spark, {"q": {"a": 0.5, "b": 0.5, "c": 0.1}})
    assert [r.doc_id for r in rank.top_k(run, 1).collect()] == ["a"]
    assert [r.doc_id for r in rank.top_k(run, 1, descending_ids=True).collect()] == ["b"]


def test_min_fill_fusion(spark):
    one, two = run_of(spark, RUN), run_of(spark, {"q1": {"d1": 1.5, "d2": 0.2, "d3": 0.5, "d4": 0.01}, "q2": {"d4": 2.0}, "q3": {"d1": 1.5}})
    got = {(r.qid, r.doc_id): r.score for r in fuse.weighted_min_fill(one, two, 1.0).collect()}
    assert not any(q == "q3" for q, _ in got)
    assert math.isclose(got["q1", "d4"], 0.099) and math.isclose(got["q2", "d4"], 0.199)
    assert {d: got["q1", d] for d in RUN["q1"]} == RUN["q1"]
    half = {(r.qid, r.doc_id): r.score for r in fuse.weighted_min_fill(one, two, 0.25).collect()}
    assert math.isclose(half["q3", "d1"], 0.75 * 1.5) and math.isclose(half["q1", "d1"], 0.25 * 1 + 0.75 * 1.5)


def test_other_fusions(spark):
    one, two = run_of(spark, {"q": {"a": 2, "b": 1}}), run_of(spark, {"q": {"b": 4, "c": 3}})
    as_dict = lambda run: {r.doc_id: r.score for r in run.collect()}
    assert as_dict(fuse.weighted_second_driven(one, two, 0.5)) == {"a": 2.5, "b": 2.5, "c": 1.5}
    assert as_dict(fuse.top_k_added(one, two, 1)) == {"a": 6.0, "b": 6.0}
    assert as_dict(fuse.outer_sum(one, two)) == {"a": 2.0, "b": 5.0, "c": 3.0}
    assert as_dict(fuse.added_where_present(one, two)) == {"a": 2.0, "b": 5.0}


def test_relevance_weight(spark):
    row = spark.range(1).select(weights.relevance_weight(F.lit(10), F.lit(2), F.lit(3), F.lit(1)).alias("w")).first()
    assert math.isclose(row.w, math.log(2.6))


def test_equal_width_bins(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "rsj double")
    assert [r.bin for r in relevance.equal_width_bins(rows, 4).orderBy("rsj").collect()] == [1, 2, 3, 3]
    with pytest.raises(ValueError):
        relevance.threshold_bins(rows, "mean")


def test_step_up(spark):
    rows = spark.createDataFrame(list(zip("abcdex", (0.001, 0.01, 0.031, 0.041, 0.2, 1e-9))), "dataset string, p double")
    got = significance.step_up(rows, 0.05, exclude=("x",)).orderBy("rank").collect()
    assert [round(r.adjusted, 5) for r in got] == [0.005, 0.025, 0.05167, 0.05125, 0.2]
    assert [r.rejected for r in got] == [True, True, False, False, False]


def test_student_p():
    # two-sided values from tables
    assert math.isclose(significance.student_p(2.228, 11), 0.05, abs_tol=1e-4)
    assert math.isclose(significance.student_p(-4.604, 5), 0.01, abs_tol=1e-4)
    assert math.isclose(significance.student_p(0.0, 9), 1.0)


def test_systems_over_datasets(spark):
    def of(shift):
        return spark.createDataFrame([(d, q, 0.5 + shift * (q % 3 + 1) * (d == "x")) for d in "xy" for q in range(9)], "dataset string, qid int, ndcg double")

    scores = {"base": of(0.0), "better": of(0.1), "worse": of(-0.1)}
    rows = {(r.system, r.dataset): r for r in significance.over_datasets(scores, ("base",), "ndcg").collect()}
    assert len(rows) == 4 and math.isclose(rows["better", "x"].t, -rows["worse", "x"].t) and rows["better", "x"].t > 0 and rows["better", "y"].p is None
    assert rows["better", "x"].p == significance.student_p(rows["better", "x"].t, 9) < 0.001
    stepped = significance.over_datasets(scores, ("base",), "ndcg", 0.05).collect()
    assert len(stepped) == 2 and all(r.rejected for r in stepped)
    with pytest.raises(ValueError):
        significance.over_datasets(scores, ("other",), "ndcg")


def test_local_average_frames():
    x = np.arange(7.0)[:, None]
    for w in (1, 2, 3, 9):
        assert np.allclose(encode.local_average(x, w)[:, 0], [np.mean(range(max(i - w, 0), min(i + w, 7))) for i in range(7)])
    with pytest.raises(ValueError):
        encode.local_average(x, 0)


class Table:
    """Two-dimensional vectors of a few tokens."""

    dim = 2
    of = {"a": [1, 0], "b": [0, 1], "c": [-1, 0], "z": [0, 0], "d": [3, 4]}

    def encode(self, tokens):
        return np.array([self.of[t] for t in tokens], dtype=float).reshape(-1, 2)


def arrays(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} long, tokens array<string>")


@pytest.fixture(scope="module")
def small(spark):
    docs = arrays(spark, "doc_id", [(1, ["a", "b", "a"]), (2, ["d"]), (3, ["c", "z", "b"]), (7, ["a", "z"]), (8, [])])
    return docs, arrays(spark, "qid", [(7, ["a", "a", "d"]), (9, ["z", "b"]), (10, [])])


def test_candidates_are_scored_where_they_are_read(spark, small):
    docs, queries = small
    pairs = docs.select("doc_id").crossJoin(queries.select("qid")).where("doc_id <> 2").union(spark.createDataFrame([(99, 9), (1, 77)], "doc_id long, qid long"))
    matches = interact.exact_matches(docs, queries, Table(), pairs.select("qid", "doc_id"))
    want = {(r.qid, r.doc_id): r.maxsim_bm25_qtf for r in interact.scored(matches, interact.query_term_idf(docs, queries), stats.summary(docs)).collect()}
    got = {(r.qid, r.doc_id): r.score for r in interact.candidate_scores(docs, queries, Table(), pairs.select("qid", "doc_id")).collect()}
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert interact.candidate_scores(docs, queries.where("false"), Table(), pairs).count() == 0
    assert interact.candidate_scores(docs, queries, Table(), pairs.where("false")).count() == 0


def test_weights_from_counts_and_relevant_documents_alone(spark):
    postings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a")], "doc_id long, term string")
    terms = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "z"), ("r", "c")], "qid string, term string")
    relevant = spark.createDataFrame([("q", 1), ("q", 3), ("r", 3)], "qid string, doc_id long")
    n_docs, n_term = spark.createDataFrame([(4,)], "n_docs long"), postings.groupBy("term").agg(F.count("*").alias("n_term"))
    whole = relevance.term_weights(postings, terms, relevant, n_docs)
    part = relevance.term_weights(postings.where("doc_id in (1, 3)"), terms, relevant, n_docs, n_term)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 4


def test_exact_matches(small):
    docs, queries = small
    got = {(r.qid, r.doc_id, r.term): (r.tf, r.qtf, round(r.total, 6), round(r.best, 6)) for r in interact.exact_matches(docs, queries, Table(), pooler="token").collect()}
    assert got == {(7, 1, "a"): (2, 2, 2.0, 1.0), (7, 7, "a"): (1, 2, 2.0, 1.0), (7, 2, "d"): (1, 1, 1.0, 1.0), (9, 1, "b"): (1, 1, 1.0, 1.0), (9, 3, "b"): (1, 1, 1.0, 1.0), (9, 3, "z"): (1, 1, 0.0, 0.0), (9, 7, "z"): (1, 1, 0.0, 0.0)}
    limited = interact.exact_matches(docs, queries, Table(), small[0].where("doc_id in (1, 3)").select(F.lit(9).cast("long").alias("qid"), "doc_id"), "token")
    assert {(r.qid, r.doc_id) for r in limited.collect()} == {(9, 1), (9, 3)}


def test_scorers_and_self_match(spark, small):
    docs, queries = small
    known = stats.idf(stats.document_frequency(stats.term_frequency(docs)), stats.summary(docs))
    scored = interact.scored(interact.exact_matches(docs, queries, Table(), pooler="token"), known, stats.summary(docs), interact.SCORERS, drop_self=True)
    got = {(r.qid, r.doc_id): r for r in scored.collect()}
    assert (7, 7) not in got and got[9, 7].maxsim_qtf == 0
    idf, mean = math.log(5 / 2), 9 / 5
    assert math.isclose(got[7, 1].maxsim_bm25_qtf, idf * 2 * (2 * 1.82) / (2 + 0.82 * (0.35 + 0.65 * 3 / mean)))
    assert math.isclose(got[7, 1].maxsim_idf_qtf, idf * 2) and math.isclose(got[7, 1].maxsim_tfidf, idf * 1 * 4)
    with pytest.raises(ValueError):
        interact.scored(interact.exact_matches(docs, queries, Table()), known, stats.summary(docs), ("nonsense",))


def test_query_groups_give_the_same(small, monkeypatch):
    docs, queries = small
    whole = sorted(map(tuple, interact.exact_matches(docs, queries, Table()).collect()))
    monkeypatch.setattr(interact.query_groups, "__defaults__", (1,))
    assert sorted(map(tuple, interact.exact_matches(docs, queries, Table()).collect())) == whole


def test_matches_do_not_depend_on_token_order(spark):
    rows = lambda order: arrays(spark, "doc_id", [(1, order)])
    query = arrays(spark, "qid", [(1, ["a", "d"])])
    one, two = (sorted(map(tuple, interact.exact_matches(rows(o), query, Table(), pooler="token").collect())) for o in (["a", "b", "d", "a"], ["a", "a", "d", "b"]))
    assert one == two


def test_all_pairs(spark, small):
    docs, queries = small
    pairs = docs.where("doc_id in (1, 2)").select(F.lit(7).cast("long").alias("qid"), "doc_id")
    for metric, expected in (("cosine", {1: 1 + 1 + 0.8, 2: 0.6 + 0.6 + 1}), ("l2", {1: -0.4, 2: -0.8 - 0.8})):
        got = {r.doc_id: r.score for r in interact.all_pairs(docs, queries, Table(), pairs, metric).collect()}
        assert all(math.isclose(got[d], s, abs_tol=1e-9) for d, s in expected.items()), metric
    with pytest.raises(ValueError):
        interact.all_pairs(docs, queries, Table(), pairs, "l1")


@pytest.mark.parametrize(("bm25", "cosines", "total", "mixed"), [([2.8, 9.56, 3.96, 8.43, 0.01], [0.37, 0.42, 0.42, 0.42, 0.42], 24.76, 10.2592), ([3.81, 7.2, 5.15, 0.0, 8.56, 0.01], [0.79, 0.78, 0.76, 0, 0.75, 0.75], 24.73, 18.9674)])
def test_decomposition(spark, bm25, cosines, total, mixed):
    rows = spark.createDataFrame([(b, c) for b, c in zip(bm25, map(float, cosines))], "b double, c double")
    row = rows.agg(F.sum("b").alias("t"), F.sum(F.col("b") * F.col("c")).alias("m")).first()
    assert round(row.t, 4) == total and round(row.m, 4) == mixed


def test_codec(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.9, -0.1]), (4, [1.0, 0.0])], "vec_id long, vec array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "code long, centroid array<double>")
    bucket = spark.createDataFrame([([-0.1, 0.0, 0.1], [-0.2, -0.05, 0.05, 0.2])], "cutoffs array<double>, weights array<double>")
    small = codec.compressed(rows, centroids, bucket).orderBy("vec_id").collect()
    assert [r.code for r in small] == [0, 1, 0, 0]
    assert small[0]["levels"] == [1, 2] and small[2]["levels"][1] == 0 and small[3]["levels"] == [1, 1]
    back = codec.decompressed(codec.compressed(rows, centroids, bucket), centroids, bucket)
    assert all(math.isclose(math.hypot(*r.vec), 1) for r in back.collect())
    packed = spark.createDataFrame([([0, 1, 2, 3],)], "levels array<int>").select(codec.packed(F.col("levels"), 2).alias("p")).first().p
    assert packed == "27"  # 00 10 01 11
    with pytest.raises(ValueError):
        codec.check(10, 2)


@pytest.mark.parametrize("nbits", [1, 2, 4])
def test_packed_codes_are_read_back(spark, nbits):
    rng = np.random.default_rng(nbits)
    levels = [rng.integers(0, 2**nbits, 32).tolist() for _ in range(50)] + [[]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "id int, levels array<int>")
    held = rows.where("size(levels) > 0").select("id", codec.packed(F.col("levels"), nbits).alias("held"))
    held = held.union(spark.createDataFrame([(50, "")], held.schema))
    back = {r.id: r.back for r in held.select("id", codec.unpacked(F.col("held"), nbits).alias("back")).collect()}
    assert [back[i] for i in range(51)] == levels


def test_codes_do_not_depend_on_groups_of_centroids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, vec array<double>")
    vectors_ = rng.normal(size=(25, 4)).tolist()
    centroids = spark.createDataFrame([(k, v) for k, v in enumerate(vectors_ + vectors_[:5])], "code long, centroid array<double>")
    whole = {r.vec_id: r.code for r in codec.assign(rows, centroids).collect()}
    monkeypatch.setattr(codec, "HELD", 17)
    assert {r.vec_id: r.code for r in codec.assign(rows, centroids).collect()} == whole
    scores = np.array([r.vec for r in rows.orderBy("vec_id").collect()]) @ np.array(vectors_ + vectors_[:5]).T
    assert [whole[i] for i in range(60)] == np.argmax(scores.round(9), axis=1).tolist()
    assert {r.code for r in codec.assign(rows, centroids.where("false")).collect()} == {-1}


def test_more_bits_reconstruct_better(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, vec array<double>")
    centroids = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(4)], "code long, centroid array<double>")
    errors = []
    for nbits in (1, 2, 4):
        bucket = codec.buckets(codec.residuals(codec.assign(rows, centroids), centroids), nbits)
        held = codec.compressed(rows, centroids, bucket).join(centroids, "code").crossJoin(bucket.select("weights"))
        raw = held.select("vec_id", F.zip_with("centroid", "levels", lambda c, n: c + F.get("weights", n)).alias("back"))
        gap = raw.join(rows, "vec_id").select((-vectors.negative_squared_distance(F.col("vec"), F.col("back"))).alias("e"))
        errors.append(gap.agg(F.avg("e")).first()[0])
    assert errors[0] > errors[1] > errors[2]


@pytest.mark.parametrize(("n", "splits"), [(101, 100), (100, 10), (5, 7)])
def test_splits_lose_nothing(spark, n, splits):
    got = rank.shards(spark.range(n).withColumnRenamed("id", "doc_id"), splits, 3)
    assert got.select("doc_id").distinct().count() == n == got.count()
    assert got.agg(F.max("split"), F.max("shard")).first()[0] < splits


def test_sharded_top_k_merges_to_the_whole(spark):
    rng = np.random.default_rng(4)
    run = spark.createDataFrame([(q, d, float(s)) for q in range(3) for d, s in enumerate(rng.integers(0, 30, 60).tolist())], "qid long, doc_id long, score double")
    parts = rank.shard_top_k(run, rank.shards(run.select("doc_id").distinct(), 20, 4).select("doc_id", "shard"), 7)
    assert sorted(map(tuple, rank.merged(parts, 7).collect())) == sorted(map(tuple, rank.top_k(run, 7).collect()))
    assert rank.merged(run.union(run)).agg(F.max("score")).first()[0] == 2 * run.agg(F.max("score")).first()[0]


def test_sequential_negatives(spark):
    lists = spark.createDataFrame([(1, "a", 1, 10, 1.0), (1, "a", 2, 11, 1.0), (1, "a", 3, 12, 1.0), (1, "b", 1, 12, 1.0), (1, "b", 2, 10, 1.0), (1, "b", 3, 13, None), (2, "a", 1, 5, 1.0)], "qid long, system string, rank int, pid long, ce double")
    positives = spark.createDataFrame([(1, 99, 3.5)], "qid long, pid long, ce double")
    got = [(r.system, r.pid) for r in mining.per_system(lists, positives, 2).orderBy("place").collect()]
    assert got == [("a", 10), ("a", 11), ("b", 12)]
    margin = [(r.system, r.pid) for r in mining.per_system(lists, positives, 2, margin=3.0).orderBy("place").collect()]
    assert margin == [("b", 13)]
    assert [(r.pid, r.system) for r in mining.all_systems(lists, positives).orderBy("pid").collect()] == [(10, "a"), (11, "a"), (12, "a"), (13, "b")]


def test_triples_rotate(spark):
    pos = spark.createDataFrame([(1, 5), (1, 6)], "qid long, pid long")
    neg = spark.createDataFrame([(1, p) for p in range(10, 13)], "qid long, pid long")
    got = [mining.triples(pos, neg, e).first() for e in range(6)]
    assert [r.pos for r in got] == [5, 6] * 3 and len({r.neg for r in got[:3]}) == 3 and got[0].neg == got[3].neg


def test_triples_without_positives(spark):
    pos = spark.createDataFrame([(1, 5)], "qid long, pid long")
    neg = spark.createDataFrame([(q, p) for q in (1, 2) for p in range(10, 13)], "qid long, pid long")
    assert [r.qid for r in mining.triples(pos, neg, 0).collect()] == [1]
    rows = [{r.qid: (r.pos, r.neg) for r in mining.triples(pos, neg, e, without_positives=True).collect()} for e in range(4)]
    order = [rows[0][1][1], rows[1][1][1], rows[2][1][1]]
    assert [r[1][0] for r in rows] == [5] * 4
    assert [r[2] for r in rows] == [(order[2 * e % 3], order[(2 * e + 1) % 3]) for e in range(4)]


def test_special_and_masked_tokens(spark):
    rows = spark.createDataFrame([(["[CLS]", "a", "b", "a", "[SEP]"], [1, 1, 0, 1, 1]), ([], [])], "t array<string>, m array<int>")
    kept = lambda *mask: [r[0] for r in rows.select(text.without_special(F.col("t"), ("[CLS]", "[SEP]"), *mask)).collect()]
    assert kept() == [["a", "b", "a"], []] and kept(F.col("m")) == [["a", "a"], []]


def test_sample_of_queries(spark):
    run = spark.createDataFrame([(q, d, float(d)) for q in range(30) for d in range(5)], "qid long, doc_id long, score double")
    taken = rank.sample(run, 3, seed=1, k=2).collect()
    assert len({r.qid for r in taken}) == 3 and sorted(r.doc_id for r in taken) == [3, 3, 3, 4, 4, 4]
    assert taken and sorted(map(tuple, taken)) == sorted(map(tuple, rank.sample(run.repartition(7), 3, seed=1, k=2).collect()))
    assert len({rank.sample(run, 1, seed=s).first().qid for s in range(8)}) > 1


def test_losses(spark):
    s = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0), (0, 1, 0, 0.0), (0, 1, 1, 0.0)], "batch long, i long, j long, score double")
    assert math.isclose(mining.ranking_loss(s).first().loss, round((math.log(1 + math.exp(-1)) + math.log(2)) / 2, 6))
    p = spark.createDataFrame([(3.0, 1.0, 1.5), (0.0, 0.0, 1.0)], "pos_score double, neg_score double, label double")
    assert mining.margin_loss(p).first().loss == 0.625


def test_sparse(spark):
    logits = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", 3.0), (1, 2, "b", -5.0), (2, 0, "a", 1.0)], "doc_id long, pos int, term string, logit double")
    got = {(r.doc_id, r.term): r.weight for r in sparse.max_pooled(logits).collect()}
    assert math.isclose(got[1, "a"], math.log(4)) and got[1, "b"] == 0
    lengths = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, doc_len long")
    assert math.isclose({(r.doc_id, r.term): r.weight for r in sparse.mean_pooled(logits, lengths).collect()}[1, "a"], (math.log(2) + math.log(4)) / 3)
    n = spark.createDataFrame([(2,)], "n_docs long")
    assert math.isclose(sparse.flops(sparse.max_pooled(logits), n).first().flops, ((math.log(4) + math.log(2)) / 2) ** 2)


def test_index(spark, small):
    stream = stats.token_stream(small[0])
    assert index.invariants(stream, small[0]).first().ok
    maps = {(r.term, r.doc_id): (r.run, r.n) for r in index.scatter_maps(stream).collect()}
    assert maps["a", 1] == (0, 2) and maps["a", 7] == (1, 1)
    offsets = [(r.term, r.offset, r.n) for r in stats.offsets(index.posting_counts(stream)).orderBy("offset").collect()]
    assert offsets == [("a", 0, 3), ("b", 3, 2), ("c", 5, 1), ("d", 6, 1), ("z", 7, 2)]


def test_bm25_counts_repeated_query_terms(spark):
    docs = arrays(spark, "doc_id", [(1, ["a", "b"]), (2, ["b"])])
    one, two = (retrieve.bm25(docs, arrays(spark, "qid", [(1, q)]), None).first().score for q in (["a"], ["a", "a"]))
    assert math.isclose(two, 2 * one, abs_tol=1e-5)
    with pytest.raises(ValueError):
        stats.idf(stats.document_frequency(stats.term_frequency(docs)), stats.summary(docs), "odd")


@pytest.mark.parametrize("kind", ["plain", "smooth"])
def test_bm25_kernel_equals_joins(spark, kind):
    rng = np.random.default_rng(6)
    make = lambda n: [f"t{int(x)}" for x in rng.zipf(1.6, n) % 40]
    docs = arrays(spark, "doc_id", [(i, make(int(rng.integers(0, 60)))) for i in range(120)] + [(500, [])])
    queries = arrays(spark, "qid", [(i, make(6)) for i in range(9)] + [(77, ["absent"]), (78, [])])
    for k in (None, 5):
        one, two = (sorted((r.qid, r.doc_id, round(r.score, 5), r["rank"] if k else 0) for r in retrieve.bm25(docs, queries, k, kind=kind, method=m).collect()) for m in retrieve.METHODS)
        assert one == two and one
    with pytest.raises(ValueError):
        retrieve.bm25(docs, queries, 5, method="odd")


def test_dense_search(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0])], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    got = [(r.doc_id, r.score) for r in dense.search(docs, queries, 2, "dot").orderBy("rank").collect()]
    assert got == [(4, 4.0), (3, 3.0)]
    assert 1 not in {r.doc_id for r in dense.search(docs, queries, None, drop_self=True).collect()}
    whole = dense.search(docs, queries, None, "cosine")
    assert {r.doc_id: r.score for r in whole.collect()}[9] == 0
    with pytest.raises(ValueError):
        dense.search(docs, queries, 1, "jaccard")


def test_explain(spark):
    source = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.5)], "qid string, ndcg double")
    target = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "qid string, ndcg double")
    assert {r.qid: r["diff"] for r in explain.metric_change(source, target, "ndcg").collect()} == {"a": 0.7, "c": 0.5}


def test_segments_and_truncation(spark):
    rows = arrays(spark, "doc_id", [(1, list("abcde")), (2, [])])
    assert [(r.segment, r.start, "".join(r.tokens)) for r in stats.segments(rows, 2).orderBy("start").collect()] == [(0, 0, "ab"), (1, 2, "cd"), (2, 4, "e")]
    docs = spark.createDataFrame([(1, "Hello, WORLD-x 42"), (2, None)], "doc_id long, text string")
    assert [r.tokens for r in stats.token_arrays(docs, most=3).orderBy("doc_id").collect()] == [["hello", "world", "x"], []]


def test_towers_heads_and_masks(spark, small):
    docs, queries = small
    swap = encode.Projected(Table(), np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert swap.encode(["a", "d"]).tolist() == [[0, 1], [4, 3]]
    same = sorted(map(tuple, interact.exact_matches(docs, queries, encode.TwoTowers(Table()), pooler="token").collect()))
    assert same == sorted(map(tuple, interact.exact_matches(docs, queries, Table(), pooler="token").collect()))
    crossed = {(r.qid, r.doc_id, r.term): r.best for r in interact.exact_matches(docs, queries, encode.TwoTowers(swap, Table()), pooler="token").collect()}
    assert crossed[7, 1, "a"] == 0 and math.isclose(crossed[7, 2, "d"], 24 / 25)
    head = encode.Projected(Table(), np.eye(2), bias=np.array([0.0, -5.0]), norm=(np.ones(2), np.zeros(2)), relu=True)
    assert np.allclose(head.encode(["d"]), [[1, 0]])
    pairs = docs.where("doc_id = 3").select(F.lit(7).cast("long").alias("qid"), "doc_id")
    assert interact.all_pairs(docs, queries, Table(), pairs).first().score == pytest.approx(0 + 0 + 0.8)
    only = arrays(spark, "doc_id", [(3, ["c"])])
    assert interact.all_pairs(only, queries, Table(), pairs).first().score == pytest.approx(-2.6)
    assert interact.all_pairs(only, queries, Table(), pairs, masked=frozenset("c")).first().score == 0


class Batched(Table):
    def encode_texts(self, texts):
        assert len(texts) <= encode.TEXTS and [len(t) for t in texts] == sorted((len(t) for t in texts), reverse=True)
        return [self.encode(t) for t in texts]


def test_texts_of_like_length_are_encoded_together(spark):
    rng = np.random.default_rng(5)
    texts = [list(rng.choice(list("abcd"), n)) for n in rng.integers(1, 40, 600)]
    assert all(np.array_equal(a, b) for a, b in zip(encode.encoded(Batched(), texts), [Table().encode(t) for t in texts], strict=True))
    docs = arrays(spark, "doc_id", [(i, t) for i, t in enumerate(texts[:50])] + [(50, [])])
    rows = lambda e: sorted((r.doc_id, r.pos, r.term, tuple(r.vec)) for r in encode.token_vectors(docs, e).collect())
    assert rows(Batched()) == rows(Table())
    means = lambda e: sorted((r.doc_id, tuple(r.vec)) for r in encode.mean_pooled(docs, e).collect())
    assert means(Batched()) == means(Table())


def test_logits_equal_a_join(spark, small):
    docs = small[0]
    pooled = encode.token_vectors(docs, Table(), window=2, normalize=False)
    plain = encode.token_vectors(docs, Table(), pooler="token", normalize=False).withColumnRenamed("vec", "own")
    joined = pooled.join(plain, ["doc_id", "pos", "term"]).select("doc_id", "pos", "term", vectors.dot(F.col("vec"), F.col("own")).alias("logit"))
    one, two = (sorted(map(tuple, x.collect())) for x in (joined, encode.token_logits(docs, Table(), window=2)))
    assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two])


def test_encoder_takes_the_whole_table(spark, small):
    n = encode.MOST_VECTORS + 5
    table = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    whole = encode.VocabularyEncoder(np.column_stack([np.arange(n), np.ones(n)]))
    found = encode.VocabularyEncoder.from_table(table)
    tokens = [f"word{i}" for i in range(2000)]
    assert len(found) == n and np.array_equal(found.encode(tokens), whole.encode(tokens))
    rows = lambda encoder: sorted((r.doc_id, r.pos, tuple(r.vec)) for r in encode.token_vectors(small[0], encoder).collect())
    assert rows(found) == rows(whole) != []
    again = encode.VocabularyEncoder.from_table(table.union(spark.createDataFrame([(5, None)], "vec_id long, embedding array<double>")), 10)
    assert len(again) == n and np.array_equal(again.encode(tokens[:50]), whole.encode(tokens[:50]))
    few = encode.VocabularyEncoder.from_table(table.where("vec_id < 3").union(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")))
    assert few.vectors.tolist() == [[0, 1], [1, 1], [2, 1]]
