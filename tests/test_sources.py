import gzip
import json

from pyspark.sql import functions as F

from rankweave.operators import encode, index, rank
from rankweave.plans.context import collection
from rankweave.sources import readers, writers
from rankweave.streaming import topk


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_collection(spark, tmp_path):
    lines(tmp_path / "corpus.jsonl", [{"_id": "d1", "title": "T", "text": "x", "metadata": {"k": "v"}}, {"_id": "d2", "title": "", "text": " y "}])
    lines(tmp_path / "queries.jsonl", [{"_id": "q1", "text": " a\tb "}, {"_id": "q2", "text": "unjudged"}])
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t2\n")
    corpus, queries, qrels = readers.collection(spark, str(tmp_path))
    assert [r.qid for r in queries.collect()] == ["q1"]
    assert [tuple(r) for r in qrels.collect()] == [("q1", "d2", 2)]
    assert sorted(r.text for r in readers.documents(spark, str(tmp_path / "corpus.jsonl")).collect()) == [" y ", "T x"]
    assert sorted(r.contents for r in writers.search_documents(corpus).collect()) == ["Tx", "y"]
    assert sorted((r.title, r.contents) for r in writers.search_documents(corpus, separate_title=True).collect()) == [("", "y"), ("T", "x")]
    assert writers.query_lines(queries).first().text == "a b" or writers.query_lines(queries).first().text.strip() == "a b"
    assert tuple(writers.judgement_lines(qrels).first()) == ("q1", 0, "d2", 2)
    writers.write_collection(corpus, queries, qrels, str(tmp_path / "out"))
    again = readers.collection(spark, str(tmp_path / "out"))
    assert [sorted(map(tuple, x.collect())) for x in again] == [sorted(map(tuple, x.collect())) for x in (corpus, queries, qrels)]
    writers.write_search_documents(corpus, str(tmp_path / "s"))
    writers.write_query_lines(queries, str(tmp_path / "t"))
    writers.write_judgement_lines(qrels, str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).first().value == "q1\t0\td2\t2"


def test_tree_of_collections(spark, tmp_path):
    for at, name in enumerate(("one", "group/one", "group/two b")):
        folder = tmp_path / "in" / name
        lines(folder / "corpus.jsonl", [{"_id": f"d{at}", "title": "T", "text": " x"}])
        lines(folder / "queries.jsonl", [{"_id": f"q{at}", "text": " a\tb "}])
        (folder / "qrels").mkdir()
        (folder / "qrels/test.tsv").write_text(f"query-id\tcorpus-id\tscore\nq{at}\td{at}\t1\n")
        (folder / "notes.tsv").write_text("no\tqrels\t0\nx\ty\t1\n")
    writers.convert_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    corpus = spark.read.schema("id string, contents string, dataset string").json(str(tmp_path / "out/corpus"))
    assert sorted((r.dataset, r.id, r.contents) for r in corpus.collect()) == [("group/one", "d1", "T x"), ("group/two b", "d2", "T x"), ("one", "d0", "T x")]
    queries = spark.read.schema("qid string, text string, dataset string").csv(str(tmp_path / "out/queries"), sep="\t")
    assert sorted((r.dataset, r.qid, r.text) for r in queries.collect()) == [("group/one", "q1", "a b"), ("group/two b", "q2", "a b"), ("one", "q0", "a b")]
    qrels = spark.read.schema("qid string, iteration int, doc_id string, rel int, dataset string, split string").csv(str(tmp_path / "out/qrels"), sep="\t")
    assert sorted((r.dataset, r.split, r.qid, r.doc_id, r.rel) for r in qrels.collect()) == [("group/one", "test", "q1", "d1", 1), ("group/two b", "test", "q2", "d2", 1), ("one", "test", "q0", "d0", 1)]


def test_hard_negatives(spark, tmp_path):
    with gzip.open(tmp_path / "n.jsonl.gz", "wt") as f:
        f.write(json.dumps({"qid": "1", "pos": [{"pid": "5", "ce-score": 9.0}], "neg": {"bm25": [{"pid": "7", "ce-score": 1.0}, {"pid": "8", "ce-score": 2.0}]}}) + "\n")
    rows = readers.hard_negatives(spark, str(tmp_path / "n.jsonl.gz"), most=10)
    assert sorted(map(tuple, readers.negative_lists(rows).collect())) == [("1", "bm25", 1, "7", 1.0), ("1", "bm25", 2, "8", 2.0)]
    assert tuple(readers.positive_list(rows).first()) == ("1", "5", 9.0)
    lines(tmp_path / "p.jsonl", [{"qid": 1, "pos": [5], "neg": {"x": [6, 7]}}])
    plain = readers.hard_negatives(spark, str(tmp_path / "p.jsonl"), scored=False)
    assert [r.pid for r in readers.negative_lists(plain, scored=False).collect()] == [6, 7] and readers.positive_list(plain, scored=False).first().pid == 5


def test_runs_and_pairs(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"q1": {"d1": 1.5, "d2": 0.5}, "q2": {"d1": 2.0}}))
    (tmp_path / "by.json").write_text(json.dumps({"f": {"q1": {"d1": 1.5}}}))
    run = readers.run_json(spark, str(tmp_path / "run.json"))
    assert sorted(map(tuple, run.collect())) == [("q1", "d1", 1.5), ("q1", "d2", 0.5), ("q2", "d1", 2.0)]
    assert tuple(readers.run_json(spark, str(tmp_path / "by.json"), by_scorer=True).first()) == ("f", "q1", "d1", 1.5)
    assert json.loads(rank.as_maps(run).where("qid = 'q1'").first().docs) == {"d1": 1.5, "d2": 0.5}
    writers.write_run(run, str(tmp_path / "out"))
    assert [tuple(r) for r in writers.debug_lines(run).collect()] == [("q1", "d1", 1.5), ("q1", "d2", 0.5), ("q2", "d1", 2.0)]
    (tmp_path / "c.tsv").write_text('1\ta "quoted" text\n')
    assert tuple(readers.pairs_tsv(spark, str(tmp_path / "c.tsv"), "pid", "passage", "long").first()) == (1, 'a "quoted" text')


def test_splits_are_lossless(spark, tmp_path):
    docs = spark.range(101).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    writers.write_splits(docs, str(tmp_path / "s"), 100)
    assert spark.read.json(str(tmp_path / "s")).select("doc_id").distinct().count() == 101


def test_index_reads_one_shard(spark, tmp_path):
    rows = spark.createDataFrame([(d, ["a", "b", "a"]) for d in range(6)], "doc_id long, tokens array<string>")

    class Ones:
        dim = 1

        def encode(self, tokens):
            import numpy as np

            return np.ones((len(tokens), 1))

    vectors = encode.token_vectors(rows, Ones()).join(rank.shards(rows, 8, 4).select("doc_id", "shard"), "doc_id")
    index.write(vectors, str(tmp_path / "ix"))
    assert readers.index(spark, str(tmp_path / "ix")).count() == 18
    one = readers.index(spark, str(tmp_path / "ix"), 1)
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().toString() and {r.shard for r in one.collect()} <= {1}


def test_codec_and_stats_come_back(spark, tmp_path):
    centroids = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.0, 1.0])], "code long, centroid array<double>")
    bucket = spark.createDataFrame([([0.0], [-0.5, 0.5], 0.1)], "cutoffs array<double>, weights array<double>, avg_residual double")
    writers.write_codec(centroids, bucket, str(tmp_path / "codec"))
    again = readers.codec(spark, str(tmp_path / "codec"))
    assert [sorted(map(str, x.collect())) for x in again] == [sorted(map(str, x.collect())) for x in (centroids, bucket)]
    rows = spark.createDataFrame([(k, 0, [1], k % 2) for k in range(6)], "vec_id long, code long, levels array<int>, chunk int")
    writers.write_compressed(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6
    writers.write_stats(spark.createDataFrame([("a", 1, 0.5)], "term string, df long, idf double"), spark.createDataFrame([(1, 2, 2.0)], "n_docs long, n_tokens long, mean_len double"), str(tmp_path / "stats"))
    assert readers.stats(spark, str(tmp_path / "stats"))[0].first().idf == 0.5


def test_stream_keeps_top_k(spark, tmp_path):
    schema = "qid long, doc_id long, score double"
    every = [(q, d, float((d * 7 + q) % 23)) for q in range(3) for d in range(40)]
    for k in range(4):
        spark.createDataFrame(every[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = topk.keep_top_k(stream, str(tmp_path / "state"), 5, str(tmp_path / "cp"))
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/batch={last}").collect()))
    assert last == 3 and got == sorted(map(tuple, rank.top_k(spark.createDataFrame(every, schema), 5).select("qid", "doc_id", "score", "rank").collect()))


def test_queries_and_sql_have_the_same_names():
    from rankweave.plans import catalog, oracles

    assert set(oracles.oracle_sql()) <= set(catalog.queries())
    assert collection.__name__ == "collection"


def test_rows_only_queries(spark):
    """Queries that SQL does not express, against plain Python on the smallest tables."""
    from rankweave.plans import catalog

    folder = "/root/testdata/sf0.001"
    made = catalog.queries()
    c = collection(spark, folder)
    rows = {r.qid: json.loads(r.docs) for r in made["run_to_map"](spark, folder).collect()}
    assert rows == {q: {str(r.doc_id): r.score for r in c.bm25.collect() if r.qid == q} for q in rows}
    pairs = {(r.qid, r.doc_id): r.score for r in made["pair_scorer"](spark, folder).collect()}
    texts, asked = {r.doc_id: r.text for r in c.docs.collect()}, {r.qid: r.text for r in c.queries.collect()}
    for (q, d), s in list(pairs.items())[:200]:
        words = set(asked[q].lower().split())
        assert abs(s - len(words & set(texts[d].lower().split())) / len(words)) < 1e-6
    for r in made["paired_t_p"](spark, folder).collect():
        assert r.p is None or 0 <= r.p <= 1
    for r in made["explain_query_terms"](spark, folder).collect():
        assert len(r.line.split(", ")) == c.qarr.where(F.col("qid") == r.qid).first().tokens.__len__()
    stop = set(__import__("rankweave.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS)
    assert not any(stop & set(r.tokens.split()) for r in made["analyzed_tokens"](spark, folder).collect())
    for r in made["coil_train_records"](spark, folder).collect():
        record = json.loads(r.record)
        assert record["qry"]["qid"] == r.qid and record["pos"][0]["pid"] == r.pid and len(record["neg"]) == r.n_neg <= 3
        assert all(n["pid"] != r.pid for n in record["neg"])
    for name in ("hard_neg_multi", "hard_neg_margin"):
        found = [(r.qid, r.pid) for r in made[name](spark, folder).collect()]
        assert len(found) == len(set(found))
