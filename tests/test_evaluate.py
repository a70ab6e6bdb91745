import json

import pytest

from rankweave.__main__ import main
from rankweave.operators.encode import VocabularyEncoder
from rankweave.plans.evaluate import Settings, rerank_collection


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("collection")
    texts = {f"d{i}": f"common words {'alpha ' * (i % 3)}{'beta ' * (i % 2)}number{i}" for i in range(30)}
    (top / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": d, "title": f"title {d}", "text": t}) for d, t in texts.items()))
    (top / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": t}) for q, t in {"q1": "alpha number5", "q2": "beta number7", "d3": "number3 common", "q9": "unjudged"}.items()))
    (top / "qrels").mkdir()
    (top / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td5\t2\nq2\td7\t1\nd3\td3\t1\n")
    return top


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "vectors.parquet")
    spark.createDataFrame([(i, [float((i * 7) % 5 - 2), float(i % 3), 1.0]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(path)
    return path


def test_rerank_a_collection(spark, folder, vectors):
    encoder = VocabularyEncoder.from_table(spark.read.parquet(vectors))
    runs, means = rerank_collection(spark, str(folder), encoder, Settings(depth=10, scorers=("maxsim_bm25_qtf", "maxsim_qtf")))
    got = {(r.system, r.k): r for r in means.collect()}
    assert {s for s, _ in got} == {"first_stage", "maxsim_bm25_qtf", "maxsim_qtf", "first_stage+maxsim_bm25_qtf", "first_stage+maxsim_qtf"}
    assert got["first_stage", 1].ndcg == 1.0
    found = runs.collect()
    assert not any(r.qid == r.doc_id for r in found if r.system == "maxsim_qtf") and {r.qid for r in found} == {"q1", "q2", "d3"}
    first = {(r.qid, r.doc_id) for r in found if r.system == "first_stage"}
    assert {(r.qid, r.doc_id) for r in found if r.system == "maxsim_qtf"} <= first and len(first) <= 30


def test_command_line(spark, folder, vectors, tmp_path, capsys):
    main(["plans"])
    assert "cbm25" in capsys.readouterr().out.split()
    main(["rerank", str(folder), vectors, str(tmp_path / "out"), "--depth", "5"])
    assert spark.read.parquet(f"{tmp_path}/out/means").where("system = 'first_stage'").count() == 5
    with pytest.raises(SystemExit):
        main(["nothing"])
