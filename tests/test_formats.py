"""Run files, TREC markup, pickled scores and index files with a very frequent term."""

from __future__ import annotations

import gzip
import json
import os
import pickle
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from rankweave.operators import index, stats
from rankweave.sources import pickles, readers, trec


def test_a_run_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    run = {f'q "{i}"': {f"d\\{j}\n": round(rng.uniform(-5, 50), 4) for j in rng.sample(range(500), 30)} for i in range(300)}
    run["none"] = {}
    (tmp_path / "run.json").write_text(json.dumps(run))
    (tmp_path / "wide.json").write_text(json.dumps(run, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("run.json", "wide.json"):
            rows = readers.run_json(spark, str(tmp_path / name))
            assert rows.rdd.getNumPartitions() > 5
            got = {}
            for r in rows.collect():
                got.setdefault(r.qid, {})[r.doc_id] = r.score
            assert got == {q: d for q, d in run.items() if d}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_brace_in_a_key_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"q1": {"d}1": 1.0, "d2": 2.0}}))
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.run_json(spark, str(tmp_path / "bad.json")).collect()


OLD = """<top>
<num> Number: 301
<title> International Organized Crime

<desc> Description:
Identify organizations that
participate.

<narr> Narrative:
A relevant document must.
</top>

<top>
<num> Number: 302 <title> Polio
<desc> Description: Is the disease?
<narr> Narrative: n/a
</top>
"""
DOCS = """<DOC>
<DOCNO> FT911-3 </DOCNO>
<HEADLINE> FT  14 MAY 91 / <b>Crime</b> </HEADLINE>
<TEXT>
First text
</TEXT>
<TEXT>second</TEXT>
</DOC>
<doc><docno>LA-1</docno><text>only &amp; text</text></doc>
<DOC>
<DOCNO>E</DOCNO>
</DOC>
"""


def test_trec_markup_round_trip(spark, tmp_path):
    (tmp_path / "topics").write_text(OLD)
    (tmp_path / "docs").write_text(DOCS.replace("</doc>", "</DOC>"))
    (tmp_path / "qrels").write_text("301 0 FT911-3 1\n302\t0\tLA-1\t0\n\n")
    got = {r.qid: (r.title, r.description, r.narrative) for r in trec.topics(spark, str(tmp_path / "topics")).collect()}
    assert got == {"301": ("International Organized Crime", "Identify organizations that participate.", "A relevant document must."), "302": ("Polio", "Is the disease?", "n/a")}
    docs = {r.doc_id: (r.title, r.text) for r in trec.documents(spark, str(tmp_path / "docs")).collect()}
    assert docs == {"FT911-3": ("FT 14 MAY 91 / Crime", "First text second"), "LA-1": ("", "only &amp; text"), "E": ("", "")}
    trec.convert(spark, str(tmp_path / "topics"), str(tmp_path / "docs"), str(tmp_path / "qrels"), str(tmp_path / "out"), "description")
    corpus, queries, qrels = readers.collection(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, queries.collect())) == [("301", "Identify organizations that participate."), ("302", "Is the disease?")]
    assert sorted(map(tuple, qrels.collect())) == [("301", "FT911-3", 1), ("302", "LA-1", 0)]
    assert corpus.count() == 3


def test_many_topics_are_split(spark, tmp_path):
    (tmp_path / "t").write_text("".join(f"<top>\n<num> Number: {i}\n<title> t{i}\n</top>\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = trec.topics(spark, str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() > 3
        assert sorted((int(r.qid), r.title) for r in rows.collect()) == [(i, f"t{i}") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("protocol", range(pickle.HIGHEST_PROTOCOL + 1))
def test_pickled_scores(spark, tmp_path, protocol):
    scores = {7: {1: 0.5, 2: -3.25, 300: 4}, "q": {"p": 1e-9, 70_000: 2**40}, 8: {}}
    scores["again"] = scores["q"]
    (tmp_path / "a.pkl").write_bytes(pickle.dumps(scores, protocol))
    (tmp_path / "b.pkl.gz").write_bytes(gzip.compress(pickle.dumps({"z": {"y": 1.0}}, protocol)))
    assert pickles.loaded((tmp_path / "a.pkl").read_bytes()) == scores
    got = pickles.ce_pickles(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted([(str(q), str(p), float(s)) for q, own in scores.items() for p, s in own.items()] + [("z", "y", 1.0)])


class Hostile:
    def __init__(self, folder):
        self.folder = folder

    def __reduce__(self):
        return os.mkdir, (self.folder,)


def test_a_hostile_pickle_is_refused_and_does_nothing(spark, tmp_path):
    bad = str(tmp_path / "made")
    for data in (pickle.dumps(Hostile(bad)), pickle.dumps({1: Hostile(bad)}), pickle.dumps({1: {2: {3: 4}}, 5: 6}), pickle.dumps([1]), b"", pickle.dumps({1: {2: 0.5}})[:-1]):
        with pytest.raises((pickles.Refused, ValueError, IndexError)):
            pickles.pair_scores(data)
    (tmp_path / "x.pkl").write_bytes(pickle.dumps({1: Hostile(bad)}))
    with pytest.raises(PySparkException, match="Refused"):
        pickles.ce_pickles(spark, str(tmp_path / "x.pkl")).collect()
    assert not os.path.exists(bad)


def test_a_frequent_term_is_split_over_files(spark, tmp_path):
    rows = [(i % 2, "the" if i % 3 else f"w{i % 50}", i, 0, [float(i)]) for i in range(6000)]
    vectors = spark.createDataFrame(rows, "shard int, term string, doc_id long, pos int, vec array<double>").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # files this small would be one
    try:
        index.write(vectors, str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = readers.index(spark, str(tmp_path / "ix"))
    assert sorted((r.shard, r.term, r.doc_id) for r in back.collect()) == sorted((s, t, d) for s, t, d, _, _ in rows)
    files = back.where("term = 'the'").selectExpr("input_file_name() AS f", "shard").groupBy("f").count().collect()
    assert len(files) > 2 and max(r["count"] for r in files) < 0.6 * 4000


def test_posting_blocks_and_their_documents(spark):
    rng = random.Random(0)
    rows = [(d, t, 1) for d in range(1000) for t in ("the", *(f"w{i}" for i in rng.sample(range(40), 3)))] + [(10**12 + 5, "the", 2)]
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long").repartition(3)
    blocks = stats.posting_blocks(tf, 64)
    assert all(r.n == len(r.gaps) <= 64 and r.gaps[0] == 0 for r in blocks.collect())
    assert sorted(map(tuple, stats.documents_of(blocks).collect())) == sorted((t, d) for d, t, _ in rows)


def test_runs_are_numbered_over_blocks(spark):
    rows = [(d, p, "the" if d % 2 else "x") for d in range(0, 900, 3) for p in range(1 + d % 2)]
    got = index.scatter_maps(spark.createDataFrame(rows, "doc_id long, pos int, term string").repartition(4), width=50).collect()
    for term in ("the", "x"):
        own = sorted((r.doc_id, r.run, r.n) for r in got if r.term == term)
        assert [r for _, r, _ in own] == list(range(len(own))) and {d for d, _, _ in own} == {d for d, _, t in rows if t == term}
