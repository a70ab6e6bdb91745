import re
from collections import Counter

import corpus_pipeline
from rankweave.llm import pii, quality
from rankweave.llm.shared import written
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups, slow_fingerprint


def test_stages_match_brute_force(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "personal data", "mixing sources", "best-fit packing"]
    kept = written(corpus_pipeline.keep_good(spark, docs, ""), "a")
    good = Counter()
    for r in quality.judge(docs.select("doc_id", "text"), quality.references(docs), carry=("doc_id", "text")).collect():
        good[r.doc_id, r.text] += r.kept
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == +good and kept.columns == docs.columns and kept.count() > 20

    single = written(corpus_pipeline.drop_near_duplicates(spark, kept, ""), "b")
    rows = kept.collect()
    best = {}
    for r, root in zip(rows, groups([slow_fingerprint(r.text) for r in rows])):
        best[root] = min(best.get(root, (1, 0)), (r.doc_id is None, r.doc_id or 0))
    named = sorted(i for missing, i in best.values() if not missing)
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == named

    clean = written(corpus_pipeline.redact(spark, single, ""), "c")
    assert clean.count() == single.count() and not any(pii.base_spans(r.text) for r in clean.collect())

    mix = written(corpus_pipeline.mix(spark, clean, ""), "d")
    took = Counter()
    for r in mix.collect():
        took[r.doc_id] += len(re.findall("[^\x20\x09-\x0d]+", r.text))
    expected = Counter()
    for d, _, _, _, n in mixed(clean.collect()):
        expected[d] += n
    assert +took == +expected

    packed = corpus_pipeline.pack(spark, mix, "").collect()
    check(packed, mix.collect())


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = docs
    for _, stage in corpus_pipeline.STAGES:
        again = written(stage(spark, again, str(tmp_path)), "x")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, out)) == Counter(map(key, again.collect()))


def test_empty(spark, none):
    again = none
    for _, stage in corpus_pipeline.STAGES:
        again = written(stage(spark, again, ""), "x")
    assert again.count() == 0

