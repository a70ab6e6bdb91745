import hashlib
import re

import numpy as np
import pytest

from rankweave.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    sized = [(r.doc_id, r.source, len(WORD.findall(r.text or "")), hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()) for r in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n, _ in sized if t == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:  # reshare the excess until none is above
        free = [s for s in sources if s not in capped]
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in sources}
    out = []
    for s in sources:
        own, start = sorted(((p, d is not None, d, n) for d, t, n, p in sized if t == s)), 0
        quota = int(target[s] + 0.5)
        for _, _, d, n in own:
            took = sum(max(0, min(e * size[s] + start + n, quota) - e * size[s] - start) for e in (0, 1))
            out.append((d, n, size[s], round(target[s], 6), took))
            start += n
    return sorted(out, key=str)


def test_counts_match_brute_force(docs):
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_counts(docs).collect()), key=str)
    assert got == brute(docs.collect())


def test_small_blocks_and_shards_take_the_same_words(docs, monkeypatch):
    whole = sorted(mixing.mix_counts(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    assert sorted(mixing.mix_counts(docs).collect(), key=str) == whole
    pieces, _ = mixing.mix_pieces(docs)
    found = pieces.toPandas()
    assert found.groupby("shard")["n_words"].sum().max() <= 16 * -(-found["n_words"].sum() // 16)
    places = found[["shard", "place"]].drop_duplicates()
    assert places.groupby("shard")["place"].apply(lambda p: sorted(p) == list(range(len(p)))).all() and found["shard"].nunique() > 3
    assert not found.duplicated([*mixing.KEY, "epoch", "first_word"]).any()


def test_quotas_are_spent_exactly():
    quotas = np.array([70, 0, 3, 500, 41])
    shards = list(mixing.split_quotas(quotas, 13, 0, 13, 1))
    assert (sum(own for _, own, _ in shards) == quotas).all()
    total = int(quotas.sum())
    assert [int(own.sum()) for _, own, _ in shards] == [total * (j + 1) // 13 - total * j // 13 for j in range(13)]
    part = [x for low in (0, 5, 9) for x in mixing.split_quotas(quotas, 13, low, min(13, low + (5 if low == 0 else 4)), 1)]
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(shards, part))


def test_draws_have_the_marginals_of_the_hypergeometric():
    """Over many seeds, a shard's draw of a source has the mean and variance of blocks drawn without replacement."""
    quotas, n_shards = np.array([60, 25, 115]), 8
    draws = np.array([[own for _, own, _ in mixing.split_quotas(quotas, n_shards, 0, n_shards, seed)] for seed in range(600)])
    total, size = quotas.sum(), quotas.sum() // n_shards
    share = quotas / total
    assert np.allclose(draws.mean(axis=0), size * share, atol=0.35)
    assert np.allclose(draws.var(axis=0), size * share * (1 - share) * (total - size) / (total - 1), rtol=0.3)


def test_blocks_are_permuted_and_disjoint():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    moved = mixing.permuted(np.arange(1000), 1000, 5)
    assert abs(np.corrcoef(moved, np.arange(1000))[0, 1]) < 0.1 and (moved != mixing.permuted(np.arange(1000), 1000, 6)).mean() > 0.9
    quotas, met = np.array([70, 0, 3, 500]), set()
    for _, src, block, place in mixing.shard_blocks(quotas, 9, 0, 9, 1):
        met |= set(zip(src.tolist(), block.tolist()))
        assert sorted(place.tolist()) == list(range(len(src)))
    assert met == {(s, b) for s, q in enumerate(quotas) for b in range(q)}


def test_rows_equal_in_id_and_text_keep_their_columns(spark):
    text = " ".join(["word"] * 30)
    rows = [(1, text, "s0", "en"), (1, text, "s1", "de"), (1, text, "s1", "fr"), (1, text, "s1", "fr"), (2, None, "s0", "en"), (None, text, None, None), (None, text, None, None)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    took = {}
    for r in out:
        took[r.source, r.lang] = took.get((r.source, r.lang), 0) + len(WORD.findall(r.text))
    # 180 words, 270 to take by 3, 1, 2: s0 stops at 60; 70 to s1, and 120, its stop, to null; then s1 has 90
    assert took[("s0", "en")] == 60 and took[(None, None)] == 120
    assert took[("s1", "de")] + took[("s1", "fr")] == 90 and {k[0] for k in took} == {"s0", "s1", None}


def test_a_shard_stands_together_in_its_order(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    pieces, rows = mixing.mix_pieces(docs)
    first = pieces.join(rows.select(*mixing.KEY, "row_key"), mixing.KEY).toPandas().sort_values("first_word").drop_duplicates([*mixing.KEY, "epoch"])
    starts = {}
    for r in first.itertuples():
        starts.setdefault(r.row_key, set()).add((r.shard, r.place, r.low))
    from pyspark.sql import functions as F

    keyed = docs.select(mixing.row_key(docs).alias("k"), F.col("doc_id"), F.col("source")).distinct().collect()
    of = {}
    for r in keyed:
        of.setdefault((r.doc_id, r.source), set()).update(starts.get(r.k, ()))
    parts = mixing.mixed_documents(docs).withColumn("part", F.spark_partition_id()).select("part", "doc_id", "source").collect()
    shards = [{s for s, _, _ in of[r.doc_id, r.source]} for r in parts if len({s for s, _, _ in of[r.doc_id, r.source]}) == 1]
    alone = [next(iter(s)) for s in shards]
    runs = [a for a, b in zip(alone, [None, *alone]) if a != b]
    assert len(runs) == len(set(runs)) > 3


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == mixing.mix_counts(docs).groupBy().sum("taken").first()[0]
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id is not None and r.text)


def test_keys_of_rows_tell_nulls_and_nested_nulls_apart(spark):
    rows = [("a", None, [None, 1], None), (None, "a", [None, 1], None), ("a", None, [1, None], None), ("a", None, None, None), ("a", None, [], None), ("a", None, None, {"x": None}), ("a", None, None, {"x": 1}), ("", None, None, None), (None, None, None, None), ("a", None, [None, 1], None)]
    frame = spark.createDataFrame(rows, "s string, `t u` string, l array<int>, m map<string,int>")
    assert frame.select(mixing.row_key(frame).alias("k")).distinct().count() == len(rows) - 1


def test_rows_that_a_microsecond_tells_apart(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "some words of a text " * 9, "s", at.replace(microsecond=i), None) for i in (1, 2)] + [(2, "others " * 50, None, at, at)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, seen timestamp, local timestamp_ntz")
    out = [r.seen.microsecond for r in mixing.mixed_documents(frame).collect() if r.doc_id == 1]
    assert set(out) == {1, 2} and out.count(1) <= 2 and out.count(2) <= 2


@pytest.mark.parametrize("f", [mixing.mix_counts, mixing.mixed_documents])
def test_empty(none, f):
    assert f(none).count() == 0
