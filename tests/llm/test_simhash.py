import numpy as np
import pytest
from xxhash import xxh64_intdigest

from rankweave.llm import simhash
from rankweave.llm.graph import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Root of each fingerprint by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [simhash.MOST, 2, 1])
def test_matches_all_pairs(docs, most):
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    least = {}
    for r, root in zip(rows, groups(fps)):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    expected = sorted(((r.doc_id, f, least.get(root)) for r, f, root in zip(rows, fps, groups(fps))), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, most).collect()), key=str)
    assert got == expected


@pytest.mark.parametrize("most", [simhash.MOST, 5, 1])
def test_dense_groups(spark, most):
    rng = np.random.default_rng(0)
    found = set()
    for base in rng.integers(0, 1 << 62, 4).tolist():
        for _ in range(40):
            found.add(base ^ sum({1 << int(b) for b in rng.integers(0, 64, 3)}))
    fps = [f - (1 << 64) if f >> 63 else f for f in found]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, least long")
    got = {r.node: r.component for r in connected_components(simhash.links(classes, most)).collect()}
    roots = groups([f % (1 << 64) for f in fps])
    same = {}
    for f, root in zip(fps, roots):
        assert same.setdefault(root, got.get(f, f)) == got.get(f, f)
    assert len(set(same.values())) == len(same)


def test_blocks_cover_any_three_bytes():
    from itertools import combinations

    blocks = simhash.quadruples()
    assert len(blocks) == 14
    assert all(any(not set(q) & set(three) for q in blocks) for three in combinations(range(8), 3))


def test_one_of_each_group(docs):
    kept = simhash.one_of_each_group(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(kept) == len(set(groups([slow_fingerprint(r.text) for r in docs.collect()])))
    assert set(ids) == {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}


def test_no_group_is_lost_and_none_kept_twice(spark):
    """Different texts under one doc_id, null ids beside named ones, rows that a microsecond or one column tells apart."""
    import datetime

    a, b, c = ("some words " + x * 3 + " of a text that is long enough" for x in ("alpha ", "beta ", "gamma "))
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = [(1, a, "s", at), (1, b, "s", at), (2, a, "s", at), (3, b, "s", at), (None, a, "t", at), (None, c, "t", at), (None, c, "t", at.replace(microsecond=2)), (None, c, "t", at), (7, None, "u", at), (7, "", "v", at)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, seen timestamp")
    kept = simhash.one_of_each_group(frame).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 7 and r.doc_id is not None) == sorted([(1, a), (1, b)])
    assert [r.text for r in kept if r.doc_id is None] == [c] and sum(r.doc_id == 7 for r in kept) == 1 and len(kept) == 4


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
