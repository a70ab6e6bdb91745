import numpy as np
import pytest

from rankweave.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, cls long, home string, copies int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(base[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.2])) * rng.uniform(0.1, 50) for i in range(400)]
    made = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(rows)]
    made += [(1000 + i, made[5][1], made[5][2]) for i in range(40)]
    made += [(5, made[5][1], made[5][2]), (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, made[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [3e38] * 16, 2), (2009, [1e-38] * 16, 2), (None, made[7][1], made[7][2]), (2010, [float("inf")] + [1.0] * 15, 0)]
    return spark.createDataFrame([(*m, 1, 2, "h", 3) for m in made], SCHEMA)


def brute(rows):
    def good(r):
        return r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)

    n = len(rows)
    unit = [np.array(r.embedding, float) / np.abs(np.array(r.embedding, float)).max() if good(r) else None for r in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            least[find(i)] = min(least.get(find(i), r.vec_id), r.vec_id)
    return sorted(((r.vec_id, links[i], least.get(find(i)), r.vec_id == least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("cell", "block"), [(1000, 2048), (5, 7), (20, 64)])
def test_matches_all_pairs(vectors, cell, block):
    got = sorted((tuple(r) for r in embedding.near_vectors(vectors, cell=cell, block=block).collect()), key=str)
    assert got == brute(vectors.collect())


def test_kmeans_gives_unit_centroids():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding.spherical_kmeans(x, 7)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    assert (x @ c.T).max(axis=1).mean() > (x @ x[:7].T).max(axis=1).mean() - 0.05


def test_unit_vectors_of_any_length():
    import pyarrow as pa

    rows = [[3.0, 4.0], [1e-38, 0.0], [-5.0], [3e38, 3e38]]
    out = embedding.unit(pa.array(rows, pa.list_(pa.float32())), 2)
    assert np.allclose(out, [[0.6, 0.8], [1, 0], [-1, 0], [0.5**0.5, 0.5**0.5]])


def test_null_ids_link_but_give_no_id(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (9, [1.0, 0.02], 1), (None, [0.0, 1.0], 2), (4, [0.0, -1.0], 2)]
    got = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 9, False), (None, 2, 9, False), (9, 2, 9, True), (None, 0, None, True), (4, 0, 4, True)], key=str)


def test_empty(spark):
    assert embedding.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
