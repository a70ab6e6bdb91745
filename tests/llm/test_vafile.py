import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, code string, own string, error long"


def made(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, width)) * 0.3
    return [(i, [float(np.float32(x)) for x in base[i % 20] + rng.normal(size=width) * rng.choice([0, 0.01, 0.2])], None if i % 7 == 0 else i % 3) for i in range(n)]


ODD = [(2000, None, 1), (2001, [float("nan")] + [0.0] * 15, 1), (2002, [None] * 16, 1), (2003, [float("inf")] * 16, 2), (2004, [0.0] * 16, 2), (None, [0.5] * 16, 2), (None, [0.25] * 16, None), (3, [0.125] * 16, 0), (2005, [3e38] * 16, 1), (2006, [-3e38] * 16, 1), (2007, [], 1), (2008, [1.0, -1.0], 0)]


def brute(rows, entries, parts=4, rounds=4):
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = parts * max(1, -(-max((len(r[1]) for r in good), default=0) // parts))
    size = width // parts
    most = int((2**61 // size) ** 0.5) // 2
    q = [[max(-most, min(most, int(np.floor(1024 * float(x))))) for x in r[1]] + [0] * (width - len(r[1])) for r in good]
    split = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in q]
    books = [[v[p] for v in split[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in split:
                own.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by = [], {}
    for r, v in zip(good, split, strict=True):
        found = [near(v[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append([r[0], "".join(f"{i:02x}" for _, i in found), error, r[2]])
        by[r[2]] = by.get(r[2], 0) + error
    return sorted([(a, b, c, by[d]) for a, b, c, d in out], key=str), books


@pytest.mark.parametrize(("n", "entries"), [(300, 40), (30, 64)])
def test_matches_brute_force(spark, n, entries):
    rows = made(n) + ODD[:8] + ODD[10:]
    frame = spark.createDataFrame([(*r, "c", "o", 1) for r in rows], SCHEMA).repartition(3)
    codes, books = vafile.encoded(frame, entries=entries)
    got = vafile.with_label_errors(codes).select("vec_id", "code", "error", "label_error").collect()
    want, want_books = brute(rows, entries)
    assert books.tolist() == want_books
    assert sorted(map(tuple, got), key=str) == want


def test_huge_components_are_held_in_64_bits(spark):
    rows = made(20) + ODD[8:10]
    codes, books = vafile.encoded(spark.createDataFrame([(*r, "c", "o", 1) for r in rows], SCHEMA), entries=8)
    want, want_books = brute(rows, 8)
    assert books.tolist() == want_books
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == sorted(w[:3] for w in want)


@pytest.mark.parametrize("spread", [3, 300, 1 << 26])
def test_bounds_hold_and_refine_few(spread):
    rng = np.random.default_rng(spread)
    entries, queries = rng.integers(-spread, spread + 1, (256, 16)), rng.integers(-spread, spread + 1, (500, 16))
    file = vafile.Approximation(entries)
    lower, upper = file.bounds(queries)
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e, strict=True)) ** 0.5 for e in entries] for q in queries[:50]])
    assert (lower[:50] <= exact).all() and (exact <= upper[:50]).all()
    codes, least, refined = file.nearest(queries)
    apart = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert codes.tolist() == apart.argmin(axis=1).tolist() and least.tolist() == apart.min(axis=1).tolist()
    assert refined.mean() < (256 if spread == 3 else 128)


def test_ties_go_to_the_lower_index():
    file = vafile.Approximation(np.array([[2, 0], [0, 0], [0, 0], [2, 0]]))
    assert file.nearest(np.array([[1, 0], [0, 1], [3, 0]]))[0].tolist() == [0, 1, 0]


def test_integers_floor():
    got = vafile.integers(pa.array([[-0.0001, 0.0009765625, 1.5, -1.0], [2.0]], pa.list_(pa.float32())), 4)
    assert got.reshape(2, 4).tolist() == [[-1, 1, 1536, -1024], [2048, 0, 0, 0]]


def test_sql_agrees(spark, tmp_path):
    rows = made(400, 64) + [(900, None, 1), (901, [float("nan")] * 64, 1), (902, [None] * 64, 1)]
    spark.createDataFrame([(*r, "c", "o", 1) for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(vafile.ORACLE_SQL).fetchall()
    got = vafile.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark):
    assert vafile.with_label_errors(vafile.encoded(spark.createDataFrame([], SCHEMA))[0]).collect() == []
