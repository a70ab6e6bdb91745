import datetime as dt
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from rankweave.llm import validtime
from rankweave.llm.validtime import CHANGE

START = dt.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, batch int, op string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def made(seed, n, clients, days=130):
    rng = random.Random(seed)
    hour = lambda: START + dt.timedelta(hours=rng.randint(0, days * 24))
    sales, changes = [], []
    for i in range(n):
        client = None if rng.random() < 0.02 else (7 if rng.random() < 0.4 else rng.randrange(clients))
        sold = None if rng.random() < 0.03 else hour()
        arrived = (sold or hour()) + dt.timedelta(minutes=rng.choice([1, 30, 60 * 24, 60 * 24 * 20]))
        sales.append((i, client, "done", 1.0, sold, arrived, 1, 9, "S"))
    for i in range(n):
        client = None if rng.random() < 0.02 else (7 if rng.random() < 0.4 else rng.randrange(clients))
        changes.append((i, client, rng.randrange(3), rng.choice("IUD"), None if rng.random() < 0.02 else hour(), "web", "s", "c", None if rng.random() < 0.05 else round(rng.uniform(-50, 50), 2)))
    changes += rng.sample(changes, n // 20)
    sales += [(None, 7, None, None, START, START, None, 1, "x"), (n, 7, None, None, None, None, None, 1, "x"), (n + 1, 10**9, None, None, hour(), hour(), None, 1, "x"), sales[0], sales[0]]
    changes += [(None, 7, None, None, START, None, None, None, None), (n + 1, 8, 1, "U", START - dt.timedelta(days=9), None, None, None, 1e300), (n + 2, 8, 1, "U", START, None, None, None, float("nan"))]
    return sales, changes


def brute(sales, changes, batches=8):
    """Batch by batch, with real waiting and pruning."""

    def batch(day):
        return max(0, min(batches - 1, (day - 19723) * batches // 152))

    def day(t):
        return (t - dt.datetime(1970, 1, 1)).days

    least = dt.datetime.min
    distinct = {str(c): c for c in changes if c[4] is not None}.values()
    sale_batches = [[s for s in sales if (batches - 1 if s[5] is None else batch(day(s[5]))) == b] for b in range(batches)]
    change_batches = [[c for c in distinct if (batches - 1 if c[0] is None else batch(day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4)) == b] for b in range(batches)]
    order = lambda c: (c[4], -1 if c[2] is None else c[2], -1 if c[0] is None else c[0])
    out, waiting, versions = [], [], {}
    top_sold = top_valid = None

    def tell(s, b):
        own = versions.get(s[1], []) if s[1] is not None else []
        fit = [c for c in own if s[4] is not None and c[4] <= s[4]]
        best = max(fit, key=order) if fit else None
        cents = None if best is None or best[8] is None or not abs(best[8]) < 1e16 else int(np.floor(100 * best[8] + 0.5))
        out.append(("sale", s[0], b, len(own), best and best[0], cents, best and best[3]))

    for b in range(batches):
        floor = least if top_valid is None else top_valid - dt.timedelta(hours=12)
        horizon = least if top_sold is None or top_valid is None else min(top_sold - dt.timedelta(hours=12), floor)
        for c in change_batches[b]:
            if c[4] < floor:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                versions.setdefault(c[1], []).append(c)
        waiting += sale_batches[b]
        for s in [s for s in waiting if s[4] is None or s[4] < horizon]:
            tell(s, b)
        waiting = [s for s in waiting if not (s[4] is None or s[4] < horizon)]
        for client, own in versions.items():
            old = [c for c in own if c[4] <= horizon]
            if old:
                last = max(old, key=order)
                versions[client] = [c for c in own if c[4] > horizon or c is last]
        top_sold = max([t for t in [top_sold, *(s[4] for s in sale_batches[b])] if t is not None], default=None)
        top_valid = max([t for t in [top_valid, *(c[4] for c in change_batches[b])] if t is not None], default=None)
    for s in waiting:
        tell(s, batches)
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10**9, 60])
def test_matches_brute_force(spark, hot):
    sales, changes = made(3, 400, 30)
    got = validtime.enriched(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(changes, CHANGES).repartition(3), hot=hot, slice_rows=40, gate_rows=100, slot_rows=300)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(sales, changes)
    assert {r[2] for r in rows if r[0] == "sale"} >= {1, 2, 3, 8} and any(r[0] == "late" for r in rows)


def test_sql_agrees_with_brute_force(spark, tmp_path):
    sales, changes = made(5, 300, 20)
    changes = [c for c in changes if c[8] is None or abs(c[8]) < 1e16]
    spark.createDataFrame(sales, SALES).write.parquet(str(tmp_path / "sales.parquet"))
    spark.createDataFrame(changes, CHANGES).write.parquet(str(tmp_path / "client_changes.parquet"))
    db = duckdb.connect()
    for name in ("sales", "client_changes"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = [w for w in brute(sales, changes) if w[4] is not None or w[6] is None]
    got = [g for g in sorted(db.execute(validtime.ORACLE_SQL).fetchall(), key=str) if g[4] is not None or g[6] is None]
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_answers_and_pruning(seed):
    rng = np.random.default_rng(seed)
    versions = pd.DataFrame({"client_id": rng.integers(0, 4, 60), "piece": rng.integers(0, 2, 60), "at": rng.integers(0, 20, 60), "seq": rng.integers(0, 2, 60), "id": np.arange(60), "cents": 0, "op": "U", "n": 1, "nulls": 0})
    sales = pd.DataFrame({"client_id": rng.integers(0, 5, 40), "piece": rng.integers(0, 2, 40), "at": rng.integers(-1, 22, 40)})
    old = (versions["at"] < 9).to_numpy()
    held, place = validtime.answers(sales, versions, old)
    for i, s in enumerate(sales.itertuples()):
        own = [v for v in versions.itertuples() if (v.client_id, v.piece) == (s.client_id, s.piece)]
        past = [v for v in own if old[v.Index]]
        left = [v for v in own if not old[v.Index]] + ([max(past, key=lambda v: (v.at, v.seq, v.id))] if past else [])
        fit = [v for v in left if v.at <= s.at]
        assert held[i] == len(left)
        assert place[i] == (max(fit, key=lambda v: (v.at, v.seq, v.id)).Index if fit else -1)


def test_tables_survive_packing():
    rows = pd.DataFrame({"id": np.array([1, -(1 << 62)], np.int64), "op": ["U", ""], "kind": CHANGE})
    assert validtime._unpacked(validtime._packed(rows)).equals(rows)


def test_empty(spark):
    got = validtime.enriched(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES), batches=1)
    assert got.collect() == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != validtime.STATE["spark.sql.streaming.stateStore.providerClass"]


def test_state_of_a_batch_does_not_stay_open(spark, monkeypatch):
    """A start reads its state once; stores left open until maintenance finds them add up over starts and partitions."""
    jvm = spark.sparkContext._jvm
    stores = getattr(getattr(jvm.org.apache.spark.sql.execution.streaming.state, "StateStore$"), "MODULE$")
    held = stores.getClass().getDeclaredField("loadedProviders")
    held.setAccessible(True)
    before = held.get(stores).size()
    sales, changes = made(3, 60, 5)
    out = validtime.enriched(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches=2)
    assert out.count() and held.get(stores).size() <= before


def test_no_more_starts_than_batches(spark, monkeypatch):
    """Each start leaves the statistics of its state stores behind in the executors; the last batch's lets all waiting sales go too."""
    starts, real = [], validtime._stages
    monkeypatch.setattr(validtime, "_stages", lambda *a: starts.append(1) or real(*a))
    sales, changes = made(3, 60, 5)
    got = validtime.enriched(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches=2)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(sales, changes, batches=2)
    assert {1, 2} <= {r[2] for r in rows if r[0] == "sale"}
    assert len(starts) == 2
