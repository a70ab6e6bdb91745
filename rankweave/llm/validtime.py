"""Sales enriched with what was known of their client when they were made, as a stateful stream.

Sales and changes of clients arrive in batches, by the day they arrived. A batch
is fed by moving its written files into the folder that a streaming query
watches; the query starts anew for each batch, on one checkpoint, and ends when
it has read what is there. Two stages with state stand behind each other:

* The gate is keyed by a hash of the sale. It holds a sale until the horizon H,
  which is the smaller of both tables' watermarks, has passed it. A row without
  sale wakes each key in each batch, so that waiting sales leave on time, in an
  empty batch too; in the last start, after the last batch's, all that still
  wait are let go as those of one batch more.
* The version stage is keyed by client: by a hash of it, so that the clients of
  a key share one call and one value of state. It answers the sales that the
  gate lets go from the versions of their client, and then prunes the versions:
  of those up to H all but the last go. A key that a batch doesn't touch is
  pruned when it is touched again, before any new row; H never falls, so the
  result is the same.

A client with over `HOT` rows has a key for each slice of time, of about `SLICE`
rows (an hour at least), so that no task gets all its rows. Slices never cross
a horizon. A slice has its own versions in full, and of each slice and batch of
its client a brief: how many versions, and the last. All versions of a brief
lie on one side of a sale of another slice and on one side of every horizon, so
a sale needs no more of them than that. A client's briefs are bounded by hours
and batches, not by its rows.

Besides the written tables, only the largest times of each batch come to the
driver.

Each start opens a state store for each stage and partition, and Spark never
frees the statistics of a RocksDB store, about half a megabyte, so an executor
holds that much more for each. A start more than the batches need is none.
What is read of a state is read once in a start, so little is cached.

Defined cases: rows without time of arrival come with the last batch, days
before the first batch with that; changes without valid_at are ignored, repeated
changes count once, repeated sales each; a sale without client, or whose client
is unknown, has no version and n_held 0; one without sold_at leaves at once and
matches none; of versions equal in valid_at, seq and change_id (nulls are least)
the one with the greater balance, then op is last; a balance that is null, not
finite or beyond 64 bits in cents gives null; empty tables give no rows; other
columns matter for nothing but telling changes apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rankweave.llm.shared import done_with, scratch_path, table, written

BATCHES, FIRST_DAY, DAYS = 8, 19723, 152
#: Microseconds: by how much a watermark stays behind the largest time; an hour.
DELAY, HOUR = 12 * 3600 * 1_000_000, 3600 * 1_000_000
#: Rows of a key of the gate and of the version stage, about; rows from which a client is dealt into slices, and of a slice.
GATE, SLOT, HOT, SLICE = 8192, 16384, 20_000, 5000
#: Before and after all times.
NEVER, ALWAYS = -(1 << 62), 1 << 62
SALE, TICK, CHANGE, BRIEF = range(4)
#: Bits of `nulls`: columns that are null; pandas has no integers that can be.
NO_ID, NO_CLIENT, NO_TIME, NO_OP, NO_CENTS = 1, 2, 4, 8, 16
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}

SALES = "kind int, bucket int, client_id long, piece int, id long, at long, nulls int"
VERSIONS = "kind int, client_id long, piece int, id long, at long, nulls int, seq long, op string, cents long, n long"
RESULT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string"


@dataclass(frozen=True)
class Turn:
    """A batch: sales before the horizon leave, changes before the floor are late; before is the horizon of the batch before."""

    batch: int
    horizon: int
    before: int
    floor: int


def micros(at: Column) -> Column:
    """Microseconds since 1970 as the clock shows them, whatever the zone."""
    seconds = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def batch_of(day: Column, batches: int) -> Column:
    at = F.floor((day - FIRST_DAY) * batches / DAYS)
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.coalesce(at, F.lit(batches - 1)))).cast("int")


def day_of(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))


def _bits(**named: Column) -> Column:
    """nulls, from the columns that may be null."""
    bit = {"id": NO_ID, "client": NO_CLIENT, "at": NO_TIME, "op": NO_OP, "cents": NO_CENTS}
    total = F.lit(0)
    for name, column in named.items():
        total = total + F.when(column.isNull(), bit[name]).otherwise(0)
    return total.cast("int")


def _frame(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


def _packed(rows: pd.DataFrame) -> bytes:
    held = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as stream:
        stream.write_table(held)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Keeper(StatefulProcessor):
    """A stage whose state of a key is one packed table; turns: of the batch, and after the last one more without new rows."""

    def __init__(self, turns: list[Turn]):
        self.turns = turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "data binary")

    def held(self) -> list[pd.DataFrame]:
        found = self.rows.get()
        return [] if found is None else [_unpacked(bytes(found[0]))]

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.rows.update((_packed(rows),))
        elif self.rows.exists():
            self.rows.clear()

    def close(self) -> None:
        pass


class Gate(_Keeper):
    """Holds sales until the horizon has passed them."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = _frame(rows)
        new = new.loc[new["kind"] == SALE, ["client_id", "piece", "id", "at", "nulls"]]
        sales = pd.concat([*self.held(), new], ignore_index=True)
        for turn in self.turns:
            leaves = ((sales["nulls"] & NO_TIME) != 0) | (sales["at"] < turn.horizon)
            if leaves.any():
                yield sales[leaves].assign(due=np.int32(turn.batch))
            sales = sales[~leaves]
        self.keep(sales)


def units(*tables: pd.DataFrame) -> list[np.ndarray]:
    """Numbers of (client, piece), the same in all tables."""
    clients, _ = pd.factorize(np.concatenate([t["client_id"].to_numpy() for t in tables]))
    pieces, known = pd.factorize(np.concatenate([t["piece"].to_numpy() for t in tables]))
    found, _ = pd.factorize(clients.astype(np.int64) * (len(known) + 1) + pieces)
    return np.split(found, np.cumsum([len(t) for t in tables])[:-1])


def in_order(versions: pd.DataFrame, unit: np.ndarray) -> np.ndarray:
    """Places of versions by unit and time."""
    op, _ = pd.factorize(versions["op"], sort=True)
    return np.lexsort((op, *(versions[name].to_numpy() for name in ("cents", "id", "seq", "at")), unit))


def unpruned(versions: pd.DataFrame, unit: np.ndarray, old: np.ndarray) -> np.ndarray:
    """All but the old versions, and of these the last of each unit."""
    keep = ~old
    order = in_order(versions, unit)
    order = order[old[order]]
    if len(order):
        last = np.append(unit[order][1:] != unit[order][:-1], True)
        keep[order[last]] = True
    return keep


def answers(sales: pd.DataFrame, versions: pd.DataFrame, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sale: its client's unpruned versions, and the place of the last of them up to the sale, or -1.

    old: versions of earlier batches up to the horizon of the batch before, of
    which the last of each client alone is unpruned.
    """
    of_version, of_sale = units(versions, sales)
    known = max(of_version.max(initial=-1), of_sale.max(initial=-1)) + 1
    live = np.bincount(of_version[~old], weights=versions["n"].to_numpy()[~old], minlength=known)
    held = live.astype(np.int64) + (np.bincount(of_version[old], minlength=known) > 0)
    places = np.flatnonzero(unpruned(versions, of_version, old))
    places = places[in_order(versions.iloc[places], of_version[places])]
    unit = np.concatenate([of_version[places], of_sale])
    at = np.concatenate([versions["at"].to_numpy()[places], sales["at"].to_numpy()])
    rank = np.concatenate([np.arange(len(places)), np.full(len(sales), len(places))])
    order = np.lexsort((rank, at, unit))
    is_version = order < len(places)
    last = np.maximum.accumulate(np.where(is_version, np.arange(len(order)), -1))
    before = order[last]
    fits = (last >= 0) & (unit[before] == unit[order]) & ~is_version
    found = np.full(len(sales), -1)
    found[order[fits] - len(places)] = places[before[fits]]
    return held[of_sale], found


class Versions(_Keeper):
    """Keeps versions of clients, answers sales and prunes."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, turn = _frame(rows), self.turns[0]
        late = (new["kind"] == CHANGE) & (new["at"] < turn.floor)
        if late.any():
            yield self._told("late", turn, new[late], np.zeros(0, np.int64), new[late], np.full(late.sum(), -1))
        fresh = new[((new["kind"] == CHANGE) | (new["kind"] == BRIEF)) & ~late & ((new["nulls"] & NO_CLIENT) == 0)]
        fresh = fresh[["client_id", "piece", "id", "at", "nulls", "seq", "op", "cents", "n"]].assign(batch=turn.batch)
        versions = pd.concat([*self.held(), fresh], ignore_index=True)
        for turn in self.turns:
            before = (versions["batch"].to_numpy() < turn.batch) & (versions["at"].to_numpy() <= turn.before)
            sales = new[(new["kind"] == SALE) & (new["due"] == turn.batch)]
            if len(sales):
                n_held, place = answers(sales, versions, before)
                stranger = ((sales["nulls"] & NO_CLIENT) != 0).to_numpy()
                yield self._told("sale", turn, sales, np.where(stranger, 0, n_held), versions, np.where(stranger, -1, place))
            (unit,) = units(versions)
            versions = versions[unpruned(versions, unit, before)]
            if turn.horizon > turn.before:
                (unit,) = units(versions)
                versions = versions[unpruned(versions, unit, versions["at"].to_numpy() <= turn.horizon)]
        self.keep(versions)

    def _told(self, rec: str, turn: Turn, rows: pd.DataFrame, n_held: np.ndarray, versions: pd.DataFrame, place: np.ndarray) -> pd.DataFrame:
        """Result rows; place: of the version in versions, or -1."""
        found, sale = place >= 0, rec == "sale"
        match = versions.iloc[place[found]]

        def column(name: str, bit: int) -> pd.arrays.IntegerArray:
            values, missing = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
            values[found], missing[found] = match[name].to_numpy(), (match["nulls"].to_numpy() & bit) != 0
            return pd.arrays.IntegerArray(values, missing)

        op = np.full(len(rows), None, object)
        op[found] = np.where((match["nulls"].to_numpy() & NO_OP) != 0, None, match["op"].to_numpy())
        return pd.DataFrame(
            {
                "rec": rec,
                "id": pd.arrays.IntegerArray(rows["id"].to_numpy().copy(), (rows["nulls"].to_numpy() & NO_ID) != 0),
                "batch": np.int64(turn.batch),
                "n_held": pd.arrays.IntegerArray(n_held if sale else np.zeros(len(rows), np.int64), np.full(len(rows), not sale)),
                "change_id": column("id", NO_ID),
                "balance_cents": column("cents", NO_CENTS),
                "op": op,
            },
            index=range(len(rows)),
        )


def horizons(sold: dict[int, int], valid: dict[int, int], batches: int) -> list[Turn]:
    """The turns, from each batch's largest times; one more, in the last batch's start, lets all sales go."""
    mark = lambda largest, b: max((t for k, t in largest.items() if k < b), default=NEVER + DELAY) - DELAY
    turns: list[Turn] = []
    for b in range(batches):
        floor = mark(valid, b)
        turns.append(Turn(b, min(mark(sold, b), floor), turns[-1].horizon if turns else NEVER, floor))
    return [*turns, Turn(batches, ALWAYS, turns[-1].horizon, NEVER)]


def enriched(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, hot: int = HOT, slice_rows: int = SLICE, gate_rows: int = GATE, slot_rows: int = SLOT) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): a row per sale and late change."""
    spark = sales.sparkSession
    cents = F.floor(F.lit(100) * F.col("balance").cast("double") + F.lit(0.5))
    cents = F.when(F.abs(cents.cast("double")) < F.lit(2.0**63), cents.cast("long"))
    sold = sales.select("client_id", F.col("sale_id").alias("id"), micros(F.col("sold_at")).alias("at"), batch_of(day_of(F.col("arrived_at")), batches).alias("batch"))
    delay = F.pmod(F.crc32(F.col("change_id").cast("string").cast("binary")), F.lit(4))
    valid = changes.where(F.col("valid_at").isNotNull()).distinct()
    valid = valid.select("client_id", F.col("change_id").alias("id"), "seq", "op", cents.alias("cents"), micros(F.col("valid_at")).alias("at"), batch_of(day_of(F.col("valid_at")) + delay, batches).alias("batch"))
    valid = written(valid, "changes")
    largest = lambda rows: {r.batch: (r.at, r.n) for r in rows.groupBy("batch").agg(F.max("at").alias("at"), F.count("*").alias("n")).collect()}  # noqa: E731  a row a batch
    by_sold, by_valid = largest(sold), largest(valid)
    times = [{b: at for b, (at, _) in by.items() if at is not None} for by in (by_sold, by_valid)]
    turns = horizons(times[0], times[1], batches)
    n_sold, n_valid = (sum(n for _, n in by.values()) for by in (by_sold, by_valid))
    buckets, slots = max(1, -(-n_sold // gate_rows)), max(1, -(-(n_sold + n_valid) // slot_rows))

    # slices of the clients with many rows: by hour, and within an hour by horizon
    hour = F.floor(F.col("at") / HOUR).alias("hour")
    rows = sold.select("client_id", hour).union(valid.select("client_id", hour)).where("client_id is not null")
    many = written(rows.groupBy("client_id").count().where(F.col("count") > hot).select("client_id"), "hot-clients")
    by_hour = rows.join(many, "client_id").groupBy("client_id", "hour").count()
    up_to = F.sum("count").over(Window.partitionBy("client_id").orderBy(F.col("hour").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = written(by_hour.select("client_id", F.coalesce("hour", F.lit(NEVER)).alias("hour"), F.floor((up_to - F.col("count")) / slice_rows).cast("int").alias("slice")), "slices")
    passed = sum((F.when(F.col("at") > t.horizon, 1).otherwise(0) for t in turns[:-1]), F.lit(0))

    def dealt(frame: DataFrame) -> DataFrame:
        found = frame.withColumn("hour", F.coalesce(hour, F.lit(NEVER))).join(slices, ["client_id", "hour"], "left").drop("hour")
        return found.withColumn("piece", F.coalesce(F.col("slice") * (batches + 1) + passed + 1, F.lit(0)).cast("int")).drop("slice")

    root = scratch_path(spark, "stream")
    column = {"client_id": F.coalesce("client_id", F.lit(0)), "id": F.coalesce("id", F.lit(NEVER)), "at": F.coalesce("at", F.lit(NEVER))}
    waits = dealt(sold).select(
        F.lit(SALE).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), column["client_id"].alias("client_id"), "piece",
        column["id"].alias("id"), column["at"].alias("at"), _bits(id=F.col("id"), client=F.col("client_id"), at=F.col("at")).alias("nulls"), "batch",
    )
    ticks = spark.range(buckets).select(F.lit(TICK).alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("client_id"), F.lit(0).alias("piece"), "id", F.lit(0).cast("long").alias("at"), F.lit(0).alias("nulls"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    waits.union(ticks).write.partitionBy("batch").parquet(f"{root}/staged/sales")

    bits = _bits(id=F.col("id"), client=F.col("client_id"), op=F.col("op"), cents=F.col("cents"))
    filled = [column["id"].alias("id"), "at", bits.alias("nulls"), F.coalesce("seq", F.lit(NEVER)).alias("seq"), F.coalesce("op", F.lit("")).alias("op"), F.coalesce("cents", F.lit(NEVER)).alias("cents")]
    placed = dealt(valid)
    details = placed.select(F.lit(CHANGE).alias("kind"), column["client_id"].alias("client_id"), "piece", *filled, F.when(F.col("piece") == 0, 1).otherwise(0).cast("long").alias("n"), "batch")
    floors = F.array(*[F.lit(t.floor) for t in turns])
    last = F.max(F.struct("at", F.coalesce("seq", F.lit(NEVER)).alias("seq"), column["id"].alias("id"), F.coalesce("cents", F.lit(NEVER)).alias("cents"), F.coalesce("op", F.lit("")).alias("op"), bits.alias("nulls")))
    briefs = placed.where((F.col("piece") > 0) & (F.col("at") >= F.element_at(floors, F.col("batch") + 1))).groupBy("client_id", "piece", "batch").agg(F.count("*").alias("n"), last.alias("last"))
    asked = dealt(sold).where("piece > 0").select("client_id", "piece").distinct()
    briefs = briefs.drop("piece").join(asked, "client_id")
    briefs = briefs.select(F.lit(BRIEF).alias("kind"), "client_id", "piece", *(f"last.{name}" for name in ("id", "at", "nulls", "seq", "op", "cents")), "n", "batch")
    details.union(briefs).write.partitionBy("batch").parquet(f"{root}/staged/changes")
    done_with(valid, many, slices)
    return _streamed(spark, root, turns, slots)


def _streamed(spark: SparkSession, root: str, turns: list[Turn], slots: int) -> DataFrame:
    """Feeds the staged batches turn by turn; what the stream wrote."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        for turn in turns[:-1]:
            for kind in ("sales", "changes"):
                fed = path(f"{root}/fed/{kind}/{turn.batch}")
                files.mkdirs(fed.getParent())
                staged = path(f"{root}/staged/{kind}/batch={turn.batch}")
                _ = files.rename(staged, fed) if files.exists(staged) else files.mkdirs(fed)
            now = turns[-2:] if turn is turns[-2] else [turn]
            query = _stages(spark, root, now, slots).writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(RESULT).parquet(f"{root}/out")


def _stages(spark: SparkSession, root: str, turns: list[Turn], slots: int) -> DataFrame:
    """The gate, its sales with the changes, and the version stage."""
    sales = spark.readStream.schema(SALES).parquet(f"{root}/fed/sales/*")
    changes = spark.readStream.schema(VERSIONS).parquet(f"{root}/fed/changes/*")
    released = sales.groupBy("bucket").transformWithStateInPandas(Gate(turns), "client_id long, piece int, id long, at long, nulls int, due int", "Append", "None")
    asks = released.select(F.lit(SALE).alias("kind"), "client_id", "piece", "id", "at", "nulls", F.lit(0).cast("long").alias("seq"), F.lit("").alias("op"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("n"), "due")
    unknown = F.when(F.col("nulls").bitwiseAND(NO_CLIENT) != 0, F.col("id")).otherwise(0)
    slot = F.pmod(F.xxhash64("client_id", "piece", unknown), F.lit(slots)).cast("int").alias("slot")
    both = asks.unionByName(changes.withColumn("due", F.lit(turns[0].batch))).select("*", slot)
    return both.groupBy("slot").transformWithStateInPandas(Versions(turns), RESULT, "Append", "None")


def op13_valid_time_sales(spark, sf_dir: str) -> DataFrame:
    return enriched(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def _sql() -> str:
    """All in one: what is unpruned in a batch follows from the horizons alone."""
    batch = lambda day: f"greatest(0, least({BATCHES - 1}, coalesce(floor(({day} - {FIRST_DAY}) * {BATCHES} / {DAYS}), {BATCHES - 1})))::INT"
    day = lambda at: f"date_diff('day', DATE '1970-01-01', {at}::DATE)"
    bits = "flatten(list_transform(string_split(change_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"CASE WHEN change_id IS NOT NULL THEN list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: xor(xor(c, x) // 2, 3988292384 * (xor(c, x) % 2))) END"
    return f"""
WITH s AS (SELECT sale_id, client_id, sold_at, {batch(day("arrived_at"))} AS b FROM sales),
c AS (SELECT *, {batch(day("valid_at") + f" + (3 - ({crc}) % 4)")} AS b FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
w AS (SELECT n.b::INT AS b, (SELECT max(sold_at) FROM s WHERE s.b < n.b) - INTERVAL 12 HOUR AS ws,
  (SELECT max(valid_at) FROM c WHERE c.b < n.b) - INTERVAL 12 HOUR AS wc FROM range({BATCHES + 1}) n(b)),
h AS (SELECT b, wc, CASE WHEN ws IS NULL OR wc IS NULL THEN NULL WHEN ws < wc THEN ws ELSE wc END AS h FROM w),
l AS (SELECT c.*, wc IS NOT NULL AND valid_at < wc AS late FROM c JOIN h USING (b)),
e AS (SELECT row_number() OVER () AS r, s.*, coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.b AND h.b < {BATCHES} AND (s.sold_at IS NULL OR s.sold_at < h.h)), {BATCHES}) AS out_b FROM s),
q AS (SELECT e.*, h.h AS before FROM e LEFT JOIN h ON h.b = e.out_b - 1),
k AS (SELECT DISTINCT client_id, out_b, before FROM q WHERE client_id IS NOT NULL),
v AS (SELECT k.client_id, k.out_b, l.valid_at, l.seq, l.change_id, l.op, l.balance, l.b < k.out_b AND coalesce(l.valid_at <= k.before, false) AS old,
  row_number() OVER (PARTITION BY k.client_id, k.out_b, l.b < k.out_b AND coalesce(l.valid_at <= k.before, false) ORDER BY l.valid_at DESC, l.seq DESC, l.change_id DESC) AS n
  FROM k JOIN l ON l.client_id = k.client_id AND l.b <= k.out_b AND NOT l.late),
u AS (SELECT * FROM v WHERE NOT old OR n = 1),
held AS (SELECT client_id, out_b, count(*) AS n_held FROM u GROUP BY ALL),
m AS (SELECT q.r, arg_max(u, (u.valid_at, u.seq, u.change_id)) AS u FROM q JOIN u ON u.client_id = q.client_id AND u.out_b = q.out_b AND u.valid_at <= q.sold_at GROUP BY q.r)
SELECT 'sale' AS rec, q.sale_id AS id, q.out_b::BIGINT AS batch, coalesce(held.n_held, 0)::BIGINT AS n_held, m.u.change_id AS change_id,
  floor(100 * m.u.balance + 0.5)::BIGINT AS balance_cents, m.u.op AS op
FROM q LEFT JOIN held ON held.client_id = q.client_id AND held.out_b = q.out_b LEFT JOIN m ON m.r = q.r
UNION ALL SELECT 'late', change_id, b::BIGINT, NULL, NULL, NULL, NULL FROM l WHERE late
"""


ORACLE_SQL = _sql()
