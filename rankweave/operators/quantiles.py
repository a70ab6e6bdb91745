"""Exact quantiles of a column that no task holds, by histograms that narrow to the wanted ranks.

A pass counts the values of each interval that still holds a wanted rank in
`bins` bins, with the least and greatest value of each; the bins with the ranks
are the next intervals. An interval ends when its values are few, which are then
counted one by one, or all the same. What a pass sends to the driver is bounded
by bins times ranks, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 4096, 4096


@dataclass
class Interval:
    """Values from low to high, of which n; before: how many are smaller."""

    low: float
    high: float
    n: int
    before: int


def at_ranks(rows: DataFrame, column: str, ranks: Sequence[int] | None = None, shares: Sequence[float] | None = None, bins: int = BINS, few: int = FEW) -> tuple[int, dict[int, float]]:
    """(number of values, value at each rank from 0 in ascending order) of a numeric column; nulls and NaN are left out.

    shares asks for the ranks below and above each share of the way from the first to the last.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    wanted = set(ranks or ())
    for share in shares or ():
        wanted |= {math.floor(share * (n - 1)), math.ceil(share * (n - 1))}
    wanted = {r for r in wanted if 0 <= r < n}
    found: dict[int, float] = {}
    live = [Interval(low, high, n, 0)] if wanted else []
    while live:
        known, live = _settled(values, live, wanted, few)
        found |= known
        if live:
            live = _narrowed(values, live, wanted, bins)
    return n, found


def _of(live: list[Interval]):
    """Which interval a value lies in; null for none."""
    which = F.lit(None).cast("int")
    for i, own in enumerate(live):
        which = F.when((F.col("x") >= own.low) & (F.col("x") <= own.high), F.lit(i)).otherwise(which)
    return which


def _settled(values: DataFrame, live: list[Interval], wanted: set[int], few: int) -> tuple[dict[int, float], list[Interval]]:
    """Ranks in intervals of one value or few values, and the other intervals."""
    found, small, large = {}, [], []
    for own in live:
        if own.low == own.high:
            found |= {r: own.low for r in wanted if own.before <= r < own.before + own.n}
        else:
            (small if own.n <= few else large).append(own)
    if small:
        counts = values.withColumn("i", _of(small)).where("i is not null").groupBy("i", "x").count().collect()  # few times ranks at most
        for i, own in enumerate(small):
            at = own.before
            for row in sorted((r for r in counts if r.i == i), key=lambda r: r.x):
                found |= {r: row.x for r in wanted if at <= r < at + row["count"]}
                at += row["count"]
    return found, large


def _narrowed(values: DataFrame, live: list[Interval], wanted: set[int], bins: int) -> list[Interval]:
    """The bins of the intervals that hold a wanted rank."""
    width = F.element_at(F.array(*[F.lit((own.high / 2 - own.low / 2) / (bins / 2)) for own in live]), F.col("i") + 1)
    low = F.element_at(F.array(*[F.lit(own.low) for own in live]), F.col("i") + 1)
    bin_of = F.least(F.floor((F.col("x") / 2 - low / 2) / (width / 2)), F.lit(bins - 1))
    counted = values.withColumn("i", _of(live)).where("i is not null").groupBy("i", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    after: list[Interval] = []
    rows = sorted(counted.collect(), key=lambda r: (r.i, r.low))  # bins times ranks at most
    for i, own in enumerate(live):
        at = own.before
        for row in (r for r in rows if r.i == i):
            if any(at <= r < at + row.n for r in wanted):
                after.append(Interval(row.low, row.high, row.n, at))
            at += row.n
    return after


def percentiles(rows: DataFrame, column: str, shares: Sequence[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The values at shares of the way from the least to the greatest, interpolated between neighbours; None without values."""
    n, at = at_ranks(rows, column, shares=shares, bins=bins, few=few)
    out: list[float | None] = []
    for share in shares:
        place = share * (n - 1)
        if not n:
            out.append(None)
            continue
        a, b = at[math.floor(place)], at[math.ceil(place)]
        part = place - math.floor(place)
        out.append(a if a == b else (1 - part) * a + part * b)
    return out
