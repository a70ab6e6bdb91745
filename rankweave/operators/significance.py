"""Paired t-test and the Benjamini-Hochberg step-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired_t(one: DataFrame, two: DataFrame, metric: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, t) over queries; a query that one side lacks counts 0 there. t is null where the differences do not vary."""
    keys = [*by, "qid"]
    rows = one.select(*keys, F.col(metric).alias("x")).join(two.select(*keys, F.col(metric).alias("y")), keys, "full_outer")
    rows = rows.withColumn("d", F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return stats.select(*by, "n", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    value, upper, lower = 1.0, 1.0, 0.0
    for step in range(400):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        lower = 1 / max(1 + term * lower, 1e-300) if 1 + term * lower >= 0 else 1 / min(1 + term * lower, -1e-300)
        upper = 1 + term / upper
        value *= upper * lower
        if step and abs(1 - upper * lower) < 1e-14:
            break
    return front * (value - 1)


def student_p(t: float, n: int) -> float:
    """Two-sided p-value of t with n - 1 degrees of freedom."""
    free = n - 1
    return incomplete_beta(free / 2, 0.5, free / (free + t * t))


def with_p(rows: DataFrame) -> DataFrame:
    """Adds p to rows with n and t; null where t is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p"] = [student_p(t, n) if not np.isnan(t) and n > 1 else None for t, n in zip(batch["t"].astype(float), batch["n"])]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, p double")


def step_up(pvalues: DataFrame, alpha: float, by: tuple[str, ...] = (), exclude: tuple[str, ...] = (), name: str = "dataset") -> DataFrame:
    """Adds rank, adjusted = p M / rank, and rejected: some rank at or after this one has adjusted < alpha.

    Rows are ranked by p from the smallest on; excluded names take no part.
    """
    rows = pvalues.where(F.col("p").isNotNull() & ~F.col(name).isin(*exclude)) if exclude else pvalues.where("p is not null")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    order = group.orderBy("p", name)
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(group))
    rows = rows.withColumn("adjusted", F.col("p") * F.col("m") / F.col("rank"))
    least = F.min("adjusted").over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("rejected", least < alpha).drop("m")


def over_datasets(scores: dict[str, DataFrame], baselines: tuple[str, ...], metric: str, alpha: float | None = None) -> DataFrame:
    """(system, baseline, dataset, n, t, p) of every other system against each baseline; scores by system: (dataset, qid, metric).

    With alpha, the step-up over the datasets of each pair: rank, adjusted, rejected.
    """
    if missing := set(baselines) - set(scores):
        raise ValueError(f"no scores of {sorted(missing)}")
    rows = None
    for system in scores.keys() - set(baselines):
        for baseline in baselines:
            pair = paired_t(scores[system], scores[baseline], metric, ("dataset",))
            pair = pair.select(F.lit(system).alias("system"), F.lit(baseline).alias("baseline"), "dataset", "n", "t")
            rows = pair if rows is None else rows.union(pair)
    if rows is None:
        raise ValueError("every system is a baseline")
    return with_p(rows) if alpha is None else step_up(with_p(rows), alpha, ("system", "baseline"))
