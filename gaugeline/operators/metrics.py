"""Scores of intervals and their summaries. Intervals are the common table: keys, y, lo, hi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import picks
from ..functions.scalar import covered, d, interval_score


def scores(alpha: float | Column, y: str = "y", lo: str = "lo", hi: str = "hi") -> list[Column]:
    """n, picp, mpiw and winkler as aggregates."""
    c = [F.col(x) for x in (y, lo, hi)]
    return [F.count("*").alias("n"), F.avg(covered(*c)).alias("picp"), F.avg(c[2] - c[1]).alias("mpiw"), F.avg(interval_score(*c, alpha)).alias("winkler")]


def scored(intervals: DataFrame, alpha: float | Column, *keys: str) -> DataFrame:
    return intervals.groupBy(*keys).agg(*scores(alpha))


def point_errors(df: DataFrame, y: str, f: str, *keys: str) -> DataFrame:
    e = F.col(y) - F.col(f)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def across(cells: DataFrame, *keys: str, target: float = 0.9, entity: str = "series", population: bool = False) -> DataFrame:
    """Pooled, mean and worst coverage over entities, with gaps and counts near the target. The worst is the first by name
    among equals."""
    sd = F.stddev_pop if population else F.stddev_samp
    worst = F.min(F.struct("picp", entity))
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n_entities"),
        (F.sum(F.col("picp") * F.col("n")) / F.sum("n")).alias("pooled_picp"),
        F.avg("picp").alias("mean_picp"),
        sd("picp").alias("sd_picp"),
        worst["picp"].alias("worst_picp"),
        worst[entity].alias("worst_entity"),
        F.avg((F.abs(F.col("picp") - d(target)) <= 0.02).cast("double")).alias("share_near"),
        F.count_if(F.col("picp") < 0.80).alias("n_below_80"),
        F.count_if(F.col("picp") < 0.85).alias("n_below_85"),
        F.avg((F.col("picp") >= 0.88).cast("double")).alias("share_safe"),
        F.avg("mpiw").alias("mean_mpiw"),
        F.avg("winkler").alias("mean_winkler"),
    )


def block_length(cadence_minutes: float, hours: float = 3.0) -> int:
    """Rows of a bootstrap block that spans some hours; two at least."""
    if cadence_minutes <= 0:
        raise ValueError("cadence must be positive")
    return max(2, round(hours * 60 / cadence_minutes))


def block_bootstrap(df: DataFrame, indicator: str, order: str, *keys: str, block: int, draws: int = 10_000, seed: int = 42, level: float = 0.9, target: float = 0.9, margin: float = 0.02) -> DataFrame:
    """mean, ci_lo and ci_hi of each series' mean under serial dependence, whether the interval contains the target, and
    whether it lies above target less margin: means of draws of n // block blocks with starts anywhere, and their
    percentiles; null for a series shorter than a block. Block means come from a running sum, so a draw costs its blocks
    and not its rows, and memory is bounded by a batch of draws."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values(order)[indicator].to_numpy(float)
        out, n = {k: [pdf[k].iloc[0]] for k in keys}, len(x)
        low = high = np.nan
        if n >= block:
            sums = np.concatenate(([0.0], np.cumsum(x)))
            totals, many = sums[block:] - sums[:-block], max(1, n // block)
            step = max(1, min(2000, 4_000_000 // many))
            means = np.concatenate([totals[picks(seed, range(i, min(draws, i + step)), many, n - block + 1)].sum(1) / (many * block) for i in range(0, draws, step)])
            tail = (1 - level) / 2 * 100
            low, high = np.percentile(means, tail), np.percentile(means, 100 - tail)
        known = n >= block
        out |= {"n": [n], "mean": [x.mean()], "ci_lo": [low], "ci_hi": [high], "contains": [bool(low <= target <= high) if known else None], "safe": [bool(low >= target - margin) if known else None]}
        return pd.DataFrame(out)

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*keys, order, F.col(indicator).cast("double").alias(indicator)).groupBy(*keys).applyInPandas(run, f"{types}, n long, mean double, ci_lo double, ci_hi double, contains boolean, safe boolean")
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ci_lo", "ci_hi")})


def agreement(df: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> Column:
    """The share of rows where two columns agree; nulls agree with each other."""
    near = F.abs(F.col(a) - F.col(b)) <= tolerance
    return F.avg((F.coalesce(near, F.lit(False)) | (F.col(a).isNull() & F.col(b).isNull())).cast("double"))
