"""Intervals from calibration scores: one margin per series, or per group of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import conformal_quantile, d


def clipped(lo: Column, clip: float | None) -> Column:
    return lo if clip is None else F.when(lo.isNotNull(), F.greatest(lo, d(clip)))


def margins(cal: DataFrame, score: str, alpha: float, *keys: str, rule=conformal_quantile) -> DataFrame:
    """q per series. Scores of a series are gathered once, after a partial aggregation."""
    return cal.groupBy(*keys).agg(rule(F.collect_list(score), alpha).alias("q"), F.count(score).alias("n_cal"))


def banded(test: DataFrame, q: DataFrame, low: str, high: str, *keys: str, clip: float | None = 0.0) -> DataFrame:
    """lo and hi: the band widened by its series' margin. Equal ends give a split-conformal interval, a quantile band a
    conformalised one."""
    joined = test.join(q, list(keys))
    return joined.withColumn("lo", clipped(F.col(low) - F.col("q"), clip)).withColumn("hi", F.col(high) + F.col("q"))


def uncrossed(df: DataFrame, low: str, high: str) -> DataFrame:
    """Crossing ends both become their midpoint; crossed tells which were."""
    mid = (F.col(low) + F.col(high)) / 2
    crossed = F.col(low) > F.col(high)
    return df.withColumn("crossed", crossed).withColumns({low: F.when(F.col("crossed"), mid).otherwise(F.col(low)), "__h": F.when(F.col("crossed"), mid).otherwise(F.col(high))}).withColumn(high, F.col("__h")).drop("__h")


def group_margins(cal: DataFrame, score: str, group: str, alpha: float, *keys: str, groups: DataFrame | None = None, least: int = 50) -> DataFrame:
    """q per series and group: of the group's own scores if there are `least`, else of its own and all of the series' (its
    own count twice); of the series' alone for a group without any. groups: the (keys, group) wanted."""
    own = cal.groupBy(*keys, group).agg(F.collect_list(score).alias("own"))
    every = cal.groupBy(*keys).agg(F.collect_list(score).alias("every"))
    wanted = groups if groups is not None else own.select(*keys, group)
    both = wanted.join(own, [*keys, group], "left").join(every, list(keys))
    mine = F.coalesce("own", F.array().cast("array<double>"))
    few = F.size(mine) < least
    return both.select(*keys, group, conformal_quantile(F.when(few, F.concat(mine, "every")).otherwise(mine), alpha).alias("q"), F.size(mine).alias("n_own"), few.alias("fell_back"))
