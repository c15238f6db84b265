"""Causal features of panels: lags, rolling statistics, leads, calendar, splits and their guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import d
from .panel import HOUR, slot_time


def lagged(panel: DataFrame, lags: Iterable[int], *keys: str, value: str = "occ", order: str = "slot") -> DataFrame:
    w = Window.partitionBy(*(keys or ("series",))).orderBy(order)
    return panel.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in lags])


def rolling(panel: DataFrame, width: int, *keys: str, value: str = "occ", order: str = "slot") -> DataFrame:
    """Mean and sample deviation of the `width` rows before; null unless all are there."""
    w = Window.partitionBy(*(keys or ("series",))).orderBy(order).rowsBetween(-width, -1)
    full = F.count(value).over(w) == width
    return panel.select("*", F.when(full, F.avg(value).over(w)).alias("roll_mean"), F.when(full, F.stddev_samp(value).over(w)).alias("roll_std"))


def targets(panel: DataFrame, horizons: Iterable[int], *keys: str, value: str = "occ", order: str = "slot") -> DataFrame:
    """y_h, and whether it was filled in."""
    w = Window.partitionBy(*(keys or ("series",))).orderBy(order)
    return panel.select("*", *[F.lead(value, h).over(w).alias(f"y_{h}") for h in horizons], *[(~F.coalesce(F.lead("observed", h).over(w), F.lit(False))).alias(f"y_interpolated_{h}") for h in horizons])


def calendar(panel: DataFrame, holidays: DataFrame | None = None, step: int = HOUR) -> DataFrame:
    """Time-of-day on the circle, weekday from Monday 0, weekend and holiday flags. holidays: a small table (day)."""
    ts = slot_time(step=step)
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = panel.select("*", F.sin(2 * F.pi() * minute / 1440).alias("tod_sin"), F.cos(2 * F.pi() * minute / 1440).alias("tod_cos"), F.weekday(ts).alias("dow"), (F.weekday(ts) >= 5).cast("long").alias("is_weekend"))
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0).cast("long"))
    days = holidays.select(F.col("day").alias("__day")).distinct()
    return out.join(days, F.to_date(ts) == F.col("__day"), "left").withColumn("is_holiday", F.col("__day").isNotNull().cast("long")).drop("__day")


def fractional_split(panel: DataFrame, train: float = 10 / 18, calibration: float = 14 / 18) -> DataFrame:
    """split, and split_start in slots: train up to a share of the whole span (both ends included), then calibration, then
    test. The train part starts a day before the first slot, so its embargo never bites."""
    ends = panel.agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    ends = ends.select((F.col("first") + (F.col("last") - F.col("first")) * d(train)).alias("te"), (F.col("first") + (F.col("last") - F.col("first")) * d(calibration)).alias("ce"), "first")
    rows = panel.crossJoin(F.broadcast(ends))  # one row
    split = lambda s: F.when(s <= F.col("te"), "train").when(s <= F.col("ce"), "calibration").otherwise("test")
    start = F.when(F.col("split") == "train", F.col("first") - 24.0).when(F.col("split") == "calibration", F.col("te")).otherwise(F.col("ce"))
    return rows.withColumn("split", split(F.col("slot"))).withColumn("split_start", start).drop("first")


def guards(panel: DataFrame, horizon: int) -> DataFrame:
    """split_ok: the target lies in the same split; embargo_ok: more than the horizon after its start; use: both.
    Needs te and ce of fractional_split."""
    target = F.col("slot") + horizon
    same = F.when(target <= F.col("te"), "train").when(target <= F.col("ce"), "calibration").otherwise("test") == F.col("split")
    out = panel.withColumn("split_ok", same).withColumn("embargo_ok", F.col("slot") - F.col("split_start") > horizon)
    return out.withColumn("use", F.col("split_ok") & F.col("embargo_ok"))


def terciles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """low, mid or high by the train rows' 33.3 and 66.7 percentiles of each series."""
    cuts = df.filter("split = 'train'").groupBy(*keys).agg(F.percentile(value, F.lit(1 / 3)).alias("__q1"), F.percentile(value, F.lit(2 / 3)).alias("__q2"))
    label = F.when(F.col(value) <= F.col("__q1"), "low").when(F.col(value) <= F.col("__q2"), "mid").otherwise("high")
    return df.join(cuts, list(keys), "left").withColumn("tercile", label).drop("__q1", "__q2")


def afternoon(ts: Column, days: Iterable[int] = range(5), first: int = 12, last: int = 19) -> Column:
    return F.weekday(ts).isin(*days) & (F.hour(ts) >= first) & (F.hour(ts) < last)


def by_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def floored(df: DataFrame, *columns: str, least: float = 0.0) -> DataFrame:
    """Readings below the least one become it; nulls stay."""
    return df.withColumns({c: F.when(F.col(c) < d(least), d(least)).otherwise(F.col(c)) for c in columns})


def overlaid(df: DataFrame, column: str, start: Column, level: Column, order: str = "i") -> DataFrame:
    """The column replaced by a level from an index on."""
    return df.withColumn(column, F.when(F.col(order) >= start, level).otherwise(F.col(column)))


def rebuilt(df: DataFrame, lags: Iterable[int], width: int, *keys: str, value: str = "occ", order: str = "i") -> DataFrame:
    """Lags and rolling statistics over the rows that are left, by position."""
    lags = list(lags)
    return rolling(lagged(df.drop(*[f"lag_{k}" for k in lags], "roll_mean", "roll_std"), lags, *keys, value=value, order=order), width, *keys, value=value, order=order)
