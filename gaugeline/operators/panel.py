"""Regular panels from irregular readings: grid, dense slots, sessions, interpolation, run lengths, arrivals.

A slot is the number of whole steps since 1970. All operators partition by series (and session), so series are
independent tasks and one shuffle serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_us, from_epoch_s

HOUR = 3600


def grained(x: Column, grain: int = 1024) -> Column:
    return F.floor(x * float(grain) + 0.5).cast("double") / float(grain)


def binned(df: DataFrame, series: Column, ts: str, value: str, step: int = HOUR, grain: int = 1024) -> DataFrame:
    """series, slot, v: the mean reading per bin, closed and labelled on the left. Kept to 1 / grain, a power of two: sums
    of such readings are exact, so later results don't depend on the order of a sum."""
    slot = F.floor(epoch_us(F.col(ts)) / (step * 1_000_000)).cast("long")
    return df.select(series.alias("series"), slot.alias("slot"), F.col(value).alias("v")).groupBy("series", "slot").agg(grained(F.avg("v"), grain).alias("v"))


def dense(cells: DataFrame, *keys: str) -> DataFrame:
    """Every slot of each series from its first to its last; observed tells the ones that had readings."""
    keys = keys or ("series",)
    span = cells.groupBy(*keys).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("slot"))
    return grid.join(cells, [*keys, "slot"], "left").withColumn("observed", F.col("v").isNotNull())


def session_grid(df: DataFrame, series: Column, ts: str, value: str, step: int = HOUR, hours: tuple[int, int] = (7, 16), grain: int = 1024) -> DataFrame:
    """Sessions are a series' days, within hours of the day. A session's slots run from the floor of its first reading to
    the ceiling of its last; a session without length has none."""
    us = epoch_us(F.col(ts))
    rows = df.select(series.alias("series"), F.to_date(ts).alias("day"), us.alias("us"), F.col(value).alias("v"), F.hour(ts).alias("hour")).filter(F.col("hour").between(*hours))
    width = step * 1_000_000
    span = rows.groupBy("series", "day").agg(F.floor(F.min("us") / width).alias("lo"), F.ceil(F.max("us") / width).alias("hi")).filter("hi > lo")
    cells = rows.groupBy("series", "day", F.floor(F.col("us") / width).alias("slot")).agg(grained(F.avg("v"), grain).alias("v"))
    grid = span.select("series", "day", F.explode(F.sequence("lo", "hi")).alias("slot"))
    return grid.join(cells, ["series", "day", "slot"], "left").withColumn("observed", F.col("v").isNotNull())


def interpolated(panel: DataFrame, limit: int, *keys: str) -> DataFrame:
    """occ: v, or linear in time between the readings around, for the first `limit` slots of each inner gap. Never beyond
    the last reading."""
    keys = keys or ("series",)
    w = Window.partitionBy(*keys).orderBy("slot")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("slot"))
    marked = panel.select("*", F.last("v", True).over(back).alias("pv"), F.last(at, True).over(back).alias("ps"), F.first("v", True).over(ahead).alias("nv"), F.first(at, True).over(ahead).alias("ns"))
    line = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("slot") - F.col("ps")) / (F.col("ns") - F.col("ps"))
    inside = F.col("pv").isNotNull() & F.col("nv").isNotNull() & (F.col("slot") - F.col("ps") <= limit)
    return marked.withColumn("occ", F.when(F.col("v").isNotNull(), F.col("v")).when(inside, line)).drop("pv", "ps", "nv", "ns")


def slot_time(slot: str = "slot", step: int = HOUR) -> Column:
    return from_epoch_s(F.col(slot) * step)


def run_lengths(df: DataFrame, value: str, *keys: str, order: str = "slot") -> DataFrame:
    """run: how many equal values in a row a row belongs to. Nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("run_id", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("run", F.count("*").over(Window.partitionBy(*keys, "run_id"))).drop("run_id")


def arrivals(df: DataFrame, series: str, ts: str, gap_minutes: float = 5.0) -> DataFrame:
    """Median minutes between readings of a series, and how many are further apart than the gap."""
    w = Window.partitionBy(series).orderBy("us")
    rows = df.select(F.col(series), epoch_us(F.col(ts)).alias("us"))
    minutes = rows.withColumn("minutes", (F.col("us") - F.lag("us").over(w)) / 60e6)
    return minutes.groupBy(series).agg(F.count("*").alias("n"), F.percentile("minutes", F.lit(0.5)).alias("median_minutes"), F.count_if(F.col("minutes") > gap_minutes).alias("n_gaps"))
