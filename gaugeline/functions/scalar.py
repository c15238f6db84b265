"""Column expressions that several operators share. All run in the JVM."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of the day by bucket, first to last; the other hours are night.
DAY_BUCKETS = {"am_rush": (6, 9), "midday": (10, 15), "pm_rush": (16, 19), "evening": (20, 23)}
EARTH_KM = 6371.0
#: The adaptive level stays inside.
LEVEL_BOUNDS = (1e-3, 1 - 1e-3)


def d(x: float) -> Column:
    """A double literal (Spark reads 0.9 as a decimal)."""
    return F.lit(float(x)).cast("double")


def conformal_rank(n: Column, alpha: Column) -> Column:
    """1-based rank of the conformal quantile: ceil((n + 1)(1 - alpha)), at most n."""
    return F.least(F.ceil((n + 1) * (1 - alpha)), n).cast("int")


def conformal_quantile(scores: Column, alpha: Column | float) -> Column:
    """The order statistic at the conformal rank; null for no scores. Never an interpolated percentile."""
    a = alpha if isinstance(alpha, Column) else d(alpha)
    return F.when(F.size(scores) > 0, F.get(F.array_sort(scores), conformal_rank(F.size(scores), a) - 1))


def skipping_quantile(scores: Column, alpha: Column | float) -> Column:
    """The retired rule, kept for attribution: one rank too high below the maximum."""
    a = alpha if isinstance(alpha, Column) else d(alpha)
    return F.get(F.array_sort(scores), F.least(conformal_rank(F.size(scores), a) + 1, F.size(scores)) - 1)


def projected(level: Column, bounds: tuple[float, float] | None = LEVEL_BOUNDS) -> Column:
    return level if bounds is None else F.greatest(d(bounds[0]), F.least(d(bounds[1]), level))


def band_score(y: Column, low: Column, high: Column) -> Column:
    """How far an outcome lies outside a band (negative inside); |y - f| where both ends are f."""
    return F.greatest(low - y, y - high)


def interval_score(y: Column, lo: Column, hi: Column, alpha: float | Column) -> Column:
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(d(0))
    return (hi - lo) + (2 / alpha if isinstance(alpha, Column) else d(2 / alpha)) * miss


def covered(y: Column, lo: Column, hi: Column) -> Column:
    return ((y >= lo) & (y <= hi)).cast("double")


def pinball(y: Column, f: Column, tau: float) -> Column:
    return F.greatest(d(tau) * (y - f), d(tau - 1) * (y - f))


def day_bucket(hour: Column) -> Column:
    out = F.lit("night")
    for name, (a, b) in DAY_BUCKETS.items():
        out = F.when(hour.between(a, b), name).otherwise(out)
    return out


def day_bucket_sql(hour: str) -> str:
    return "CASE " + " ".join(f"WHEN {hour} BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in DAY_BUCKETS.items()) + " ELSE 'night' END"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * d(EARTH_KM) * F.asin(F.sqrt(h))


def normal_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def right_closed_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """1 to `bins` equal widths, each closed on the right; the lowest value is in the first."""
    width = (high - low) / bins
    return F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - low) / width)))).otherwise(1).cast("int")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def from_epoch_s(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
