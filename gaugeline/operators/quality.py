"""Data-quality flags and guards of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DISTINCT = 10
#: Least rows of train, calibration and test parts, by use.
THIN = {"core": (100, 50, 50), "baseline": (50, 50, 10), "selective": (100, 100, 50), "folds": (500, 200, 200)}


def dynamic(df: DataFrame, value: str, *keys: str, least: float = 5.0, population: bool = False) -> DataFrame:
    """A flag per series: the deviation over its train rows is at least `least`. Fold runs use the population's."""
    v = F.when(F.col("split") == "train", F.col(value))
    sd = (F.stddev_pop if population else F.stddev_samp)(v)
    return df.groupBy(*keys).agg(sd.alias("train_sd"), (F.coalesce(sd, F.lit(0.0)) >= least).alias("dynamic"))


def low_information(df: DataFrame, value: str, *keys: str, least: int = MIN_DISTINCT) -> DataFrame:
    """A flag per series: fewer than `least` distinct readings among the rows given, which should be those that are
    scored. Exact; a series without readings has none."""
    n = F.countDistinct(value)
    return df.groupBy(*keys).agg(n.alias("n_distinct"), (n < least).alias("low_information"))


#: When calibration scores count as nearly 0: by their greatest size, by the greatest, or if none is above 0.
DEGENERATE = {"size": lambda s, t: F.max(F.abs(s)) < t, "greatest": lambda s, t: F.max(s) < t, "none_above": lambda s, t: F.max(s) <= 0}


def degenerate(scores: DataFrame, score: str, *keys: str, tolerance: float = 1e-9, rule: str = "size") -> DataFrame:
    """A flag per series: all calibration scores are nearly 0."""
    return scores.groupBy(*keys).agg(DEGENERATE[rule](F.col(score), tolerance).alias("degenerate"))


def thin(df: DataFrame, *keys: str, least: tuple[int, int, int] = THIN["core"]) -> DataFrame:
    """A row per series with its counts and a status: thin series stay as marker rows."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "calibration", "test")])
    enough = (F.col("n_train") >= least[0]) & (F.col("n_calibration") >= least[1]) & (F.col("n_test") >= least[2])
    return counts.withColumn("status", F.when(enough, "ok").otherwise("SKIPPED-thin"))


def excluded(df: DataFrame, flags: DataFrame, flag: str, *keys: str) -> DataFrame:
    """Rows of series that aren't flagged."""
    return df.join(flags.filter(F.col(flag)).select(*keys), list(keys), "left_anti")


def stuck(runs: DataFrame, value: str, *keys: str, least: int = 12) -> DataFrame:
    """Shares of rows in runs of at least `least`, of zeros, the longest run and the most frequent value's share. Runs are
    those of run_lengths over whole series."""
    shares = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("run") >= least).cast("double")).alias("stuck_share"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"), F.max("run").alias("max_run"))
    modal = runs.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c")).groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("modal_share"))
    return shares.join(modal, list(keys), "left")
