"""Coverage over partitions of the same intervals, and how much of its spread they explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import scores


def hashed_label(*cols: Column, groups: int = 5, salt: str = "") -> Column:
    """A label that stands for chance: any engine with MD5 gives the same."""
    return F.concat(F.lit("r"), F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long") % groups)


def partition_cells(intervals: DataFrame, labels: dict[str, Column], alpha: float, *keys: str) -> DataFrame:
    """keys, partition, cell, n, picp, mpiw, winkler: all partitions in one pass over the intervals."""
    pairs = F.array(*[F.struct(F.lit(k).alias("partition"), v.cast("string").alias("cell")) for k, v in labels.items()])
    return intervals.select("*", F.explode(pairs).alias("__p")).select(*intervals.columns, "__p.*").groupBy(*keys, "partition", "cell").agg(*scores(alpha))


def grained(intervals: DataFrame, cell: str, alpha: float, entity: str = "series") -> DataFrame:
    """Pooled cells, entity by cell, and the worst cell of an entity, in one table by grain."""
    flat = intervals.groupBy(entity, cell).agg(*scores(alpha))
    pooled = flat.groupBy(cell).agg(F.sum("n").alias("n"), (F.sum(F.col("picp") * F.col("n")) / F.sum("n")).alias("picp"))
    worst = flat.groupBy(entity).agg(F.min_by(F.struct(cell, "n", "picp"), F.struct("picp", cell)).alias("w"))
    return (
        pooled.select(F.lit("pooled").alias("grain"), F.lit(None).cast("string").alias(entity), cell, "n", "picp")
        .unionByName(flat.select(F.lit("entity_cell").alias("grain"), entity, cell, "n", "picp"))
        .unionByName(worst.select(F.lit("worst_cell").alias("grain"), entity, F.col(f"w.{cell}").alias(cell), F.col("w.n").alias("n"), F.col("w.picp").alias("picp")))
    )


def cramers_v(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """The association of two labels; null unless each has two levels. Cells without rows count too: their share of the
    statistic is their expected count."""
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("o"))
    by_a = cells.withColumn("ra", F.sum("o").over(Window.partitionBy(*keys, a))).withColumn("rb", F.sum("o").over(Window.partitionBy(*keys, b)))
    one = by_a.groupBy(*keys).agg(F.sum("o").alias("n"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"))
    small = F.least("ka", "kb")
    return one.select(*keys, "n", F.when(small >= 2, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / (small - 1))).alias("cramers_v"))


def excess_dispersion(cells: DataFrame, base: str, *keys: str, population: bool = True) -> DataFrame:
    """Spread of coverage over cells of each partition, and what exceeds the chance partition's. Variances that differ by
    less than 1e-15 are equal."""
    sd = (F.stddev_pop if population else F.stddev_samp)("picp")
    spread = cells.groupBy(*keys, "partition").agg(F.count("*").alias("n_cells"), sd.alias("sd"))
    floor = spread.filter(F.col("partition") == base).select(*keys, F.col("sd").alias("floor_sd"))
    rows = spread.join(floor, list(keys)) if keys else spread.crossJoin(F.broadcast(floor))
    return rows.withColumn("excess", F.sqrt(F.greatest(F.round(F.col("sd") * F.col("sd") - F.col("floor_sd") * F.col("floor_sd"), 15), F.lit(0.0))))


def structure_removed(dispersion: DataFrame, base: str, cells: DataFrame) -> DataFrame:
    """Adds the cells' mean and least coverage, how many lie below 0.80, and 1 - excess^2 / excess^2 of a base method in the
    same partition; null where the base has none. Rows: method, partition."""
    on = ["method", "partition"]
    more = cells.groupBy(*on).agg(F.avg("picp").alias("mean_picp"), F.min("picp").alias("least_picp"), F.count_if(F.col("picp") < 0.8).alias("n_below_80"))
    own = dispersion.filter(F.col("method") == base).select("partition", (F.col("excess") * F.col("excess")).alias("__base"))
    share = F.when(F.col("__base") > 0, 1 - F.col("excess") * F.col("excess") / F.col("__base"))
    return dispersion.join(own, "partition").withColumn("structure_removed", share).drop("__base").join(more, on)


def in_folds(df: DataFrame, folds: DataFrame, at: str = "slot") -> DataFrame:
    """fold and split of rows in half-open windows (train0, cal0, test0, test1); a row may be in several folds. folds is a
    table of a few rows."""
    hit = df.join(F.broadcast(folds), (F.col(at) >= F.col("train0")) & (F.col(at) < F.col("test1")))
    split = F.when(F.col(at) < F.col("cal0"), "train").when(F.col(at) < F.col("test0"), "calibration").otherwise("test")
    return hit.drop("split").withColumn("split", split) if "split" in df.columns else hit.withColumn("split", split)
