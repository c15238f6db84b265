"""Operations on result tables: relational set operations, alignment, differences, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerance classes: relative differences that a column may have, and hints in names, looked at in this order.
CLASSES = {"exact": 0.0, "tight": 1e-12, "declared": 1e-9}
HINTS = {"declared": ("ci_lo", "ci_hi", "_p", "boot"), "exact": ("picp", "n_", "count"), "tight": ("",)}


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows, by column name; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def in_all(df: DataFrame, entity: str, group: str) -> DataFrame:
    """Entities that occur in every group: relational division by counting."""
    n = df.agg(F.countDistinct(group).alias("__n"))
    return df.groupBy(entity).agg(F.countDistinct(group).alias("__c")).join(F.broadcast(n), F.col("__c") == F.col("__n")).select(entity)


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order, not just any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_before", "_after")) -> DataFrame:
    """Full outer join on keys as text, with origin: both, left_only or right_only."""
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys], F.lit(1).alias("__in" + suffix))

    both = side(left, suffixes[0]).join(side(right, suffixes[1]), keys, "full_outer")
    a, b = (F.col("__in" + s).isNotNull() for s in suffixes)
    return both.withColumn("origin", F.when(a & b, "both").when(a, "left_only").otherwise("right_only")).drop(*["__in" + s for s in suffixes])


def deltas(both: DataFrame, keys: list[str], metrics: list[str], suffixes: tuple[str, str] = ("_before", "_after")) -> DataFrame:
    """A row per key and metric: before, after, delta."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m + suffixes[0]).cast("double").alias("before"), F.col(m + suffixes[1]).cast("double").alias("after")) for m in metrics])
    return both.select(*keys, "origin", F.inline(rows)).withColumn("delta", F.col("after") - F.col("before"))


def tolerance_class(column: str) -> str:
    return next(c for c, hints in HINTS.items() if any(h in column for h in hints))


def same_value(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both null, or within a relative tolerance; NaN equals NaN."""
    close = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(close, F.lit(False))


def table_diff(made: DataFrame, reference: DataFrame, keys: list[str], unstable: DataFrame | None = None) -> DataFrame:
    """Cells that differ: keys, column, class, made, reference, excused. Rows that one side lacks show with the column
    `*`. unstable (keys, column, made) lists values that are excused, never in the class exact."""
    values = [c for c in reference.columns if c not in keys]
    if set(made.columns) != set(reference.columns):
        raise ValueError(f"columns differ: {sorted(set(made.columns) ^ set(reference.columns))}")
    both = aligned(made, reference, keys, ("_made", "_reference"))
    numeric = {f.name for f in reference.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")}

    def cell(c: str) -> Column:
        a, b, kind = F.col(c + "_made"), F.col(c + "_reference"), tolerance_class(c)
        same = same_value(a.cast("double"), b.cast("double"), CLASSES[kind]) if c in numeric else a.eqNullSafe(b)
        return F.struct(F.lit(c).alias("column"), F.lit(kind).alias("class"), a.cast("string").alias("made"), b.cast("string").alias("reference"), same.alias("same"))

    cells = both.filter("origin = 'both'").select(*keys, F.inline(F.array(*map(cell, values)))).filter(~F.col("same")).drop("same")
    lone = both.filter("origin <> 'both'").select(*keys, F.lit("*").alias("column"), F.lit("exact").alias("class"), F.when(F.col("origin") == "left_only", "row").alias("made"), F.when(F.col("origin") == "right_only", "row").alias("reference"))
    found = cells.unionByName(lone)
    if unstable is None:
        return found.withColumn("excused", F.lit(False))
    known = unstable.select(*[F.col(k).cast("string").alias(k) for k in keys], "column", F.col("made").cast("string").alias("made"), F.lit(True).alias("__known")).distinct()
    return found.join(known, [*keys, "column", "made"], "left").withColumn("excused", F.coalesce("__known", F.lit(False)) & (F.col("class") != "exact")).drop("__known")


def assert_gate(made: DataFrame, logged: DataFrame, keys: list[str], decimals: int = 4) -> None:
    """Stops unless the tables agree to some decimals."""
    cut = lambda df: df.select(*keys, *[F.round(c, decimals).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys])
    if bad := table_diff(cut(made), cut(logged), keys).limit(5).collect():
        raise AssertionError(f"differs from what was logged: {bad}")
