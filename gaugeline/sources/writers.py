"""Sinks: columnar tables, compressed text tables, resumable partitioned results, run reports and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import exists


def columnar(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def text_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def resume(df: DataFrame, path: str, unit: list[str]) -> None:
    """Writes units of work; a unit that is written again replaces itself and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(path)


def missing_units(todo: DataFrame, path: str, unit: list[str]) -> DataFrame:
    """Units of todo that aren't in the results yet."""
    spark = todo.sparkSession
    if not exists(spark, path):
        return todo
    done = spark.read.parquet(path).select(*[F.col(c).cast(todo.schema[c].dataType) for c in unit]).distinct()
    return todo.join(done, unit, "left_anti")


def report(df: DataFrame, series: str, split: str, readings: list[str]) -> DataFrame:
    """One row: a JSON report of rows, series, rows by split and nulls by column."""
    one = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(series).alias("series"),
        *[F.count_if(F.col(split) == s).alias(f"rows_{s}") for s in ("train", "calibration", "test")],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in readings],
    )
    return one.select(F.to_json(F.struct("*")).alias("report"))


def cached(df: DataFrame, path: str) -> DataFrame:
    """Written once, read afterwards."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
