"""Scans of raw feeds: wide text tables, site coordinates, capacity feeds; checks and fallbacks for paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingInput(FileNotFoundError):
    """An input that a step needs isn't there."""


def exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def require(spark: SparkSession, *paths: str) -> None:
    if lacking := [p for p in paths if not exists(spark, p)]:
        raise MissingInput(", ".join(lacking))


def first_of(spark: SparkSession, *paths: str) -> str:
    """The first path that exists: a run's own output before a shipped one."""
    for p in paths:
        if exists(spark, p):
            return p
    raise MissingInput(" or ".join(paths))


def stamp(column: str) -> Column:
    """`Sat Mar 2017 04 15:00:59` as a zone-free timestamp; null if it isn't one. The weekday is not read."""
    return F.expr(f"try_to_timestamp(regexp_replace(trim(`{column}`), '^[A-Za-z]+ ', ''), 'MMM yyyy dd HH:mm:ss')").cast("timestamp_ntz")


def lenient(text: Column) -> Column:
    """A number, or null."""
    return F.trim(text).try_cast("double")


def wide_feed(spark: SparkSession, path: str, header_row: int = 4, series: str = "series") -> DataFrame:
    """A headerless comma-separated table: row `header_row` (from 1) names the columns, what follows is data, the first
    column is a time. Returns time, series_id (in header order from 1), series, reading. The header is one line: only it
    is read on the driver."""
    lines = spark.read.text(path, wholetext=False)
    head = lines.limit(header_row).collect()
    if len(head) < header_row:
        raise MissingInput(f"{path} has no row {header_row}")
    names = [x.strip().strip('"') for x in head[-1][0].split(",")]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    timed = rows.withColumn("time", stamp("c0")).filter("time is not null")
    cells = F.array(*[F.struct(F.lit(i).alias("series_id"), F.lit(n).alias(series), lenient(F.col(f"c{i}")).alias("reading")) for i, n in enumerate(names) if i and n])
    return timed.select("time", F.inline(cells))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """site, longitude, latitude from rows whose second field is all digits."""
    rows = spark.read.schema("a string, b string, c string, d string").csv(path)
    return rows.filter(F.trim("b").rlike("^[0-9]+$")).select(F.trim("b").cast("long").alias("site"), lenient(F.col("c")).alias("longitude"), lenient(F.col("d")).alias("latitude"))


def headed(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table with a header; raises if one of the columns isn't there. columns: name to type."""
    rows = spark.read.option("header", True).csv(path)
    if lacking := [c for c in columns if c not in rows.columns]:
        raise MissingInput(f"{path} lacks {lacking}")
    return rows.select(*[F.trim(F.col(c)).try_cast(t).alias(c) for c, t in columns.items()])


def with_rate(df: DataFrame, reading: str = "occupancy", capacity: str = "capacity") -> DataFrame:
    """occupancy_rate: reading by capacity, from 0 to 1; null without a capacity."""
    rate = F.try_divide(reading, capacity)
    return df.withColumn("occupancy_rate", F.when(rate.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))))


def sorted_ids(df: DataFrame, name: str, out: str = "series_id") -> DataFrame:
    """Numbers names from 1 in sorted order. Only the distinct names are sorted in one place."""
    ids = df.select(name).distinct().withColumn(out, F.row_number().over(Window.orderBy(name)))
    return df.join(ids, name)


def hashed_files(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """path, bytes, sha256 of the files under a folder. With a list (name, sha256): state is `same`, `changed`, `missing` (only
    listed) or `unlisted`, by the files' names below the folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", path.rstrip("/") + "/", -1)
    files = found.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if listed is None:
        return files
    both = files.join(listed.select("name", F.col("sha256").alias("listed")), "name", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256") == F.col("listed"), "same").otherwise("changed")
    return both.withColumn("state", state)


def table_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table as the next step's input: a delimited file with a header, or a columnar one, with the columns and types
    that the step asks for."""
    plain = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    wanted = T.StructType.fromDDL(schema)
    return plain.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
