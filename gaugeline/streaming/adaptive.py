"""Adaptive intervals over streams, and panels of streams.

A row brings a series' band and, in this replay of the delayed-feedback rule, the outcome that will be known h steps
later. State is a level, a window of scores and the feedback that hasn't matured: it doesn't grow with the stream. Rows of
a micro-batch are sorted by time; rows behind the watermark are dropped by Spark, duplicates by id within it. The
reference semantics of the batch fold hold for any split into micro-batches, as long as rows arrive in order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import LEVEL_BOUNDS

OUT = "series string, i long, alpha double, q double, lo double, hi double"
STATE = "i long, level double, width int, pool array<double>, scores array<double>, misses array<int>"


def deduplicated(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row per id; ts becomes a timestamp with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def binned_stream(stream: DataFrame, series: str, ts: str, value: str, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """series, start, v: the mean reading of each closed window, when the watermark has passed it. late: None if the stream
    has a watermark."""
    timed = stream if late is None else stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.col(series).alias("series"), F.window(ts, width).alias("w")).agg(F.avg(value).alias("v")).select("series", F.col("w.start").alias("start"), "v")


def adaptive(stream: DataFrame, alpha: float = 0.1, horizon: int = 1, gamma: float = 0.05, bounds: tuple[float, float] = LEVEL_BOUNDS, clip: float = 0.0) -> DataFrame:
    """stream: series, ts, split, low, high, y. Calibration rows fill the pool, whose size is the window; test rows get
    intervals."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        i, level, width, pool, scores, misses = state.get if state.exists else (0, alpha, 0, [], [], [])
        pool, waiting = list(pool), list(zip(scores, misses, strict=True))
        ranked = sorted(pool)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for split, low, high, y in rows[["split", "low", "high", "y"]].itertuples(index=False):
            score = max(low - y, y - high)
            if split == "calibration":
                pool.append(score)
                insort(ranked, score)
                width += 1
                continue
            if split != "test":
                continue
            if i >= horizon:
                s, m = waiting.pop(0)
                if len(pool) == width:
                    del ranked[bisect_left(ranked, pool.pop(0))]
                pool.append(s)
                insort(ranked, s)
                level = min(max(level + gamma * (alpha - m), bounds[0]), bounds[1])
            n = len(ranked)
            q = ranked[min(ceil((n + 1) * (1 - level)), n) - 1] if n else float("nan")
            waiting.append((score, 0 if low - q <= y <= high + q else 1))
            out.append((key[0], i, level, q, max(low - q, clip), high + q))
            i += 1
        state.update((i, level, width, pool, [s for s, _ in waiting], [m for _, m in waiting]))
        yield pd.DataFrame(out, columns=["series", "i", "alpha", "q", "lo", "hi"])

    return stream.select("series", "ts", "split", "low", "high", "y").groupBy("series").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark, rows: DataFrame, path: str, parts: int = 4, **how) -> DataFrame:
    """Writes rows (series, slot, split, low, high, y) as `parts` files by time, streams them through `adaptive` one file
    per micro-batch, and returns what the sink holds."""
    kept = rows.select("series", "slot", F.timestamp_seconds(F.col("slot") * 3600).alias("ts"), "split", "low", "high", "y")
    kept.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lo, hi = rows.agg(F.min("slot"), F.max("slot")).first()
    for k in range(parts):
        a, b = lo + (hi + 1 - lo) * k // parts, lo + (hi + 1 - lo) * (k + 1) // parts
        rows.filter((F.col("slot") >= a) & (F.col("slot") < b)).drop("slot").coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.drop("slot").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = adaptive(source, **how).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/out")


def closed_windows(spark, rows: DataFrame, path: str, series: str, ts: str, value: str, parts: int = 3, **how) -> DataFrame:
    """Writes rows as `parts` files by time, and streams them through deduplicated() and binned_stream(): series, start (whole
    seconds), v of the windows that the watermark has passed at the end."""
    if rows.schema[ts].dataType.simpleString() == "timestamp_ntz":  # a stream's time has a zone; readings' time has none
        rows = rows.withColumn(ts, F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)))
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lo, hi = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    for k in range(parts):
        a, b = lo + (hi + 1 - lo) * k // parts, lo + (hi + 1 - lo) * (k + 1) // parts
        rows.filter((F.unix_micros(ts) >= a) & (F.unix_micros(ts) < b)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    closed = binned_stream(deduplicated(source, ts=ts, **how), series, ts, value, late=None)
    query = closed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{path}/out").select("series", F.unix_seconds("start").alias("start"), "v")
