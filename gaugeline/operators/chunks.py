"""Chunks of a stream and ensemble intervals that learn from chunks whose outcomes have come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_chunks(df: DataFrame, day, *keys: str, order: str = "i") -> DataFrame:
    """chunk_start and chunk_end (exclusive) of each day of a series, in positions of the stream."""
    return df.withColumn("chunk", day).groupBy(*keys, "chunk").agg(F.min(order).alias("chunk_start"), (F.max(order) + 1).alias("chunk_end"))


def row_chunks(df: DataFrame, size: int, order: str = "i") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(order) / size))


def matured(chunks: DataFrame, horizon: int, *keys: str, n: str = "n") -> DataFrame:
    """released: how many outcomes are known when a chunk has ended. A forecast of step i is resolved at i + horizon;
    rows held back come with a later chunk."""
    if horizon < 1:
        raise ValueError("horizon must be 1 at least")
    w = Window.partitionBy(*keys).orderBy("chunk_end").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("released", F.least(F.col(n), F.greatest(F.lit(0), F.max(F.col("chunk_end") - horizon + 1).over(w))))


def matured_end(chunk_end: int, horizon: int, released: int, n: int) -> int:
    return min(n, max(released, chunk_end - horizon + 1))


def ensemble_intervals(df: DataFrame, features: list[str], y: str, value: str, day: str, *keys: str, alpha: float = 0.1, horizon: int = 1, members: int = 30, blocks: int = 10, seed: int = 42, trees: int = 5, depth: float = 6) -> DataFrame:
    """Ensemble batch prediction intervals (Xu and Xie): forests on bootstrapped blocks of the train and calibration rows;
    a row's residual is that of the members that didn't see it; test days get the interval of the last residuals, whose
    width is the least over splits of alpha, and the residuals move on by outcomes that have matured."""

    def run(pdf):
        import numpy as np

        from .forecast import forest

        pdf = pdf.sort_values("i")
        fit, test = pdf[pdf["split"] != "test"], pdf[pdf["split"] == "test"].copy()
        x, t = fit[features].to_numpy(float), (fit[y] - fit[value]).to_numpy(float)
        rng = np.random.default_rng(seed)
        parts = np.array_split(np.arange(len(t)), blocks)
        preds, seen, ahead = np.zeros((members, len(t))), np.zeros((members, len(t)), bool), np.zeros((members, len(test)))
        for m in range(members):
            rows = np.concatenate([parts[k] for k in rng.integers(0, blocks, blocks)])
            seen[m, rows] = True
            model = forest(x[rows], t[rows], trees=trees, depth=depth, seed=seed + m)
            preds[m] = model(x)
            if len(test):
                ahead[m] = model(test[features].to_numpy(float))
        out = ~seen
        held = np.where(out.any(0), (preds * out).sum(0) / np.maximum(1, out.sum(0)), preds.mean(0))
        residuals = list(t - held)
        window, centre = len(residuals), ahead.mean(0)
        actual = (test[y] - test[value]).to_numpy(float)
        lo, hi = np.full(len(test), np.nan), np.full(len(test), np.nan)
        released = start = 0
        betas = np.linspace(0, alpha, 11)
        for _, chunk in test.groupby(test[day], sort=True):
            end = start + len(chunk)
            last = np.asarray(residuals[-window:])
            low, high = np.quantile(last, betas), np.quantile(last, 1 - alpha + betas)
            k = int(np.argmin(high - low))
            lo[start:end], hi[start:end] = centre[start:end] + low[k], centre[start:end] + high[k]
            upto = matured_end(end, horizon, released, len(test))
            residuals += list(actual[released:upto] - centre[released:upto])
            released, start = upto, end
        test["lo"], test["hi"] = test[value].to_numpy(float) + lo, test[value].to_numpy(float) + hi
        return test[[*keys, "i", y, "lo", "hi"]]

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in (*keys, "i", y))
    rows = df.select(*dict.fromkeys([*keys, "i", y, value, day, "split", *features]))
    # fits are long where rows are few: series go to tasks of their own, which a fixed number of partitions keeps apart
    return rows.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys).groupBy(*keys).applyInPandas(run, f"{types}, lo double, hi double")
