"""Adaptive conformal streams with delayed feedback.

A forecast issued at step i is resolved at step i + h, when its score enters the pool and its miss moves the level. Scores
depend on outcomes and centres only, so levels that differ in their rate share one pool. Rows are dealt out by series and
sorted by step; a worker goes through them batch by batch and carries a series' state on: the window of scores, sorted,
the levels, and the feedback that hasn't matured. So a step costs a search in the window, and memory is the window,
however long a series is. Series are independent tasks.

The rules are also written as one fold over arrays in the JVM (`engine="fold"`), which copies its history per step: the
plainest form of them, for short series, and what tests hold the other engine against.

Rows without a score, an end or an outcome take no part; a series without calibration rows gives none; steps with equal
numbers are ordered by their values.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LEVEL_BOUNDS, band_score, conformal_rank, d, pinball, projected

GAMMAS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)
_OUT = "array<struct<i:bigint,alpha:double,q:double,miss:int>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def gathered(cal: DataFrame, test: DataFrame, *keys: str, low: str, high: str, y: str = "y", order: str = "i") -> DataFrame:
    """One row per series: cal (scores in order) and test (steps in order)."""
    step = F.struct(F.col(order).cast("long").alias("i"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(y).alias("y"))
    c = cal.filter("score is not null").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("score")))), lambda s: s["score"]).alias("cal"))
    t = test.dropna(subset=[low, high, y]).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("test"))
    return c.join(t, list(keys))


def _moved(a: Column, gamma: Column, alpha: float, miss: Column, bounds) -> Column:
    return projected(a + gamma * (d(alpha) - miss), bounds)


def folded(cal: Column, test: Column, alpha: float, horizon: int, gamma: Column, window: Column | None = None, bounds=LEVEL_BOUNDS) -> Column:
    """array<struct<i, alpha, q, miss>> for the steps of one series."""
    scores = F.transform(test, lambda t: band_score(t["y"], t["low"], t["high"]))
    every = F.concat(cal, scores)
    width = F.size(cal) if window is None else window

    def step(acc: Column, t: Column) -> Column:
        n = F.size(acc["out"])
        old = F.get(acc["out"], n - horizon)["miss"]
        a = F.when(n >= horizon, _moved(acc["a"], gamma, alpha, old, bounds)).otherwise(acc["a"])
        have = F.size(acc["cal"]) + F.greatest(n - horizon + 1, F.lit(0))
        start = F.greatest(have - acc["width"], F.lit(0))
        pool = F.array_sort(F.slice(acc["every"], start + 1, have - start))

        def emit(v: Column) -> Column:
            q = F.get(v["pool"], conformal_rank(F.size(v["pool"]), v["a"]) - 1)
            miss = lambda x: F.when((t["y"] >= t["low"] - x) & (t["y"] <= t["high"] + x), 0).otherwise(1)
            row = _let(q, lambda x: F.struct(t["i"].alias("i"), v["a"].alias("alpha"), x.alias("q"), miss(x).alias("miss")))
            return F.struct(v["a"].alias("a"), acc["cal"].alias("cal"), acc["every"].alias("every"), acc["width"].alias("width"), F.concat(acc["out"], F.array(row)).alias("out"))

        return _let(F.struct(a.alias("a"), pool.alias("pool")), emit)

    zero = F.struct(d(alpha).alias("a"), cal.alias("cal"), every.alias("every"), width.alias("width"), F.array().cast(_OUT).alias("out"))
    return F.aggregate(test, zero, step, lambda acc: acc["out"])


def _opened(rows: DataFrame, keys, out: str, clip: float | None) -> DataFrame:
    return _clipped(rows.select(*keys, F.explode(F.arrays_zip("test", out)).alias("z")).select(*keys, "z.test.*", f"z.{out}.alpha", f"z.{out}.q"), clip)


class _Pool:
    """A group's scores: the last ones in order of arrival and sorted, and the levels."""

    def __init__(self, scores: list[float], width: int, levels: list[float]) -> None:
        self.kept, self.levels = deque(scores[-width:] if width else (), maxlen=width), levels
        self.ranked = sorted(self.kept)

    def add(self, score: float) -> None:
        if len(self.kept) == self.kept.maxlen:
            if not self.kept:
                return
            del self.ranked[bisect_left(self.ranked, self.kept[0])]
        self.kept.append(score)
        insort(self.ranked, score)


class Replay:
    """One series by the rules. opening: (group, score) of its calibration rows, in order."""

    def __init__(self, opening: list[tuple], gammas: list[float], alpha: float, horizon: int, window=None, bounds=LEVEL_BOUNDS, least: int = 0) -> None:
        self.every, self.own = [s for _, s in opening], {}
        for g, s in opening:
            self.own.setdefault(g, []).append(s)
        self.gammas, self.alpha, self.horizon, self.window, self.bounds, self.least = gammas, alpha, horizon, window, bounds, least
        self.pools: dict = {}
        self.waiting: deque = deque()

    def _pool(self, group) -> _Pool:
        if group not in self.pools:
            scores = self.own.get(group, [])
            scores = scores + self.every if len(scores) < self.least else scores
            n = len(scores)
            self.pools[group] = _Pool(scores, self.window(n) if callable(self.window) else self.window or n, [self.alpha] * len(self.gammas))
        return self.pools[group]

    def step(self, low: float, high: float, y: float, group=None) -> list[tuple[float, float | None]]:
        """(level, margin) per gamma."""
        if len(self.waiting) >= self.horizon:
            where, score, misses = self.waiting.popleft()
            pool = self._pool(where)
            pool.add(score)
            moved = [a + g * (self.alpha - m) for a, g, m in zip(pool.levels, self.gammas, misses, strict=True)]
            pool.levels = moved if self.bounds is None else [min(max(a, self.bounds[0]), self.bounds[1]) for a in moved]
        pool = self._pool(group)
        n, out = len(pool.ranked), []
        for a in pool.levels:
            rank = min(ceil((n + 1) * (1 - a)), n)
            out.append((a, pool.ranked[rank - 1] if rank > 0 else None))
        misses = [0 if q is not None and low - q <= y <= high + q else 1 for _, q in out]
        self.waiting.append((group, max(low - y, y - high), misses))
        return out


def replayed(cal: DataFrame, test: DataFrame, *keys: str, low: str, high: str, gammas: tuple | Column, alpha: float | Column, horizon: int, window: int | Callable[[int], int] | None = None, bounds=LEVEL_BOUNDS, group: str | None = None, least: int = 0, y: str = "y", order: str = "i") -> DataFrame:
    """keys, __group, i, low, high, y, __rate (gamma), alpha, q: a row per test row and gamma. gammas: a grid, or a column of
    test rows with the one gamma of their series; alpha may be such a column too."""
    one, every = isinstance(gammas, Column), not isinstance(alpha, Column)
    grid, nominal = None if one else list(gammas), alpha if every else None
    of = (lambda df: F.col(group)) if group else (lambda df: F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    at = F.col(order).cast("long").alias("__i")
    c = cal.select(*keys, F.lit(0).alias("__phase"), at, F.col("score").cast("double").alias("__score"), *[none.alias(x) for x in ("__low", "__high", "__y")], of(cal).alias("__group"), none.alias("__gamma"), none.alias("__alpha")).filter("__score is not null")
    t = test.select(*keys, F.lit(1).alias("__phase"), at, none.alias("__score"), *[F.col(x).cast("double").alias(n) for x, n in ((low, "__low"), (high, "__high"), (y, "__y"))], of(test).alias("__group"), (gammas if one else none).alias("__gamma"), (none if every else alpha).alias("__alpha")).dropna(subset=["__low", "__high", "__y"])
    rows = c.unionByName(t)
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "__phase", "__i", "__score", "__low", "__high", "__y", "__group")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (", " if keys else "") + f"__group {types['__group']}, i long, low double, high double, y double, __rate double, alpha double, q double"
    k = len(keys)

    def run(batches):
        import pyarrow as pa

        current, opening, series = None, [], None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in [*keys, "__group"]]
            out: list[list] = [[] for _ in range(k + 8)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phase, i, score, low_, high_, y_, where, gamma, a0 = row[k:]
                if row[:k] != current or current is None:
                    current, opening, series = row[:k], [], None
                if phase == 0:
                    opening.append((where, score))
                    continue
                if not opening:
                    continue
                if series is None:
                    series = Replay(opening, grid or [gamma], a0 if nominal is None else nominal, horizon, window, bounds, least)
                for g, (a, q) in zip(series.gammas, series.step(low_, high_, y_, where), strict=True):
                    for column, value in zip(out, (*row[:k], where, i, low_, high_, y_, g, a, q), strict=True):
                        column.append(value)
            if out[-1]:
                types = [*kinds, pa.int64(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*keys, "__group", "i", "low", "high", "y", "__rate", "alpha", "q"])

    return rows.mapInArrow(run, schema)


def _clipped(flat: DataFrame, clip: float | None) -> DataFrame:
    lo = F.col("low") - F.col("q")
    return flat.withColumn("lo", lo if clip is None else F.greatest(lo, d(clip))).withColumn("hi", F.col("high") + F.col("q"))


def stream(cal: DataFrame, test: DataFrame, *keys: str, low: str, high: str, alpha: float | Column = 0.1, horizon: int = 1, gamma: float | Column = 0.05, window: int | Callable[[int], int] | None = None, bounds=LEVEL_BOUNDS, clip: float | None = 0.0, y: str = "y", order: str = "i", engine: str = "sorted") -> DataFrame:
    """keys, i, low, high, y, alpha, q, lo, hi. cal has a column score; gamma may be a column of the keys; the window may
    follow from the number of calibration rows (with the sorted engine)."""
    if engine == "fold":
        rows = gathered(cal, test, *keys, low=low, high=high, y=y, order=order)
        g = gamma if isinstance(gamma, Column) else d(gamma)
        return _opened(rows.withColumn("out", folded(F.col("cal"), F.col("test"), alpha, horizon, g, None if window is None else F.lit(window), bounds)), keys, "out", clip)
    found = replayed(cal, test, *keys, low=low, high=high, gammas=gamma if isinstance(gamma, Column) else (gamma,), alpha=alpha, horizon=horizon, window=window, bounds=bounds, y=y, order=order)
    return _clipped(found.select(*keys, "i", "low", "high", "y", "alpha", "q"), clip)


def chosen_gamma(cal: DataFrame, *keys: str, low: str, high: str, alpha: float | Column = 0.1, horizon: int = 1, grid: tuple = GAMMAS, share: float = 0.5, y: str = "y", order: str = "i") -> DataFrame:
    """gamma per series, chosen within the calibration rows: the first part opens the pool, the rest is replayed for each
    gamma; the nearest coverage wins, then the lower interval score, then the smaller gamma. Short series get the middle
    of the grid. cal has a column score; alpha may be one of the keys."""
    from .metrics import scores

    every = Window.partitionBy(*keys)
    rows = cal.withColumn("__n", F.count("*").over(every)).withColumn("__cut", F.floor(F.col("__n") * d(share)))
    short = (F.col("__cut") < 30) | (F.col("__n") - F.col("__cut") < max(50, 10 * horizon))
    rows = rows.withColumn("__short", short).withColumn("__at", F.row_number().over(every.orderBy(order, "score", low, high, y)))
    first = F.col("__at") <= F.col("__cut")
    flat = replayed(rows.filter(~F.col("__short") & first), rows.filter(~F.col("__short") & ~first), *keys, low=low, high=high, gammas=grid, alpha=alpha, horizon=horizon, y=y, order=order)
    level = 1 - alpha if isinstance(alpha, Column) else d(1 - alpha)
    scored = _clipped(flat.withColumnRenamed("__rate", "gamma"), None).groupBy(*keys, "gamma").agg(*scores(alpha))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("gamma", "picp", "winkler"), F.struct(F.round(F.abs(F.col("picp") - level), 12).alias("a"), F.round("winkler", 9).alias("w"), "gamma")).alias("b"))
    picked = best.select(*keys, F.col("b.gamma").alias("gamma"), F.col("b.picp").alias("cal_picp"), F.col("b.winkler").alias("cal_winkler"))
    none = F.lit(None).cast("double")
    return picked.unionByName(rows.filter("__short").select(*keys).distinct().select(*keys, d(grid[len(grid) // 2]).alias("gamma"), none.alias("cal_picp"), none.alias("cal_winkler")))


def grouped_stream(cal: DataFrame, test: DataFrame, group: str, *keys: str, low: str, high: str, alpha: float = 0.1, horizon: int = 1, gamma: float = 0.05, least: int = 50, bounds=LEVEL_BOUNDS, clip: float | None = 0.0, y: str = "y", order: str = "i") -> DataFrame:
    """A level and a pool per group of a series; feedback returns to the group that issued it, h steps of the whole series
    later. A group with fewer than `least` scores opens with its own and all of the series'; its window is its opening
    size."""
    found = replayed(cal, test, *keys, low=low, high=high, gammas=(gamma,), alpha=alpha, horizon=horizon, bounds=bounds, group=group, least=least, y=y, order=order)
    return _clipped(found.select(*keys, "i", "low", "high", "y", F.col("__group").alias(group), "alpha", "q"), clip)


def aggregated_experts(cal: DataFrame, test: DataFrame, *keys: str, low: str, high: str, alpha: float = 0.1, horizon: int = 1, eta: float = 0.01, gammas: tuple = GAMMAS, y: str = "y", order: str = "i") -> DataFrame:
    """Exponentially weighted streams, one per gamma, with weights of their own for each end: keys, i, y, lo, hi. The loss
    of step j first weighs at step j + h. After the streams it's windows only."""
    flat = _clipped(replayed(cal, test, *keys, low=low, high=high, gammas=gammas, alpha=alpha, horizon=horizon, y=y, order=order).withColumnRenamed("__rate", "gamma"), None)
    before = Window.partitionBy(*keys, "gamma").orderBy("i").rowsBetween(Window.unboundedPreceding, -horizon)
    for end, tau in (("lo", alpha / 2), ("hi", 1 - alpha / 2)):
        flat = flat.withColumn(f"loss_{end}", F.coalesce(F.sum(pinball(F.col("y"), F.col(end), tau)).over(before), d(0)))
    at = Window.partitionBy(*keys, "i")
    for end in ("lo", "hi"):
        flat = flat.withColumn(f"w_{end}", F.exp(-d(eta) * (F.col(f"loss_{end}") - F.min(f"loss_{end}").over(at))))
    for end in ("lo", "hi"):  # means are taken from the least: experts that agree give just what they say
        flat = flat.withColumn(f"least_{end}", F.min(end).over(at))
    mean = lambda e: F.first(f"least_{e}") + F.sum(F.col(f"w_{e}") * (F.col(e) - F.col(f"least_{e}"))) / F.sum(f"w_{e}")
    return flat.groupBy(*keys, "i").agg(F.first("y").alias("y"), mean("lo").alias("lo"), mean("hi").alias("hi"))
