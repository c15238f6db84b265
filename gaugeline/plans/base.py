"""The panel that the reports use, as DataFrames and as SQL common table expressions.

Series are event types on an hourly grid; a reading is the mean value. The horizon is three slots, the target level 90
percent, and persistence the forecast unless a report fits something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_bucket, day_bucket_sql
from ..operators import features as ft
from ..operators import panel as pn
from ..sources.session import ship

ALPHA, HORIZON, LAGS, WIDTH, LIMIT, GAMMA = 0.1, 3, (1, 2, 3, 6), 6, 2, 0.05
FEATURES = [*(f"lag_{k}" for k in LAGS), "roll_mean", "roll_std", "tod_sin", "tod_cos"]
TRAIN, CAL = 10 / 18, 14 / 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles to some decimals, and no negative zero."""
    return df.select(*[(F.round(c, decimals) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def panel(spark: SparkSession, sf_dir: str, step: int = pn.HOUR, series: Column | None = None) -> DataFrame:
    cells = pn.binned(read(spark, sf_dir, "events"), F.col("event_type") if series is None else series, "ts", "value", step)
    return pn.interpolated(pn.dense(cells), LIMIT)


def featured(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Lags, rolling statistics, target, calendar, split and guards of a panel."""
    out = ft.calendar(ft.targets(ft.rolling(ft.lagged(df, LAGS), WIDTH), [horizon]))
    return ft.guards(ft.fractional_split(out, TRAIN, CAL), horizon)


def usable(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows without nulls that the guards let through; i numbers a series' rows in a split from 0."""
    full = df.filter("use").dropna(subset=["occ", f"y_{horizon}", *FEATURES]).withColumnRenamed(f"y_{horizon}", "y")
    hour = F.hour(pn.slot_time())
    w = Window.partitionBy("series", "split").orderBy("slot")
    keep = ["series", "slot", "occ", "y", "split", *FEATURES]
    return full.select(*keep, F.weekday(pn.slot_time()).alias("dow"), hour.alias("hour"), day_bucket(hour).alias("bucket"), (F.row_number().over(w) - 1).cast("long").alias("i"))


def rows(spark: SparkSession, sf_dir: str, horizon: int = HORIZON) -> DataFrame:
    return usable(featured(panel(spark, sf_dir), horizon), horizon)


def part(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def calibration(df: DataFrame, low: str = "occ", high: str = "occ") -> DataFrame:
    return part(df, "calibration").withColumn("score", F.greatest(F.col(low) - F.col("y"), F.col("y") - F.col(high)))


# SQL

_D = "CAST({} AS DOUBLE)"


def num(x: float) -> str:
    return _D.format(repr(float(x)))


def grained_sql(x: str) -> str:
    return f"floor({x} * 1024.0::DOUBLE + 0.5::DOUBLE) / 1024.0::DOUBLE"


def panel_sql(step: int = pn.HOUR, series: str = "event_type") -> str:
    return f"""
cells AS (SELECT {series} AS series, epoch_us(ts) // {step * 1_000_000} AS slot, {grained_sql('avg(value)')} AS v FROM events GROUP BY 1, 2),
span AS (SELECT series, min(slot) AS lo, max(slot) AS hi FROM cells GROUP BY series),
grid AS (SELECT series, unnest(generate_series(lo, hi)) AS slot FROM span),
dense AS (SELECT g.series, g.slot, c.v, c.v IS NOT NULL AS observed FROM grid g LEFT JOIN cells c ON g.series = c.series AND g.slot = c.slot),
around AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS ps,
    first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS ns
  FROM dense WINDOW b AS (PARTITION BY series ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY series ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
panel AS (SELECT series, slot, v, observed, CASE WHEN v IS NOT NULL THEN v
    WHEN pv IS NOT NULL AND nv IS NOT NULL AND slot - ps <= {LIMIT} THEN pv + (nv - pv) * (slot - ps) / (ns - ps) END AS occ FROM around)"""


def features_sql(horizon: int = HORIZON) -> str:
    lags = ", ".join(f"lag(occ, {k}) OVER w AS lag_{k}" for k in LAGS)
    return f"""
f AS (SELECT *, {lags}, CASE WHEN count(occ) OVER r = {WIDTH} THEN avg(occ) OVER r END AS roll_mean,
    CASE WHEN count(occ) OVER r = {WIDTH} THEN stddev_samp(occ) OVER r END AS roll_std,
    lead(occ, {horizon}) OVER w AS y_{horizon}, NOT coalesce(lead(observed, {horizon}) OVER w, false) AS y_interpolated_{horizon},
    sin(2 * pi() * ((slot % 24) * 60) / 1440) AS tod_sin, cos(2 * pi() * ((slot % 24) * 60) / 1440) AS tod_cos,
    CAST((slot // 24 + 3) % 7 AS INTEGER) AS dow, CAST(slot % 24 AS INTEGER) AS hour
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY slot), r AS (PARTITION BY series ORDER BY slot ROWS BETWEEN {WIDTH} PRECEDING AND 1 PRECEDING)),
ends AS (SELECT min(slot) AS first, min(slot) + (max(slot) - min(slot)) * {num(TRAIN)} AS te, min(slot) + (max(slot) - min(slot)) * {num(CAL)} AS ce FROM panel),
parts AS (SELECT f.*, te, ce, CASE WHEN slot <= te THEN 'train' WHEN slot <= ce THEN 'calibration' ELSE 'test' END AS split,
    CASE WHEN slot <= te THEN first - 24.0 WHEN slot <= ce THEN te ELSE ce END AS split_start FROM f, ends),
guarded AS (SELECT *, (CASE WHEN slot + {horizon} <= te THEN 'train' WHEN slot + {horizon} <= ce THEN 'calibration' ELSE 'test' END) = split AS split_ok,
    slot - split_start > {horizon} AS embargo_ok FROM parts)"""


def rows_sql(horizon: int = HORIZON, series: str = "event_type") -> str:
    full = " AND ".join(f"{c} IS NOT NULL" for c in ("occ", f"y_{horizon}", *FEATURES))
    return f"""{panel_sql(series=series)},{features_sql(horizon)},
fc AS (SELECT series, slot, occ, y_{horizon} AS y, split, {', '.join(FEATURES)}, dow, hour, {day_bucket_sql('hour')} AS bucket,
    row_number() OVER (PARTITION BY series, split ORDER BY slot) - 1 AS i FROM guarded WHERE split_ok AND embargo_ok AND {full})"""


def rank_sql(n: str, alpha: str) -> str:
    return f"CAST(least(ceil(({n} + 1) * (1 - {alpha})), {n}) AS BIGINT)"


def scores_sql(alpha: float = ALPHA, y: str = "y", lo: str = "lo", hi: str = "hi") -> str:
    return (
        f"count(*) AS n, avg(CASE WHEN {y} >= {lo} AND {y} <= {hi} THEN 1.0::DOUBLE ELSE 0 END) AS picp, avg({hi} - {lo}) AS mpiw, "
        f"avg(({hi} - {lo}) + {num(2 / alpha)} * CASE WHEN {y} < {lo} THEN {lo} - {y} WHEN {y} > {hi} THEN {y} - {hi} ELSE 0 END) AS winkler"
    )


def split_cp_sql(alpha: float = ALPHA) -> str:
    return f"""
q AS (SELECT series, sc[{rank_sql('len(sc)', num(alpha))}] AS q, len(sc) AS n_cal FROM (SELECT series, list_sort(list(abs(y - occ))) AS sc FROM fc WHERE split = 'calibration' GROUP BY series)),
cp AS (SELECT t.*, q, greatest(occ - q, 0) AS lo, occ + q AS hi FROM fc t JOIN q ON t.series = q.series WHERE split = 'test')"""


def fold_sql(steps: str, keys: str = "series", gamma: str = num(GAMMA), alpha: float = ALPHA, horizon: int = HORIZON) -> str:
    """A recursive expression `fold` over steps (keys, i, low, high, y, pool)."""
    on = " AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    row = f"{keys}, i, a, q, list_append(errs, CASE WHEN y >= low - q AND y <= high + q THEN 0 ELSE 1 END) AS errs"
    picked = f"*, pool[{rank_sql('len(pool)', 'a')}] AS q"
    return f"""
fold AS (
  SELECT {row} FROM (SELECT {picked} FROM (SELECT *, {num(alpha)} AS a, CAST([] AS INTEGER[]) AS errs FROM {steps} WHERE i = 0))
  UNION ALL
  SELECT {row} FROM (SELECT {picked} FROM (SELECT {ks}, s.i, s.low, s.high, s.y, s.pool, f.errs,
      CASE WHEN s.i >= {horizon} THEN greatest({num(1e-3)}, least({num(1 - 1e-3)}, f.a + {gamma} * ({num(alpha)} - f.errs[s.i - {horizon} + 1]))) ELSE f.a END AS a
    FROM fold f JOIN {steps} s ON {on} AND s.i = f.i + 1)))"""


def steps_sql(source: str, low: str, high: str, name: str = "steps", horizon: int = HORIZON) -> str:
    """Steps of the test rows of `source` with the score pool that each may see."""
    score = f"greatest({low} - y, y - {high})"
    return f"""
nc AS (SELECT series, count(*) AS w FROM {source} WHERE split = 'calibration' GROUP BY series),
seq AS (SELECT s.series, CASE WHEN split = 'test' THEN w + i + 1 ELSE i + 1 END AS r, {score} AS sc FROM {source} s JOIN nc ON s.series = nc.series WHERE split <> 'train'),
pools AS (SELECT t.series, t.i, list_sort(list(sc)) AS pool FROM {source} t JOIN nc ON t.series = nc.series JOIN seq a ON a.series = t.series
    AND a.r > greatest(t.i - {horizon} + 1, 0) AND a.r <= w + greatest(t.i - {horizon} + 1, 0) WHERE t.split = 'test' GROUP BY t.series, t.i),
{name} AS (SELECT t.series, t.i, {low} AS low, {high} AS high, y, pool FROM {source} t JOIN pools p ON t.series = p.series AND t.i = p.i WHERE t.split = 'test')"""


def band_sql(alpha: float = ALPHA) -> str:
    """`band`: fc with quantile bands of train changes by bucket, uncrossed."""
    cut = lambda p: f"quantile_cont(y - occ, {num(p)})"
    return f"""
own AS (SELECT series, bucket, {cut(alpha / 2)} AS a, {cut(1 - alpha / 2)} AS b FROM fc WHERE split = 'train' GROUP BY series, bucket),
every AS (SELECT series, {cut(alpha / 2)} AS a, {cut(1 - alpha / 2)} AS b FROM fc WHERE split = 'train' GROUP BY series),
band AS (SELECT t.*, occ + coalesce(o.a, e.a) AS low, occ + coalesce(o.b, e.b) AS high FROM fc t LEFT JOIN own o ON t.series = o.series AND t.bucket = o.bucket JOIN every e ON t.series = e.series)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(p.strip() for p in parts) + "\n"


def rounded_sql(sql: str, columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in columns.split())}) FROM ({sql})"
