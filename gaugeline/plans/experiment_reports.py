"""Whole experiments: every method at every horizon and level, contrasts between methods, conditional and orthogonal
partitions of the same intervals, rolling origins, allocation over seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import conformal_quantile, d
from ..operators import adaptive as ad
from ..operators import conformal as cf
from ..operators import decisions as dc
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import inference as inf
from ..operators import metrics as mt
from ..operators import partitions as pt
from . import base as b
from .interval_reports import _GROUPED, _GROUPED_FOLD, _MONDRIAN, folds, mondrian, split_cp
from .interval_reports import _AT, _FOLDS, _RATES
from .panel_reports import ORACLES, report
from .summary_reports import _CONTRAST, _SITES, _contrast_sql, _holm_sql, _outcome_sql, sites

HORIZONS, MISSES, BAND_MISSES = (1, 3, 6), (0.2, 0.15, 0.1, 0.05), (0.1, 0.05)


def union(tables):
    return reduce(lambda x, y: x.unionByName(y), tables)


def core(rows, horizon: int, misses=MISSES, band_misses=BAND_MISSES, keys: tuple = ("series",)):
    """Intervals of four methods at several levels: keys, method, rule (how gamma was set), miss, i, y, lo, hi. Levels are keys
    of the streams, so a series' levels are replayed side by side."""
    spread = lambda x, m: x.withColumn("miss", F.explode(F.array(*map(d, m))))
    bands = union([cf.uncrossed(fc.quantile_band(rows, "y", "occ", "bucket", a, *keys), "low", "high").withColumn("miss", d(a)) for a in band_misses])
    plain = spread(rows.withColumn("low", F.col("occ")).withColumn("high", F.col("occ")), misses)
    on = [*keys, "base", "miss"]
    source = union([x.filter("split <> 'train'").withColumn("base", F.lit(m)).select(*on, "split", "i", "y", "low", "high") for m, x in (("aci", plain), ("acqr", bands))])
    cal, test = b.calibration(source, "low", "high"), b.part(source, "test")
    q = cal.groupBy(*on).agg(F.collect_list("score").alias("s")).select(*on, conformal_quantile(F.col("s"), F.col("miss")).alias("q"))
    still = cf.banded(test, q, "low", "high", *on).withColumn("rule", F.lit(None).cast("string")).withColumn("method", F.when(F.col("base") == "aci", "split_cp").otherwise("cqr"))
    gamma = ad.chosen_gamma(cal, *on, low="low", high="high", alpha=F.col("miss"), horizon=horizon).select(*on, "gamma")
    both = F.inline(F.array(F.struct(F.lit("calibrated").alias("rule"), F.col("gamma")), F.struct(F.lit("fixed").alias("rule"), d(b.GAMMA).alias("gamma"))))
    rates = gamma.select(*on, both)
    moved = ad.stream(cal.join(rates.drop("gamma"), on), test.join(rates, on), *on, "rule", low="low", high="high", alpha=F.col("miss"), horizon=horizon, gamma=F.col("gamma"))
    return union([x.select(*keys, "method", "rule", "miss", "i", "y", "lo", "hi") for x in (still, moved.withColumn("method", F.col("base")))])


def _fold(name: str, steps: str, keys: str, horizon: int) -> str:
    """b.fold_sql for steps that carry their level (miss) and rate (gamma)."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM f.{k}" for k in ks)
    row = f"{keys}, i, a, q, list_append(errs, CASE WHEN y >= low - q AND y <= high + q THEN 0 ELSE 1 END) AS errs"
    picked = f"*, pool[{b.rank_sql('len(pool)', 'a')}] AS q"
    return f"""{name} AS (
  SELECT {row} FROM (SELECT {picked} FROM (SELECT *, miss AS a, CAST([] AS INTEGER[]) AS errs FROM {steps} WHERE i = 0))
  UNION ALL
  SELECT {row} FROM (SELECT {picked} FROM (SELECT {', '.join(f's.{k}' for k in ks)}, s.i, s.low, s.high, s.y, s.pool, f.errs,
      CASE WHEN s.i >= {horizon} THEN greatest({b.num(1e-3)}, least({b.num(1 - 1e-3)}, f.a + s.gamma * (s.miss - f.errs[s.i - {horizon} + 1]))) ELSE f.a END AS a
    FROM {name} f JOIN {steps} s ON {on} AND s.i = f.i + 1)))"""


def _pools(prefix: str, source: str, keys: str, horizon: int) -> str:
    """`{prefix}pool`: the scores that each test row of a source (keys, split, i, low, high, y) may see."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in ks)
    of = lambda x: ", ".join(f"{x}.{k}" for k in ks)
    return f"""{prefix}nc AS (SELECT {keys}, count(*) AS w FROM {source} WHERE split = 'calibration' GROUP BY ALL),
{prefix}seq AS (SELECT {of('s')}, CASE WHEN split = 'test' THEN w + i + 1 ELSE i + 1 END AS r, greatest(low - y, y - high) AS sc FROM {source} s JOIN {prefix}nc c ON {on('s', 'c')}),
{prefix}pool AS (SELECT {of('t')}, t.i, list_sort(list(sc)) AS pool FROM {source} t JOIN {prefix}nc c ON {on('t', 'c')} JOIN {prefix}seq a ON {on('t', 'a')} AND a.r > greatest(t.i - {horizon} + 1, 0) AND a.r <= w + greatest(t.i - {horizon} + 1, 0) WHERE t.split = 'test' GROUP BY ALL)"""


def _scores(miss: str = "miss") -> str:
    return f"count(*) AS n, avg(CASE WHEN y >= lo AND y <= hi THEN 1.0::DOUBLE ELSE 0 END) AS picp, avg(hi - lo) AS mpiw, avg((hi - lo) + 2 / {miss} * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END) AS winkler"


def core_sql(horizon: int, misses=MISSES, band_misses=BAND_MISSES, rows: str | None = None, keys: str = "series") -> str:
    """A query of the columns of core(). rows: CTEs up to `fc`."""
    on = lambda x, y, more="": " AND ".join(f"{x}.{k.strip()} = {y}.{k.strip()}" for k in (keys + more).split(","))
    of = lambda x, more="": ", ".join(f"{x}.{k.strip()}" for k in (keys + more).split(","))
    grid = ", ".join(b.num(g) for g in ad.GAMMAS)
    full = f"base, miss, {keys}"
    cut = lambda p: f"quantile_cont(y - occ, {b.num(p)})"
    bands = " UNION ALL ".join(
        f"SELECT 'acqr' AS base, {b.num(a)} AS miss, {of('t')}, t.split, t.i, t.y, occ + coalesce(o.a, e.a) AS low, occ + coalesce(o.z, e.z) AS high FROM fc t LEFT JOIN (SELECT {keys}, bucket, {cut(a / 2)} AS a, {cut(1 - a / 2)} AS z FROM fc WHERE split = 'train' GROUP BY ALL) o ON {on('t', 'o')} AND t.bucket = o.bucket JOIN (SELECT {keys}, {cut(a / 2)} AS a, {cut(1 - a / 2)} AS z FROM fc WHERE split = 'train' GROUP BY ALL) e ON {on('t', 'e')} WHERE t.split <> 'train'"
        for a in band_misses
    )
    least = max(50, 10 * horizon)
    same = lambda x, y: f"{x}.base = {y}.base AND {x}.miss = {y}.miss AND {on(x, y)}"
    return f"""WITH RECURSIVE {rows or b.rows_sql(horizon)},
src AS (SELECT 'aci' AS base, miss, {keys}, split, i, y, occ AS low, occ AS high FROM fc, (SELECT unnest([{', '.join(b.num(m) for m in misses)}]) AS miss) WHERE split <> 'train' UNION ALL {bands}),
cm AS (SELECT {full}, list_sort(list(greatest(low - y, y - high))) AS sc FROM src WHERE split = 'calibration' GROUP BY ALL),
st AS (SELECT s.*, sc[{b.rank_sql('len(sc)', 's.miss')}] AS q FROM src s JOIN cm ON {same('s', 'cm')} WHERE split = 'test'),
cal AS (SELECT *, count(*) OVER (PARTITION BY {full}) AS n, CAST(floor(count(*) OVER (PARTITION BY {full}) * 0.5) AS BIGINT) AS cut FROM src WHERE split = 'calibration'),
half AS (SELECT {full}, y, low, high, CASE WHEN i < cut THEN 'calibration' ELSE 'test' END AS split, CASE WHEN i < cut THEN i ELSE i - cut END AS i FROM cal WHERE cut >= 30 AND n - cut >= {least}),
{_pools('h', 'half', full, horizon)},
hs AS (SELECT h.*, pool, gamma FROM half h JOIN hpool p ON {same('h', 'p')} AND h.i = p.i, (SELECT unnest([{grid}]) AS gamma) WHERE split = 'test'),
{_fold('hf', 'hs', full + ', gamma', horizon)},
hi_ AS (SELECT h.base, h.miss, {of('h')}, h.gamma, h.y, low - q AS lo, high + q AS hi FROM hf f JOIN hs h ON {same('f', 'h')} AND f.gamma = h.gamma AND f.i = h.i),
hm AS (SELECT {full}, gamma, {_scores()} FROM hi_ GROUP BY ALL),
gm AS (SELECT {full}, gamma FROM (SELECT *, row_number() OVER (PARTITION BY {full} ORDER BY round(abs(picp - (1 - miss)), 12), round(winkler, 9), gamma) AS k FROM hm) WHERE k = 1 UNION ALL SELECT DISTINCT {full}, {b.num(ad.GAMMAS[len(ad.GAMMAS) // 2])} FROM cal WHERE NOT (cut >= 30 AND n - cut >= {least})),
rt AS (SELECT *, 'calibrated' AS rule FROM gm UNION ALL SELECT {full}, {b.num(b.GAMMA)}, 'fixed' FROM gm),
{_pools('m', 'src', full, horizon)},
ms AS (SELECT s.*, pool, gamma, rule FROM src s JOIN mpool p ON {same('s', 'p')} AND s.i = p.i JOIN rt r ON {same('s', 'r')} WHERE split = 'test'),
{_fold('mf', 'ms', full + ', rule', horizon)}
SELECT CASE base WHEN 'aci' THEN 'split_cp' ELSE 'cqr' END AS method, NULL::VARCHAR AS rule, miss, {keys}, i, y, greatest(low - q, 0) AS lo, high + q AS hi FROM st
UNION ALL SELECT s.base, s.rule, s.miss, {of('s')}, s.i, s.y, greatest(low - q, 0), high + q FROM mf f JOIN ms s ON {same('f', 's')} AND f.rule = s.rule AND f.i = s.i"""


_M = "picp mpiw winkler"


@report(" UNION ALL ".join(f"SELECT {h} AS horizon, method, rule, miss, series, {_scores()} FROM ({core_sql(h)}) GROUP BY method, rule, miss, series" for h in HORIZONS), f"miss {_M}")
def core_run(spark, sf_dir):
    """Four methods, three horizons, all levels, gamma fixed and calibrated."""
    out = [core(b.rows(spark, sf_dir, h), h).withColumn("horizon", F.lit(h)) for h in HORIZONS]
    return union(out).groupBy("horizon", "method", "rule", "miss", "series").agg(*mt.scores(F.col("miss")))


_PAIRS = [("aci", "split_cp"), ("aci", "cqr"), ("acqr", "cqr"), ("acqr", "split_cp")]
_ONE = core_sql(b.HORIZON, (b.ALPHA,), (b.ALPHA,))


def _one(spark, sf_dir):
    """The four methods at the report's level and horizon, with fixed gamma."""
    return core(b.rows(spark, sf_dir), b.HORIZON, (b.ALPHA,), (b.ALPHA,)).filter("rule is null or rule = 'fixed'")


_UNITS = f"cz AS (SELECT method AS arm, series AS entity, {_scores()} FROM ({_ONE}) WHERE rule IS NULL OR rule = 'fixed' GROUP BY 1, 2), unit AS (SELECT 'D' AS family, arm, entity, abs(picp - 0.9::DOUBLE) AS v FROM cz UNION ALL SELECT 'E', arm, entity, winkler FROM cz)"


@report(b.with_(_contrast_sql(_UNITS, _PAIRS).replace("HP", "wilcoxon_p"), recursive=True) + _holm_sql("wilcoxon_p"), _CONTRAST)
def method_contrasts(spark, sf_dir):
    """Distance from the level (D) and interval score (E) of methods, paired by series, with signed ranks adjusted within a
    family."""
    cells = mt.scored(_one(spark, sf_dir), b.ALPHA, "method", "series").withColumn("gap", F.abs(F.col("picp") - d(0.9)))
    both = F.inline(F.array(F.struct(F.lit("D").alias("family"), F.col("gap").alias("v")), F.struct(F.lit("E").alias("family"), F.col("winkler").alias("v"))))
    return inf.holm(inf.contrasts(cells.select("method", "series", both), "v", "method", _PAIRS, "series", "family"), "wilcoxon_p", "family", large=False)


_FIVE = [*_PAIRS, ("acqr", "aci")]
_EVERY = " UNION ALL ".join(f"SELECT {h} AS horizon, * FROM ({core_sql(h, (b.ALPHA,), (b.ALPHA,))})" for h in HORIZONS)
_UNITS_3 = f"cz AS (SELECT horizon, method AS arm, series AS entity, {_scores()} FROM ({_EVERY}) WHERE rule IS NULL OR rule = 'fixed' GROUP BY 1, 2, 3), unit AS (SELECT 'coverage' AS family, horizon, arm, entity, abs(picp - 0.9::DOUBLE) AS v FROM cz UNION ALL SELECT 'score', horizon, arm, entity, winkler FROM cz)"


@report(b.with_(_contrast_sql(_UNITS_3, _FIVE, "family, horizon").replace("HP", "wilcoxon_p"), recursive=True) + _holm_sql("wilcoxon_p", "family, horizon"), _CONTRAST)
def paired_tests(spark, sf_dir):
    """Five pairs of methods, two metrics, every horizon."""
    rows = union([core(b.rows(spark, sf_dir, h), h, (b.ALPHA,), (b.ALPHA,)).withColumn("horizon", F.lit(h)) for h in HORIZONS])
    cells = mt.scored(rows.filter("rule is null or rule = 'fixed'"), b.ALPHA, "horizon", "method", "series")
    both = F.inline(F.array(F.struct(F.lit("coverage").alias("family"), F.abs(F.col("picp") - d(0.9)).alias("v")), F.struct(F.lit("score").alias("family"), F.col("winkler").alias("v"))))
    return inf.holm(inf.contrasts(cells.select("horizon", "method", "series", both), "v", "method", _FIVE, "series", "family", "horizon"), "wilcoxon_p", "family", "horizon", large=False)


@report(
    f"WITH c AS (SELECT method, series, {_scores()} FROM ({_ONE}) WHERE rule IS NULL OR rule = 'fixed' GROUP BY 1, 2) SELECT method, count(*) AS n_entities, sum(picp * n) / sum(n) AS pooled_picp, avg(picp) AS mean_picp, stddev_samp(picp) AS sd_picp, min(picp) AS worst_picp, arg_min(series, struct_pack(p := picp, s := series)) AS worst_entity, avg(CAST(abs(picp - 0.9::DOUBLE) <= 0.02 AS DOUBLE)) AS share_near, count(*) FILTER (WHERE picp < 0.8) AS n_below_80, count(*) FILTER (WHERE picp < 0.85) AS n_below_85, avg(CAST(picp >= 0.88 AS DOUBLE)) AS share_safe, avg(mpiw) AS mean_mpiw, avg(winkler) AS mean_winkler FROM c GROUP BY method",
    "pooled_picp mean_picp sd_picp worst_picp share_near share_safe mean_mpiw mean_winkler",
)
def population_table(spark, sf_dir):
    return mt.across(mt.scored(_one(spark, sf_dir), b.ALPHA, "method", "series"), "method")


@report(
    f"""WITH c AS (SELECT method, series, avg(CAST(y >= lo AND y <= hi AS DOUBLE)) AS picp FROM ({_ONE}) WHERE rule IS NULL OR rule = 'fixed' GROUP BY 1, 2),
n AS (SELECT series, CAST(count(*) AS DOUBLE) AS n_cal FROM ({b.with_(b.rows_sql())} SELECT * FROM fc) WHERE split = 'calibration' GROUP BY series),
r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY n_cal) + (count(*) OVER (PARTITION BY method, n_cal) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY method ORDER BY picp) + (count(*) OVER (PARTITION BY method, picp) - 1) / 2.0::DOUBLE AS z FROM c JOIN n USING (series))
SELECT method, count(*) AS n, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT z) > 1 THEN corr(a, z) END AS rho FROM r GROUP BY method""",
    "rho",
)
def calibration_size_correlation(spark, sf_dir):
    """Whether coverage goes with the number of calibration rows; undefined where either is constant."""
    n = b.part(b.rows(spark, sf_dir), "calibration").groupBy("series").agg(F.count("*").cast("double").alias("n_cal"))
    return inf.spearman(mt.scored(_one(spark, sf_dir), b.ALPHA, "method", "series").join(n, "series"), "n_cal", "picp", "method", large=False)


# The same intervals under several partitions.

_TERCILES = "ter AS (SELECT series, quantile_cont(occ, 0.3333333333333333::DOUBLE) AS q1, quantile_cont(occ, 0.6666666666666666::DOUBLE) AS q2 FROM fc WHERE split = 'train' GROUP BY series)"
_STREAM = b.steps_sql("fc", "occ", "occ")
_LIMITS = f"""SELECT 'split_cp' AS method, series, i, lo, hi FROM ({b.with_(b.rows_sql(), b.split_cp_sql())} SELECT * FROM cp)
UNION ALL SELECT 'mondrian', series, i, lo, hi FROM ({b.with_(b.rows_sql(), _MONDRIAN.replace("SELECT t.series, t.bucket, y,", "SELECT t.series, t.i, t.bucket, y,"))} SELECT * FROM mond)
UNION ALL SELECT 'aci', f.series, f.i, lo, hi FROM ({b.with_(b.rows_sql(), _STREAM, b.fold_sql('steps'), recursive=True)} SELECT f.series, f.i, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN steps s ON f.series = s.series AND f.i = s.i) f
UNION ALL SELECT 'tod_aci', f.series, f.i, lo, hi FROM ({b.with_(b.rows_sql(), _GROUPED, _GROUPED_FOLD, recursive=True)} SELECT f.series, f.i, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN gstep s ON f.series = s.series AND f.i = s.i) f"""
_FOUR = b.with_(b.rows_sql(), _TERCILES, f"four AS (SELECT method, l.series, t.i, y, lo, hi, bucket, dow, CASE WHEN occ <= q1 THEN 'low' WHEN occ <= q2 THEN 'mid' ELSE 'high' END AS tercile FROM ({_LIMITS}) l JOIN fc t ON t.series = l.series AND t.i = l.i AND t.split = 'test' JOIN ter ON ter.series = t.series)")


def four(spark, sf_dir):
    """Intervals of four methods with the labels of their rows."""
    rows = ft.terciles(b.rows(spark, sf_dir), "occ", "series")
    cal, test = b.calibration(rows), b.part(rows, "test")
    how = {"low": "occ", "high": "occ", "alpha": b.ALPHA, "horizon": b.HORIZON, "gamma": b.GAMMA}
    out = {
        "split_cp": split_cp(rows),
        "mondrian": mondrian(rows),
        "aci": ad.stream(cal, test, "series", **how),
        "tod_aci": ad.grouped_stream(cal, test, "bucket", "series", least=30, **how),
    }
    limits = union([x.select("series", "i", "lo", "hi").withColumn("method", F.lit(m)) for m, x in out.items()])
    return limits.join(test.select("series", "i", "y", "bucket", "dow", "tercile"), ["series", "i"])


@report(
    _FOUR + f"""SELECT method, bucket, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n, sum(picp * n) / sum(n) AS pooled_picp, avg(picp) AS mean_picp, stddev_pop(picp) AS sd_picp, min(picp) AS worst_picp, arg_min(series, struct_pack(p := picp, s := series)) AS worst_series, count(*) FILTER (WHERE picp < 0.8) AS n_below_80
FROM (SELECT method, series, bucket, {b.scores_sql()} FROM four GROUP BY 1, 2, 3) GROUP BY method, bucket""",
    "pooled_picp mean_picp sd_picp worst_picp",
)
def tod_conditional_methods(spark, sf_dir):
    """The time-of-day table of four methods."""
    cells, worst = mt.scored(four(spark, sf_dir), b.ALPHA, "method", "series", "bucket"), F.min(F.struct("picp", "series"))
    return cells.groupBy("method", "bucket").agg(F.count("*").alias("n_series"), F.sum("n").alias("n"), (F.sum(F.col("picp") * F.col("n")) / F.sum("n")).alias("pooled_picp"), F.avg("picp").alias("mean_picp"), F.stddev_pop("picp").alias("sd_picp"), worst["picp"].alias("worst_picp"), worst["series"].alias("worst_series"), F.count_if(F.col("picp") < 0.8).alias("n_below_80"))


_CELL = {"bucket": "bucket", "weekday": "CAST(dow AS VARCHAR)", "tercile": "tercile", "chance": "'r' || CAST(CAST('0x' || substr(md5(concat_ws('|', '', series, CAST(i AS VARCHAR))), 1, 8) AS BIGINT) % 5 AS VARCHAR)"}
_PARTS = "pc AS (" + " UNION ALL ".join(f"SELECT method, series, '{k}' AS partition, {v} AS cell, {b.scores_sql()} FROM four GROUP BY 1, 2, 3, 4" for k, v in _CELL.items()) + ")"


def _labels():
    return {"bucket": F.col("bucket"), "weekday": F.col("dow"), "tercile": F.col("tercile"), "chance": pt.hashed_label(F.col("series"), F.col("i"))}


@report(_FOUR.strip() + ", " + _PARTS + " SELECT * FROM pc", _M)
def partition_cells_methods(spark, sf_dir):
    """Four methods, four partitions of the same intervals."""
    return pt.partition_cells(four(spark, sf_dir), _labels(), b.ALPHA, "method", "series")


@report(
    _FOUR.strip() + ", " + _PARTS + """, s AS (SELECT method, partition, count(*) AS n_cells, stddev_pop(picp) AS sd, avg(picp) AS mean_picp, min(picp) AS least_picp, count(*) FILTER (WHERE picp < 0.8) AS n_below_80 FROM pc GROUP BY 1, 2),
x AS (SELECT s.*, f.sd AS floor_sd, sqrt(greatest(round(s.sd * s.sd - f.sd * f.sd, 15), 0)) AS excess FROM s JOIN s f ON s.method = f.method AND f.partition = 'chance')
SELECT x.*, CASE WHEN e.excess > 0 THEN 1 - x.excess * x.excess / (e.excess * e.excess) END AS structure_removed FROM x JOIN x e ON e.partition = x.partition AND e.method = 'split_cp'""",
    "sd mean_picp least_picp floor_sd excess structure_removed",
)
def partition_structure(spark, sf_dir):
    """How much coverage varies over cells beyond chance, and the share of it that a method removes."""
    cells = pt.partition_cells(four(spark, sf_dir), _labels(), b.ALPHA, "method", "series")
    return pt.structure_removed(pt.excess_dispersion(cells, "chance", "method"), "split_cp", cells)


# Rolling origins: per fold the series that move, gamma fixed and calibrated.

_FOLD_ROWS = f"""{b.panel_sql()},{b.features_sql()},
spn AS (SELECT min(slot) AS s0, max(slot) - min(slot) AS n FROM panel),
fd AS ({' UNION ALL '.join(f"SELECT '{f}' AS fold, {_AT(a)} AS train0, {_AT(c)} AS cal0, {_AT(t)} AS test0, {_AT(e)} AS test1 FROM (SELECT s0, n FROM spn)" for f, a, c, t, e in _FOLDS)}),
fz AS (SELECT fold, series, slot, occ, y_{b.HORIZON} AS y, hour, CASE WHEN slot < cal0 THEN 'train' WHEN slot < test0 THEN 'calibration' ELSE 'test' END AS split FROM f JOIN fd ON slot >= train0 AND slot < test1 WHERE occ IS NOT NULL AND y_{b.HORIZON} IS NOT NULL),
dy AS (SELECT fold, series FROM fz GROUP BY 1, 2 HAVING stddev_pop(occ) FILTER (WHERE split = 'train') >= 28.7),
fc AS (SELECT z.*, {b.day_bucket_sql('hour')} AS bucket, row_number() OVER (PARTITION BY z.fold, z.series, split ORDER BY slot) - 1 AS i FROM fz z JOIN dy USING (fold, series))"""


@report(f"SELECT fold, method, rule, series, {_scores()} FROM ({core_sql(b.HORIZON, (b.ALPHA,), (b.ALPHA,), _FOLD_ROWS, 'fold, series')}) GROUP BY ALL", _M)
def rolling_origin_methods(spark, sf_dir):
    """Three folds, the series that move in each fold's train rows, four methods, gamma fixed and calibrated."""
    from ..functions.scalar import day_bucket
    from ..operators import panel as pn
    from ..operators import quality as ql

    panel = b.panel(spark, sf_dir)
    rows = ft.targets(panel, [b.HORIZON]).withColumnRenamed(f"y_{b.HORIZON}", "y").dropna(subset=["occ", "y"])
    rows = pt.in_folds(rows, folds(panel)).withColumn("bucket", day_bucket(F.hour(pn.slot_time())))
    moving = ql.dynamic(rows, "occ", "fold", "series", least=28.7, population=True).filter("dynamic").select("fold", "series")
    at = F.row_number().over(Window.partitionBy("fold", "series", "split").orderBy("slot")) - 1
    rows = rows.join(moving, ["fold", "series"]).withColumn("i", at.cast("long"))
    return core(rows, b.HORIZON, (b.ALPHA,), (b.ALPHA,), ("fold", "series")).groupBy("fold", "method", "rule", "series").agg(*mt.scores(F.col("miss")))


# Allocation over seeds: demand around anchors, three policies on the same requests.

_SEEDS, _REQUESTS, _ANCHORS, _BOX = 20, 600, [(44.80, 20.45), (44.86, 20.52), (44.78, 20.60), (44.90, 20.42)], (44.75, 44.93, 20.40, 20.62)


def _u(name: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws('|', '{name}', CAST(seed AS VARCHAR), CAST(request AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"


def _normal(n: str) -> str:
    return f"sqrt(-2 * ln(1 - {_u(n + 'a')})) * cos(2 * pi() * {_u(n + 'b')})"


def _wide(lo: float, hi: float, n: str) -> str:
    return f"({b.num(lo - 0.15 * (hi - lo))} + {_u(n)} * {b.num(1.3 * (hi - lo))})"


_PICK = lambda k: f"[{', '.join(b.num(a[k]) for a in _ANCHORS)}][CAST(floor({_u('anchor')} * {len(_ANCHORS)}) AS BIGINT) + 1]"
_DEMAND = f"""req AS (SELECT seed, request, CASE WHEN {_u('hot')} < 0.65::DOUBLE THEN {_PICK(0)} + 0.0035::DOUBLE * {_normal('y')} ELSE {_wide(*_BOX[:2], 'lat')} END AS lat,
 CASE WHEN {_u('hot')} < 0.65::DOUBLE THEN {_PICK(1)} + 0.0035::DOUBLE * {_normal('x')} ELSE {_wide(*_BOX[2:], 'lon')} END AS lon FROM (SELECT unnest(range({_SEEDS})) AS seed), (SELECT unnest(range({_REQUESTS})) AS request))"""
_KM = "2 * 6371 * asin(sqrt(pow(sin(radians(s.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - r.lon) / 2), 2)))"
_RULES = {"POINT": "capacity - yhat >= 1", "INTERVAL": "capacity - upper >= 1", "MARGIN": "capacity - (yhat + margin) >= 1"}
_CHOSEN = ", ".join(
    [
        _SITES[: _SITES.index("req AS (")].rstrip(" ,\n"),
        _DEMAND,
        f"pr AS (SELECT seed, request, site, {_KM} AS km, y, capacity, yhat, upper, margin FROM req r, mg s)",
        "ch AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, seed, request, site, km, y, capacity FROM (SELECT *, row_number() OVER (PARTITION BY seed, request ORDER BY round(km, 9), site) AS k FROM pr WHERE {c}) WHERE k = 1" for p, c in _RULES.items()) + ")",
        "pol AS (SELECT unnest(['POINT', 'INTERVAL', 'MARGIN']) AS policy)",
        "oc AS (" + _outcome_sql("seed, policy", "SELECT r.seed, p.policy, c.site, c.km, capacity - y < 1 AS poor FROM pol p CROSS JOIN req r LEFT JOIN ch c ON c.policy = p.policy AND c.seed = r.seed AND c.request = r.request") + ")",
    ]
)


def _outcomes(spark, sf_dir):
    asked = dc.demand(spark, _SEEDS, _REQUESTS, _ANCHORS, _BOX).drop("slot")
    chosen = dc.allocated(asked, sites(spark, sf_dir), None, "seed", "request")
    return dc.allocation_report(chosen, F.col("capacity") - F.col("y") < 1, "seed", "policy")


@report(f"WITH {_CHOSEN} SELECT * FROM oc", "served bad overflow unserved_or_overflow mean_km p90_km")
def allocation_over_seeds(spark, sf_dir):
    return _outcomes(spark, sf_dir)


_CASES = [(a, c, v) for a, c in (("POINT", "INTERVAL"), ("POINT", "MARGIN"), ("MARGIN", "INTERVAL")) for v in ("bad", "unserved_or_overflow", "mean_km")]


@report(
    f"WITH {_CHOSEN}, "
    + "pp AS (" + " UNION ALL ".join(f"SELECT '{a} - {c}' AS contrast, '{v}' AS value, seed, max({v}) FILTER (WHERE policy = '{a}') AS x, max({v}) FILTER (WHERE policy = '{c}') AS z FROM oc GROUP BY seed" for a, c, v in _CASES) + ") "
    + "SELECT contrast, value, count(x - z) AS n_seeds, avg(x) AS mean_a, avg(z) AS mean_b, avg(x - z) AS mean_d, min(x - z) AS least_d, max(x - z) AS greatest_d, count(*) FILTER (WHERE x - z > 0) AS n_above, avg(x - z) / nullif(avg(x), 0) AS relative_d FROM pp GROUP BY contrast, value",
    "mean_a mean_b mean_d least_d greatest_d relative_d",
)
def policy_pairs_over_seeds(spark, sf_dir):
    """Policies paired by seed: the same requests, the difference of outcomes, in how many seeds its sign holds."""
    return dc.policy_contrasts(_outcomes(spark, sf_dir), _CASES)


@report(
    b.with_(b.rows_sql(), "r AS (SELECT series, avg(occ) FILTER (WHERE dow < 5 AND hour >= 12 AND hour < 19) / max(occ) AS ratio FROM fc WHERE split = 'train' GROUP BY series)")
    + "SELECT series, ratio, CAST(row_number() OVER (ORDER BY ratio DESC, series) AS INTEGER) AS place FROM r WHERE ratio IS NOT NULL QUALIFY place <= 4",
    "ratio",
)
def anchor_sites(spark, sf_dir):
    """The four series that are fullest on train weekdays' afternoons, by their capacity."""
    from ..operators import panel as pn

    rows = b.part(b.rows(spark, sf_dir), "train")
    return dc.anchors(rows, "occ", ft.afternoon(pn.slot_time()), 4, "series")


# The delay grid's SQL: windows of at least 50 scores, ends that aren't clipped.


def _delay_sql(horizon: int) -> str:
    pools = _pools("g", "src", "series", horizon).replace(f"a.r > greatest(t.i - {horizon} + 1, 0)", f"a.r > w + greatest(t.i - {horizon} + 1, 0) - greatest(w, 50)")
    grid = ", ".join(b.num(g) for g in _RATES)
    both = b.with_(
        b.rows_sql(horizon),
        "src AS (SELECT series, split, i, y, occ AS low, occ AS high FROM fc WHERE split <> 'train')",
        pools,
        f"ds AS (SELECT s.*, pool, gamma, {b.num(b.ALPHA)} AS miss FROM src s JOIN gpool p ON s.series = p.series AND s.i = p.i, (SELECT unnest([{grid}]) AS gamma) WHERE split = 'test')",
        _fold("df", "ds", "series, gamma", horizon),
        f"cq AS (SELECT series, sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS q FROM (SELECT series, list_sort(list(abs(y - low))) AS sc FROM src WHERE split = 'calibration' GROUP BY series))",
        recursive=True,
    )
    return both + "SELECT 'aci' AS method, f.gamma, f.series, y, low - q AS lo, high + q AS hi FROM df f JOIN ds s ON f.series = s.series AND f.gamma = s.gamma AND f.i = s.i UNION ALL SELECT 'split_cp', NULL::DOUBLE, s.series, y, low - q, high + q FROM src s JOIN cq ON cq.series = s.series WHERE split = 'test'"


ORACLES["delay_sensitivity_grid"] = b.rounded_sql(" UNION ALL ".join(f"SELECT {h} AS horizon, method, gamma, series, {b.scores_sql()} FROM ({_delay_sql(h)}) GROUP BY method, gamma, series" for h in HORIZONS), "gamma picp mpiw winkler")
