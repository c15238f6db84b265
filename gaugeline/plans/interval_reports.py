"""Reports on intervals: constant, conditional and adaptive."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.draws import pick_sql
from ..functions.scalar import conformal_quantile, d, skipping_quantile
from ..operators import adaptive as ad
from ..operators import chunks as ch
from ..operators import conformal as cf
from ..operators import forecast as fc
from ..operators import metrics as mt
from ..operators import partitions as pt
from . import base as b
from .panel_reports import report

_M = "picp mpiw winkler"


def split_cp(rows, alpha: float = b.ALPHA, keys: tuple = ("series",), rule=conformal_quantile):
    q = cf.margins(b.calibration(rows), "score", alpha, *keys, rule=rule)
    return cf.banded(b.part(rows, "test"), q, "occ", "occ", *keys)


@report(b.with_(b.rows_sql(), b.split_cp_sql()) + "SELECT series, i, y, q, lo, hi FROM cp", "y q lo hi")
def split_cp_intervals(spark, sf_dir):
    return split_cp(b.rows(spark, sf_dir)).select("series", "i", "y", "q", "lo", "hi")


@report(b.with_(b.rows_sql(), b.split_cp_sql()) + f"SELECT series, {b.scores_sql()} FROM cp GROUP BY series", _M)
def split_cp_metrics(spark, sf_dir):
    return mt.scored(split_cp(b.rows(spark, sf_dir)), b.ALPHA, "series")


_LEVELS = (0.2, 0.15, 0.1, 0.05)


@report(
    b.with_(b.rows_sql(), "sc AS (SELECT series, list_sort(list(abs(y - occ))) AS sc FROM fc WHERE split = 'calibration' GROUP BY series)")
    + " UNION ALL ".join(f"(SELECT {1 - a:.2f}::DOUBLE AS level, series, {b.scores_sql(a)} FROM (SELECT fc.series, y, greatest(occ - sc[{b.rank_sql('len(sc)', b.num(a))}], 0) AS lo, occ + sc[{b.rank_sql('len(sc)', b.num(a))}] AS hi FROM fc JOIN sc ON fc.series = sc.series WHERE split = 'test') GROUP BY series)" for a in _LEVELS),
    f"level {_M}",
)
def level_sweep(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    scores = b.calibration(rows).groupBy("series").agg(F.collect_list("score").alias("s"))
    joined = b.part(rows, "test").join(scores.select("series", F.inline(F.array(*[F.struct(d(round(1 - a, 2)).alias("level"), conformal_quantile(F.col("s"), a).alias("q")) for a in _LEVELS]))), "series")
    out = joined.withColumn("lo", F.greatest(F.col("occ") - F.col("q"), d(0))).withColumn("hi", F.col("occ") + F.col("q"))
    miss = F.when(F.col("y") < F.col("lo"), F.col("lo") - F.col("y")).when(F.col("y") > F.col("hi"), F.col("y") - F.col("hi")).otherwise(d(0))
    factor = F.create_map(*[x for a in _LEVELS for x in (d(round(1 - a, 2)), d(2 / a))])[F.col("level")]
    hit = ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double")
    return out.groupBy("level", "series").agg(F.count("*").alias("n"), F.avg(hit).alias("picp"), F.avg(F.col("hi") - F.col("lo")).alias("mpiw"), F.avg(F.col("hi") - F.col("lo") + factor * miss).alias("winkler"))


_BAND_Q = f"""bq AS (SELECT series, sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS q FROM (SELECT series, list_sort(list(greatest(low - y, y - high))) AS sc FROM band WHERE split = 'calibration' GROUP BY series)),
cqr AS (SELECT t.series, i, y, q, greatest(low - q, 0) AS lo, high + q AS hi FROM band t JOIN bq ON t.series = bq.series WHERE split = 'test')"""


def banded(rows):
    return cf.uncrossed(fc.quantile_band(rows, "y", "occ", "bucket", b.ALPHA, "series"), "low", "high")


@report(b.with_(b.rows_sql(), b.band_sql(), _BAND_Q) + f"SELECT series, {b.scores_sql()}, any_value(q) AS q FROM cqr GROUP BY series", f"{_M} q")
def cqr_bucket_quantile(spark, sf_dir):
    rows = banded(b.rows(spark, sf_dir))
    out = cf.banded(b.part(rows, "test"), cf.margins(b.calibration(rows, "low", "high"), "score", b.ALPHA, "series"), "low", "high", "series")
    return out.groupBy("series").agg(*mt.scores(b.ALPHA), F.first("q").alias("q"))


_MONDRIAN = f"""own AS (SELECT series, bucket, list(abs(y - occ)) AS o FROM fc WHERE split = 'calibration' GROUP BY series, bucket),
every AS (SELECT series, list(abs(y - occ)) AS e FROM fc WHERE split = 'calibration' GROUP BY series),
want AS (SELECT DISTINCT series, bucket FROM fc WHERE split = 'test'),
pool AS (SELECT w.series, w.bucket, coalesce(len(o), 0) AS n_own, list_sort(CASE WHEN coalesce(len(o), 0) < 30 THEN list_concat(coalesce(o, []), e) ELSE o END) AS sc FROM want w LEFT JOIN own ON own.series = w.series AND own.bucket = w.bucket JOIN every ON every.series = w.series),
mq AS (SELECT series, bucket, n_own, n_own < 30 AS fell_back, sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS q FROM pool),
mond AS (SELECT t.series, t.bucket, y, n_own, fell_back, q, greatest(occ - q, 0) AS lo, occ + q AS hi FROM fc t JOIN mq ON t.series = mq.series AND t.bucket = mq.bucket WHERE split = 'test')"""


def mondrian(rows):
    test = b.part(rows, "test")
    q = cf.group_margins(b.calibration(rows), "score", "bucket", b.ALPHA, "series", groups=test.select("series", "bucket").distinct(), least=30)
    return cf.banded(test, q, "occ", "occ", "series", "bucket")


@report(b.with_(b.rows_sql(), _MONDRIAN) + f"SELECT series, bucket, n_own, fell_back, any_value(q) AS q, {b.scores_sql()} FROM mond GROUP BY series, bucket, n_own, fell_back", f"q {_M}")
def mondrian_split_cp(spark, sf_dir):
    return mondrian(b.rows(spark, sf_dir)).groupBy("series", "bucket", F.col("n_own").cast("long").alias("n_own"), "fell_back").agg(F.first("q").alias("q"), *mt.scores(b.ALPHA))


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _MONDRIAN, f"cells AS (SELECT 'split_cp' AS method, series, bucket, {b.scores_sql()} FROM cp GROUP BY series, bucket UNION ALL SELECT 'mondrian', series, bucket, {b.scores_sql()} FROM mond GROUP BY series, bucket)".replace("cells AS", "cell AS"))
    + """SELECT method, bucket, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n, sum(picp * n) / sum(n) AS pooled_picp, avg(picp) AS mean_picp, stddev_pop(picp) AS sd_picp, min(picp) AS worst_picp, arg_min(series, struct_pack(p := picp, s := series)) AS worst_series, count(*) FILTER (WHERE picp < 0.8) AS n_below_80 FROM cell GROUP BY method, bucket""",
    "pooled_picp mean_picp sd_picp worst_picp",
)
def tod_conditional_summary(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    cells = mt.scored(split_cp(rows), b.ALPHA, "series", "bucket").withColumn("method", F.lit("split_cp")).unionByName(mt.scored(mondrian(rows), b.ALPHA, "series", "bucket").withColumn("method", F.lit("mondrian")))
    worst = F.min(F.struct("picp", "series"))
    return cells.groupBy("method", "bucket").agg(F.count("*").alias("n_series"), F.sum("n").alias("n"), (F.sum(F.col("picp") * F.col("n")) / F.sum("n")).alias("pooled_picp"), F.avg("picp").alias("mean_picp"), F.stddev_pop("picp").alias("sd_picp"), worst["picp"].alias("worst_picp"), worst["series"].alias("worst_series"), F.count_if(F.col("picp") < 0.8).alias("n_below_80"))


@report(b.with_(b.rows_sql(), b.steps_sql("fc", "occ", "occ"), b.fold_sql("steps"), recursive=True) + "SELECT f.series, f.i, a AS alpha, q, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN steps s ON f.series = s.series AND f.i = s.i", "alpha q lo hi")
def aci_stream(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    return ad.stream(b.calibration(rows), b.part(rows, "test"), "series", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON, gamma=b.GAMMA).select("series", "i", "alpha", "q", "lo", "hi")


@report(b.with_(b.rows_sql(), b.band_sql(), b.steps_sql("band", "low", "high"), b.fold_sql("steps"), recursive=True) + "SELECT f.series, f.i, a AS alpha, q, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN steps s ON f.series = s.series AND f.i = s.i", "alpha q lo hi")
def acqr_stream(spark, sf_dir):
    rows = banded(b.rows(spark, sf_dir))
    return ad.stream(b.calibration(rows, "low", "high"), b.part(rows, "test"), "series", low="low", high="high", alpha=b.ALPHA, horizon=b.HORIZON, gamma=b.GAMMA).select("series", "i", "alpha", "q", "lo", "hi")


_GAMMAS = ", ".join(b.num(g) for g in ad.GAMMAS)
_NESTED = f"""c AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, CAST(floor(count(*) OVER (PARTITION BY series) * 0.5) AS BIGINT) AS cut FROM fc WHERE split = 'calibration'),
half AS (SELECT series, occ, y, CASE WHEN i < cut THEN 'calibration' ELSE 'test' END AS split, CASE WHEN i < cut THEN i ELSE i - cut END AS i FROM c WHERE cut >= 30 AND n - cut >= 50),
{b.steps_sql('half', 'occ', 'occ').strip()},
gs AS (SELECT g.gamma, s.* FROM steps s, (SELECT unnest([{_GAMMAS}]) AS gamma) g)"""
_NESTED_FOLD = b.fold_sql("gs", "series, gamma", "s.gamma")


@report(
    b.with_(b.rows_sql(), _NESTED, _NESTED_FOLD, f"""iv AS (SELECT g.series, g.gamma, g.y, low - q AS lo, high + q AS hi FROM fold f JOIN gs g ON f.series = g.series AND f.gamma = g.gamma AND f.i = g.i),
m AS (SELECT series, gamma, {b.scores_sql()} FROM iv GROUP BY series, gamma)""", recursive=True)
    + """SELECT series, gamma, picp AS cal_picp, winkler AS cal_winkler FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(abs(picp - 0.9::DOUBLE), 12), round(winkler, 9), gamma) AS k FROM m) WHERE k = 1
UNION ALL SELECT DISTINCT series, 0.02::DOUBLE, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM c WHERE NOT (cut >= 30 AND n - cut >= 50)""",
    "gamma cal_picp cal_winkler",
)
def gamma_selection(spark, sf_dir):
    return ad.chosen_gamma(b.calibration(b.rows(spark, sf_dir)), "series", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON)


_GROUPED = f"""names AS (SELECT series, bucket, row_number() OVER (PARTITION BY series ORDER BY bucket) AS g FROM (SELECT DISTINCT series, bucket FROM fc WHERE split = 'test')),
cal AS (SELECT series, bucket, i, abs(y - occ) AS sc, count(*) OVER (PARTITION BY series, bucket) AS c FROM fc WHERE split = 'calibration'),
have AS (SELECT n.series, n.bucket, n.g, coalesce(max(c), 0) AS n_own FROM names n LEFT JOIN cal ON cal.series = n.series AND cal.bucket = n.bucket GROUP BY 1, 2, 3),
opened AS (SELECT h.series, g, row_number() OVER (PARTITION BY h.series, g ORDER BY i) AS pos, sc FROM have h JOIN cal ON cal.series = h.series AND cal.bucket = h.bucket
  UNION ALL SELECT h.series, g, n_own + row_number() OVER (PARTITION BY h.series, g ORDER BY i), sc FROM have h JOIN cal ON cal.series = h.series WHERE n_own < 30),
width AS (SELECT series, g, count(*) AS w FROM opened GROUP BY series, g),
test AS (SELECT t.series, n.g, t.i, occ, y, abs(y - occ) AS sc, row_number() OVER (PARTITION BY t.series, n.g ORDER BY t.i) AS k FROM fc t JOIN names n ON t.series = n.series AND t.bucket = n.bucket WHERE split = 'test'),
line AS (SELECT * FROM opened UNION ALL SELECT t.series, t.g, w + k, sc FROM test t JOIN width x ON t.series = x.series AND t.g = x.g),
known AS (SELECT t.series, t.g, t.i, w, (SELECT count(*) FROM test o WHERE o.series = t.series AND o.g = t.g AND o.i <= t.i - {b.HORIZON}) AS m FROM test t JOIN width x ON t.series = x.series AND t.g = x.g),
pool AS (SELECT k.series, k.i, list_sort(list(l.sc)) AS pool FROM known k JOIN line l ON l.series = k.series AND l.g = k.g AND l.pos > m AND l.pos <= w + m GROUP BY 1, 2),
gstep AS (SELECT t.series, t.i, t.g, occ AS low, occ AS high, y, pool FROM test t JOIN pool p ON p.series = t.series AND p.i = t.i)"""
_GROW = "series, i, g, a, q, levels, list_append(errs, CASE WHEN y >= low - q AND y <= high + q THEN 0 ELSE 1 END) AS errs, list_append(gs, g) AS gs"
_GROUPED_FOLD = f"""fold AS (
  SELECT {_GROW} FROM (SELECT *, pool[{b.rank_sql('len(pool)', 'a')}] AS q FROM (SELECT s.*, {b.num(b.ALPHA)} AS a, list_transform(range((SELECT max(g) FROM names)), lambda z: {b.num(b.ALPHA)}) AS levels, CAST([] AS INTEGER[]) AS errs, CAST([] AS BIGINT[]) AS gs FROM gstep s WHERE i = 0))
  UNION ALL
  SELECT {_GROW} FROM (SELECT *, pool[{b.rank_sql('len(pool)', 'a')}] AS q FROM (SELECT *, levels[g] AS a FROM (SELECT s.series, s.i, s.g, s.low, s.high, s.y, s.pool, f.errs, f.gs,
      CASE WHEN s.i >= {b.HORIZON} THEN list_transform(f.levels, lambda x, k: CASE WHEN k = f.gs[s.i - {b.HORIZON} + 1] THEN greatest({b.num(1e-3)}, least({b.num(1 - 1e-3)}, x + {b.num(b.GAMMA)} * ({b.num(b.ALPHA)} - f.errs[s.i - {b.HORIZON} + 1]))) ELSE x END) ELSE f.levels END AS levels
    FROM fold f JOIN gstep s ON s.series = f.series AND s.i = f.i + 1))))"""


@report(b.with_(b.rows_sql(), _GROUPED, _GROUPED_FOLD, recursive=True) + "SELECT f.series, f.i, f.a AS alpha, f.q, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN gstep s ON f.series = s.series AND f.i = s.i", "alpha q lo hi")
def tod_aci_stream(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    out = ad.grouped_stream(b.calibration(rows), b.part(rows, "test"), "bucket", "series", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON, gamma=b.GAMMA, least=30)
    return out.select("series", "i", "alpha", "q", "lo", "hi")


_EXPERTS = f"gs AS (SELECT g.gamma, s.* FROM steps s, (SELECT unnest([{_GAMMAS}]) AS gamma) g)"
_PIN = lambda e, tau: f"greatest({b.num(tau)} * (y - {e}), {b.num(tau - 1)} * (y - {e}))"


@report(
    b.with_(b.rows_sql(), b.steps_sql("fc", "occ", "occ"), _EXPERTS, b.fold_sql("gs", "series, gamma", "s.gamma"), f"""iv AS (SELECT g.series, g.gamma, g.i, g.y, low - q AS lo, high + q AS hi FROM fold f JOIN gs g ON f.series = g.series AND f.gamma = g.gamma AND f.i = g.i),
l AS (SELECT *, coalesce(sum({_PIN('lo', b.ALPHA / 2)}) OVER w, 0) AS l1, coalesce(sum({_PIN('hi', 1 - b.ALPHA / 2)}) OVER w, 0) AS l2 FROM iv WINDOW w AS (PARTITION BY series, gamma ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {b.HORIZON} PRECEDING)),
w AS (SELECT *, exp(-0.01::DOUBLE * (l1 - min(l1) OVER (PARTITION BY series, i))) AS w1, exp(-0.01::DOUBLE * (l2 - min(l2) OVER (PARTITION BY series, i))) AS w2, min(lo) OVER (PARTITION BY series, i) AS m1, min(hi) OVER (PARTITION BY series, i) AS m2 FROM l)""", recursive=True)
    + "SELECT series, i, any_value(y) AS y, any_value(m1) + sum(w1 * (lo - m1)) / sum(w1) AS lo, any_value(m2) + sum(w2 * (hi - m2)) / sum(w2) AS hi FROM w GROUP BY series, i",
    "y lo hi",
)
def agaci_stream(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    return ad.aggregated_experts(b.calibration(rows), b.part(rows, "test"), "series", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON)


@report(b.with_(b.rows_sql(), b.steps_sql("fc", "occ", "occ"), f"gs AS (SELECT g.gamma, s.* FROM steps s, (SELECT unnest([{b.num(0.005)}, {b.num(0.05)}]) AS gamma) g)", b.fold_sql("gs", "series, gamma", "s.gamma"), recursive=True) + f"SELECT gamma, series, {b.scores_sql()} FROM (SELECT g.gamma, g.series, g.y, low - q AS lo, high + q AS hi FROM fold f JOIN gs g ON f.series = g.series AND f.gamma = g.gamma AND f.i = g.i) GROUP BY gamma, series", f"gamma {_M}")
def delay_sensitivity(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    cal = b.calibration(rows)
    test = b.part(rows, "test")
    spread = F.explode(F.array(d(0.005), d(0.05)))
    out = ad.stream(cal.withColumn("gamma", spread), test.withColumn("gamma", spread), "series", "gamma", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON, gamma=F.col("gamma"), clip=None)
    return mt.scored(out, b.ALPHA, "gamma", "series")


_DELAYS, _RATES = (1, 3, 6), (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)


@report()
def delay_sensitivity_grid(spark, sf_dir):
    """The whole grid: six gammas at three horizons, and split-CP, which has no feedback that could come late, as control."""
    out = []
    for h in _DELAYS:
        rows = b.rows(spark, sf_dir, h)
        cal, test = b.calibration(rows), b.part(rows, "test")
        spread = F.explode(F.array(*map(d, _RATES)))
        aci = ad.stream(cal.withColumn("gamma", spread), test.withColumn("gamma", spread), "series", "gamma", low="occ", high="occ", alpha=b.ALPHA, horizon=h, gamma=F.col("gamma"), window=lambda n: max(50, n), clip=None)
        split = cf.banded(test, cf.margins(cal, "score", b.ALPHA, "series"), "occ", "occ", "series", clip=None).withColumn("gamma", F.lit(None).cast("double"))
        for method, x in (("aci", aci), ("split_cp", split)):
            out.append(mt.scored(x, b.ALPHA, "gamma", "series").withColumn("method", F.lit(method)).withColumn("horizon", F.lit(h)))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


@report(
    b.with_(b.rows_sql(), f"""sc AS (SELECT series, list_sort(list(abs(y - occ))) AS sc FROM fc WHERE split = 'calibration' GROUP BY series),
arms AS (SELECT 'corrected' AS arm, series, sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS q FROM sc UNION ALL SELECT 'legacy', series, sc[least({b.rank_sql('len(sc)', b.num(b.ALPHA))} + 1, len(sc))] FROM sc),
iv AS (SELECT arm, t.series, y, greatest(occ - q, 0) AS lo, occ + q AS hi FROM fc t JOIN arms a ON t.series = a.series WHERE split = 'test'),
m AS (SELECT arm, series, {b.scores_sql()} FROM iv GROUP BY arm, series)""")
    + "SELECT c.series, c.picp AS picp_corrected, l.picp AS picp_legacy, l.picp - c.picp AS d_picp, l.mpiw - c.mpiw AS d_mpiw, (l.mpiw - c.mpiw) / c.mpiw AS rel_mpiw, l.winkler - c.winkler AS d_winkler FROM m c JOIN m l ON c.series = l.series AND c.arm = 'corrected' AND l.arm = 'legacy'",
    "picp_corrected picp_legacy d_picp d_mpiw rel_mpiw d_winkler",
)
def legacy_quantile_attribution(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    s = b.calibration(rows).groupBy("series").agg(F.collect_list("score").alias("s"))
    arms = s.select("series", F.inline(F.array(F.struct(F.lit("corrected").alias("arm"), conformal_quantile(F.col("s"), b.ALPHA).alias("q")), F.struct(F.lit("legacy").alias("arm"), skipping_quantile(F.col("s"), b.ALPHA).alias("q")))))
    m = mt.scored(cf.banded(b.part(rows, "test"), arms, "occ", "occ", "series"), b.ALPHA, "arm", "series")
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    diff = lambda c: pick("legacy", c) - pick("corrected", c)
    return m.groupBy("series").agg(pick("corrected", "picp").alias("picp_corrected"), pick("legacy", "picp").alias("picp_legacy"), diff("picp").alias("d_picp"), diff("mpiw").alias("d_mpiw"), (diff("mpiw") / pick("corrected", "mpiw")).alias("rel_mpiw"), diff("winkler").alias("d_winkler"))


_FOLDS = [("f1", 0.0, 0.40, 0.55, 0.70), ("f2", 0.0, 0.50, 0.65, 0.80), ("f3", 0.0, 0.60, 0.75, 1.01)]


def folds(panel):
    span = panel.agg(F.min("slot").alias("s0"), (F.max("slot") - F.min("slot")).alias("n"))
    at = lambda p: F.floor(F.col("s0") + F.col("n") * d(p))
    return span.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), at(a).alias("train0"), at(c).alias("cal0"), at(t).alias("test0"), at(e).alias("test1")) for f, a, c, t, e in _FOLDS])))


_AT = lambda p: f"floor(s0 + n * {b.num(p)})"


@report(
    b.with_(b.panel_sql(), b.features_sql(), f"""sp AS (SELECT min(slot) AS s0, max(slot) - min(slot) AS n FROM panel),
fd AS ({' UNION ALL '.join(f"SELECT '{f}' AS fold, {_AT(a)} AS train0, {_AT(c)} AS cal0, {_AT(t)} AS test0, {_AT(e)} AS test1 FROM sp" for f, a, c, t, e in _FOLDS)}),
z AS (SELECT fold, series, slot, occ, y_3 AS y, CASE WHEN slot < cal0 THEN 'train' WHEN slot < test0 THEN 'calibration' ELSE 'test' END AS split FROM f JOIN fd ON slot >= train0 AND slot < test1 WHERE occ IS NOT NULL AND y_3 IS NOT NULL),
sc AS (SELECT fold, series, list_sort(list(abs(y - occ))) AS sc FROM z WHERE split = 'calibration' GROUP BY fold, series),
iv AS (SELECT z.fold, z.series, y, greatest(occ - sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}], 0) AS lo, occ + sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS hi FROM z JOIN sc ON z.fold = sc.fold AND z.series = sc.series WHERE split = 'test')""")
    + f"SELECT fold, series, {b.scores_sql()} FROM iv GROUP BY fold, series",
    _M,
)
def rolling_origin_folds(spark, sf_dir):
    from ..operators import features as ft

    panel = b.panel(spark, sf_dir)
    rows = ft.targets(panel, [b.HORIZON]).withColumnRenamed("y_3", "y").dropna(subset=["occ", "y"])
    return mt.scored(split_cp(pt.in_folds(rows, folds(panel)), keys=("fold", "series")), b.ALPHA, "fold", "series")


# Fitted learners and resampling have no SQL: tests hold them against plain Python. Sizes are the reference's, whose
# trees are grown without a limit of depth.

FOREST = {"trees": 100, "depth": math.inf}


@report()
def base_learners(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    out = [fc.fitted(rows, b.FEATURES, "y", "occ", n, "series", **o).withColumn("learner", F.lit(n)) for n, o in (("ridge", {}), ("forest", FOREST), ("boosting", {"rounds": 200}))]
    every = out[0].unionByName(out[1]).unionByName(out[2])
    return mt.point_errors(b.part(every, "test"), "y", "yhat", "learner", "series")


@report()
def fitted_quantile_cqr(spark, sf_dir):
    rows = cf.uncrossed(fc.fitted_band(b.rows(spark, sf_dir), b.FEATURES, "y", "occ", b.ALPHA, "series", rounds=100), "low", "high")
    return mt.scored(cf.banded(b.part(rows, "test"), cf.margins(b.calibration(rows, "low", "high"), "score", b.ALPHA, "series"), "low", "high", "series"), b.ALPHA, "series")


@report()
def gaussian_band_conformal(spark, sf_dir):
    rows = fc.fitted_band(b.rows(spark, sf_dir), b.FEATURES, "y", "occ", b.ALPHA, "series", kind="gaussian", rounds=300, rate=0.03)
    plain = b.part(rows, "test").withColumn("lo", F.col("low")).withColumn("hi", F.col("high")).withColumn("method", F.lit("gaussian"))
    conf = cf.banded(b.part(rows, "test"), cf.margins(b.calibration(rows, "low", "high"), "score", b.ALPHA, "series"), "low", "high", "series").withColumn("method", F.lit("gaussian_conformal"))
    return mt.scored(plain.select("method", "series", "y", "lo", "hi").unionByName(conf.select("method", "series", "y", "lo", "hi")), b.ALPHA, "method", "series")


@report()
def enbpi_intervals(spark, sf_dir):
    rows = b.rows(spark, sf_dir).withColumn("day", F.floor(F.col("slot") / 24))
    return mt.scored(ch.ensemble_intervals(rows, b.FEATURES, "y", "occ", "day", "series", alpha=b.ALPHA, horizon=b.HORIZON, members=30, **FOREST), b.ALPHA, "series")


_BLOCK, _DRAWS = mt.block_length(60, 6.0), 10_000


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), f"""h AS (SELECT series, CASE WHEN y >= lo AND y <= hi THEN 1.0::DOUBLE ELSE 0 END AS hit, row_number() OVER (PARTITION BY series ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY series) AS n FROM cp),
s AS (SELECT series, p, n, sum(hit) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN CURRENT ROW AND {_BLOCK - 1} FOLLOWING) AS t FROM h),
d AS (SELECT series, n, draw, unnest(range(greatest(1, n // {_BLOCK}))) AS k FROM (SELECT DISTINCT series, n FROM h WHERE n >= {_BLOCK}), (SELECT unnest(range({_DRAWS})) AS draw)),
u AS (SELECT *, {pick_sql('42', 'draw', 'k', f'(n - {_BLOCK} + 1)')} AS p FROM d),
m AS (SELECT u.series, draw, sum(t) / (count(*) * {_BLOCK}) AS mean FROM u JOIN s ON s.series = u.series AND s.p = u.p GROUP BY 1, 2),
c AS (SELECT series, quantile_cont(mean, 0.05) AS ci_lo, quantile_cont(mean, 0.95) AS ci_hi FROM m GROUP BY series)""")
    + "SELECT h.series, count(*) AS n, avg(hit) AS mean, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi, any_value(ci_lo <= 0.9::DOUBLE AND ci_hi >= 0.9::DOUBLE) AS contains, any_value(ci_lo >= 0.9::DOUBLE - 0.02::DOUBLE) AS safe FROM h LEFT JOIN c ON c.series = h.series GROUP BY h.series",
    "mean ci_lo ci_hi",
)
def coverage_block_bootstrap(spark, sf_dir):
    out = split_cp(b.rows(spark, sf_dir)).withColumn("hit", ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))
    return mt.block_bootstrap(out, "hit", "i", "series", block=_BLOCK, draws=_DRAWS)
