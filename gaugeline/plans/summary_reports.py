"""Reports over interval results: reliability, inference, decisions, space, verification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import number_sql, pick_sql
from ..functions.scalar import d
from ..operators import adaptive as ad
from ..operators import conformal as cf
from ..operators import decisions as dc
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import inference as inf
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import partitions as pt
from ..operators import quality as ql
from ..operators import spatial as sp
from ..operators import tables as tb
from . import base as b
from .interval_reports import _MONDRIAN, FOREST, mondrian, split_cp
from .panel_reports import report

_CELLS = f"cell AS (SELECT series, {b.scores_sql()} FROM cp GROUP BY series)"


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _CELLS, "sd AS (SELECT series, stddev_samp(occ) FILTER (WHERE split = 'train') AS sd FROM fc GROUP BY series)")
    + "SELECT threshold, count(*) AS n_series, avg(picp) AS mean_picp, stddev_samp(picp) AS sd_picp, avg(winkler) AS mean_winkler FROM cell c JOIN sd ON c.series = sd.series JOIN (SELECT unnest([0.0, 2.0, 5.0, 10.0, 28.6, 28.8, 29.0])::DOUBLE AS threshold) t ON sd >= threshold GROUP BY threshold",
    "threshold mean_picp sd_picp mean_winkler",
)
def sigma_threshold_sweep(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    cells = mt.scored(split_cp(rows), b.ALPHA, "series").join(ql.dynamic(rows, "occ", "series").select("series", "train_sd"), "series")
    many = cells.withColumn("threshold", F.explode(F.array(*map(d, (0.0, 2.0, 5.0, 10.0, 28.6, 28.8, 29.0))))).filter("train_sd >= threshold")
    return many.groupBy("threshold").agg(F.count("*").alias("n_series"), F.avg("picp").alias("mean_picp"), F.stddev_samp("picp").alias("sd_picp"), F.avg("winkler").alias("mean_winkler"))


def _summary(cells):
    return cells.groupBy("bucket").agg(F.count("*").alias("n_series"), F.avg("picp").alias("picp"), F.avg("winkler").alias("winkler"))


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), f"c AS (SELECT series, bucket, {b.scores_sql()} FROM cp GROUP BY series, bucket), bad AS (SELECT series FROM cp GROUP BY series HAVING count(DISTINCT y) < 150), s1 AS (SELECT bucket, avg(picp) AS picp, avg(winkler) AS winkler FROM c GROUP BY bucket), s2 AS (SELECT bucket, avg(picp) AS picp, avg(winkler) AS winkler FROM c WHERE series NOT IN (SELECT series FROM bad) GROUP BY bucket)")
    + "SELECT coalesce(a.bucket, e.bucket) AS bucket, CASE WHEN e.bucket IS NULL THEN 'left_only' WHEN a.bucket IS NULL THEN 'right_only' ELSE 'both' END AS origin, metric, before, after, after - before AS delta FROM s1 a FULL JOIN s2 e ON a.bucket = e.bucket, LATERAL (SELECT 'picp' AS metric, a.picp AS before, e.picp AS after UNION ALL SELECT 'winkler', a.winkler, e.winkler)",
    "before after delta",
)
def exclusion_before_after(spark, sf_dir):
    out = split_cp(b.rows(spark, sf_dir))
    cells = mt.scored(out, b.ALPHA, "series", "bucket")
    flags = ql.low_information(out, "y", "series", least=150)
    kept = ql.excluded(cells, flags, "low_information", "series")
    return tb.deltas(tb.aligned(_summary(cells), _summary(kept), ["bucket"]), ["bucket"], ["picp", "winkler"])


_LABELS = {"bucket": "bucket", "weekday": "CAST(dow AS VARCHAR)", "chance": "'r' || CAST(CAST('0x' || substr(md5(concat_ws('|', '', series, CAST(i AS VARCHAR))), 1, 8) AS BIGINT) % 5 AS VARCHAR)"}


def labels():
    return {"bucket": F.col("bucket"), "weekday": F.col("dow"), "chance": pt.hashed_label(F.col("series"), F.col("i"))}


_PCELLS = "pc AS (" + " UNION ALL ".join(f"SELECT series, '{k}' AS partition, {v} AS cell, {b.scores_sql()} FROM cp GROUP BY 1, 2, 3" for k, v in _LABELS.items()) + ")"


@report(b.with_(b.rows_sql(), b.split_cp_sql(), _PCELLS) + "SELECT * FROM pc", "picp mpiw winkler")
def partition_coverage(spark, sf_dir):
    return pt.partition_cells(split_cp(b.rows(spark, sf_dir)), labels(), b.ALPHA, "series")


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _PCELLS, "s AS (SELECT series, partition, count(*) AS n_cells, stddev_pop(picp) AS sd FROM pc GROUP BY 1, 2)")
    + "SELECT s.series, s.partition, s.n_cells, s.sd, f.sd AS floor_sd, sqrt(greatest(s.sd * s.sd - f.sd * f.sd, 0)) AS excess FROM s JOIN s f ON s.series = f.series AND f.partition = 'chance'",
    "sd floor_sd excess",
)
def excess_dispersion(spark, sf_dir):
    return pt.excess_dispersion(pt.partition_cells(split_cp(b.rows(spark, sf_dir)), labels(), b.ALPHA, "series"), "chance", "series")


@report(
    b.with_(b.rows_sql(), """c AS (SELECT series, bucket, dow, CAST(count(*) AS DOUBLE) AS o FROM fc WHERE split = 'test' GROUP BY 1, 2, 3),
m AS (SELECT *, sum(o) OVER (PARTITION BY series, bucket) AS ra, sum(o) OVER (PARTITION BY series, dow) AS rb FROM c)""")
    + "SELECT series, CAST(sum(o) AS BIGINT) AS n, CASE WHEN least(count(DISTINCT bucket), count(DISTINCT dow)) >= 2 THEN sqrt(greatest(0, sum(o * o / (ra * rb)) - 1) / (least(count(DISTINCT bucket), count(DISTINCT dow)) - 1)) END AS cramers_v FROM m GROUP BY series",
    "cramers_v",
)
def cramers_v(spark, sf_dir):
    return pt.cramers_v(b.part(b.rows(spark, sf_dir), "test"), "bucket", "dow", "series")


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), f"e AS (SELECT series, bucket, {b.scores_sql()} FROM cp GROUP BY 1, 2)")
    + """SELECT 'pooled' AS grain, NULL AS series, bucket, CAST(sum(n) AS BIGINT) AS n, sum(picp * n) / sum(n) AS picp FROM e GROUP BY bucket
UNION ALL SELECT 'entity_cell', series, bucket, n, picp FROM e
UNION ALL SELECT 'worst_cell', series, bucket, n, picp FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY picp, bucket) AS k FROM e) WHERE k = 1""",
    "picp",
)
def tod_grains(spark, sf_dir):
    return pt.grained(split_cp(b.rows(spark, sf_dir)), "bucket", b.ALPHA)


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _MONDRIAN, f"e AS (SELECT 'split_cp' AS method, series, {b.scores_sql()} FROM cp GROUP BY series UNION ALL SELECT 'mondrian', series, {b.scores_sql()} FROM mond GROUP BY series)")
    + """SELECT method, count(*) AS n_entities, sum(picp * n) / sum(n) AS pooled_picp, avg(picp) AS mean_picp, stddev_samp(picp) AS sd_picp, min(picp) AS worst_picp, arg_min(series, struct_pack(p := picp, s := series)) AS worst_entity,
 avg(CAST(abs(picp - 0.9::DOUBLE) <= 0.02 AS DOUBLE)) AS share_near, count(*) FILTER (WHERE picp < 0.8) AS n_below_80, count(*) FILTER (WHERE picp < 0.85) AS n_below_85, avg(CAST(picp >= 0.88 AS DOUBLE)) AS share_safe, avg(mpiw) AS mean_mpiw, avg(winkler) AS mean_winkler FROM e GROUP BY method""",
    "pooled_picp mean_picp sd_picp worst_picp share_near share_safe mean_mpiw mean_winkler",
)
def pooled_vs_worst(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    cells = mt.scored(split_cp(rows), b.ALPHA, "series").withColumn("method", F.lit("split_cp")).unionByName(mt.scored(mondrian(rows), b.ALPHA, "series").withColumn("method", F.lit("mondrian")))
    return mt.across(cells, "method")


_P = "(o_orderkey * 7919 % 1000) / 1000.0::DOUBLE"


@report(f"""WITH p AS (SELECT o_orderpriority AS family, o_orderkey AS contrast, {_P} AS p FROM orders),
s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p AS s FROM p WINDOW w AS (PARTITION BY family ORDER BY p, contrast))
SELECT family, contrast, p, least(1.0, max(s) OVER (PARTITION BY family ORDER BY p, contrast ROWS UNBOUNDED PRECEDING)) AS p_holm FROM s""", "p p_holm")
def holm_adjust(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders")
    return inf.holm(o.select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("contrast"), (F.col("o_orderkey") * 7919 % 1000 / d(1000)).alias("p")), "p", "family")


@report("""WITH s AS (SELECT c_custkey, any_value(c_mktsegment) AS segment, any_value(c_acctbal) AS balance, CAST(count(o_orderkey) AS DOUBLE) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
r AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY balance) + (count(*) OVER (PARTITION BY segment, balance) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY segment ORDER BY n) + (count(*) OVER (PARTITION BY segment, n) - 1) / 2.0::DOUBLE AS b FROM s)
SELECT segment, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY segment""", "rho")
def spearman_rank(spark, sf_dir):
    n = b.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"))
    c = b.read(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", F.coalesce("orders", d(0)).alias("orders"))
    return inf.spearman(c, "c_acctbal", "orders", "segment")


def _sites_panel(spark, sf_dir):
    return b.panel(spark, sf_dir, 6 * pn.HOUR, F.col("user_id") % 20)


_BUCKETS = f"e AS (SELECT series, bucket, {b.scores_sql()} FROM cp GROUP BY series, bucket)"
#: P(T > t) for whole degrees of freedom: a finite sum in the angle whose tangent is t / sqrt(df).
_T_SF = """list_transform([atan({t} / sqrt({n}))], lambda w: 0.5 - 0.5 * CASE WHEN {n} % 2 = 0 THEN sin(w) * coalesce(list_sum(list_transform(range({n} // 2), lambda j: pow(cos(w), 2 * j) * exp(lgamma(j + 0.5) - lgamma(0.5::DOUBLE) - lgamma(j + 1.0)))), 0)
 ELSE 2 / pi() * (w + coalesce(list_sum(list_transform(range(({n} - 1) // 2), lambda j: sin(w) * pow(cos(w), 2 * j + 1) * exp(lgamma(j + 1.0) + lgamma(0.5::DOUBLE) - lgamma(j + 1.5)) / 2)), 0)) END)[1]"""


def _t_sf(t: str, n: str) -> str:
    return _T_SF.format(t=t, n=n)


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _BUCKETS, f"""m AS (SELECT bucket, count(picp) AS n, avg(picp) AS mean, stddev_samp(picp) AS sd FROM e GROUP BY bucket),
bis AS (SELECT n, 0 AS k, 0.0::DOUBLE AS a, 1000.0::DOUBLE AS z FROM (SELECT DISTINCT n FROM m WHERE n > 1)
  UNION ALL SELECT n, k + 1, CASE WHEN {_t_sf('((a + z) / 2)', '(n - 1)')} > 0.05 THEN (a + z) / 2 ELSE a END, CASE WHEN {_t_sf('((a + z) / 2)', '(n - 1)')} > 0.05 THEN z ELSE (a + z) / 2 END FROM bis WHERE k < 70),
tq AS (SELECT n, (a + z) / 2 AS t FROM bis WHERE k = 70)""", recursive=True)
    + f"""SELECT bucket, n, mean, sd, sd / sqrt(n) AS se, mean - t * sd / sqrt(n) AS ci_lo, mean + t * sd / sqrt(n) AS ci_hi,
 CASE WHEN n > 1 AND sd > 0 THEN greatest({_t_sf('((mean - 0.9::DOUBLE + 0.02::DOUBLE) / (sd / sqrt(n)))', '(n - 1)')}, {_t_sf('((0.02::DOUBLE - (mean - 0.9::DOUBLE)) / (sd / sqrt(n)))', '(n - 1)')}) END AS tost_p FROM m LEFT JOIN tq USING (n)""",
    "mean sd se ci_lo ci_hi tost_p",
)
def t_interval_legs(spark, sf_dir):
    cells = mt.scored(split_cp(b.rows(spark, sf_dir)), b.ALPHA, "series", "bucket")
    return inf.mean_legs(cells, "picp", "bucket")


_MANY = 10_000


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _BUCKETS, f"""x AS (SELECT bucket, picp, row_number() OVER (PARTITION BY bucket ORDER BY series) - 1 AS p, count(*) OVER (PARTITION BY bucket) AS n FROM e),
d AS (SELECT bucket, n, draw, unnest(range(n)) AS k FROM (SELECT DISTINCT bucket, n FROM x), (SELECT unnest(range({_MANY})) AS draw)),
u AS (SELECT *, {pick_sql('42', 'draw', 'k', 'n')} AS p FROM d),
m AS (SELECT u.bucket, draw, avg(picp) AS mean FROM u JOIN x ON x.bucket = u.bucket AND x.p = u.p GROUP BY 1, 2),
c AS (SELECT bucket, quantile_cont(mean, 0.05) AS ci_lo, quantile_cont(mean, 0.95) AS ci_hi FROM m GROUP BY bucket)""")
    + "SELECT x.bucket, count(*) AS n, avg(picp) AS mean, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi FROM x JOIN c ON c.bucket = x.bucket GROUP BY x.bucket",
    "mean ci_lo ci_hi",
)
def facility_bootstrap(spark, sf_dir):
    cells = mt.scored(split_cp(b.rows(spark, sf_dir)), b.ALPHA, "series", "bucket")
    return inf.bootstrap_mean(cells, "picp", "series", "bucket")


def _contrast_sql(cells: str, pairs: list[tuple[str, str]], keys: str = "family") -> str:
    """CTEs from `unit` (keys, arm, entity, v) to `found`: the columns of inference.contrasts. Signed ranks are exact for at
    most 50 differences without ties or zeros, else normal with the error function as a series."""
    erfc = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(160), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(greatest({z}, 1e-300::DOUBLE)) - lgamma(j + 1.0) - ln(2.0 * j + 1))))"
    named = ", ".join(f"({k}, '{a}', '{c}')" for k, (a, c) in enumerate(pairs))
    on = keys.split(", ")
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in on)
    of = lambda x: ", ".join(f"{x}.{k}" for k in on)
    return f"""{cells},
pr AS (SELECT {of('l')}, c.k AS num, c.a || ' - ' || c.b AS contrast, l.entity, l.v - r.v AS d FROM (VALUES {named}) AS c(k, a, b) JOIN unit l ON l.arm = c.a JOIN unit r ON r.arm = c.b AND {same('r', 'l')} AND r.entity = l.entity WHERE l.v - r.v IS NOT NULL),
px AS (SELECT *, row_number() OVER (PARTITION BY {keys}, num ORDER BY entity) - 1 AS p, count(*) OVER (PARTITION BY {keys}, num) AS n FROM pr),
dr AS (SELECT *, unnest(range(n)) AS k FROM (SELECT DISTINCT {keys}, num, n FROM px), (SELECT unnest(range({_MANY})) AS draw)),
up AS (SELECT *, {pick_sql(f'42 + num * {_MANY}', 'draw', 'k', 'n')} AS p FROM dr),
bm AS (SELECT {of('u')}, u.num, draw, avg(d) AS mean FROM up u JOIN px x ON {same('x', 'u')} AND x.num = u.num AND x.p = u.p GROUP BY ALL),
bo AS (SELECT {keys}, num, quantile_cont(mean, 0.05) AS ci_lo, quantile_cont(mean, 0.95) AS ci_hi, least(1.0, 2 * least(avg(CAST(mean <= 1e-12::DOUBLE AS DOUBLE)), avg(CAST(mean >= -1e-12::DOUBLE AS DOUBLE)))) AS boot_p FROM bm GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY {keys}, num ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, num, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, num, abs(d)) AS alike FROM px WHERE d <> 0),
sr AS (SELECT {keys}, num, count(*) AS m, any_value(n) AS n, max(alike) > 1 AS tied, sum(alike * alike - 1) AS ties, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS plus FROM rk GROUP BY ALL),
sw AS (SELECT *, least(plus, m * (m + 1) / 2.0::DOUBLE - plus) AS w FROM sr),
ways AS (SELECT 0 AS size, [1::HUGEINT] AS ways UNION ALL SELECT size + 1, list_transform(range(CAST((size + 1) * (size + 2) / 2 AS BIGINT) + 1), lambda s: coalesce(ways[s + 1], 0) + CASE WHEN s >= size + 1 THEN coalesce(ways[s - size], 0) ELSE 0 END) FROM ways WHERE size < 50),
sp AS (SELECT {keys}, num, CASE WHEN m <= 50 AND NOT tied AND m = n THEN least(1.0, 2 * CAST(list_sum(ways[1 : CAST(floor(w) AS BIGINT) + 1]) AS DOUBLE) / pow(2, m)) ELSE least(1.0, {erfc.format(z='((m * (m + 1) / 4.0::DOUBLE - w) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) / sqrt(2))')}) END AS wilcoxon_p FROM sw JOIN ways ON size = least(m, 50)),
found AS (SELECT {of('x')}, x.contrast, count(*) AS n, avg(d) AS mean_d, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi, any_value(boot_p) AS boot_p, avg(CAST(d < 0 AS DOUBLE)) AS share_less, any_value(wilcoxon_p) AS wilcoxon_p FROM px x JOIN bo ON {same('bo', 'x')} AND bo.num = x.num LEFT JOIN sp ON {same('sp', 'x')} AND sp.num = x.num GROUP BY {of('x')}, x.num, x.contrast),
ho AS (SELECT *, (count(HP) OVER (PARTITION BY {keys}) - row_number() OVER hw + 1) * HP AS s FROM found WINDOW hw AS (PARTITION BY {keys} ORDER BY HP NULLS LAST, contrast))"""


def _holm_sql(p: str, keys: str = "family") -> str:
    return f"SELECT * EXCLUDE (s), CASE WHEN {p} IS NOT NULL THEN least(1.0, max(s) OVER (PARTITION BY {keys} ORDER BY {p} NULLS LAST, contrast ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM ho"


_CONTRAST = "mean_d ci_lo ci_hi boot_p share_less wilcoxon_p p_holm"


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _MONDRIAN, _contrast_sql(f"unit AS (SELECT 'D' AS family, arm, series || '|' || bucket AS entity, abs(picp - 0.9::DOUBLE) AS v FROM (SELECT 'split_cp' AS arm, series, bucket, {b.scores_sql()} FROM cp GROUP BY series, bucket UNION ALL SELECT 'mondrian', series, bucket, {b.scores_sql()} FROM mond GROUP BY series, bucket))", [("split_cp", "mondrian")]).replace("HP", "boot_p"), recursive=True) + _holm_sql("boot_p"),
    _CONTRAST,
)
def wilcoxon_contrasts(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    cells = mt.scored(split_cp(rows), b.ALPHA, "series", "bucket").withColumn("arm", F.lit("split_cp")).unionByName(mt.scored(mondrian(rows), b.ALPHA, "series", "bucket").withColumn("arm", F.lit("mondrian")))
    cells = cells.withColumn("entity", F.concat_ws("|", "series", "bucket")).withColumn("gap", F.abs(F.col("picp") - 0.9)).withColumn("family", F.lit("D"))
    return inf.holm(inf.contrasts(cells, "gap", "arm", [("split_cp", "mondrian")], "entity", "family"), "boot_p", "family", large=False)


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _CELLS) + "SELECT count(picp) AS n, avg(picp) AS mean, stddev_samp(picp) AS sd, quantile_cont(picp, 0.25) AS q1, quantile_cont(picp, 0.5) AS median, quantile_cont(picp, 0.75) AS q3, min(picp) AS low, max(picp) AS high, count(*) FILTER (WHERE picp > 0) AS n_positive, count(*) FILTER (WHERE picp < 0) AS n_negative FROM cell",
    "mean sd q1 median q3 low high",
)
def seeds_summary(spark, sf_dir):
    return inf.seeds_summary(mt.scored(split_cp(b.rows(spark, sf_dir)), b.ALPHA, "series"), "picp")


_SHARES = (0.3, 0.5, 0.7, 0.9)
_HALVES = f"""h AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE split = 'calibration'),
own AS (SELECT series, bucket, list(abs(y - occ)) AS o FROM h WHERE i < n // 2 GROUP BY 1, 2), every AS (SELECT series, list(abs(y - occ)) AS e FROM h WHERE i < n // 2 GROUP BY 1),
want AS (SELECT DISTINCT series, bucket FROM fc WHERE split <> 'train'),
pool AS (SELECT w.series, w.bucket, list_sort(CASE WHEN coalesce(len(o), 0) < 12 THEN list_concat(coalesce(o, []), e) ELSE o END) AS sc FROM want w LEFT JOIN own ON own.series = w.series AND own.bucket = w.bucket JOIN every ON every.series = w.series),
hq AS (SELECT series, bucket, sc[{b.rank_sql('len(sc)', b.num(b.ALPHA))}] AS q FROM pool),
ib AS (SELECT h.series, greatest(occ - q, 0) AS lo, occ + q AS hi FROM h JOIN hq ON h.series = hq.series AND h.bucket = hq.bucket WHERE i >= n // 2),
th AS (SELECT series, share, quantile_cont(hi - lo, share) AS threshold FROM ib, (SELECT unnest([{', '.join(b.num(s) for s in _SHARES)}]) AS share) GROUP BY series, share)""".replace("quantile_cont(hi - lo, share)", "CASE share " + " ".join(f"WHEN {b.num(s)} THEN quantile_cont(hi - lo, {b.num(s)})" for s in _SHARES) + " END") + """,
sel AS (SELECT t.series, t.bucket, t.i, share, y, greatest(occ - q, 0) AS lo, occ + q AS hi, (occ + q) - greatest(occ - q, 0) <= threshold AS committed FROM fc t JOIN hq ON t.series = hq.series AND t.bucket = hq.bucket JOIN th ON th.series = t.series WHERE split = 'test')"""


def _selection(spark, sf_dir):
    """Split intervals per bucket from the first half of calibration; commit thresholds from the second."""
    from pyspark.sql import Window

    from ..operators import conformal as cf

    rows = b.rows(spark, sf_dir)
    cal = b.calibration(rows).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    later = cal.filter("i >= n div 2")
    test = b.part(rows, "test")
    groups = rows.filter("split <> 'train'").select("series", "bucket").distinct()
    q = cf.group_margins(cal.filter("i < n div 2"), "score", "bucket", b.ALPHA, "series", groups=groups, least=12)
    thresholds = dc.commit_thresholds(cf.banded(later, q, "occ", "occ", "series", "bucket"), list(_SHARES), "series")
    return dc.selected(cf.banded(test, q, "occ", "occ", "series", "bucket"), thresholds, "series")


_SEL = """count(*) AS n, avg(CAST(committed AS DOUBLE)) AS commit_rate, avg(abs(y - (lo + hi) / 2)) FILTER (WHERE committed) AS mae,
 100 * avg(abs(y - (lo + hi) / 2)) FILTER (WHERE committed) / greatest(avg(y), 1) AS mae_pct, avg(CAST(y >= lo AND y <= hi AS DOUBLE)) FILTER (WHERE committed) AS picp"""


@report(b.with_(b.rows_sql(), _HALVES) + f"SELECT series, share, {_SEL} FROM sel GROUP BY series, share", "share commit_rate mae mae_pct picp")
def trust_abstain(spark, sf_dir):
    return dc.selection_report(_selection(spark, sf_dir), "series", "share")


@report(
    b.with_(b.rows_sql(), _HALVES, "c AS (SELECT series, share, bucket, count(*) AS n, count(*) FILTER (WHERE NOT committed) AS n_abstained FROM sel GROUP BY 1, 2, 3)")
    + "SELECT *, (n_abstained / nullif(sum(n_abstained) OVER (PARTITION BY series, share), 0)) / (n / sum(n) OVER (PARTITION BY series, share)) AS lift FROM c",
    "share lift",
)
def abstention_lift(spark, sf_dir):
    return dc.abstention_lift(_selection(spark, sf_dir), "bucket", "series", "share")


@report(
    b.with_(b.rows_sql(), _HALVES, """k AS (SELECT series, share, count(*) FILTER (WHERE committed) AS k FROM sel GROUP BY 1, 2),
r AS (SELECT s.* EXCLUDE (committed), draw, row_number() OVER (PARTITION BY s.series, s.share, draw ORDER BY md5(concat_ws('|', CAST(draw AS VARCHAR), s.series, CAST(CAST(s.share * 10 AS INTEGER) AS VARCHAR), CAST(s.i AS VARCHAR))), s.i) <= k AS committed FROM sel s JOIN k ON s.series = k.series AND s.share = k.share, (SELECT unnest(range(20)) AS draw))""")
    + f"SELECT series, share, avg(mae) AS mean_mae, stddev_samp(mae) AS sd_mae FROM (SELECT series, share, draw, {_SEL} FROM r GROUP BY 1, 2, 3) GROUP BY series, share",
    "share mean_mae sd_mae",
)
def random_control(spark, sf_dir):
    rows = _selection(spark, sf_dir).withColumn("tenths", (F.col("share") * 10).cast("int"))
    drawn = dc.matched_random(rows, 20, "i", "series", "tenths")
    per = dc.selection_report(drawn, "series", "tenths", "draw")
    return per.groupBy("series", (F.col("tenths") / d(10)).alias("share")).agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("sd_mae"))


# Sites are suppliers with derived coordinates, requests are orders.

_OUTCOMES = "served bad overflow unserved_or_overflow mean_km p90_km"
_KM = "2 * 6371 * asin(sqrt(pow(sin(radians(s.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - r.lon) / 2), 2)))"
_SITES = """sites AS (SELECT s_suppkey AS site, 44.75 + (s_suppkey * 11 % 19) * 0.01::DOUBLE AS lat, 20.40 + (s_suppkey * 7 % 23) * 0.01::DOUBLE AS lon, CAST(40 + s_suppkey % 60 AS DOUBLE) AS capacity,
  CAST(20 + (s_suppkey * 13) % 70 AS DOUBLE) AS yhat, CAST(20 + (s_suppkey * 13) % 70 + 2 + s_suppkey % 9 AS DOUBLE) AS upper, CAST(20 + (s_suppkey * 17) % 75 AS DOUBLE) AS y FROM supplier),
mg AS (SELECT *, avg(upper - yhat) OVER () AS margin FROM sites),
req AS (SELECT o_orderkey AS request, 44.70 + (o_orderkey % 977) / 977.0::DOUBLE * 0.3 AS lat, 20.35 + (o_orderkey * 31 % 991) / 991.0::DOUBLE * 0.35 AS lon FROM orders)"""


def sites(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    out = s.select(k.alias("site"), (d(44.75) + (k * 11 % 19) * d(0.01)).alias("lat"), (d(20.40) + (k * 7 % 23) * d(0.01)).alias("lon"), (40 + k % 60).cast("double").alias("capacity"), (20 + (k * 13) % 70).cast("double").alias("yhat"), (20 + (k * 13) % 70 + 2 + k % 9).cast("double").alias("upper"), (20 + (k * 17) % 75).cast("double").alias("y"))
    margin = out.agg(F.avg(F.col("upper") - F.col("yhat")).alias("margin"))
    return out.crossJoin(F.broadcast(margin))


def requests(spark, sf_dir):
    k = F.col("o_orderkey")
    return b.read(spark, sf_dir, "orders").select(k.alias("request"), (d(44.70) + (k % 977) / d(977) * d(0.3)).alias("lat"), (d(20.35) + (k * 31 % 991) / d(991) * d(0.35)).alias("lon"))


def _alloc_sql(rules: dict, extra: str) -> str:
    arms = " UNION ALL ".join(f"SELECT '{p}' AS policy, request, site, km, y, capacity FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(km, 9), site) AS k FROM pr WHERE {cond}) WHERE k = 1" for p, cond in rules.items())
    return b.with_(_SITES, f"pr AS (SELECT request, site, {_KM} AS km, y, capacity, yhat, upper, margin FROM req r, mg s)", f"ch AS ({arms})", f"pol AS (SELECT unnest([{', '.join(repr(p) for p in rules)}]) AS policy)") + _outcome_sql("policy", f"SELECT p.policy, r.request, c.site, c.km, {extra} AS poor FROM pol p CROSS JOIN req r LEFT JOIN ch c ON c.policy = p.policy AND c.request = r.request")


def _outcome_sql(keys: str, rows: str) -> str:
    """Rows: keys, site, km, poor."""
    share = lambda c: f"avg(CAST({c} AS DOUBLE))"
    return f"""SELECT {keys}, count(*) AS n, count(site) AS n_assigned, {share('site IS NOT NULL')} AS served, {share('site IS NOT NULL AND poor')} AS bad, {share('CASE WHEN site IS NOT NULL THEN poor END')} AS overflow,
 {share('site IS NULL OR poor')} AS unserved_or_overflow, avg(km) AS mean_km, quantile_cont(km, 0.9) AS p90_km FROM ({rows}) GROUP BY {keys}"""

@report(_alloc_sql({"POINT": "capacity - yhat >= 1", "INTERVAL": "capacity - upper >= 1", "MARGIN": "capacity - (yhat + margin) >= 1"}, "coalesce(capacity - y < 1, false)"), _OUTCOMES)
def greedy_allocation(spark, sf_dir):
    chosen = dc.allocated(requests(spark, sf_dir), sites(spark, sf_dir), None, "request")
    return dc.allocation_report(chosen, F.col("capacity") - F.col("y") < 1, "policy")


@report(_alloc_sql({"POINT": "yhat <= 0.9::DOUBLE * capacity", "INTERVAL": "upper <= 0.9::DOUBLE * capacity"}, "coalesce(y >= 0.9::DOUBLE * capacity, false)"), _OUTCOMES)
def relative_threshold_allocation(spark, sf_dir):
    chosen = dc.allocated(requests(spark, sf_dir), sites(spark, sf_dir), dc.relative_policies(0.9), "request")
    return dc.allocation_report(chosen, F.col("y") >= d(0.9) * F.col("capacity"), "policy")


_THETAS = (0.85, 0.9, 0.925, 0.95)


def _capable(rows):
    out = split_cp(rows).withColumn("yhat", F.col("occ")).withColumn("upper", F.col("hi"))
    return out.join(dc.capacity_proxy(rows, "occ", "series"), "series")


_CAP = "cap AS (SELECT series, max(occ) FILTER (WHERE split = 'train') AS capacity FROM fc GROUP BY series)"


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _CAP)
    + f"""SELECT cp.series, theta, count(*) AS n, count(*) FILTER (WHERE y >= theta * capacity) AS n_events, avg(CAST(y >= theta * capacity AS DOUBLE)) AS event_rate, avg(CAST(occ > theta * capacity AS DOUBLE)) AS point_withdraws, avg(CAST(hi > theta * capacity AS DOUBLE)) AS interval_withdraws,
 count(*) FILTER (WHERE hi > theta * capacity AND occ <= theta * capacity) AS interval_only FROM cp JOIN cap ON cp.series = cap.series, (SELECT unnest([{', '.join(b.num(t) for t in _THETAS)}]) AS theta) GROUP BY 1, 2""",
    "theta event_rate point_withdraws interval_withdraws",
)
def capability_table(spark, sf_dir):
    return dc.capability(_capable(b.rows(spark, sf_dir)), list(_THETAS), "series")


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _CAP, """z AS (SELECT cp.series, level, i, CASE WHEN i >= 60 THEN level * capacity ELSE occ END + q > 0.9::DOUBLE * capacity AS w, occ + q > 0.9::DOUBLE * capacity AS w0 FROM cp JOIN cap ON cp.series = cap.series, (SELECT unnest([0.2, 0.5, 0.8, 1.0])::DOUBLE AS level)),
o AS (SELECT series, level, min(i) FILTER (WHERE w AND i >= 60) AS first_withdrawal, min(i) FILTER (WHERE w0 AND i >= 60) AS base_first, avg(CAST(w AS DOUBLE)) FILTER (WHERE i < 60) AS rate_before, avg(CAST(w AS DOUBLE)) FILTER (WHERE i >= 60) AS rate_after, avg(CAST(w0 AS DOUBLE)) FILTER (WHERE i >= 60) AS base_rate FROM z GROUP BY 1, 2)""")
    + """SELECT o.series, o.level, first_withdrawal, first_withdrawal - 60 AS lead, (SELECT bool_and(w) FROM z WHERE z.series = o.series AND z.level = o.level AND z.i >= o.first_withdrawal) AS persistent, rate_before, rate_after, base_first, base_rate,
 first_withdrawal IS NOT NULL AND (base_first IS NULL OR first_withdrawal < base_first) AS caused, rate_after - coalesce(base_rate, 0) AS excess FROM o""",
    "level rate_before rate_after base_rate excess",
)
def failure_injection(spark, sf_dir):
    rows = _capable(b.rows(spark, sf_dir)).withColumn("level", F.explode(F.array(*map(d, (0.2, 0.5, 0.8, 1.0)))))
    hit = ft.overlaid(rows, "occ", F.lit(60), F.col("level") * F.col("capacity"))
    gone = F.col("occ") + F.col("q") > d(0.9) * F.col("capacity")
    made, base = (dc.withdrawals(x, gone, F.lit(60), "series", "level") for x in (hit, rows))
    return dc.causal(made, base, "series", "level")


_ONSET, _OVERSHOOT = 60, 1.6769
_SWEEP = (0.8, 0.9, 0.95, 0.98, 1.0, 1.05, 1.2, _OVERSHOOT)


def injected(rows):
    """Test rows of each arm: nothing, an implausible level, a plausible one, and the sweep's levels, from the onset on.
    Lags and rolling statistics are rebuilt over all retained rows of the series."""
    train = F.col("split") == "train"
    known = rows.groupBy("series").agg(F.max(F.when(train, F.col("occ"))).alias("capacity"), F.percentile(F.when(train, F.col("occ")), F.lit(0.5)).alias("median"))
    levels = [("none", F.lit(None).cast("double")), ("implausible", d(_OVERSHOOT) * F.col("capacity")), ("plausible", F.col("median")), *((f"level_{x:.4f}", d(x) * F.col("capacity")) for x in _SWEEP)]
    many = rows.join(known, "series").select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), v.alias("level")) for a, v in levels])))
    start = F.when((F.col("split") == "test") & F.col("level").isNotNull(), F.lit(_ONSET))
    for c in ("occ", "y"):
        many = ft.overlaid(many, c, start, F.col("level"))
    return b.part(ft.rebuilt(many, b.LAGS, b.WIDTH, "series", "arm", order="slot"), "test").dropna(subset=b.FEATURES)


@report()
def failure_injection_arms(spark, sf_dir):
    """Three arms and eight levels, through fitted models and adaptive quantile intervals as without an injection. The
    models of a series are fitted once; its arms are rows to predict."""
    rows = b.rows(spark, sf_dir)
    arms = injected(rows)
    every = rows.filter("split <> 'test'").withColumn("arm", F.lit("")).unionByName(arms.drop("capacity", "median", "level"))
    how = {"carry": ("i", "split", "arm")}
    on = ["series", *how["carry"]]
    point = fc.fitted(every, b.FEATURES, "y", "occ", "forest", "series", **how, **FOREST).select(*on, "yhat")
    band = cf.uncrossed(fc.fitted_band(every, b.FEATURES, "y", "occ", b.ALPHA, "series", rounds=100, **how), "low", "high")
    cal = b.calibration(band, "low", "high").drop("arm")
    gamma = ad.chosen_gamma(cal, "series", low="low", high="high", alpha=b.ALPHA, horizon=b.HORIZON).select("series", "gamma")
    keyed = arms.select("series", "arm").distinct().join(gamma, "series")
    iv = ad.stream(cal.join(keyed, "series"), b.part(band, "test").join(gamma, "series"), "series", "arm", "gamma", low="low", high="high", alpha=b.ALPHA, horizon=b.HORIZON, gamma=F.col("gamma"))
    seen = iv.join(b.part(point, "test").drop("split"), ["series", "arm", "i"]).join(arms.select("series", "arm", "i", "capacity"), ["series", "arm", "i"])
    by = seen.select("series", "arm", "gamma", "i", "capacity", F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(c).alias("bound")) for p, c in (("interval", "hi"), ("point", "yhat"))])))
    made = dc.withdrawals(by, F.col("capacity") - F.col("bound") < 1, F.lit(_ONSET), "series", "arm", "policy", "gamma")
    out = dc.causal(made, made.filter("arm = 'none'"), "series", "policy")
    first = lambda p: F.max(F.when(F.col("policy") == p, F.col("first_withdrawal"))).over(Window.partitionBy("series", "arm"))
    return out.withColumn("lead_over_point", first("point") - first("interval"))


# Space: sites are users modulo 20 on a six-hour grid.

_COORD = "coord AS (SELECT CAST(k AS BIGINT) AS site, 44.75 + (k * 11 % 19) * 0.01::DOUBLE AS lat, 20.40 + (k * 7 % 23) * 0.01::DOUBLE AS lon FROM range(20) t(k))"
_SPACE = f"""pairs AS (SELECT r.site AS a, s.site AS b, {_KM} AS km FROM coord r JOIN coord s ON r.site < s.site),
full_ AS (SELECT slot FROM panel WHERE occ IS NOT NULL GROUP BY slot HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM panel WHERE occ IS NOT NULL)),
o AS (SELECT CAST(series AS BIGINT) AS site, slot, occ FROM panel WHERE slot IN (SELECT slot FROM full_) AND occ IS NOT NULL),
co AS (SELECT x.site AS a, y.site AS b, count(*) AS n, corr(x.occ, y.occ) AS r FROM o x JOIN o y ON x.slot = y.slot AND x.site < y.site GROUP BY 1, 2),
pr AS (SELECT p.a, p.b, km, n, r FROM pairs p JOIN co ON p.a = co.a AND p.b = co.b)"""
_GRID = b.panel_sql(6 * 3600, "user_id % 20")


def coordinates(spark):
    k = F.col("id")
    return spark.range(20).select(k.alias("site"), (d(44.75) + (k * 11 % 19) * d(0.01)).alias("lat"), (d(20.40) + (k * 7 % 23) * d(0.01)).alias("lon"))


def spatial_pairs(spark, sf_dir):
    p = _sites_panel(spark, sf_dir).withColumnRenamed("series", "site")
    return sp.distances(coordinates(spark)).join(sp.pair_correlations(p, "occ"), ["a", "b"])


def site_means(spark, sf_dir):
    p = _sites_panel(spark, sf_dir).withColumnRenamed("series", "site")
    return sp.common_times(p.filter("occ is not null")).groupBy("site").agg(pn.grained(F.avg("occ")).alias("mean_occ"))


@report(b.with_(_GRID, _COORD, _SPACE) + "SELECT a, b, km, n, r FROM pr", "km r")
def pair_distance_correlation(spark, sf_dir):
    return spatial_pairs(spark, sf_dir).select("a", "b", "km", "n", "r")


@report(b.with_(_GRID, _COORD, _SPACE) + "SELECT count(*) FILTER (WHERE km < 2) AS n_near, avg(r) FILTER (WHERE km < 2) AS r_near, count(*) FILTER (WHERE km > 5) AS n_far, avg(r) FILTER (WHERE km > 5) AS r_far FROM pr", "r_near r_far")
def near_far_correlation(spark, sf_dir):
    return sp.near_far(spatial_pairs(spark, sf_dir))


@report(
    b.with_(_GRID, _COORD, _SPACE, f"""me AS (SELECT site, {b.grained_sql('avg(occ)')} AS v FROM o GROUP BY site), z AS (SELECT site, v - (SELECT avg(v) FROM me) AS z FROM me),
t AS (SELECT sum(2 * CASE WHEN km > 0 THEN 1 / km ELSE 0 END * x.z * y.z) AS top, sum(2 * CASE WHEN km > 0 THEN 1 / km ELSE 0 END) AS w FROM pairs p JOIN z x ON x.site = a JOIN z y ON y.site = b)""")
    + "SELECT (SELECT count(*) FROM z) AS n, (SELECT count(*) FROM z) / w * top / (SELECT sum(z * z) FROM z) AS moran_i FROM t",
    "moran_i",
)
def morans_i(spark, sf_dir):
    return sp.morans_i(sp.distances(coordinates(spark)), site_means(spark, sf_dir), "mean_occ")


@report(b.with_(_GRID, _COORD, _SPACE) + "SELECT count(*) AS n_pairs, corr(km, r) AS mantel_r FROM pr", "mantel_r")
def mantel_r(spark, sf_dir):
    return sp.mantel_r(spatial_pairs(spark, sf_dir))


@report(b.with_(_GRID, _COORD, _SPACE) + "SELECT count(*) AS n_pairs, corr(km, r) AS mantel_r FROM pr WHERE a NOT IN (1, 8) AND b NOT IN (1, 8)", "mantel_r")
def mantel_on_roster(spark, sf_dir):
    return sp.mantel_r(sp.on_roster(spatial_pairs(spark, sf_dir), coordinates(spark).filter("site not in (1, 8)")))


@report(
    b.with_(_GRID, _COORD, _SPACE, f"""me AS (SELECT site, {b.grained_sql('avg(occ)')} AS v FROM o GROUP BY site), z AS (SELECT site, v - (SELECT avg(v) FROM me) AS z, row_number() OVER (ORDER BY site) - 1 AS p FROM me),
mat AS (SELECT x.p AS i, y.p AS j, km, r, CASE WHEN km > 0 THEN 1 / km ELSE 0 END AS w, x.z AS zi, y.z AS zj FROM pr JOIN z x ON x.site = a JOIN z y ON y.site = b),
sym AS (SELECT i, j, r FROM mat UNION ALL SELECT j, i, r FROM mat),
dr AS (SELECT draw, p, z FROM z, (SELECT unnest(range(9999)) AS draw)),
ord AS (SELECT draw, p AS picked, z, row_number() OVER (PARTITION BY draw ORDER BY {number_sql('42', 'draw', 'p')}, p) - 1 AS p FROM dr),
per AS (SELECT m.i, m.j, km, w, x.draw, s.r, x.z * y.z AS zz FROM mat m JOIN ord x ON x.p = m.i JOIN ord y ON y.p = m.j AND y.draw = x.draw JOIN sym s ON s.i = x.picked AND s.j = y.picked),
st AS (SELECT draw, sum(2 * w * zz) AS top, corr(km, r) AS mr FROM per GROUP BY draw),
ob AS (SELECT sum(2 * w * zi * zj) AS top, sum(2 * w) AS w, corr(km, r) AS mr FROM mat),
f AS (SELECT (SELECT count(*) FROM z) / w / (SELECT sum(z * z) FROM z) AS f, top, mr FROM ob)""")
    + "SELECT f * top AS moran_i, ((SELECT count(*) FROM st WHERE draw < 999 AND abs(f.f * st.top) >= abs(f.f * f.top) - 1e-12::DOUBLE) + 1) / 1000.0::DOUBLE AS moran_p, mr AS mantel_r, ((SELECT count(*) FROM st WHERE abs(st.mr) >= abs(f.mr) - 1e-12::DOUBLE) + 1) / 10000.0::DOUBLE AS mantel_p FROM f",
    "moran_i moran_p mantel_r mantel_p",
)
def spatial_permutation_tests(spark, sf_dir):
    return sp.permutation_tests(spatial_pairs(spark, sf_dir), site_means(spark, sf_dir), "mean_occ")


@report(
    b.with_(b.rows_sql(), b.split_cp_sql(), _MONDRIAN, f"x AS (SELECT series, {b.scores_sql()} FROM cp GROUP BY series), m AS (SELECT series, {b.scores_sql()} FROM mond GROUP BY series)")
    + """SELECT x.series, k AS "column", CASE k WHEN 'n' THEN 'tight' WHEN 'picp' THEN 'exact' ELSE 'tight' END AS class FROM x JOIN m ON x.series = m.series, (SELECT unnest(['n', 'picp', 'mpiw', 'winkler']) AS k)
WHERE CASE k WHEN 'n' THEN x.n <> m.n WHEN 'picp' THEN x.picp <> m.picp WHEN 'mpiw' THEN abs(x.mpiw - m.mpiw) > 1e-12 * greatest(abs(x.mpiw), abs(m.mpiw)) ELSE abs(x.winkler - m.winkler) > 1e-12 * greatest(abs(x.winkler), abs(m.winkler)) END""",
)
def table_diff(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    return tb.table_diff(mt.scored(split_cp(rows), b.ALPHA, "series"), mt.scored(mondrian(rows), b.ALPHA, "series"), ["series"]).select("series", "column", "class")
