"""Reports on tables of results: chunks, masks, agreement, display tables, reruns; and panels of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import pick_sql
from ..functions.scalar import d, normal_z
from ..operators import adaptive as ad
from ..operators import chunks as ch
from ..operators import decisions as dc
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import inference as inf
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import quality as ql
from ..operators import tables as tb
from ..sources.session import shared_path
from ..streaming import adaptive as st
from . import base as b
from .experiment_reports import HORIZONS, _scores, core, core_sql, union
from .interval_reports import _BLOCK, _DRAWS, _GROUPED, _GROUPED_FOLD, _MONDRIAN, mondrian, split_cp
from .panel_reports import report
from .summary_reports import _CAP, _capable, _t_sf

_M = "picp mpiw winkler"
_CP = b.with_(b.rows_sql(), b.split_cp_sql())


def _with(*more: str) -> str:
    return b.with_(b.rows_sql(), b.split_cp_sql(), *more)


@report(_with(_CAP) + "SELECT cp.series, bool_and((occ > 0.9::DOUBLE * capacity) = (hi > 0.9::DOUBLE * capacity)) AS identical, count(*) FILTER (WHERE (occ > 0.9::DOUBLE * capacity) <> (hi > 0.9::DOUBLE * capacity)) AS n_different FROM cp JOIN cap ON cap.series = cp.series GROUP BY cp.series")
def policy_masks(spark, sf_dir):
    """Whether two policies withdraw at the same steps."""
    gone = lambda c: F.col(c) > d(0.9) * F.col("capacity")
    return dc.same_masks(_capable(b.rows(spark, sf_dir)), gone("yhat"), gone("upper"), "series")


@report(
    b.with_(b.rows_sql(), f"r AS (SELECT *, lag(occ, 1) OVER w AS l1, avg(occ) OVER p AS rm, count(occ) OVER p AS k FROM fc WINDOW w AS (PARTITION BY series ORDER BY slot), p AS (PARTITION BY series ORDER BY slot ROWS BETWEEN {b.WIDTH} PRECEDING AND 1 PRECEDING))")
    + f"SELECT series, avg(CAST(coalesce(abs(lag_1 - l1) <= 1e-9::DOUBLE, false) OR (lag_1 IS NULL AND l1 IS NULL) AS DOUBLE)) AS lag_agrees, avg(CAST(coalesce(abs(roll_mean - CASE WHEN k = {b.WIDTH} THEN rm END) <= 1e-9::DOUBLE, false) OR (roll_mean IS NULL AND CASE WHEN k = {b.WIDTH} THEN rm END IS NULL) AS DOUBLE)) AS roll_agrees FROM r GROUP BY series",
    "lag_agrees roll_agrees",
)
def rebuilt_agreement(spark, sf_dir):
    """How often features rebuilt over the rows that are left agree with those of the whole panel."""
    rows = b.rows(spark, sf_dir)
    made = ft.rebuilt(rows.withColumn("was_lag", F.col("lag_1")).withColumn("was_roll", F.col("roll_mean")), b.LAGS, b.WIDTH, "series", order="slot")
    return made.groupBy("series").agg(mt.agreement(made, "was_lag", "lag_1").alias("lag_agrees"), mt.agreement(made, "was_roll", "roll_mean").alias("roll_agrees"))


@report(_with() + f"SELECT series, CAST(floor(i / 24) AS BIGINT) AS chunk, {b.scores_sql()} FROM cp GROUP BY 1, 2", _M)
def chunk_scores(spark, sf_dir):
    return mt.scored(ch.row_chunks(split_cp(b.rows(spark, sf_dir)), 24), b.ALPHA, "series", "chunk")


@report(_with() + "SELECT series, bucket, i, y, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY series, bucket ORDER BY slot, i) AS k FROM cp) WHERE k = 1", "y lo hi")
def first_of_each_bucket(spark, sf_dir):
    return tb.first_of_key(split_cp(b.rows(spark, sf_dir)), ["series", "bucket"], ["slot", "i"]).select("series", "bucket", "i", "y", "lo", "hi")


@report(_with(_MONDRIAN) + f"SELECT 'series' AS grain, series, NULL AS bucket, {b.scores_sql()} FROM cp GROUP BY series UNION ALL SELECT 'cell', series, bucket, {b.scores_sql()} FROM mond GROUP BY series, bucket", _M)
def stacked_scores(spark, sf_dir):
    """Tables of different grains, one below the other."""
    rows = b.rows(spark, sf_dir)
    one = mt.scored(split_cp(rows), b.ALPHA, "series").withColumn("grain", F.lit("series"))
    return tb.stacked(one, mt.scored(mondrian(rows), b.ALPHA, "series", "bucket").withColumn("grain", F.lit("cell")))


@report(b.with_(b.panel_sql(), b.features_sql()) + f"SELECT series, {', '.join(f'count({c}) AS n_{c}' for c in [*(f'lag_{k}' for k in b.LAGS), 'roll_mean', 'roll_std'])} FROM f GROUP BY series")
def feature_counts(spark, sf_dir):
    """Readings of the columns with given prefixes."""
    rows = b.featured(b.panel(spark, sf_dir))
    return rows.groupBy("series").agg(*[F.count(c).alias(f"n_{c}") for c in ft.by_prefix(rows, "lag_", "roll_")])


@report(b.with_(b.panel_sql()) + "SELECT series, count(occ) AS n, avg(CASE WHEN occ - 480 < 0 THEN 0 ELSE occ - 480 END) AS mean_floored, min(CASE WHEN occ - 480 < 0 THEN 0 ELSE occ - 480 END) AS least FROM panel GROUP BY series", "mean_floored least")
def floored_readings(spark, sf_dir):
    rows = ft.floored(b.panel(spark, sf_dir).withColumn("occ", F.col("occ") - 480), "occ")
    return rows.groupBy("series").agg(F.count("occ").alias("n"), F.avg("occ").alias("mean_floored"), F.min("occ").alias("least"))


_Z = b.num(normal_z(b.ALPHA))


@report(
    b.with_(b.rows_sql(), "ms AS (SELECT series, avg(y - occ) AS mu, stddev_pop(y - occ) AS sigma FROM fc WHERE split = 'train' GROUP BY series)", f"ga AS (SELECT t.series, y, occ + mu - {_Z} * sigma AS lo, occ + mu + {_Z} * sigma AS hi FROM fc t JOIN ms ON ms.series = t.series WHERE split = 'test')")
    + f"SELECT series, {b.scores_sql()} FROM ga GROUP BY series",
    _M,
)
def gaussian_band_of_changes(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    change = F.col("y") - F.col("occ")
    own = b.part(rows, "train").groupBy("series").agg(F.avg(change).alias("mu"), F.stddev_pop(change).alias("sigma"))
    band = fc.gaussian_band(b.part(rows, "test").join(own, "series"), "mu", "sigma", b.ALPHA)
    return mt.scored(band.withColumnsRenamed({"low": "lo", "high": "hi"}), b.ALPHA, "series")


@report(
    b.with_(b.rows_sql())
    + "SELECT series, max(abs(y - occ)) < 24 AS by_size, max(y - occ) < 24 AS by_greatest, max(y - occ) <= 0 AS none_above FROM fc WHERE split = 'calibration' GROUP BY series",
)
def degenerate_variants(spark, sf_dir):
    """Three rules for series whose calibration scores are nearly 0."""
    cal = b.part(b.rows(spark, sf_dir), "calibration").withColumn("change", F.col("y") - F.col("occ"))
    out = None
    for rule, name in (("size", "by_size"), ("greatest", "by_greatest"), ("none_above", "none_above")):
        one = ql.degenerate(cal, "change", "series", tolerance=24, rule=rule).withColumnRenamed("degenerate", name)
        out = one if out is None else out.join(one, "series")
    return out


_FLAGGED = " UNION ALL ".join(f"SELECT {h} AS horizon, series FROM ({b.with_(b.rows_sql(h))} SELECT * FROM fc) WHERE split = 'test' GROUP BY series HAVING count(DISTINCT y) < 150" for h in HORIZONS)


@report(f"SELECT series, count(*) AS n_horizons, min(horizon) AS first_horizon FROM ({_FLAGGED}) GROUP BY series")
def exclusion_union(spark, sf_dir):
    """Series that are left out at some horizon."""
    found = [ql.low_information(b.part(b.rows(spark, sf_dir, h), "test"), "y", "series", least=150).filter("low_information").select("series", F.lit(h).alias("horizon")) for h in HORIZONS]
    return union(found).groupBy("series").agg(F.count("*").alias("n_horizons"), F.min("horizon").alias("first_horizon"))


@report(_with("few AS (SELECT DISTINCT series FROM fc ORDER BY series LIMIT 4), bad AS (SELECT series FROM cp GROUP BY series HAVING count(DISTINCT y) < 150)") + f"SELECT series, {b.scores_sql()} FROM cp WHERE series IN (SELECT series FROM few) AND series NOT IN (SELECT series FROM bad) GROUP BY series", _M)
def first_series(spark, sf_dir):
    """The first four series by name, before any is left out."""
    rows = b.rows(spark, sf_dir)
    few = rows.select("series").distinct().orderBy("series").limit(4)
    out = split_cp(rows)
    kept = ql.excluded(out.join(few, "series", "left_semi"), ql.low_information(out, "y", "series", least=150), "low_information", "series")
    return mt.scored(kept, b.ALPHA, "series")


# Group-conditional streams in three arms: parts of the day, hours, and one group as control.

_ARMS = {"day_parts": None, "hours": "lpad(CAST(hour AS VARCHAR), 2, '0')", "one_group": "'all'"}


def _arm_sql(label: str | None) -> str:
    rows = b.rows_sql() if label is None else b.rows_sql().replace(f"{b.day_bucket_sql('hour')} AS bucket", f"{label} AS bucket")
    return b.with_(rows, _GROUPED, _GROUPED_FOLD, recursive=True) + "SELECT f.series, f.i, y, greatest(low - q, 0) AS lo, high + q AS hi FROM fold f JOIN gstep s ON f.series = s.series AND f.i = s.i"


@report(" UNION ALL ".join(f"SELECT '{a}' AS arm, series, {b.scores_sql()} FROM ({_arm_sql(x)}) GROUP BY series" for a, x in _ARMS.items()), _M)
def group_arms(spark, sf_dir):
    rows = b.rows(spark, sf_dir)
    labels = {"day_parts": F.col("bucket"), "hours": F.lpad(F.col("hour").cast("string"), 2, "0"), "one_group": F.lit("all")}
    out = []
    for arm, label in labels.items():
        x = rows.withColumn("grp", label)
        iv = ad.grouped_stream(b.calibration(x), b.part(x, "test"), "grp", "series", low="occ", high="occ", alpha=b.ALPHA, horizon=b.HORIZON, gamma=b.GAMMA, least=30)
        out.append(mt.scored(iv, b.ALPHA, "series").withColumn("arm", F.lit(arm)))
    return union(out)


# Display tables.

_TWO = core_sql(b.HORIZON, (0.1, 0.05), (0.1, 0.05))


@report(
    f"WITH c AS (SELECT method, miss, series, {_scores()} FROM ({_TWO}) WHERE rule IS NULL OR rule = 'fixed' GROUP BY 1, 2, 3), m AS (SELECT method, miss, avg(picp) AS picp, stddev_samp(picp) AS sd, avg(mpiw) AS mpiw FROM c GROUP BY 1, 2) "
    + "SELECT method, " + ", ".join(f"max({v}) FILTER (WHERE miss = {b.num(a)}) AS {v}_{n}" for n, a in ((90, 0.1), (95, 0.05)) for v in ("picp", "sd", "mpiw")) + " FROM m GROUP BY method",
    "picp_90 sd_90 mpiw_90 picp_95 sd_95 mpiw_95",
)
def two_levels_in_a_row(spark, sf_dir):
    cells = core(b.rows(spark, sf_dir), b.HORIZON, (0.1, 0.05), (0.1, 0.05)).filter("rule is null or rule = 'fixed'").groupBy("method", "miss", "series").agg(*mt.scores(F.col("miss")))
    one = cells.groupBy("method", "miss").agg(F.avg("picp").alias("picp"), F.stddev_samp("picp").alias("sd"), F.avg("mpiw").alias("mpiw"))
    return one.groupBy("method").agg(*[F.max(F.when(F.col("miss") == d(a), F.col(v))).alias(f"{v}_{n}") for n, a in ((90, 0.1), (95, 0.05)) for v in ("picp", "sd", "mpiw")])


_EFFECTS = f"""SELECT 'exclusion' AS effect, avg(picp) AS before, avg(picp) FILTER (WHERE n_distinct >= 150) AS after FROM (SELECT series, {b.scores_sql()}, count(DISTINCT y) AS n_distinct FROM cp GROUP BY series)
UNION ALL SELECT 'quantile_rule', avg(l.picp), avg(c.picp) FROM (SELECT series, {b.scores_sql()} FROM (SELECT t.series, y, greatest(occ - sc[least({b.rank_sql('len(sc)', b.num(b.ALPHA))} + 1, len(sc))], 0) AS lo, occ + sc[least({b.rank_sql('len(sc)', b.num(b.ALPHA))} + 1, len(sc))] AS hi FROM fc t JOIN scs ON scs.series = t.series WHERE split = 'test') GROUP BY series) l JOIN (SELECT series, {b.scores_sql()} FROM cp GROUP BY series) c ON c.series = l.series"""


@report(_with("scs AS (SELECT series, list_sort(list(abs(y - occ))) AS sc FROM fc WHERE split = 'calibration' GROUP BY series)") + f"SELECT *, after - before AS delta FROM ({_EFFECTS})", "before after delta")
def protocol_effects(spark, sf_dir):
    """Mean coverage before and after two decisions of protocol: leaving series out, and the quantile's rule."""
    from ..functions.scalar import skipping_quantile

    rows = b.rows(spark, sf_dir)
    out = split_cp(rows)
    cells = mt.scored(out, b.ALPHA, "series")
    kept = ql.excluded(cells, ql.low_information(out, "y", "series", least=150), "low_information", "series")
    legacy = mt.scored(split_cp(rows, rule=skipping_quantile), b.ALPHA, "series")
    mean = lambda x, n: x.agg(F.avg("picp").alias(n))  # noqa: E731  one row each
    pairs = [("exclusion", cells, kept), ("quantile_rule", legacy, cells)]
    return union([mean(x, "before").crossJoin(F.broadcast(mean(y, "after"))).select(F.lit(n).alias("effect"), "before", "after", (F.col("after") - F.col("before")).alias("delta")) for n, x, y in pairs])


def _boot(seed: int, name: str) -> str:
    return f"""{name}u AS (SELECT *, {pick_sql(str(seed), 'draw', 'k', f'(n - {_BLOCK} + 1)')} AS p FROM dd), {name}m AS (SELECT u.series, draw, sum(t) / (count(*) * {_BLOCK}) AS mean FROM {name}u u JOIN bs ON bs.series = u.series AND bs.p = u.p GROUP BY 1, 2),
{name} AS (SELECT series, quantile_cont(mean, 0.05) AS ci_lo, quantile_cont(mean, 0.95) AS ci_hi FROM {name}m GROUP BY series)"""


_HITS = f"""hh AS (SELECT series, CASE WHEN y >= lo AND y <= hi THEN 1.0::DOUBLE ELSE 0 END AS hit, row_number() OVER (PARTITION BY series ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY series) AS n FROM cp),
bs AS (SELECT series, p, sum(hit) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN CURRENT ROW AND {_BLOCK - 1} FOLLOWING) AS t FROM hh),
dd AS (SELECT series, n, draw, unnest(range(greatest(1, n // {_BLOCK}))) AS k FROM (SELECT DISTINCT series, n FROM hh WHERE n >= {_BLOCK}), (SELECT unnest(range({_DRAWS})) AS draw))"""


@report(
    _with(_HITS, _boot(42, "ba"), _boot(777_777, "bz"))
    + "SELECT ba.series, ba.ci_lo AS lo_before, bz.ci_lo AS lo_after, bz.ci_lo - ba.ci_lo AS d_lo, bz.ci_hi - ba.ci_hi AS d_hi, abs(bz.ci_lo - ba.ci_lo) <= 0.02 AND abs(bz.ci_hi - ba.ci_hi) <= 0.02 AS within, true AS control_same FROM ba JOIN bz ON bz.series = ba.series",
    "lo_before lo_after d_lo d_hi",
)
def reseeded_bootstrap(spark, sf_dir):
    """Intervals of coverage under two seeds: the mean, the control, must not move, and the ends little."""
    hit = split_cp(b.rows(spark, sf_dir)).withColumn("hit", ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))
    runs = [mt.block_bootstrap(hit, "hit", "i", "series", block=_BLOCK, draws=_DRAWS, seed=s) for s in (42, 777_777)]
    both = tb.aligned(*[r.select("series", "mean", "ci_lo", "ci_hi") for r in runs], ["series"])
    move = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    return both.select("series", F.col("ci_lo_before").alias("lo_before"), F.col("ci_lo_after").alias("lo_after"), move("ci_lo").alias("d_lo"), move("ci_hi").alias("d_hi"), ((F.abs(move("ci_lo")) <= 0.02) & (F.abs(move("ci_hi")) <= 0.02)).alias("within"), (F.abs(move("mean")) <= 1e-12).alias("control_same"))


@report(
    _with(_HITS, _boot(42, "ba"))
    + "SELECT count(*) AS n_entities, stddev_samp(picp) AS sd_picp, min(picp) AS worst_picp, arg_min(series, struct_pack(p := picp, s := series)) AS worst_entity, avg(CAST(ci_lo < 0.9::DOUBLE - 0.02::DOUBLE AS DOUBLE)) AS share_unsafe, avg(CAST(picp < 0.9::DOUBLE AS DOUBLE)) AS share_below, quantile_cont((ci_hi - ci_lo) / 2, 0.5) AS median_half, max((ci_hi - ci_lo) / 2) AS greatest_half, avg(CAST(ci_lo <= 0.9::DOUBLE AND ci_hi >= 0.9::DOUBLE AS DOUBLE)) AS share_containing FROM (SELECT series, avg(hit) AS picp FROM hh GROUP BY series) JOIN ba USING (series)",
    "sd_picp worst_picp share_unsafe share_below median_half greatest_half share_containing",
)
def entity_table(spark, sf_dir):
    """The table of single series: spread, the worst, and what their intervals of coverage say. No equivalence is claimed."""
    hit = split_cp(b.rows(spark, sf_dir)).withColumn("hit", ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))
    return inf.entity_table(mt.block_bootstrap(hit, "hit", "i", "series", block=_BLOCK, draws=_DRAWS), "series")


_STUCK = f"""lv AS (SELECT series, slot, floor(occ / 20) AS level FROM panel), sc1 AS (SELECT *, CASE WHEN lag(slot) OVER w IS NOT NULL AND lag(level) OVER w IS NOT DISTINCT FROM level THEN 0 ELSE 1 END AS new FROM lv WINDOW w AS (PARTITION BY series ORDER BY slot)),
sc2 AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING) AS gid FROM sc1), sc3 AS (SELECT series, count(*) OVER (PARTITION BY series, gid) AS run FROM sc2),
stk AS (SELECT series FROM sc3 GROUP BY series HAVING avg(CAST(run >= 3 AS DOUBLE)) >= 0.015), cz AS (SELECT series, {b.scores_sql()} FROM cp GROUP BY series)"""


@report(_with(_STUCK) + "SELECT 'all' AS roster, count(*) AS n_series, avg(picp) AS picp, avg(winkler) AS winkler FROM cz UNION ALL SELECT 'moving', count(*), avg(picp), avg(winkler) FROM cz WHERE series NOT IN (SELECT series FROM stk)", "picp winkler")
def stuck_impact(spark, sf_dir):
    """Scores with and without series that stand still for long."""
    cells = mt.scored(split_cp(b.rows(spark, sf_dir)), b.ALPHA, "series")
    levels = b.panel(spark, sf_dir).select("series", "slot", F.floor(F.col("occ") / 20).cast("double").alias("level"))
    flags = ql.stuck(pn.run_lengths(levels, "level", "series"), "level", "series", least=3).select("series", (F.col("stuck_share") >= 0.015).alias("stuck"))
    one = lambda x, n: x.agg(F.count("*").alias("n_series"), F.avg("picp").alias("picp"), F.avg("winkler").alias("winkler")).withColumn("roster", F.lit(n))
    return union([one(cells, "all"), one(ql.excluded(cells, flags, "stuck", "series"), "moving")])


@report(
    "WITH s AS (SELECT c_custkey, any_value(c_mktsegment) AS segment, any_value(c_acctbal) AS balance, CAST(count(o_orderkey) AS DOUBLE) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), "
    + "r AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY balance) + (count(*) OVER (PARTITION BY segment, balance) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY segment ORDER BY n) + (count(*) OVER (PARTITION BY segment, n) - 1) / 2.0::DOUBLE AS b FROM s), q AS (SELECT segment, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY segment) "
    + f"SELECT segment, n, rho, 2 * {_t_sf('(abs(rho) * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')} AS p FROM q",
    "rho p",
)
def spearman_test(spark, sf_dir):
    n = b.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"))
    c = b.read(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", F.coalesce("orders", d(0)).alias("orders"))
    return inf.spearman_test(c, "c_acctbal", "orders", "segment")


@report(
    f"SELECT method, rule, miss, horizon, count(*) AS n_entities, sum(picp * n) / sum(n) AS pooled_picp, min(picp) AS worst_picp, sum(picp * n) / sum(n) - min(picp) AS gap FROM ({' UNION ALL '.join(f'SELECT {h} AS horizon, method, rule, miss, series, {_scores()} FROM ({core_sql(h, (0.2, 0.1), (0.1,))}) GROUP BY method, rule, miss, series' for h in HORIZONS)}) GROUP BY ALL",
    "miss pooled_picp worst_picp gap",
)
def pooled_worst_grid(spark, sf_dir):
    """The pooled and the worst coverage of every method, horizon and level."""
    cells = union([core(b.rows(spark, sf_dir, h), h, (0.2, 0.1), (0.1,)).withColumn("horizon", F.lit(h)) for h in HORIZONS]).groupBy("horizon", "method", "rule", "miss", "series").agg(*mt.scores(F.col("miss")))
    one = cells.groupBy("method", "rule", "miss", "horizon").agg(F.count("*").alias("n_entities"), (F.sum(F.col("picp") * F.col("n")) / F.sum("n")).alias("pooled_picp"), F.min("picp").alias("worst_picp"))
    return one.withColumn("gap", F.col("pooled_picp") - F.col("worst_picp"))


@report(
    _with(_MONDRIAN, f"x AS (SELECT series, {b.scores_sql()} FROM cp GROUP BY series), m AS (SELECT series, {b.scores_sql()} FROM mond GROUP BY series)")
    + "SELECT x.series, k AS \"column\", k <> 'picp' AND x.series < 'm' AS excused FROM x JOIN m ON x.series = m.series, (SELECT unnest(['picp', 'winkler']) AS k) WHERE CASE k WHEN 'picp' THEN x.picp <> m.picp ELSE abs(x.winkler - m.winkler) > 1e-12 * greatest(abs(x.winkler), abs(m.winkler)) END",
)
def excused_cells(spark, sf_dir):
    """Differences between two runs, of which some are known: those of the first series are excused, but not exact columns."""
    rows = b.rows(spark, sf_dir)
    made, ref = mt.scored(split_cp(rows), b.ALPHA, "series").select("series", "picp", "winkler"), mt.scored(mondrian(rows), b.ALPHA, "series").select("series", "picp", "winkler")
    known = made.filter("series < 'm'").select("series", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("made")) for c in ("picp", "winkler")])))
    return tb.table_diff(made, ref, ["series"], known).select("series", "column", "excused")


@report("WITH e AS (SELECT DISTINCT ON (event_id) event_type, ts, value FROM events) SELECT event_type AS series, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, avg(value) AS v FROM e WHERE epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 3600000000 GROUP BY 1, 2", "v")
def streamed_panel(spark, sf_dir):
    """Duplicates dropped and windows closed by a watermark, over the events as a stream."""
    rows = b.read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return st.closed_windows(spark, rows, shared_path(spark, "stream-panel"), "event_type", "ts", "value")
