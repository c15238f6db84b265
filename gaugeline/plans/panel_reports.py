"""Reports on panels, features and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import d, day_bucket, day_bucket_sql
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import quality as ql
from ..operators import tables as tb
from ..sources import writers
from . import base as b

QUERIES, ORACLES = {}, {}


def report(sql: str | None = None, doubles: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: b.rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = b.rounded_sql(sql, doubles) if doubles else sql
        return f

    return add


@report(b.with_(b.panel_sql()) + "SELECT series, slot, v, observed FROM dense", "v")
def panel_hourly(spark, sf_dir):
    return b.panel(spark, sf_dir).select("series", "slot", "v", "observed")


@report(b.with_(b.panel_sql(900)) + "SELECT series, slot, occ, NOT observed AND occ IS NOT NULL AS occ_interpolated FROM panel", "occ")
def panel_interpolated(spark, sf_dir):
    return b.panel(spark, sf_dir, 900).select("series", "slot", "occ", (~F.col("observed") & F.col("occ").isNotNull()).alias("occ_interpolated"))


_F = "lag_1, lag_2, lag_3, lag_6, roll_mean, roll_std, y_3, y_interpolated_3"


@report(b.with_(b.panel_sql(), b.features_sql()) + f"SELECT series, slot, occ, {_F} FROM f", "occ lag_1 lag_2 lag_3 lag_6 roll_mean roll_std y_3")
def features_lag_roll(spark, sf_dir):
    out = ft.targets(ft.rolling(ft.lagged(b.panel(spark, sf_dir), b.LAGS), b.WIDTH), [b.HORIZON])
    return out.select("series", "slot", "occ", *_F.split(", "))


@report(b.with_(b.panel_sql(6 * 3600, "user_id"), b.features_sql()) + "SELECT series, count(*) AS n, count(lag_1) AS n_lag, avg(lag_1) AS mean_lag, count(roll_mean) AS n_roll, avg(roll_mean) AS mean_roll FROM f GROUP BY series", "mean_lag mean_roll")
def features_by_user(spark, sf_dir):
    """Panels and features of many series: as many tasks as there are users."""
    rows = ft.rolling(ft.lagged(b.panel(spark, sf_dir, 6 * pn.HOUR, F.col("user_id")), (1,)), b.WIDTH)
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.count("lag_1").alias("n_lag"), F.avg("lag_1").alias("mean_lag"), F.count("roll_mean").alias("n_roll"), F.avg("roll_mean").alias("mean_roll"))


@report(b.with_(b.panel_sql(), b.features_sql()) + f"SELECT series, slot, tod_sin, tod_cos, dow, CAST(dow >= 5 AS BIGINT) AS is_weekend, CAST((slot // 24) % 30 = 5 AS BIGINT) AS is_holiday, {day_bucket_sql('hour')} AS bucket FROM f", "tod_sin tod_cos")
def calendar_features(spark, sf_dir):
    p = b.panel(spark, sf_dir)
    days = p.select(F.to_date(pn.slot_time()).alias("day"), F.floor(F.col("slot") / 24).alias("n")).filter("n % 30 = 5").select("day").distinct()
    return ft.calendar(p, days).select("series", "slot", "tod_sin", "tod_cos", "dow", "is_weekend", "is_holiday", day_bucket(F.hour(pn.slot_time())).alias("bucket"))


@report(b.with_(b.panel_sql(), b.features_sql()) + "SELECT series, slot, slot + 3 AS target_slot, split, split_ok, embargo_ok, split_ok AND embargo_ok AS use FROM guarded")
def split_embargo_flags(spark, sf_dir):
    return b.featured(b.panel(spark, sf_dir)).select("series", "slot", (F.col("slot") + b.HORIZON).alias("target_slot"), "split", "split_ok", "embargo_ok", "use")


@report(f"""WITH r AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, epoch_us(ts) AS us, value FROM events WHERE hour(ts) BETWEEN 7 AND 16),
s AS (SELECT series, day, min(us) // 3600000000 AS lo, (max(us) + 3599999999) // 3600000000 AS hi FROM r GROUP BY series, day),
c AS (SELECT series, day, us // 3600000000 AS slot, {b.grained_sql('avg(value)')} AS v FROM r GROUP BY 1, 2, 3),
g AS (SELECT series, day, unnest(generate_series(lo, hi)) AS slot FROM s WHERE hi > lo)
SELECT g.series, CAST(g.day AS VARCHAR) AS day, g.slot, v, v IS NOT NULL AS observed FROM g LEFT JOIN c ON g.series = c.series AND g.day = c.day AND g.slot = c.slot""", "v")
def session_panel(spark, sf_dir):
    out = pn.session_grid(b.read(spark, sf_dir, "events"), F.col("event_type"), "ts", "value")
    return out.select("series", F.col("day").cast("string").alias("day"), "slot", "v", "observed")


@report("SELECT l_suppkey, count(DISTINCT l_linenumber) AS n_lines, count(DISTINCT l_linenumber) < 10 AS lines_low, count(DISTINCT l_quantity) AS n_quantities, count(DISTINCT l_quantity) < 10 AS quantities_low FROM lineitem GROUP BY l_suppkey")
def distinct_reading_quality(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    one = ql.low_information(li, "l_linenumber", "l_suppkey").withColumnsRenamed({"n_distinct": "n_lines", "low_information": "lines_low"})
    two = ql.low_information(li, "l_quantity", "l_suppkey").withColumnsRenamed({"n_distinct": "n_quantities", "low_information": "quantities_low"})
    return one.join(two, "l_suppkey")


@report(b.with_(b.rows_sql()) + "SELECT series, stddev_samp(occ) FILTER (WHERE split = 'train') AS train_sd, stddev_samp(occ) FILTER (WHERE split = 'train') >= 5 AS dynamic FROM fc GROUP BY series", "train_sd")
def dynamic_flag(spark, sf_dir):
    return ql.dynamic(b.rows(spark, sf_dir), "occ", "series")


@report(b.with_(b.rows_sql()) + """SELECT series, n_train, n_calibration, n_test, CASE WHEN n_train >= 100 AND n_calibration >= 50 AND n_test >= 50 THEN 'ok' ELSE 'SKIPPED-thin' END AS status
FROM (SELECT series, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'calibration') AS n_calibration, count(*) FILTER (WHERE split = 'test') AS n_test FROM fc GROUP BY series)""")
def thin_guard(spark, sf_dir):
    return ql.thin(b.rows(spark, sf_dir), "series")


_RUNS = """p AS (SELECT series, slot, floor(occ / 20) AS level FROM panel),
c AS (SELECT *, CASE WHEN lag(slot) OVER w IS NOT NULL AND lag(level) OVER w IS NOT DISTINCT FROM level THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY series ORDER BY slot)),
g AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING) AS gid FROM c),
r AS (SELECT *, count(*) OVER (PARTITION BY series, gid) AS run FROM g),
m AS (SELECT series, max(c) / sum(c) AS modal_share FROM (SELECT series, level, CAST(count(*) AS DOUBLE) AS c FROM r WHERE level IS NOT NULL GROUP BY series, level) GROUP BY series)"""


@report(b.with_(b.panel_sql(), _RUNS) + "SELECT r.series, count(*) AS n, avg(CAST(run >= 3 AS DOUBLE)) AS stuck_share, avg(CAST(level = 0 AS DOUBLE)) AS zero_share, max(run) AS max_run, any_value(modal_share) AS modal_share FROM r JOIN m ON r.series = m.series GROUP BY r.series", "stuck_share zero_share modal_share")
def run_length_diagnostic(spark, sf_dir):
    levels = b.panel(spark, sf_dir).select("series", "slot", F.floor(F.col("occ") / 20).cast("double").alias("level"))
    return ql.stuck(pn.run_lengths(levels, "level", "series"), "level", "series", least=3)


@report("""WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 60e6 AS minutes FROM events)
SELECT event_type, count(*) AS n, quantile_cont(minutes, 0.5) AS median_minutes, count(*) FILTER (WHERE minutes > 30) AS n_gaps FROM g GROUP BY event_type""", "median_minutes")
def interarrival_gaps(spark, sf_dir):
    return pn.arrivals(b.read(spark, sf_dir, "events"), "event_type", "ts", 30.0)


@report(b.with_(b.panel_sql()) + "SELECT series, slot // 24 AS day, count(*) AS n_slots, count(*) FILTER (WHERE observed) AS n_observed, count(*) FILTER (WHERE observed) / 24.0::DOUBLE AS share_of_day, count(DISTINCT CASE WHEN observed THEN slot % 24 END) AS n_hours FROM panel GROUP BY 1, 2", "share_of_day")
def daily_coverage(spark, sf_dir):
    p = b.panel(spark, sf_dir).withColumn("day", F.floor(F.col("slot") / 24))
    return p.groupBy("series", "day").agg(F.count("*").alias("n_slots"), F.count_if("observed").alias("n_observed"), (F.count_if("observed") / d(24)).alias("share_of_day"), F.countDistinct(F.when(F.col("observed"), F.col("slot") % 24)).alias("n_hours"))


@report(b.with_(b.rows_sql()) + "SELECT series, split, count(*) AS n, avg(abs(y - occ)) AS mae, sqrt(avg((y - occ) * (y - occ))) AS rmse FROM fc GROUP BY series, split", "mae rmse")
def persistence_base_metrics(spark, sf_dir):
    return mt.point_errors(b.rows(spark, sf_dir), "y", "occ", "series", "split")


@report(b.with_(b.rows_sql()) + """, t AS (SELECT series, quantile_cont(occ, 1 / 3.0::DOUBLE) AS q1, quantile_cont(occ, 2 / 3.0::DOUBLE) AS q2 FROM fc WHERE split = 'train' GROUP BY series)
SELECT fc.series, split, CASE WHEN occ <= q1 THEN 'low' WHEN occ <= q2 THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, avg(occ) AS mean_occ FROM fc JOIN t ON fc.series = t.series GROUP BY 1, 2, 3""", "mean_occ")
def occupancy_terciles(spark, sf_dir):
    return ft.terciles(b.rows(spark, sf_dir), "occ", "series").groupBy("series", "split", "tercile").agg(F.count("*").alias("n"), F.avg("occ").alias("mean_occ"))


@report(b.with_(b.panel_sql(), b.features_sql()) + "SELECT count(*) AS rows, count(DISTINCT series) AS series, count(*) FILTER (WHERE split = 'train') AS rows_train, count(*) FILTER (WHERE split = 'calibration') AS rows_calibration, count(*) FILTER (WHERE split = 'test') AS rows_test, count(*) FILTER (WHERE occ IS NULL) AS null_occ, count(*) FILTER (WHERE y_3 IS NULL) AS null_y_3 FROM parts")
def run_report(spark, sf_dir):
    one = writers.report(b.featured(b.panel(spark, sf_dir)), "series", "split", ["occ", "y_3"])
    names = ["rows", "series", "rows_train", "rows_calibration", "rows_test", "null_occ", "null_y_3"]
    return one.select(F.from_json("report", ", ".join(f"`{n}` long" for n in names)).alias("r")).select("r.*")


@report(b.with_(b.rows_sql()) + """SELECT series, count(*) AS n, avg(occ) AS mean, stddev_samp(occ) AS sd, stddev_pop(occ) AS sd_pop, min(occ) AS low, max(occ) AS high, median(occ) AS median, count(DISTINCT dow) AS n_dow, string_agg(DISTINCT bucket, ';' ORDER BY bucket) AS buckets, max_by(slot, struct_pack(o := occ, s := -slot)) AS peak_slot,
 sum(occ * (i + 1)) / sum(i + 1) AS weighted FROM fc WHERE split = 'test' GROUP BY series""", "mean sd sd_pop low high median weighted")
def series_summary(spark, sf_dir):
    t = b.part(b.rows(spark, sf_dir), "test")
    return t.groupBy("series").agg(F.count("*").alias("n"), F.avg("occ").alias("mean"), F.stddev_samp("occ").alias("sd"), F.stddev_pop("occ").alias("sd_pop"), F.min("occ").alias("low"), F.max("occ").alias("high"), F.percentile("occ", F.lit(0.5)).alias("median"), F.countDistinct("dow").alias("n_dow"), F.array_join(F.array_sort(F.collect_set("bucket")), ";").alias("buckets"), F.max_by("slot", F.struct("occ", -F.col("slot"))).alias("peak_slot"), (F.sum(F.col("occ") * (F.col("i") + 1)) / F.sum(F.col("i") + 1)).alias("weighted"))


@report(b.with_(b.rows_sql()) + ", w AS (SELECT min(occ) AS lo, max(occ) AS hi FROM fc) SELECT CAST(greatest(1, least(8, ceil((occ - lo) / ((hi - lo) / 8)))) AS INTEGER) AS bin, count(*) AS n, avg(y - occ) AS mean_change FROM fc, w GROUP BY 1", "mean_change")
def binned_changes(spark, sf_dir):
    from ..functions.scalar import right_closed_bin

    r = b.rows(spark, sf_dir)
    ends = r.agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"))
    return r.crossJoin(F.broadcast(ends)).groupBy(right_closed_bin(F.col("occ"), F.col("lo"), F.col("hi"), 8).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("occ")).alias("mean_change"))


@report(b.with_(b.rows_sql()) + """SELECT series, day AS chunk, min(i) AS chunk_start, max(i) + 1 AS chunk_end, least(n, greatest(0, max(max(i) + 1 - 3 + 1) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING))) AS released
FROM (SELECT *, slot // 24 AS day, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE split = 'test') GROUP BY series, day, n""")
def matured_releases(spark, sf_dir):
    from ..operators import chunks

    t = b.part(b.rows(spark, sf_dir), "test")
    days = chunks.day_chunks(t, F.floor(F.col("slot") / 24), "series")
    return chunks.matured(days.join(t.groupBy("series").agg(F.count("*").alias("n")), "series"), 3, "series").drop("n")


@report(b.with_(b.panel_sql()) + ", n AS (SELECT count(DISTINCT series) AS n FROM panel) SELECT slot FROM panel, n WHERE observed GROUP BY slot, n.n HAVING count(DISTINCT series) = n.n")
def common_slots(spark, sf_dir):
    return tb.in_all(b.panel(spark, sf_dir).filter("observed"), "slot", "series")
