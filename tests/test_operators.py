"""Properties of the library's operators, on small made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import distributions as ds
from gaugeline.functions.scalar import conformal_quantile, projected, skipping_quantile
from gaugeline.operators import adaptive, chunks, conformal, decisions, features, forecast, inference, metrics, panel, partitions, quality, spatial, tables
from gaugeline.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n", [1, 2, 10, 19, 52, 200])
@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.2, 0.5])
def test_conformal_quantile_is_an_order_statistic(spark, n, alpha):
    x = [random.Random(n).random() for _ in range(n)]
    k = min(math.ceil((n + 1) * (1 - alpha)), n)
    lit = F.array(*map(F.lit, x))
    assert one(spark, conformal_quantile(lit, alpha)) == sorted(x)[k - 1]
    assert one(spark, skipping_quantile(lit, alpha)) == sorted(x)[min(k, n - 1)]


def test_level_is_projected(spark):
    assert one(spark, projected(F.lit(-0.2))) == 1e-3
    assert one(spark, projected(F.lit(1.2))) == 1 - 1e-3


def series(spark, n_cal, n_test, seed=1, shift=1.0, name="s"):
    rng = np.random.default_rng(seed)
    rows = [(name, "calibration", i, 50.0, 50.0 + rng.normal(), "abc"[i % 3]) for i in range(n_cal)]
    rows += [(name, "test", i, 50.0, 50.0 + (shift if i > n_test // 3 else 1.0) * rng.normal(), "abc"[(i * 7) % 3]) for i in range(n_test)]
    df = spark.createDataFrame([(a, b, c, float(f), float(y), g) for a, b, c, f, y, g in rows], "series string, split string, i long, f double, y double, grp string")
    return df.filter("split = 'calibration'").withColumn("score", F.abs(F.col("y") - F.col("f"))), df.filter("split = 'test'")


@pytest.mark.parametrize("horizon", [1, 3, 6])
def test_fold_equals_replay_and_sorted_engine(spark, horizon):
    cal, test = series(spark, 60, 150, shift=3.0)
    how = {"low": "f", "high": "f", "horizon": horizon, "gamma": 0.05}
    a = adaptive.stream(cal, test, "series", **how).orderBy("i").collect()
    b = adaptive.stream(cal, test, "series", engine="fold", **how).orderBy("i").collect()
    assert [(r.alpha, r.q, r.lo, r.hi) for r in a] == [(r.alpha, r.q, r.lo, r.hi) for r in b]
    scores = [r.score for r in cal.orderBy("i").collect()]
    level, pool, queue = 0.1, list(scores), {}
    for i, r in enumerate(test.orderBy("i").collect()):
        for s, m in queue.pop(i, []):
            pool.append(s)
            level = min(max(level + 0.05 * (0.1 - m), 1e-3), 1 - 1e-3)
        last = sorted(pool[-len(scores):])
        q = last[min(math.ceil((len(last) + 1) * (1 - level)), len(last)) - 1]
        assert (a[i].alpha, a[i].q) == (level, q)
        queue.setdefault(i + horizon, []).append((abs(r.y - r.f), 0 if r.f - q <= r.y <= r.f + q else 1))


@pytest.mark.parametrize(("window", "bounds"), [(None, None), (20, (0.2, 0.8)), (500, (1e-3, 1 - 1e-3))])
def test_engines_agree_on_several_series_in_small_batches(spark, window, bounds):
    parts = [series(spark, n, m, seed=n, shift=2.0, name=f"s{n}") for n, m in ((40, 90), (1, 30), (25, 60))]
    cal, test = (x.unionByName(y).unionByName(z) for x, y, z in zip(*parts, strict=True))
    lone = series(spark, 0, 10, name="no calibration")[1]
    test = test.unionByName(lone).unionByName(test.limit(1).withColumn("y", F.lit(None).cast("double")))
    cal = cal.unionByName(cal.limit(1).withColumn("score", F.lit(None).cast("double")))
    rows = []
    for size, engine in (("7", "sorted"), ("10000", "fold")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = adaptive.stream(cal, test, "series", low="f", high="f", horizon=3, gamma=0.4, window=window, bounds=bounds, engine=engine)
        rows.append(sorted((r.series, r.i, r.alpha, r.q, r.lo, r.hi) for r in out.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert repr(rows[0]) == repr(rows[1])
    assert len(rows[0]) == 180


def test_groups_have_pools_and_levels_of_their_own(spark):
    cal, test = series(spark, 70, 120, shift=3.0)
    got = adaptive.grouped_stream(cal, test, "grp", "series", low="f", high="f", horizon=4, gamma=0.1, least=24).orderBy("i").collect()
    scores = [(r.grp, r.score) for r in cal.orderBy("i").collect()]
    pools, width, level = {}, {}, dict.fromkeys("abc", 0.1)
    for g in "abc":
        own = [s for x, s in scores if x == g]
        pools[g] = own + [s for _, s in scores] if len(own) < 24 else own
        width[g] = len(pools[g])
    late = []
    for i, r in enumerate(test.orderBy("i").collect()):
        if i >= 4:
            g, s, m = late[i - 4]
            pools[g].append(s)
            level[g] = min(max(level[g] + 0.1 * (0.1 - m), 1e-3), 1 - 1e-3)
        last = sorted(pools[r.grp][-width[r.grp] :])
        q = last[min(math.ceil((len(last) + 1) * (1 - level[r.grp])), len(last)) - 1]
        assert (got[i].grp, got[i].alpha, got[i].q) == (r.grp, level[r.grp], q)
        late.append((r.grp, abs(r.y - r.f), 0 if r.f - q <= r.y <= r.f + q else 1))


def test_a_long_series_takes_linear_time():
    import time

    def seconds(n):
        rng = np.random.default_rng(1)
        y = rng.normal(size=n).tolist()
        series, began = adaptive.Replay([(None, abs(v)) for v in rng.normal(size=1000).tolist()], list(adaptive.GAMMAS), 0.1, 3), time.process_time()
        for v in y:
            series.step(0.0, 0.0, v)
        assert len(series.pools[None].kept) == 1000
        assert len(series.waiting) == 3
        return time.process_time() - began

    short, long_ = seconds(20_000), seconds(100_000)
    assert long_ < 8 * short


def test_no_lookahead(spark):
    cal, test = series(spark, 60, 80)
    late = test.withColumn("y", F.when(F.col("i") == 40, F.col("y") + 50).otherwise(F.col("y")))
    a, b = ([(r.lo, r.hi) for r in adaptive.stream(cal, t, "series", low="f", high="f", horizon=3).orderBy("i").collect()] for t in (test, late))
    assert a[:43] == b[:43]
    assert a[43:] != b[43:]


def test_adaptive_recovers_from_a_shift(spark):
    cal, test = series(spark, 200, 900, shift=3.0)
    out = adaptive.stream(cal, test, "series", low="f", high="f", horizon=1)
    fixed = conformal.banded(test, conformal.margins(cal, "score", 0.1, "series"), "f", "f", "series")
    cover = [x.filter("i > 500").agg(F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))).first()[0] for x in (out, fixed)]
    assert abs(cover[0] - 0.9) < 0.03
    assert cover[1] < 0.85


def test_one_group_reduces_to_the_plain_stream(spark):
    cal, test = series(spark, 60, 60)
    one_group = [x.withColumn("grp", F.lit("a")) for x in (cal, test)]
    a = adaptive.grouped_stream(*one_group, "grp", "series", low="f", high="f", horizon=3).orderBy("i").collect()
    b = adaptive.stream(cal, test, "series", low="f", high="f", horizon=3).orderBy("i").collect()
    assert [(r.alpha, r.q) for r in a] == [(r.alpha, r.q) for r in b]


def test_interpolation_fills_the_first_slots_of_inner_gaps(spark):
    cells = spark.createDataFrame([("a", 0, 0.0), ("a", 5, 10.0), ("a", 6, None)], "series string, slot long, v double")
    got = [r.occ for r in panel.interpolated(panel.dense(cells), 2).orderBy("slot").collect()]
    assert got == [0.0, 2.0, 4.0, None, None, 10.0, None]


def test_rolling_needs_all_rows(spark):
    df = spark.createDataFrame([("a", i, float(i) if i != 2 else None) for i in range(8)], "series string, slot long, occ double")
    got = [r.roll_mean for r in features.rolling(df, 2).orderBy("slot").collect()]
    assert got == [None, None, 0.5, None, None, 3.5, 4.5, 5.5]


def test_embargo_is_strict_and_targets_stay_in_their_split(spark):
    df = spark.createDataFrame([("a", i) for i in range(181)], "series string, slot long")
    out = features.guards(features.fractional_split(df), 3).collect()
    assert sum(r.split == "train" for r in out) == 101
    assert all(r.embargo_ok for r in out if r.split == "train")
    assert sum(not r.embargo_ok for r in out) == 6
    assert sum(not r.split_ok for r in out) == 6


def test_run_lengths_and_low_information(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, None, None, 2.0, 1.0])], "series string, slot long, v double")
    assert [r.run for r in panel.run_lengths(df, "v", "series").orderBy("slot").collect()] == [2, 2, 2, 2, 1, 1]
    assert quality.low_information(df, "v", "series").first().low_information
    many = spark.range(12).selectExpr("'b' AS series", "double(id) AS v")
    assert not quality.low_information(many, "v", "series").first().low_information


def test_crossing_ends_meet(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 3.0), (2.0, 4.0)], "low double, high double")
    rows = conformal.uncrossed(df, "low", "high").collect()
    assert [(r.low, r.high, r.crossed) for r in rows] == [(1.0, 2.0, False), (4.0, 4.0, True), (2.0, 4.0, False)]


def test_chunks_cover_the_stream_and_release_in_time(spark):
    days = [37, 52, 41, 48]
    rows = [("a", i, d) for i, d in enumerate(d for d, n in enumerate(days) for _ in range(n))]
    df = spark.createDataFrame(rows, "series string, i long, day long")
    for h in (1, 2, 3, 6):
        got = chunks.matured(chunks.day_chunks(df, F.col("day"), "series").withColumn("n", F.lit(len(rows))), h, "series").orderBy("chunk").collect()
        assert [r.chunk_start for r in got] == [0, 37, 89, 130]
        assert [r.released for r in got] == [e - h + 1 for e in (37, 89, 130, 178)]


def test_scores_and_bootstrap(spark):
    df = spark.createDataFrame([("a", i, 5.0, 4.0, 6.0 if i % 10 else 4.5) for i in range(200)], "series string, i long, y double, lo double, hi double")
    r = metrics.scored(df, 0.1, "series").first()
    assert (r.n, round(r.picp, 6), round(r.mpiw, 6), round(r.winkler, 6)) == (200, 0.9, 1.85, 2.85)
    hits = df.withColumn("hit", (F.col("y") <= F.col("hi")).cast("double"))
    ci = metrics.block_bootstrap(hits, "hit", "i", "series", block=10, draws=2000).first()
    assert ci.ci_lo <= 0.9 <= ci.ci_hi
    assert metrics.block_bootstrap(hits.limit(5), "hit", "i", "series", block=10).first().ci_lo is None
    assert metrics.block_length(5) == 36
    assert metrics.block_length(30) == 6


def test_distributions():
    assert abs(ds.t_quantile(0.95, 20) - 1.724718) < 1e-5
    assert abs(ds.t_sf(2.0, 10) - 0.036694) < 1e-6
    assert ds.wilcoxon([float(i + 1) for i in range(20)] + [-0.5])[1] == 4 / 2**21
    assert math.isnan(ds.wilcoxon([0.0])[1])


def test_holm_never_falls(spark):
    df = spark.createDataFrame([("f", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "family string, contrast string, p double")
    rows = inference.holm(df, "p", "family").orderBy(F.col("p").asc_nulls_last()).collect()
    assert [None if r.p_holm is None else round(r.p_holm, 6) for r in rows] == [0.02, 0.03, 0.06, 0.06, None]


def test_rank_correlation_and_contrasts(spark):
    df = spark.createDataFrame([("g", float(i // 2), float((i * i) % 11)) for i in range(20)], "g string, a double, b double")
    r = inference.spearman_test(df, "a", "b", "g").first()
    a, b = np.array([i // 2 for i in range(20)]), np.array([(i * i) % 11 for i in range(20)])
    rank = lambda x: np.array([(np.sum(x < v) + np.sum(x <= v) + 1) / 2 for v in x])
    assert abs(r.rho - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-12
    assert 0 <= r.p <= 1
    rows = [(f"s{i}", arm, float(i + (arm == "x") * (1 + i / 10))) for i in range(12) for arm in ("x", "y")]
    out = inference.contrasts(spark.createDataFrame(rows, "entity string, arm string, v double").withColumn("family", F.lit("D")), "v", "arm", [("x", "y")], "entity", "family", draws=500).first()
    assert out.n == 12
    assert out.wilcoxon_p == 2 / 2**12


def test_interval_policy_withdraws_whenever_point_does(spark):
    sites = spark.createDataFrame([(i, 44.7 + i / 100, 20.4, 50.0, 40.0 + i, 42.0 + i, 1.0, 45.0) for i in range(15)], "site long, lat double, lon double, capacity double, yhat double, upper double, margin double, y double")
    req = decisions.demand(spark, 2, 100, [(44.75, 20.4)], (44.7, 44.85, 20.3, 20.5))
    assert req.count() == 200
    out = decisions.allocated(req, sites, None, "seed", "request").collect()
    by = {(r.seed, r.request, r.policy): r for r in out}
    assert len(by) == 600
    assert all(by[s, q, "POINT"].km <= by[s, q, "INTERVAL"].km for s, q, p in by if p == "INTERVAL" and by[s, q, p].site is not None)


def test_cramers_v_and_partitions(spark):
    df = spark.createDataFrame([("s", str(i % 2), str(i % 2), 1.0, 0.0, 2.0, i) for i in range(40)], "series string, a string, b string, y double, lo double, hi double, i long")
    assert abs(partitions.cramers_v(df, "a", "b", "series").first().cramers_v - 1) < 1e-12
    assert partitions.cramers_v(df.withColumn("b", F.lit("x")), "a", "b", "series").first().cramers_v is None
    cells = partitions.partition_cells(df, {"a": F.col("a"), "chance": partitions.hashed_label(F.col("i"))}, 0.1, "series")
    assert sum(r.n for r in cells.collect()) == 80


def test_spatial_statistics(spark):
    sites = spark.createDataFrame([(i, 44.0 + i / 50, 20.0) for i in range(8)], "site long, lat double, lon double")
    values = spark.createDataFrame([(i, float(i)) for i in range(8)], "site long, v double")
    pairs = spatial.distances(sites)
    assert pairs.count() == 28
    assert spatial.morans_i(pairs, values, "v").first().moran_i > 0
    tests = spatial.permutation_tests(pairs.withColumn("r", -F.col("km")), values, "v", 99, 99).first()
    assert abs(tests.mantel_r + 1) < 1e-9
    assert tests.mantel_p <= 0.02


def test_table_diff_notices_what_differs(spark):
    a = spark.createDataFrame([("x", 0.5, 1.0), ("y", 0.6, 2.0), ("z", 0.1, 1.0)], "k string, picp double, mpiw double")
    b = spark.createDataFrame([("x", 0.5, 1.0 + 1e-14), ("y", 0.6 + 1e-13, 2.0), ("w", 0.1, 1.0)], "k string, picp double, mpiw double")
    assert {(r.k, r["column"]) for r in tables.table_diff(a, b, ["k"]).collect()} == {("y", "picp"), ("z", "*"), ("w", "*")}
    tables.assert_gate(a, a, ["k"])
    with pytest.raises(AssertionError):
        tables.assert_gate(a, b, ["k"])


def test_learners_and_bands(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x = float(rng.normal())
        rows.append(("s", i, "train" if i < 120 else "calibration" if i < 180 else "test", x, 10.0, 10 + 2 * x + float(rng.normal()) * 0.1))
    df = spark.createDataFrame(rows, "series string, i long, split string, x double, occ double, y double")
    for name, options in (("ridge", {}), ("forest", {"trees": 10}), ("boosting", {"rounds": 60})):
        out = forecast.fitted(df, ["x"], "y", "occ", name, "series", **options).filter("split = 'test'")
        assert metrics.point_errors(out, "y", "yhat", "series").first().mae < 0.5
    band = forecast.fitted_band(df, ["x"], "y", "occ", 0.1, "series", rounds=60)
    assert metrics.scored(band.filter("split = 'test'").selectExpr("series", "y", "low AS lo", "high AS hi"), 0.1, "series").first().picp > 0.7
    bad = forecast.fitted(df.withColumn("x", F.lit(None).cast("double")), ["x"], "y", "occ", "ridge", "series")
    assert bad.select("status").distinct().count() == 1
    out = chunks.ensemble_intervals(df.withColumn("day", F.floor(F.col("i") / 20)), ["x"], "y", "occ", "day", "series", members=8, trees=1, horizon=2)
    assert out.count() == 60


def test_readers_and_writers(spark, tmp_path):
    wide = tmp_path / "wide.csv"
    wide.write_text("t\nx\ny\n,Alpha,Beta\nSat Mar 2017 04 15:00:59,1,2\n,3,4\nSun Mar 2017 05 00:05:00,,x7\n")
    rows = readers.wide_feed(spark, str(wide)).orderBy("time", "series_id").collect()
    assert [(str(r.time), r.series_id, r.series, r.reading) for r in rows] == [("2017-03-04 15:00:59", 1, "Alpha", 1.0), ("2017-03-04 15:00:59", 2, "Beta", 2.0), ("2017-03-05 00:05:00", 1, "Alpha", None), ("2017-03-05 00:05:00", 2, "Beta", None)]
    coords = tmp_path / "c.csv"
    coords.write_text(",id,lon,lat\n,1,20.4,44.8\n,x,1,2\n")
    assert [tuple(r) for r in readers.coordinates(spark, str(coords)).collect()] == [(1, 20.4, 44.8)]
    feed = tmp_path / "f.csv"
    feed.write_text("name,capacity,occupancy\nb,10,5\na,0,3\nb,10,20\n")
    df = readers.sorted_ids(readers.with_rate(readers.headed(spark, str(feed), {"name": "string", "capacity": "double", "occupancy": "double"})), "name")
    assert {(r.name, r.series_id, r.occupancy_rate) for r in df.collect()} == {("a", 1, None), ("b", 2, 0.5), ("b", 2, 1.0)}
    with pytest.raises(readers.MissingInput):
        readers.headed(spark, str(feed), {"other": "string"})
    with pytest.raises(readers.MissingInput):
        readers.require(spark, str(tmp_path / "none"))
    assert readers.first_of(spark, str(tmp_path / "none"), str(feed)) == str(feed)
    out = str(tmp_path / "units")
    units = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, v long")
    assert writers.missing_units(units, out, ["unit"]).count() == 2
    writers.resume(units.filter("unit = 'a'"), out, ["unit"])
    assert [r.unit for r in writers.missing_units(units, out, ["unit"]).collect()] == ["b"]
    writers.resume(units.withColumn("v", F.col("v") * 10), out, ["unit"])
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [10, 20]
    writers.text_table(units, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert writers.cached(units, str(tmp_path / "cache")).count() == writers.cached(units, str(tmp_path / "cache")).count() == 2


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    from gaugeline.streaming import adaptive as st

    cal, test = series(spark, 50, 60)
    rows = cal.withColumn("slot", F.col("i")).drop("score").unionByName(test.withColumn("slot", F.col("i") + 50)).withColumn("low", F.col("f")).withColumn("high", F.col("f"))
    want = [(r.i, r.alpha, r.q) for r in adaptive.stream(cal, test, "series", low="f", high="f", horizon=2).orderBy("i").collect()]
    for parts in (1, 5):
        out = st.replay(spark, rows, str(tmp_path / f"p{parts}"), parts, horizon=2)
        assert [(r.i, r.alpha, r.q) for r in out.orderBy("i").collect()] == want


def test_allocation_equals_all_pairs_anywhere_on_the_globe(spark):
    """The grid's answer against distances to all sites: cities, poles, the date line, slots, ties and places far away."""
    draw = random.Random(4)
    km = lambda a, b, c, e: 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2)))
    spots = {
        "city": lambda: (44.75 + draw.random() * 0.3, 20.4 + draw.random() * 0.3),
        "line": lambda: (draw.uniform(-1, 1), draw.choice([179.9, -179.9]) + draw.uniform(-0.09, 0.09)),
        "pole": lambda: (90 - draw.random(), draw.uniform(-180, 180)),
        "globe": lambda: (draw.uniform(-90, 90), draw.uniform(-180, 180)),
        "grid": lambda: (44 + draw.randint(0, 3) * 0.01, 20 + draw.randint(0, 3) * 0.01),
    }
    for name, spot in spots.items():
        sites = [(i, draw.randint(0, 1), *spot(), float(draw.randint(10, 30)), float(draw.randint(5, 32)), float(draw.randint(0, 40))) for i in range(draw.choice([1, 40, 120]))]
        asked = [(i, draw.randint(0, 2), *(spots["globe"]() if i % 10 == 0 else spot())) for i in range(120)] + [(500, 0, None, None)]
        s = spark.createDataFrame(sites, "site int, slot int, lat double, lon double, capacity double, yhat double, y double").withColumn("upper", F.col("yhat") + 3).withColumn("margin", F.lit(2.0))
        r = spark.createDataFrame(asked, "request int, slot int, lat double, lon double")
        got = {(x.request, x.policy): (x.site, x.km) for x in decisions.allocated(r, s, None, "request").collect()}
        assert len(got) == 3 * len(asked)
        for q, slot, lat, lon in asked:
            for policy, ahead in (("POINT", 0), ("INTERVAL", 3), ("MARGIN", 2)):
                near = [] if lat is None else sorted((round(km(lat, lon, c, e), 9), i) for i, t, c, e, cap, f, _ in sites if t == slot and cap - f - ahead >= 1)
                site, far = got[q, policy]
                if not near:
                    assert site is None, name
                else:
                    assert abs(far - near[0][0]) < 1e-6, name
                    assert site in [i for k, i in near if k < near[0][0] + 1e-6], name
        dealt = {(x.request, x.policy): (x.site, x.km) for x in decisions.allocated(r, s, None, "request", send=0).collect()}
        assert dealt == got


def test_paired_policies_over_seeds(spark):
    rows = [(s, p, v) for s in range(6) for p, v in (("POINT", 0.1 * s), ("INTERVAL", 0.05 * s + 0.02))]
    r = decisions.policy_pairs(spark.createDataFrame(rows, "seed int, policy string, bad double"), "POINT", "INTERVAL", "bad").first()
    d = [0.05 * s - 0.02 for s in range(6)]
    assert (r.n_seeds, r.n_above) == (6, sum(x > 0 for x in d))
    assert (r.mean_d, r.least_d, r.greatest_d) == pytest.approx((sum(d) / 6, min(d), max(d)))
    assert r.relative_d == pytest.approx(sum(d) / 6 / 0.25)


def test_same_sites_in_another_order_have_the_same_mean(spark):
    """Sums of doubles in two orders differ in the last place, and the sign of that is no difference of policies."""
    far = [0.1, 0.2, 0.3]
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    rows = [(s, p, 1, k, 0.0, 5.0) for s in range(3) for p, way in (("POINT", 1), ("INTERVAL", -1)) for k in far[::way]]
    rows += [(s, p, None, None, None, None) for s in range(3) for p in ("POINT", "INTERVAL", "NONE")]
    rows += [(0, "NAN", 1, k, 0.0, 5.0) for k in (1.0, float("nan"))]
    chosen = spark.createDataFrame(rows, "seed int, policy string, site int, km double, y double, capacity double").coalesce(1)
    out = decisions.allocation_report(chosen, F.col("capacity") - F.col("y") < 1, "seed", "policy")
    by = {(r.seed, r.policy): r.mean_km for r in out.collect()}
    assert {by[s, p] for s in range(3) for p in ("POINT", "INTERVAL")} == {0.2}
    assert by[0, "NONE"] is None and math.isnan(by[0, "NAN"])
    for a, b in (("POINT", "INTERVAL"), ("INTERVAL", "POINT")):
        r = decisions.policy_pairs(out.filter("policy in ('POINT', 'INTERVAL')"), a, b, "mean_km").first()
        assert (r.n_seeds, r.n_above, r.mean_d, r.least_d, r.greatest_d) == (3, 0, 0.0, 0.0, 0.0)


def test_contrasts_of_policies_are_one_pass(spark):
    """Outcomes are computed once for all cases, and each case is what it is alone."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(k, s, p, 0.1 * s + i, 0.3 * i * s) for k in "xy" for s in range(4) for i, p in enumerate(("POINT", "INTERVAL", "MARGIN"))]
    kind = "k string, seed int, policy string, bad double, mean_km double"
    plain = spark.createDataFrame(rows, kind)
    cases = [(a, b, v) for a, b in (("POINT", "INTERVAL"), ("POINT", "MARGIN"), ("MARGIN", "INTERVAL")) for v in ("bad", "mean_km")]
    got = sorted(decisions.policy_contrasts(plain.mapInArrow(seen, kind), cases, "k").collect())
    assert made.value == len(rows)
    assert got == sorted(r for a, b, v in cases for r in decisions.policy_pairs(plain, a, b, v, "k").collect())
    assert len(got) == 2 * len(cases)
    assert next(r.mean_d for r in got if (r.k, r.contrast, r.value) == ("y", "MARGIN - INTERVAL", "bad")) == pytest.approx(1)


def _grow_one(x, y, leaf, depth):
    """A regression tree, node by node, as a function of a row."""
    best = None
    if depth > 0 and len(y) >= 2 * leaf and y.max() > y.min():
        for f in range(x.shape[1]):
            for c in sorted(set(x[:, f]))[:-1]:
                side = x[:, f] <= c
                if side.sum() >= leaf and (~side).sum() >= leaf:
                    loss = ((y[side] - y[side].mean()) ** 2).sum() + ((y[~side] - y[~side].mean()) ** 2).sum()
                    if best is None or loss < best[0] - 1e-9:
                        best = loss, f, (c + min(v for v in x[:, f] if v > c)) / 2
    if best is None:
        return lambda z: y.mean()
    _, f, c = best
    side = x[:, f] <= c
    low, high = _grow_one(x[side], y[side], leaf, depth - 1), _grow_one(x[~side], y[~side], leaf, depth - 1)
    return lambda z: low(z) if z[f] <= c else high(z)


@pytest.mark.parametrize(("leaf", "depth"), [(1, math.inf), (2, math.inf), (2, 3), (5, 12)])
def test_forest_equals_trees_grown_node_by_node(leaf, depth):
    rng = np.random.default_rng(leaf)
    x = np.column_stack([rng.normal(size=60), rng.integers(0, 5, 60), rng.normal(size=60).round(1)])
    y = rng.normal(size=60) + x[:, 1]
    drawn = [rng.integers(0, 60, 60) for _ in range(8)]
    takes = iter(drawn)
    predict = forecast.forest(x, y, trees=8, leaf=leaf, depth=depth, rows=lambda: next(takes))
    trees = [_grow_one(x[r], y[r], leaf, depth) for r in drawn]
    z = np.vstack([x, rng.normal(size=(40, 3))])
    assert predict(z) == pytest.approx([np.mean([t(row) for t in trees]) for row in z])


def test_ranks_of_large_groups_part_by_part(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(f, i, draw.choice([None, 0.5, draw.random(), draw.random()]), draw.random()) for f in "ab" for i in range(700)] + [("c", 0, 0.3, 0.1), ("d", 1, None, 0.2)]
    df = spark.createDataFrame(rows, "family string, contrast int, p double, q double")
    both = df.filter("p is not null")
    whole = [inference.holm(df, "p", "family").collect(), inference.spearman(df, "p", "q", "family").collect(), inference.average_rank(both, "p", "r", "family").collect()]
    assert "__part" not in inference.in_parts(df, "p", "family").columns
    monkeypatch.setattr(inference, "LOT", 20)
    monkeypatch.setattr(inference, "PARTS", 16)
    assert inference.in_parts(df, "p", "family").select("family", "__part").distinct().count() > 20
    parts = [inference.holm(df, "p", "family").collect(), inference.spearman(df, "p", "q", "family").collect(), inference.average_rank(both, "p", "r", "family").collect()]
    for a, b in zip(whole, parts, strict=True):
        a, b = (sorted(x, key=lambda r: repr(tuple(r))) for x in (a, b))
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
            assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])


def test_spearman_of_a_constant_is_undefined(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    assert inference.spearman(df, "a", "b").first().rho is None


def test_readings_below_the_least_become_it(spark):
    df = features.floored(spark.createDataFrame([(-2.0, 1), (3.0, 2), (None, 3)], "occ double, i int"), "occ")
    assert [r.occ for r in df.orderBy("i").collect()] == [0.0, 3.0, None]


def test_files_are_hashed_and_compared_with_a_list(spark, tmp_path):
    import hashlib

    for name, text in (("a.txt", "one"), ("sub/b.txt", "two"), ("c.txt", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = {r.name: (r.bytes, r.sha256) for r in readers.hashed_files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": (3, sha("one")), "sub/b.txt": (3, sha("two")), "c.txt": (5, sha("three"))}
    listed = spark.createDataFrame([("a.txt", sha("one")), ("sub/b.txt", sha("other")), ("d.txt", sha("x"))], "name string, sha256 string")
    assert {r.name: r.state for r in readers.hashed_files(spark, str(tmp_path), listed).collect()} == {"a.txt": "same", "sub/b.txt": "changed", "c.txt": "unlisted", "d.txt": "missing"}


def test_result_tables_are_the_next_steps_input(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 3), ("b", None, 4)], "series string, picp double, n int")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t"))
    for path in ("t.csv", "t"):
        got = readers.table_file(spark, str(tmp_path / path), "series string, n long, picp double")
        assert got.dtypes == [("series", "string"), ("n", "bigint"), ("picp", "double")]
        assert sorted(map(tuple, got.collect())) == [("a", 3, 0.5), ("b", 4, None)]


def test_draws_are_spread_and_repeat(spark):
    from gaugeline.functions import draws

    x = draws.numbers(42, range(0, 300), 50)
    assert (draws.numbers(42, range(100, 200), 50) == x[100:200]).all()
    assert len(np.unique(x)) > 14_990
    counts = np.bincount(draws.picks(7, range(0, 2000), 50, 10).ravel(), minlength=10)
    assert abs(counts / 10_000 - 1).max() < 0.05
