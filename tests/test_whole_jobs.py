"""Reports do the whole job: sizes of fits and numbers of draws are not cut where a report is registered."""

import inspect
import math

import numpy as np
import pytest

from gaugeline import plans
from gaugeline.operators import chunks, forecast

SF = "/root/testdata/sf0.001"


def calls(monkeypatch, spark, name, module, function):
    """Arguments, defaults included, of a function's calls while the report is planned."""
    found, plain = [], getattr(module, function)

    def noted(*args, **options):
        bound = inspect.signature(plain).bind(*args, **options)
        bound.apply_defaults()
        found.append(bound.arguments)
        return plain(*args, **options)

    with monkeypatch.context() as m:
        m.setattr(module, function, noted)
        plans.QUERIES[name](spark, SF)
    return found


def test_fits_have_the_reference_sizes(spark, monkeypatch):
    got = {c["learner"]: c["options"] for c in calls(monkeypatch, spark, "base_learners", forecast, "fitted")}
    assert got == {"ridge": {}, "forest": {"trees": 100, "depth": math.inf}, "boosting": {"rounds": 200}}
    assert [c["options"] for c in calls(monkeypatch, spark, "fitted_quantile_cqr", forecast, "fitted_band")] == [{"rounds": 100}]
    assert [c["options"] for c in calls(monkeypatch, spark, "gaussian_band_conformal", forecast, "fitted_band")] == [{"rounds": 300, "rate": 0.03}]
    c = calls(monkeypatch, spark, "enbpi_intervals", chunks, "ensemble_intervals")[0]
    assert (c["members"], c["blocks"], c["trees"], c["depth"]) == (30, 10, 100, math.inf)


@pytest.mark.parametrize("steps", [0, 1])
def test_neighbouring_doubles_are_split(steps):
    low = 0.1
    for _ in range(steps):
        low = math.nextafter(low, 1)
    x = np.array([low] * 5 + [math.nextafter(low, 1)] * 5)[:, None]
    predict = forecast.forest(x, np.array([0.0] * 5 + [1.0] * 5), trees=1, rows=lambda: np.arange(10))
    assert predict(np.array([[0.0], [0.5]])).tolist() == [0.0, 1.0]


def test_permutation_tests_draw_in_full(spark, monkeypatch):
    from gaugeline.operators import spatial

    c = calls(monkeypatch, spark, "spatial_permutation_tests", spatial, "permutation_tests")[0]
    assert (c["moran_draws"], c["mantel_draws"]) == (999, 9_999)


def test_delay_grid_holds_the_smaller_report(spark):
    sf = "/root/testdata/sf0.01"
    got = plans.QUERIES["delay_sensitivity_grid"](spark, sf).toPandas()
    n = got["series"].nunique()
    assert len(got) == n * 3 * (6 + 1)
    assert sorted(got.loc[got["method"] == "aci", "gamma"].unique()) == [0.002, 0.005, 0.01, 0.02, 0.05, 0.1]
    small = plans.QUERIES["delay_sensitivity"](spark, sf).toPandas().set_index(["gamma", "series"])
    same = got[(got["horizon"] == 3) & got["gamma"].isin([0.005, 0.05])].set_index(["gamma", "series"]).loc[small.index]
    assert np.abs(same[["picp", "mpiw", "winkler"]].to_numpy() - small[["picp", "mpiw", "winkler"]].to_numpy()).max() == 0


def test_injection_rebuilds_features_in_every_arm(spark):
    from gaugeline.plans import base, summary_reports

    rows = base.rows(spark, "/root/testdata/sf0.01").filter("series = 'click'").cache()
    got = summary_reports.injected(rows).toPandas().sort_values("i").set_index("arm")
    assert got.index.nunique() == 11
    kept = rows.toPandas().sort_values("slot")
    cap = kept.loc[kept["split"] == "train", "occ"].max()
    for arm, level in (("none", None), ("level_0.8000", 0.8 * cap), ("plausible", kept.loc[kept["split"] == "train", "occ"].median())):
        want = kept.assign(level=kept["occ"] if level is None else level)
        hit = (want["split"] == "test") & (want["i"] >= 60)
        want["occ"] = want["occ"].where(~hit, want["level"])
        x = got.loc[arm]
        for k in base.LAGS:
            assert np.allclose(x[f"lag_{k}"], want["occ"].shift(k)[want["split"] == "test"])
        assert np.allclose(x["roll_mean"], want["occ"].shift(1).rolling(6).mean()[want["split"] == "test"])
