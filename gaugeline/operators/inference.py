"""Inference over entities: intervals of means, bootstraps, paired contrasts, multiplicity, rank correlation.

Moments, ranks and step-down adjustments are aggregations and windows. Resampling works on one value per entity, in a
grouped function, after sorting by entity, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import spearman_p, t_quantile, t_sf, wilcoxon
from ..functions.draws import picks


def _types(df: DataFrame, keys) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def mean_legs(df: DataFrame, value: str, *keys: str, target: float = 0.9, margin: float = 0.02, level: float = 0.9) -> DataFrame:
    """Mean, sample deviation, error, interval of the mean, and p of equivalence within the margin. The moments are one
    aggregation; the t distribution is looked up per group."""
    one = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    schema = _types(one, keys) + "n long, mean double, sd double, se double, ci_lo double, ci_hi double, tost_p double"

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = pdf.copy()
            out["se"] = out["sd"] / np.sqrt(out["n"])
            t = [t_quantile((1 + level) / 2, n - 1) if n > 1 else np.nan for n in out["n"]]
            out["ci_lo"], out["ci_hi"] = out["mean"] - t * out["se"], out["mean"] + t * out["se"]
            gap = out["mean"] - target
            out["tost_p"] = [max(t_sf((g + margin) / s, n - 1), t_sf((margin - g) / s, n - 1)) if n > 1 and s > 0 else np.nan for g, s, n in zip(gap, out["se"], out["n"], strict=True)]
            yield out

    return one.mapInPandas(run, schema)


def bootstrap_mean(df: DataFrame, value: str, entity: str, *keys: str, draws: int = 10_000, seed: int = 42, level: float = 0.9) -> DataFrame:
    """Percentile interval of the mean over entities."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values(entity)[value].to_numpy(float)
        means = _means(seed, x, draws)
        tail = (1 - level) / 2 * 100
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"n": [len(x)], "mean": [x.mean()], "ci_lo": [np.percentile(means, tail)], "ci_hi": [np.percentile(means, 100 - tail)]})

    return df.select(*keys, entity, value).dropna(subset=[value]).groupBy(*keys).applyInPandas(run, _types(df, keys) + "n long, mean double, ci_lo double, ci_hi double")


def _means(seed: int, x, draws: int):
    import numpy as np

    step = max(1, 4_000_000 // max(1, len(x)))
    return np.concatenate([x[picks(seed, range(i, min(draws, i + step)), len(x), len(x))].mean(1) for i in range(0, draws, step)])


def paired(df: DataFrame, value: str, arm: str, a: str, b: str, entity: str, *keys: str) -> DataFrame:
    """The difference a - b of entities that have both arms: one conditional aggregation, no join."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return df.filter(F.col(arm).isin(a, b)).groupBy(*keys, entity).agg((pick(a) - pick(b)).alias("d")).filter("d is not null")


def contrasts(df: DataFrame, value: str, arm: str, pairs: list[tuple[str, str]], entity: str, *keys: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired contrasts: mean difference, bootstrap interval and two-sided p, share of entities where a is less, signed-rank
    p. One sequence of numbers serves the contrasts of a group, each from a place of its own in their order. Means within
    1e-12 of 0 are 0."""
    names = sorted({x for p in pairs for x in p})
    wide = df.filter(F.col(arm).isin(names)).groupBy(*keys, entity).pivot(arm, names).agg(F.first(value))

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf, rows = pdf.sort_values(entity), []
        for k, (a, b) in enumerate(pairs):
            d = (pdf[a] - pdf[b]).dropna().to_numpy(float)
            if not len(d):
                continue
            means = _means(seed + k * draws, d, draws)
            p = min(1.0, 2 * min((means <= 1e-12).mean(), (means >= -1e-12).mean()))
            rows.append({k: pdf[k].iloc[0] for k in keys} | {"contrast": f"{a} - {b}", "n": len(d), "mean_d": d.mean(), "ci_lo": np.percentile(means, 5), "ci_hi": np.percentile(means, 95), "boot_p": p, "share_less": (d < 0).mean(), "wilcoxon_p": wilcoxon(list(d))[1]})
        return pd.DataFrame(rows, columns=[*keys, "contrast", "n", "mean_d", "ci_lo", "ci_hi", "boot_p", "share_less", "wilcoxon_p"])

    schema = _types(df, keys) + "contrast string, n long, mean_d double, ci_lo double, ci_hi double, boot_p double, share_less double, wilcoxon_p double"
    return wide.groupBy(*keys).applyInPandas(run, schema)


#: Parts that the rows of a group of more than LOT are cut into by their values.
PARTS, LOT = 256, 1_000_000


def in_parts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds __part where a group has more than LOT rows: rows of a lower part have no greater values. Small groups are one part;
    a large one is cut at quantiles, a row of cuts per LOT rows, so that its order needs no task with all of it. Nulls are
    in the last part."""
    cuts = F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)])
    big = df.groupBy(*keys).agg(F.count("*").alias("__n"), cuts.alias("__cuts")).filter(F.col("__n") > LOT).drop("__n")
    if big.isEmpty():
        return df
    rows = df.join(F.broadcast(big), list(keys), "left") if keys else df.crossJoin(F.broadcast(big))
    part = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return rows.withColumn("__part", F.when(F.col("__cuts").isNull(), 0).when(F.col(value).isNull(), PARTS).otherwise(part)).drop("__cuts")


def _ahead(parts: DataFrame, what, out: str, *keys: str) -> DataFrame:
    """An aggregate of the parts before each part: a few rows per group."""
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, what.over(before))


def holm(df: DataFrame, p: str, *family: str, name: str = "contrast", large: bool = True) -> DataFrame:
    """p_holm: step-down adjusted within a family, never less than that of a smaller p. Nulls stay null. large: whether a
    family may have more than LOT rows; such ones are looked for, and ranked part by part."""
    rows = in_parts(df, p, *family) if large else df
    if "__part" not in rows.columns:
        w = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), name)
        step = (F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(w) + 1) * F.col(p)
        most = F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("__s", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), most))).drop("__s")
    on = [*family, "__part"]
    w = Window.partitionBy(*on).orderBy(F.col(p).asc_nulls_last(), name)

    def with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Adds what is known of a row's part; a null family is one like any other."""
        side = parts.withColumnsRenamed({c: f"{c}_of" for c in on})
        met = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in on]
        return rows.join(side, met).drop(*[f"{c}_of" for c in on])

    counts = rows.groupBy(*on).agg(F.count("*").alias("__rows"), F.count(p).alias("__with"))
    counts = _ahead(counts, F.sum("__rows"), "__before", *family).withColumn("__m", F.sum("__with").over(Window.partitionBy(*family)))
    ranked = with_parts(rows, counts.select(*on, F.coalesce("__before", F.lit(0)).alias("__before"), "__m"))
    ranked = ranked.withColumn("__s", (F.col("__m") - (F.col("__before") + F.row_number().over(w)) + 1) * F.col(p))
    tops = _ahead(ranked.groupBy(*on).agg(F.max("__s").alias("__top")), F.max("__top"), "__floor", *family).select(*on, "__floor")
    upto = F.greatest(F.col("__floor"), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return with_parts(ranked, tops).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), upto))).select(*df.columns, "p_holm")


def average_rank(df: DataFrame, value: str, out: str, *keys: str, large: bool = True) -> DataFrame:
    """Ranks of equal values are their mean. Values are ranked by counts of distinct values, so a crowd of equal ones is
    a row. large: whether a group may have more than LOT distinct values; such ones are ranked part by part."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    counts = in_parts(counts, value, *keys) if large else counts
    ahead, on = F.lit(0), list(keys)
    if "__part" in counts.columns:
        on = [*keys, "__part"]
        before = _ahead(counts.groupBy(*on).agg(F.sum("__c").alias("__rows")), F.sum("__rows"), "__before", *keys).select(*on, F.coalesce("__before", F.lit(0)).alias("__before"))
        counts, ahead = counts.join(before, on), F.col("__before")
    w = Window.partitionBy(*on).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(out, ahead + F.sum("__c").over(w) - (F.col("__c") - 1) / 2)
    return df.join(ranks.select(*keys, value, out), [*keys, value])


def spearman(df: DataFrame, a: str, b: str, *keys: str, large: bool = True) -> DataFrame:
    """rho and n; null where a side is constant."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_rank(average_rank(rows, a, "__ra", *keys, large=large), b, "__rb", *keys, large=large)
    one = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("__ra", "__rb").alias("__c"), (F.stddev_pop("__ra") * F.stddev_pop("__rb")).alias("__s"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("__c", "__s")))
    return one.select(*keys, "n", F.when(F.col("__s") > 0, rho).alias("rho"))


def spearman_test(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    one = spearman(df, a, b, *keys)

    def run(batches):
        for pdf in batches:
            pdf["p"] = [spearman_p(r, int(n)) if r is not None else None for r, n in zip(pdf["rho"], pdf["n"], strict=True)]
            yield pdf

    return one.mapInPandas(run, _types(one, keys) + "n long, rho double, p double")


def entity_table(intervals: DataFrame, entity: str, *keys: str, target: float = 0.9, margin: float = 0.02) -> DataFrame:
    """Of intervals of coverage per entity (mean, ci_lo, ci_hi): the spread and the worst of means, shares whose interval
    begins below target less margin, whose mean is below the target, and whose interval contains it, and half widths."""
    half, worst = (F.col("ci_hi") - F.col("ci_lo")) / 2, F.min(F.struct("mean", entity))
    share = lambda c: F.avg(c.cast("double"))
    low = F.lit(target).cast("double") - F.lit(margin).cast("double")
    return intervals.groupBy(*keys).agg(F.count("*").alias("n_entities"), F.stddev_samp("mean").alias("sd_picp"), worst["mean"].alias("worst_picp"), worst[entity].alias("worst_entity"), share(F.col("ci_lo") < low).alias("share_unsafe"), share(F.col("mean") < target).alias("share_below"), F.percentile(half, F.lit(0.5)).alias("median_half"), F.max(half).alias("greatest_half"), share((F.col("ci_lo") <= target) & (F.col("ci_hi") >= target)).alias("share_containing"))


def seeds_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Of repeated runs: moments, quartiles, extremes and signs."""
    v = F.col(value)
    q = [F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *q, F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"))
