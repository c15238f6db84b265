"""Spatial association between sites: distances, residual correlations, Moran's I and Mantel's r.

Sites are few (each pair is a row); readings are many. Correlations come from one equi-join on time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import numbers
from ..functions.scalar import haversine_km

#: Sites beyond which pairs are refused: a million pairs and a half.
MOST_SITES = 1_750


def _checked(sites: DataFrame) -> DataFrame:
    if sites.limit(MOST_SITES + 1).count() > MOST_SITES:
        raise ValueError(f"pairs of more than {MOST_SITES} sites")
    return sites


def distances(sites: DataFrame) -> DataFrame:
    """a < b and km for sites (site, lat, lon)."""
    s = _checked(sites)
    a, b = (s.select(F.col("site").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}")) for n in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km"))


def common_times(df: DataFrame, site: str = "site", slot: str = "slot") -> DataFrame:
    """Rows of the slots that every site has."""
    n = df.agg(F.countDistinct(site).alias("__n"))
    full = df.groupBy(slot).agg(F.countDistinct(site).alias("__c")).join(F.broadcast(n), F.col("__c") == F.col("__n")).select(slot)
    return df.join(full, slot, "left_semi")


def pair_correlations(df: DataFrame, value: str, site: str = "site", slot: str = "slot") -> DataFrame:
    """a < b, n and Pearson's r on common times. A slot's readings meet as one sorted array per slot, of sites."""
    rows = common_times(df.filter(F.col(value).isNotNull()), site, slot).groupBy(slot).agg(F.array_sort(F.collect_list(F.struct(F.col(site).alias("s"), F.col(value).alias("v")))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + 2, F.greatest(F.size("r") - i - 1, F.lit(0))), lambda y: F.struct(x["s"].alias("a"), y["s"].alias("b"), x["v"].alias("x"), y["v"].alias("y")))))
    return rows.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def near_far(pairs: DataFrame, near: float = 2.0, far: float = 5.0) -> DataFrame:
    """Mean correlation of near and of far pairs (km, r)."""
    return pairs.agg(F.count_if(F.col("km") < near).alias("n_near"), F.avg(F.when(F.col("km") < near, F.col("r"))).alias("r_near"), F.count_if(F.col("km") > far).alias("n_far"), F.avg(F.when(F.col("km") > far, F.col("r"))).alias("r_far"))


def morans_i(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """n, moran_i with weights 1 / km (0 for sites in one place)."""
    mean = values.agg(F.avg(value).alias("m"))
    z = values.crossJoin(F.broadcast(mean)).select("site", (F.col(value) - F.col("m")).alias("z"))
    zz = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    w = F.when(F.col("km") > 0, 1 / F.col("km")).otherwise(0.0)
    both = pairs.join(z.select(F.col("site").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("site").alias("b"), F.col("z").alias("zb")), "b")
    top = both.agg(F.sum(2 * w * F.col("za") * F.col("zb")).alias("top"), F.sum(2 * w).alias("w"))
    return zz.crossJoin(top).select("n", (F.col("n") / F.col("w") * F.col("top") / F.col("zz")).alias("moran_i"))


def mantel_r(pairs: DataFrame) -> DataFrame:
    """n_pairs, mantel_r of pairs (km, r)."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.corr("km", "r").alias("mantel_r"))


def permutation_tests(pairs: DataFrame, values: DataFrame, value: str, moran_draws: int = 999, mantel_draws: int = 9_999, seed: int = 42, batch: int = 250) -> DataFrame:
    """Statistics with two-sided p by relabelling sites. A relabelling orders sites by the numbers of its draw; draws are
    dealt out in batches, and each task has the matrices of at most MOST_SITES sites. Statistics within 1e-12 are equal."""
    spark = pairs.sparkSession
    sites = [(r["site"], r[value]) for r in values.orderBy("site").limit(MOST_SITES + 1).collect()]
    if len(sites) > MOST_SITES:
        raise ValueError(f"pairs of more than {MOST_SITES} sites")
    known = spark.sparkContext.broadcast((sites, [tuple(r) for r in pairs.select("a", "b", "km", "r").collect()]))

    def run(batches):
        import numpy as np
        import pandas as pd

        sites, rows = known.value
        at, n = {s: i for i, (s, _) in enumerate(sites)}, len(sites)
        km, r = np.zeros((n, n)), np.zeros((n, n))
        for a, b, k, c in rows:
            km[at[a], at[b]] = km[at[b], at[a]] = k
            r[at[a], at[b]] = r[at[b], at[a]] = c
        w = np.divide(1, km, out=np.zeros_like(km), where=km > 0)
        z = np.array([v for _, v in sites], float)
        z = z - z.mean()
        up = np.triu_indices(n, 1)
        moran = lambda x: n / w.sum() * (x @ w @ x) / (x @ x)
        mantel = lambda p: np.corrcoef(km[up], r[np.ix_(p, p)][up])[0, 1]
        i0, m0 = moran(z), mantel(np.arange(n))
        for pdf in batches:
            out = []
            for first, last in zip(pdf["first"], pdf["last"], strict=True):
                orders = np.argsort(numbers(seed, range(first, last), n), axis=1, kind="stable")
                more_i = sum(abs(moran(z[p])) >= abs(i0) - 1e-12 for p in orders[: max(0, moran_draws - first)])
                more_m = sum(abs(mantel(p)) >= abs(m0) - 1e-12 for p in orders[: max(0, mantel_draws - first)])
                out.append((i0, m0, more_i, more_m))
            yield pd.DataFrame(out, columns=["i0", "m0", "more_i", "more_m"])

    most = max(moran_draws, mantel_draws)
    parts = spark.range(-(-most // batch)).select((F.col("id") * batch).alias("first"), F.least((F.col("id") + 1) * batch, F.lit(most)).alias("last"))
    found = parts.repartition(spark.sparkContext.defaultParallelism, "first").mapInPandas(run, "i0 double, m0 double, more_i long, more_m long")
    p = lambda c, n: (F.sum(c) + 1) / F.lit(float(n + 1))
    return found.agg(F.first("i0").alias("moran_i"), p("more_i", moran_draws).alias("moran_p"), F.first("m0").alias("mantel_r"), p("more_m", mantel_draws).alias("mantel_p"))


def on_roster(pairs: DataFrame, roster: DataFrame) -> DataFrame:
    """Pairs with both ends on a roster (site)."""
    return pairs.join(roster.select(F.col("site").alias("a")), "a", "left_semi").join(roster.select(F.col("site").alias("b")), "b", "left_semi")
