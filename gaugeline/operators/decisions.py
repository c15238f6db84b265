"""Decisions on intervals: committing or abstaining, allocation to the nearest feasible site, failure injection."""

from __future__ import annotations

from math import log2, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_KM, d, haversine_km


def commit_thresholds(intervals: DataFrame, shares: list[float], *keys: str) -> DataFrame:
    """share and threshold per series: the linear quantile of widths at each target share."""
    width = F.col("hi") - F.col("lo")
    many = F.array(*[F.struct(d(s).alias("share"), F.percentile(width, d(s)).alias("threshold")) for s in shares])
    return intervals.groupBy(*keys).agg(many.alias("t")).select(*keys, F.inline("t"))


def selected(test: DataFrame, thresholds: DataFrame, *keys: str) -> DataFrame:
    """Test rows per share, with committed: the width is at most the threshold."""
    return test.join(thresholds, list(keys)).withColumn("committed", F.col("hi") - F.col("lo") <= F.col("threshold"))


def selection_report(rows: DataFrame, *keys: str, y: str = "y") -> DataFrame:
    """What is committed: rate, coverage, and error of the midpoint, absolute and by the mean outcome."""
    e = F.abs(F.col(y) - (F.col("lo") + F.col("hi")) / 2)
    on = lambda x: F.avg(F.when(F.col("committed"), x))
    hit = ((F.col(y) >= F.col("lo")) & (F.col(y) <= F.col("hi"))).cast("double")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("committed").cast("double")).alias("commit_rate"), on(e).alias("mae"), (100 * on(e) / F.greatest(F.avg(y), d(1))).alias("mae_pct"), on(hit).alias("picp"))


def abstention_lift(rows: DataFrame, group: str, *keys: str) -> DataFrame:
    """A group's share among abstained rows by its share among all."""
    cells = rows.groupBy(*keys, group).agg(F.count("*").alias("n"), F.count_if(~F.col("committed")).alias("n_abstained"))
    w = Window.partitionBy(*keys)
    lift = F.try_divide(F.col("n_abstained") / F.nullif(F.sum("n_abstained").over(w), F.lit(0)), F.col("n") / F.sum("n").over(w))
    return cells.withColumn("lift", lift)


def hash_order(*cols: Column, salt: Column | str = "") -> Column:
    """A seeded order that any engine with MD5 gives."""
    return F.md5(F.concat_ws("|", salt if isinstance(salt, Column) else F.lit(salt), *[c.cast("string") for c in cols]))


def matched_random(rows: DataFrame, draws: int, order: str, *keys: str) -> DataFrame:
    """Random controls: in each draw as many rows per series as were committed, without replacement."""
    n = rows.groupBy(*keys).agg(F.count_if("committed").alias("k"))
    many = rows.drop("committed").join(n, list(keys)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = F.row_number().over(Window.partitionBy(*keys, "draw").orderBy(hash_order(*[F.col(k) for k in keys], F.col(order), salt=F.col("draw").cast("string")), order))
    return many.withColumn("committed", at <= F.col("k")).drop("k")


def anchors(train: DataFrame, value: str, when: Column, k: int, *keys: str) -> DataFrame:
    """The k series with the highest mean reading at some times, by the most they ever had: keys, ratio, place. A top-k by a
    plain order, so each task keeps k rows."""
    one = train.groupBy(*keys).agg((F.avg(F.when(when, F.col(value))) / F.max(value)).alias("ratio")).filter("ratio is not null")
    top = one.orderBy(F.col("ratio").desc(), *keys).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("ratio").desc(), *keys)))


def demand(spark, seeds: int, requests: int, anchors: list[tuple[float, float]], box: tuple[float, float, float, float], hot: float = 0.65, spread: float = 0.0035, slots: int = 1) -> DataFrame:
    """Requests (seed, request, slot, lat, lon): a share around anchors, the others anywhere in the box widened by 15
    percent. Made in the cluster from seeded functions of the row's number."""
    lat0, lat1, lon0, lon1 = box
    rows = spark.range(seeds * requests).select((F.col("id") / requests).cast("int").alias("seed"), (F.col("id") % requests).alias("request"))
    u = lambda name: F.conv(F.substring(hash_order(F.col("seed"), F.col("request"), salt=name), 1, 8), 16, 10).cast("double") / 4294967296.0
    normal = lambda n: F.sqrt(-2 * F.log(1 - u(f"{n}a"))) * F.cos(2 * F.pi() * u(f"{n}b"))
    pick = F.get(F.array(*[F.struct(d(a).alias("lat"), d(b).alias("lon")) for a, b in anchors]), F.floor(u("anchor") * len(anchors)).cast("int"))
    wide = lambda a, b, n: d(a - 0.15 * (b - a)) + u(n) * d(1.3 * (b - a))
    is_hot = u("hot") < hot
    return rows.select("seed", "request", F.floor(u("slot") * slots).alias("slot"), F.when(is_hot, pick["lat"] + d(spread) * normal("y")).otherwise(wide(lat0, lat1, "lat")).alias("lat"), F.when(is_hot, pick["lon"] + d(spread) * normal("x")).otherwise(wide(lon0, lon1, "lon")).alias("lon"))


#: Whether a policy sees room at a site: capacity against forecast, upper end, or forecast plus the mean margin.
POLICIES = {
    "POINT": lambda: F.col("capacity") - F.col("yhat") >= 1,
    "INTERVAL": lambda: F.col("capacity") - F.col("upper") >= 1,
    "MARGIN": lambda: F.col("capacity") - (F.col("yhat") + F.col("margin")) >= 1,
}


def _cells(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Column and row of a point in a grid of 2 ** level cells around the globe."""
    n = float(1 << level)
    x = F.least(F.floor((lon + 180) / 360 * n), F.lit((1 << level) - 1))
    return F.greatest(F.lit(0), x).cast("long"), F.floor((lat + 90) / 360 * n).cast("long")


def _levels(sites: DataFrame) -> list[int]:
    """Grid levels for the places of sites: from some sixteen cells a place to cells that are as large as all."""
    spread = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    box = sites.agg(spread.alias("spread"), F.approx_count_distinct(F.struct("lat", "lon")).alias("n")).first()
    if not box["n"]:
        return [0]
    spread = max(box["spread"], 1e-4)
    finest = int(min(26, max(2, 2 + log2(360 * sqrt(box["n"]) / spread))))
    return [0, *range(max(2, int(log2(360 / spread))), finest + 1)]


def candidates(cells: DataFrame, open_: DataFrame, levels: list[int], on: list[str]) -> DataFrame:
    """on, x, y, policy, near: for each cell (on, x, y) of the finest level, the sites (on, policy, lat, lon, s) that can be
    nearest to a point in it. A site is in the 3 by 3 cells around its own at every level, so a cell looks one place up.
    The finest level where there is a site gives a distance; the level whose block reaches beyond it holds the nearest
    one of every point in the cell, and what is farther from the cell's middle than that by more than the cell goes."""
    finest = levels[-1]
    size = 360.0 / (1 << finest)
    wide = EARTH_KM * radians(size)  # no two points of a cell are farther apart
    rows = []
    for level in levels:
        x, y = _cells(F.col("lat"), F.col("lon"), level)
        steps = (-1, 0, 1) if level else (0,)
        rows += [F.struct(F.lit(level).alias("level"), F.pmod(x + i, F.lit(1 << level)).alias("at_x"), (y + j).alias("at_y")) for i in steps for j in steps]
    around = open_.select("*", F.inline(F.array(*rows)))
    up = lambda c, level: F.shiftright(c, finest - level)
    every = F.array(*[F.struct(F.lit(level).alias("level"), up("x", level).alias("at_x"), up("y", level).alias("at_y")) for level in levels])
    place = ["level", "at_x", "at_y"]
    held = around.select(*on, "policy", *place).distinct()
    first = cells.select(*on, "x", "y", F.inline(every)).join(held, [*on, *place]).groupBy(*on, "x", "y", "policy").agg(F.max("level").alias("level"))

    mid_lat, mid_lon = (F.col("y") + 0.5) * d(size) - 90, (F.col("x") + 0.5) * d(size) - 180
    km = haversine_km(mid_lat, mid_lon, F.col("lat"), F.col("lon"))

    def looked_up(df: DataFrame) -> DataFrame:
        here = [F.call_function("shiftright", F.col(c), F.lit(finest) - F.col("level")).alias(f"at_{c}") for c in ("x", "y")]
        return df.select("*", *here).join(around, [*on, "policy", *place]).withColumn("km", km)

    found = looked_up(first).groupBy(*on, "x", "y", "policy").agg(F.min("km").alias("least"))
    need = F.col("least") + 2 * wide + 1e-6
    # what lies outside a cell's block is a cell away in latitude, or beyond a meridian that is
    reach = lambda level: F.least(d(radians(360 / (1 << level))), F.asin(d(sin(radians(360 / (1 << level)))) * F.cos(F.radians(mid_lat)))) * d(EARTH_KM)
    level = F.greatest(F.lit(0), *[F.when(reach(k) >= need, F.lit(k)) for k in levels if k > 2])
    near = looked_up(found.withColumn("level", level)).filter(F.col("km") <= need)
    return near.groupBy(*on, "x", "y", "policy").agg(F.collect_list(F.struct("lat", "lon", "s")).alias("near"))


def allocated(requests: DataFrame, sites: DataFrame, policies: dict | None = None, *keys: str, send: int = 1_000_000) -> DataFrame:
    """Each request goes, for each policy, to the nearest site that looks feasible (the first id among equals), or
    nowhere: keys, policy, site, km, y, capacity. Requests are independent, and may have a slot that sites have too.

    Sites (site, slot?, lat, lon, capacity, yhat, upper, margin, y) are indexed by cells of a grid, and the cells that
    hold requests get the few sites that can be nearest to a point in them. So a request meets a row of its cell, once,
    and distances are computed to these sites alone: the work is in proportion to requests. The cells' rows are sent to
    all executors if they hold at most `send` sites, else both sides are dealt out by cell."""
    rules = policies or POLICIES
    on = [c for c in ("slot",) if c in sites.columns and c in requests.columns]
    ruled = F.array(*[F.struct(F.lit(n).alias("policy"), rule().alias("ok")) for n, rule in rules.items()])
    open_ = sites.select(*on, "site", "lat", "lon", "y", "capacity", F.inline(ruled)).filter("ok and lat is not null and lon is not null")
    # of sites in one place, the first id can be chosen
    open_ = open_.groupBy(*on, "policy", "lat", "lon").agg(F.min(F.struct("site", "y", "capacity")).alias("s"))
    levels = _levels(open_)
    x, y = _cells(F.col("lat"), F.col("lon"), levels[-1])
    asked = requests.select(*dict.fromkeys([*keys, *on]), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), x.alias("x"), y.alias("y"))
    few = candidates(asked.select(*on, "x", "y").distinct(), open_, levels, on)
    mine = lambda p: F.flatten(F.collect_list(F.when(F.col("policy") == p, F.col("near"))))
    few = few.groupBy(*on, "x", "y").agg(*[mine(p).alias(f"near_{i}") for i, p in enumerate(rules)])
    few = few.persist()
    held = few.agg(F.sum(sum((F.size(f"near_{i}") for i in range(len(rules))), F.lit(0)))).first()[0]
    both = asked.join(F.broadcast(few) if (held or 0) <= send else few, [*on, "x", "y"], "left")
    best = lambda i: F.array_min(F.transform(f"near_{i}", lambda c: F.struct(F.round(haversine_km(F.col("__lat"), F.col("__lon"), c["lat"], c["lon"]), 9).alias("km"), c["s"]["site"].alias("site"), c["s"]["y"].alias("y"), c["s"]["capacity"].alias("capacity"))))
    long = F.array(*[F.struct(F.lit(n).alias("policy"), best(i).alias("b")) for i, n in enumerate(rules)])
    return both.select(*keys, F.inline(long)).select(*keys, "policy", "b.*")


def allocation_report(chosen: DataFrame, bad: Column, *keys: str) -> DataFrame:
    """Served and bad shares of requests; the bad share of what was served; requests that were not served or badly; mean
    and ninth decile of the distance of what was served. Distances are summed as decimals: a mean doesn't depend on the
    order of rows, and policies that choose the same sites have the same one."""
    served = F.col("site").isNotNull()
    poor = F.coalesce(served & bad, F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    nan = F.isnan("km")
    mean = F.sum(F.when(~nan, F.col("km").cast("decimal(20,9)"))) / F.nullif(F.count("km"), F.lit(0))
    return chosen.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("site").alias("n_assigned"),
        share(served).alias("served"),
        share(poor).alias("bad"),
        share(F.when(served, poor)).alias("overflow"),
        share(~served | poor).alias("unserved_or_overflow"),
        F.coalesce(F.max(F.when(nan, F.col("km"))), mean.cast("double")).alias("mean_km"),
        F.percentile("km", d(0.9)).alias("p90_km"),
    )


def policy_contrasts(outcomes: DataFrame, cases: list[tuple[str, str, str]], *keys: str, seed: str = "seed") -> DataFrame:
    """Of two policies on the same requests of each seed: means, the mean, least and greatest difference a - b, in how many
    seeds it is above 0, and the difference by the mean of a. outcomes: keys, seed, policy, values. All cases (a, b, value)
    come from one pass over outcomes."""
    pick = lambda p, value: F.max(F.when(F.col("policy") == p, F.col(value)))
    every = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.lit(value).alias("value"), pick(a, value).alias("a"), pick(b, value).alias("b")) for a, b, value in cases])
    one = outcomes.groupBy(*keys, seed).agg(every.alias("__cases")).select(*keys, seed, F.inline("__cases")).withColumn("d", F.col("a") - F.col("b"))
    return one.groupBy(*keys, "contrast", "value").agg(F.count("d").alias("n_seeds"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_d"), F.min("d").alias("least_d"), F.max("d").alias("greatest_d"), F.count_if(F.col("d") > 0).alias("n_above"), F.try_divide(F.avg("d"), F.nullif(F.avg("a"), F.lit(0.0))).alias("relative_d"))


def policy_pairs(outcomes: DataFrame, a: str, b: str, value: str, *keys: str, seed: str = "seed") -> DataFrame:
    """One case of policy_contrasts."""
    return policy_contrasts(outcomes, [(a, b, value)], *keys, seed=seed)


def relative_policies(theta: float) -> dict:
    """Offers while the predicted occupancy is at most a share of the capacity."""
    return {"POINT": lambda: F.col("yhat") <= d(theta) * F.col("capacity"), "INTERVAL": lambda: F.col("upper") <= d(theta) * F.col("capacity")}


def capacity_proxy(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.when(F.col("split") == "train", F.col(value))).alias("capacity"))


def capability(df: DataFrame, shares: list[float], *keys: str) -> DataFrame:
    """Slots at or above shares of capacity, by input alone."""
    grid = F.explode(F.array(*map(d, shares)))
    rows = df.withColumn("theta", grid)
    return rows.groupBy(*keys, "theta").agg(F.count("*").alias("n"), F.count_if(F.col("y") >= F.col("theta") * F.col("capacity")).alias("n_events"), F.avg((F.col("y") >= F.col("theta") * F.col("capacity")).cast("double")).alias("event_rate"), F.avg((F.col("yhat") > F.col("theta") * F.col("capacity")).cast("double")).alias("point_withdraws"), F.avg((F.col("upper") > F.col("theta") * F.col("capacity")).cast("double")).alias("interval_withdraws"), F.count_if((F.col("upper") > F.col("theta") * F.col("capacity")) & (F.col("yhat") <= F.col("theta") * F.col("capacity"))).alias("interval_only"))


def withdrawals(df: DataFrame, withdrawn: Column, onset: Column, *keys: str, order: str = "i") -> DataFrame:
    """The first step from the onset on at which an offer is withdrawn, the lead to it, whether it then stays so, and
    rates before and after."""
    after = F.col(order) >= onset
    rows = df.withColumn("__w", withdrawn).withColumn("__after", after)
    first = F.min(F.when(F.col("__w") & F.col("__after"), F.col(order))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("__first", first).withColumn("__onset", onset)
    return rows.groupBy(*keys).agg(F.max("__first").alias("first_withdrawal"), (F.max("__first") - F.max("__onset")).alias("lead"), F.bool_and(F.when(F.col(order) >= F.col("__first"), F.col("__w"))).alias("persistent"), F.avg(F.when(~F.col("__after"), F.col("__w").cast("double"))).alias("rate_before"), F.avg(F.when(F.col("__after"), F.col("__w").cast("double"))).alias("rate_after"))


def causal(injected: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Which withdrawals the injection caused: new ones, or earlier than without it."""
    b = baseline.select(*keys, F.col("first_withdrawal").alias("base_first"), F.col("rate_after").alias("base_rate"))
    rows = injected.join(b, list(keys), "left")
    new = F.col("first_withdrawal").isNotNull() & (F.col("base_first").isNull() | (F.col("first_withdrawal") < F.col("base_first")))
    return rows.withColumn("caused", new).withColumn("excess", F.col("rate_after") - F.coalesce("base_rate", F.lit(0.0)))


def same_masks(df: DataFrame, a: Column, b: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(a == b).alias("identical"), F.count_if(a != b).alias("n_different"))


