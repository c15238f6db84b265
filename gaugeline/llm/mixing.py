"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are counted by membership pattern (the set of a document's sources); token
capacity of each pattern is routed to the quotas of its sources by a min-cost flow in which a pattern's n-th pass over
its documents costs more than the one before (convex costs, so no pattern is repeated before others are used once, as
far as quotas allow); then documents are selected: whole passes, and for the rest a seeded order of the pattern's
documents, cut before the rest is exceeded. The NEAR documents before the cut and as many after it are then chosen anew,
as the sum of sizes that comes nearest to what they should give: first among copies that differ by one pass, and where
that leaves more than a thousandth of the pattern's tokens open, among all numbers of copies. Sums are exact up to
SUMS distinct ones; beyond, of sums that differ by less than a share 1 / SUMS of the whole one is kept. A pattern of at
most 2 * NEAR documents so takes what comes nearest of all that can be taken.

Equal rows (key, size, pattern and text hash) are one group with a count until the end. The flow's graph is built from
counts: a node per pattern and per source, gathered on the driver. Its size is the number of patterns, not of documents
(some kilobytes each); `max_patterns` guards the driver's memory, and what has more raises and can be given a higher
one. The seeded order's cut is found from sums per (pattern, 4096 hash ranges), and the documents near it in the few
ranges around the cut, so no task sorts a whole source.

Defined results: a null text has no words and is taken as often as its pattern asks, for no words; a null or empty list
of sources is the source null, which comes last; a source without words has target 0; equal rows are separate documents,
whose copies differ by one at most; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, ordered, text_or_empty, unfolded, unused

BUCKETS = 4096
#: Documents on each side of a cut that are chosen anew, and distinct sums that are told apart.
NEAR, SUMS = 64, 1 << 15
#: Equal rows that one task unfolds at a time, and rows that are sent to all executors, of some 40 bytes.
LOT, SEND = 100_000, 1_000_000


def targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Quotas of sources. Sources by code point, null last, get the weights in turn, and `share` of all sizes by weight;
    a target stops at `most` times the source's size, and the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, free = share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _component(patterns: list, tokens: dict, quota: dict, passes: int) -> dict:
    """Successive shortest paths with potentials. Nodes: start, patterns, sources, end; pass k of a pattern costs k * k
    more than nothing. The routed tokens of each (pattern, source)."""
    names = ["<", *patterns, *sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or "")), ">"]
    at = {("p", n) if isinstance(n, tuple) else ("s", n): i for i, n in enumerate(names)}
    edges: list[list] = []  # to, capacity left, cost
    out: list[list[int]] = [[] for _ in names]

    def add(a: int, b: int, cap: int, cost: int) -> None:
        for x, e in ((a, [b, cap, cost]), (b, [a, 0, -cost])):
            out[x].append(len(edges))
            edges.append(e)

    first, last = 0, len(names) - 1
    routes = {}
    for p in patterns:
        for k in range(passes):
            add(first, at["p", p], tokens[p], k * k)
        for s in p:
            routes[p, s] = len(edges)
            add(at["p", p], at["s", s], passes * tokens[p], 0)
    for i, n in enumerate(names[1:-1], 1):
        if not isinstance(n, tuple):
            add(i, last, quota[n], 0)
    high = [0] * len(names)
    while True:
        far, via, queue = {first: 0}, {}, [(0, first)]
        done = set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                to, cap, cost = edges[e]
                if cap > 0 and (new := d + cost + high[x] - high[to]) < far.get(to, 1 << 62):
                    far[to], via[to] = new, e
                    heapq.heappush(queue, (new, to))
        if last not in far:
            break
        high = [h + far.get(i, far[last]) for i, h in enumerate(high)]
        path, x = [], last
        while x != first:
            path.append(via[x])
            x = edges[via[x] ^ 1][0]
        flow = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= flow
            edges[e ^ 1][1] += flow
    return {ps: edges[e ^ 1][1] for ps, e in routes.items()}


def route(tokens: dict, quota: dict, passes: int = 2) -> dict:
    """Routed tokens of each (pattern, source): a min-cost flow of each connected part of the pattern-source graph."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in tokens:
        for s in p[1:]:
            root[find(("s", s))] = find(("s", p[0]))
    parts: dict = {}
    for p in sorted(tokens, key=repr):
        parts.setdefault(find(("s", p[0])), []).append(p)
    routed: dict = {}
    for patterns in parts.values():
        routed |= _component(patterns, tokens, quota, passes)
    return routed


def _member(df: DataFrame, sources: str) -> Column:
    kind = df.select(sources).schema[0].dataType
    member = F.array_sort(F.array_distinct(F.col(sources))) if isinstance(kind, T.ArrayType) else F.array(F.col(sources).cast("string"))
    return F.when(F.coalesce(F.size(member), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(member)


def _prio(key: str, text: str, seed: int) -> Column:
    """A seeded hash of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.crc32(F.encode(text_or_empty(text), "UTF-8"))), 1)


def _bucket(prio: str) -> Column:
    return F.shiftright(prio, 51).cast("int")


def grouped(df: DataFrame, key: str, text: str, sources: str, seed: int) -> DataFrame:
    """key, size, pattern (sorted array of sources), prio (a seeded hash), n (rows that share these) and bucket (the highest 12
    bits of prio). sources: a column of one source, or of an array of them."""
    rows = df.select(F.col(key).alias("key"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"), _member(df, sources).alias("pattern"), _prio(key, text, seed).alias("prio"))
    return rows.groupBy("key", "size", "pattern", "prio").agg(F.count("*").alias("n")).withColumn("bucket", _bucket("prio"))


def nearest(sizes: Sequence[int], counts: Sequence[Sequence[int]], want: int) -> list[int]:
    """For each size one of its counts, so that the sum of size times count comes nearest to `want`; among equals the
    smaller sum, and of one sum the counts that come first."""
    import numpy as np

    sums, steps = np.zeros(1, np.int64), []
    for size, options in zip(sizes, counts, strict=True):
        made = np.concatenate([sums + size * c for c in options])
        made, first = np.unique(made, return_index=True)
        # of sums beyond what is wanted only the least can matter
        upto = np.searchsorted(made, want, "right") + 1
        made, first = made[:upto], first[:upto]
        if len(made) > SUMS:
            part = (made - made[0]) * SUMS // max(1, int(made[-1] - made[0]))
            keep = np.flatnonzero(np.diff(part, prepend=-1))
            made, first = made[keep], first[keep]
        steps.append(((first % len(sums)).astype(np.int32), (first // len(sums)).astype(np.int8)))
        sums = made
    at, out = int(np.argmin(np.abs(sums - want))), []
    for (before, which), options in zip(reversed(steps), reversed(list(counts)), strict=True):
        out.append(options[int(which[at])])
        at = int(before[at])
    return out[::-1]


def chosen(sizes: Sequence[int], picked: Sequence[bool], full: int, most: int, gap: int, tokens: int) -> list[int]:
    """Copies of the documents around a cut. gap: what the picked ones leave open."""
    one = [[min(most, full + p), min(most, full + (not p))] for p in picked]
    want = gap + sum(s * o[0] for s, o in zip(sizes, one, strict=True))
    best = nearest(sizes, one, want)
    off = abs(sum(s * c for s, c in zip(sizes, best, strict=True)) - want)
    if 1000 * off <= tokens:
        return best
    more = nearest(sizes, [[*o, *(c for c in range(most + 1) if c not in o)] for o in one], want)
    return more if abs(sum(s * c for s, c in zip(sizes, more, strict=True)) - want) < off else best


def _rechosen(near: DataFrame, most: int) -> DataFrame:
    """pattern, prio, key, size, copies (of all rows of the group) of the groups near their pattern's cut. A row of near:
    a group, with up to NEAR of its rows that are picked (inside) and of those that are not (outside)."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (r["prio"], r["key"] is not None, r["key"] or "", r["size"]))
        sizes, picked, of = [], [], []
        for i, r in enumerate(rows):
            units = r["inside"] + r["outside"]
            sizes += [r["size"]] * units
            picked += [True] * r["inside"] + [False] * r["outside"]
            of += [i] * units
        one = rows[0]
        total = [r["away"] for r in rows]
        for i, c in zip(of, chosen(sizes, picked, one["full"], most, one["gap"], one["tokens"]), strict=True):
            total[i] += c
        schema = pa.schema([("pattern", pa.list_(pa.string())), ("prio", pa.int64()), ("key", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("copies", pa.int64())])
        return pa.table({c: [r[c] for r in rows] for c in schema.names[:-1]} | {"copies": total}, schema=schema)

    kind = near.schema["key"].dataType.simpleString()
    near = near.withColumn("key", F.col("key").cast("string"))
    found = near.groupBy("pattern").applyInArrow(run, "pattern array<string>, prio long, key string, size long, n long, copies long")
    return found.withColumn("key", F.col("key").cast(kind))


class Mix:
    """groups: with pattern, prio and n. plan: a row per pattern (pattern, full, last: the hash up to which its documents get
    one copy more). near: the groups near cuts, with the copies of all their rows. sizes, quota: of sources."""

    def __init__(self, df: DataFrame, key: str, text: str, sources: str, seed: int, weights=(5, 2, 1), share: float = 1.5, most: int = 2, max_patterns: int = 100_000) -> None:
        spark, self.most = df.sparkSession, most
        self.scratch = scratch = Scratch(spark)
        self.groups = groups = scratch.stage(grouped(df, key, text, sources, seed), "mix-groups")
        worth = F.col("size") * F.col("n")
        sums = scratch.stage(groups.groupBy("pattern", "bucket").agg(F.sum(worth).alias("tokens"), F.sum("n").alias("rows")), "mix-sums")
        found = sums.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
        if len(found) > max_patterns:
            raise ValueError(f"more than {max_patterns} membership patterns; max_patterns may be raised as far as the driver's memory goes")
        tokens = {tuple(r["pattern"]): int(r["tokens"]) for r in found}
        self.sizes: dict = {}
        for p, n in tokens.items():
            for s in p:
                self.sizes[s] = self.sizes.get(s, 0) + n
        self.quota = targets(self.sizes, weights, share, most)
        routed = route({p: n for p, n in tokens.items() if n}, {s: round(x) for s, x in self.quota.items()}, most)
        plan = []
        for p, n in tokens.items():
            total = sum(routed.get((p, s), 0) for s in p)
            full = min(most, total // n) if n else 0
            plan.append((list(p), full, total - full * n, n))
        plan = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, full int, rest long, tokens long"))

        # the ranges around the cut that hold NEAR rows on either side
        order = Window.partitionBy("pattern").orderBy("bucket")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.withColumn("upto", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        ahead = ahead.join(plan.select("pattern", "full", "rest", F.col("tokens").alias("all")), "pattern").filter("all > 0")
        inside = F.col("upto") <= F.col("rest")  # of a pattern's ranges, the first ones begin before its cut
        at_cut = ahead.groupBy("pattern").agg(F.max(F.when(inside, F.col("rows_before"))).alias("low"), F.max(F.when(inside, F.col("rows_before") + F.col("rows"))).alias("high"))
        about = ahead.join(F.broadcast(at_cut), "pattern").filter((F.col("rows_before") + F.col("rows") > F.col("low") - NEAR) & (F.col("rows_before") < F.col("high") + NEAR))
        span = about.groupBy("pattern").agg(F.min("bucket").alias("first"), F.max("bucket").alias("final"), F.min("upto").alias("upto"), F.first("full").alias("full"), F.first("rest").alias("rest"), F.first("all").alias("tokens"))
        span = scratch.stage(span, "mix-span")

        # in them: who is picked, and how far from the cut
        run = Window.partitionBy("pattern").orderBy("prio", "key", "size")
        rows = groups.join(F.broadcast(span), "pattern").filter(F.col("bucket").between(F.col("first"), F.col("final")))
        rows = rows.withColumn("before", F.col("upto") + F.coalesce(F.sum(worth).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("before")) / F.col("size"))).otherwise(F.when(F.col("before") <= F.col("rest"), F.col("n")).otherwise(0))
        rows = rows.withColumn("picked", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long"))
        every = Window.partitionBy("pattern")
        rows = rows.withColumn("gap", F.col("rest") - F.max(F.when(F.col("picked") > 0, F.col("before") + F.col("picked") * F.col("size")).otherwise(F.col("upto"))).over(every))
        back = Window.partitionBy("pattern").orderBy(F.col("prio").desc(), F.col("key").desc(), F.col("size").desc())
        picked_after = F.coalesce(F.sum("picked").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        open_before = F.coalesce(F.sum(F.col("n") - F.col("picked")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("inside", F.greatest(F.lit(0), F.least(F.col("picked"), NEAR - picked_after)).cast("long"))
        rows = rows.withColumn("outside", F.greatest(F.lit(0), F.least(F.col("n") - F.col("picked"), NEAR - open_before)).cast("long"))
        away = F.least(F.lit(most), F.col("full") + 1) * (F.col("picked") - F.col("inside")) + F.col("full") * (F.col("n") - F.col("picked") - F.col("outside"))
        rows = rows.withColumn("away", away.cast("long"))
        last = rows.groupBy("pattern").agg(F.max(F.when(F.col("picked") > 0, F.col("prio"))).alias("last"))
        near = rows.filter((F.col("inside") + F.col("outside") > 0) | F.col("picked").between(1, F.col("n") - 1))
        self.near = scratch.stage(_rechosen(near.select("pattern", "prio", "key", "size", "n", "full", "tokens", "gap", "inside", "outside", "away"), most), "mix-near")
        # documents of ranges before the span are picked too
        last = span.join(last, "pattern", "left").select("pattern", F.coalesce("last", F.shiftleft(F.col("first").cast("long"), 51) - 1).alias("last"))
        self.plan = F.broadcast(scratch.stage(plan.join(last, "pattern", "left").select("pattern", "full", "last"), "mix-plan"))
        scratch.drop(sums, span)

    def copies_of(self, rows: DataFrame) -> DataFrame:
        """groups (pattern, prio, key, size, n) with the copies of all their rows."""
        on = ["pattern", "prio", "size"]
        near = self.near.select(*on, F.col("key").alias("near_key"), F.col("copies").alias("chosen"))
        near = F.broadcast(near) if self.near.count() <= SEND else near
        rows = rows.join(near, [rows[c].eqNullSafe(near[c]) for c in on] + [rows["key"].eqNullSafe(near["near_key"])], "left").select(*[rows[c] for c in rows.columns], "chosen")
        rows = rows.join(self.plan, "pattern", "left")
        return rows.withColumn("copies", F.coalesce("chosen", F.col("n") * _passes(self.most))).drop("chosen", "full", "last")


def _passes(most: int, prio: str = "prio", full: str = "full", last: str = "last") -> Column:
    """Copies of a row that isn't near its pattern's cut."""
    return F.least(F.lit(most), F.coalesce(full, F.lit(0)) + F.when(F.col(prio) <= F.col(last), 1).otherwise(0)).cast("long")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", sources: str = "source", seed: int = 20, **how) -> DataFrame:
    """A row per row of df: key, size, pattern, copies, taken, and of a single source its source_size and target."""
    m = Mix(df, key, text, sources, seed, **how)
    rows = unfolded(m.copies_of(m.groups), "n", "number", ["key", "prio"], LOT)
    of_one = F.expr("copies div n") + F.when(F.col("number") < F.col("copies") % F.col("n"), 1).otherwise(0)
    rows = rows.select("key", "size", "pattern", of_one.cast("int").alias("copies"))
    info = df.sparkSession.createDataFrame([([s], n, float(m.quota[s])) for s, n in m.sizes.items()], "pattern array<string>, source_size long, target double")
    return rows.join(F.broadcast(info), "pattern", "left").withColumn("taken", F.col("copies") * F.col("size"))


def repeat_rows(df: DataFrame, key: str = "doc_id", text: str = "text", sources: str = "source", seed: int = 20, **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it. Texts aren't moved: a row's copies follow from its pattern and
    hash, but for the few near their pattern's cut. Of equal rows there, as many are taken as the mix says; they are
    combined, with a count, before they meet."""
    m = Mix(df, key, text, sources, seed, **how)
    pattern, prio, full, last, n, copies, at = unused(df, "pattern", "prio", "full", "last", "n", "copies", "at")
    rows = df.withColumn(pattern, _member(df, sources)).withColumn(prio, _prio(key, text, seed))
    rows = rows.join(m.plan.select(F.col("pattern").alias(pattern), F.col("full").alias(full), F.col("last").alias(last)), pattern, "left")
    near = m.near.groupBy("pattern", "prio", "key").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    near = m.scratch.stage(near, "mix-near-rows")
    side = F.broadcast(near) if near.count() <= SEND else near
    near_row = (rows[pattern] == near["pattern"]) & (rows[prio] == near["prio"]) & rows[key].eqNullSafe(near["key"])
    rows = rows.join(side, near_row, "left").select(*[rows[c] for c in rows.columns], near["n"].alias(n), near["copies"].alias(copies))
    alone = rows.filter(F.col(n).isNull() | (F.col(n) == 1)).withColumn(copies, F.coalesce(copies, _passes(m.most, prio, full, last)))
    out = alone.filter(F.col(copies) > 0).withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(df.columns)
    if near.filter("n > 1").isEmpty():
        return out
    alike = rows.filter(F.col(n) > 1).groupBy(*df.columns, pattern, prio, n, copies).agg(F.count("*").alias(at))
    upto = F.sum(at).over(Window.partitionBy(pattern, prio, key).orderBy(ordered(df)))
    # the first `copies % n` of n rows get one more
    given = lambda k: k * F.expr(f"`{copies}` div `{n}`") + F.least(k, F.col(copies) % F.col(n))
    alike = alike.withColumn(full, upto).withColumn(copies, given(F.col(full)) - given(F.col(full) - F.col(at)))
    return out.unionByName(unfolded(alike.drop(at), copies, at, [prio, full], LOT).select(df.columns))
