"""Exact top-k search in binary codes by incremental multi-index hashing.

A vector's code holds the signs of its elements, in words of 64 bits: as many as the longest vector needs. Codes are cut
into m segments of 16 bits; an index maps (segment, value) to the distinct codes that have it there. Round r of a search
looks up all values at Hamming distance r from the query's segments. Once segments 0 to j have been searched up to
radius r and the others up to r - 1, every code within distance m * r + j has been met; so a query stops when its kth
verified distance is covered, ties included, and within a round it uses no more segments than that takes. Nothing is
approximate.

Equal codes are one entry with their k smallest ids, equal query codes are searched once, and an entry with many codes
is split by their hash, so no row or task holds a crowd. All joins deal both sides out; nothing is sent to all executors.

Defined results: a null vector, or one with a null, has no code: it is neither found nor answered; a vector shorter than
the longest has zeros in front; a row isn't its own neighbour, a repeated row with the same id isn't either; ties go to
the smaller id; queries with fewer than k others get all of them; an empty table, or one of empty vectors, gives
distances of 0 or no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS, WIDTH = 64, 16
#: Codes of one index row.
FULL = 512


def sign_code(vector: Column, words: int) -> list[Column]:
    """The signs of a vector's elements as words of 64 bits, the last element in the lowest bit of the last word; null if
    the vector or an element is."""
    whole = ~F.exists(vector, lambda x: x.isNull())
    bit = lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))

    def word(j: int) -> Column:
        """The j-th from the end."""
        stop = F.greatest(F.lit(0), F.size(vector) - BITS * j)
        start = F.greatest(F.lit(0), stop - BITS)
        part = vector if words == 1 else F.slice(vector, start + 1, stop - start)
        return F.when(whole, F.aggregate(part, F.lit(0).cast("long"), bit)).alias(f"c{words - 1 - j}")

    return [word(j) for j in reversed(range(words))]


def distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def segments(code: list[Column]) -> Column:
    return F.array(*[F.shiftrightunsigned(c, WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for c in code for j in range(BITS // WIDTH)])


def build_index(codes: DataFrame, names: list[str]) -> DataFrame:
    """segment, value, codes: arrays of at most about FULL codes."""
    rows = codes.select(F.struct(*names).alias("code"), F.posexplode(segments([F.col(n) for n in names])).alias("segment", "value"))
    counts = rows.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > FULL)
    split = rows.join(counts.hint("merge"), ["segment", "value"], "left").withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("code"), F.ceil(F.col("n") / (FULL // 2)))))
    return split.groupBy("segment", "value", "part").agg(F.collect_list("code").alias("codes")).drop("part")


def masks(r: int) -> Column:
    """The numbers of WIDTH bits with r of them set, as a literal."""
    return F.from_json(F.lit(json.dumps([x for x in range(1 << WIDTH) if x.bit_count() == r])), "array<int>")


def search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbour_id, distance for each row of queries, against all rows of df."""
    scratch = Scratch(df.sparkSession)
    longest = lambda x: x.agg(F.max(F.size(vector))).first()[0] or 0
    words = max(1, -(-max(longest(df), longest(queries)) // BITS))
    m = words * (BITS // WIDTH)
    names, asks = [f"c{j}" for j in range(words)], [f"q{j}" for j in range(words)]
    query = [F.col(q) for q in asks]

    own = scratch.stage(df.select(F.col(key).cast("long").alias("id"), *sign_code(F.col(vector), words)).filter("c0 is not null"), "codes")
    ranked = own.distinct().withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).filter(F.col("n") <= k + 1)
    entries = scratch.stage(ranked.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    index = scratch.stage(build_index(entries, names), "code-index")
    asked = queries.select(F.col(key).cast("long").alias("query_id"), *[c.alias(q) for c, q in zip(sign_code(F.col(vector), words), asks, strict=True)])
    asked = scratch.stage(asked.filter("q0 is not null").distinct(), "asked")
    state = scratch.stage(asked.select(*asks).distinct().withColumn("bound", F.lit(BITS * words)), "bounds")
    best = None
    sizes = entries.select(*names, F.size("ids").alias("n_ids"), F.get("ids", F.lit(0)).alias("least"))
    for r in range(WIDTH + 1):
        active = state.filter(F.col("bound") >= m * r)
        if active.isEmpty():
            break
        parts = active.select(*asks, "bound", F.posexplode(segments(query)).alias("segment", "at")).filter(F.col("segment") + m * r <= F.col("bound"))
        probes = parts.select(*asks, "bound", "segment", "at", F.explode(masks(r)).alias("mask")).select(*asks, "bound", "segment", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))
        near = F.filter("codes", lambda c: distance([c[n] for n in names], query) <= F.col("bound"))
        hits = index.hint("merge").join(probes, ["segment", "value"]).select(*asks, near.alias("near")).filter(F.size("near") > 0).select(*asks, F.explode("near").alias("code")).select(*asks, "code.*").distinct()
        fresh = hits.join(sizes.hint("merge"), names).select(*asks, *names, distance([F.col(n) for n in names], query).alias("distance"), "n_ids", "least")
        pool = fresh if best is None else best.unionByName(fresh).distinct()
        order = Window.partitionBy(*asks).orderBy("distance", "least")
        best = scratch.stage(pool.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), f"best{r}")
        upto = best.withColumn("upto", F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") >= k + 1).groupBy(*asks).agg(F.min("distance").alias("now"))
        state = scratch.stage(state.join(upto.hint("merge"), asks, "left").select(*asks, F.coalesce("now", "bound").alias("bound")), f"bounds{r}")
    if best is None:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("neighbour_id"), F.lit(0).alias("distance")).limit(0)
    scratch.close(keep=[asked, best, entries])
    rows = asked.join(best.hint("merge"), asks).join(entries.hint("merge"), names).select("query_id", "distance", F.explode("ids").alias("neighbour_id")).filter("not neighbour_id <=> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")
