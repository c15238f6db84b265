"""Sharding by fixed virtual slots.

Each record hashes to one of `n_slots` virtual slots, for good. Bytes are added up per slot, and a slot map, a table of
`n_slots` rows with a version, says which shard holds each slot. Rebalancing edits the map (a new version), never the
hash: only the slots that change hands move. All steps are DataFrame operations; what is gathered in one row or
broadcast is bounded by `n_slots`.

Equal rows (same key, size and checksum) are counted first and dealt as numbered copies, each with a slot of its own, so
that a crowd of them spreads over all slots; the narrow rows meet once for that, by all their values.

Defined results: a null text has no bytes and checksum 0; a null key hashes like any other value, together with the
text's checksum; equal rows get different places, whichever of them has which; an empty table gives an empty map and no
rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stage, unfolded

N_SLOTS = 4096
OVERHEAD = 8
#: Equal rows that one task unfolds at a time.
LOT = 100_000


def counted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes of the text plus 8) and text_crc32, with the number n of rows that share them; the text is
    read once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    return rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))


def slotted(df: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """key, size, text_crc32, copy and virtual_slot of each row. The first of equal rows has the slot of its values."""
    salt = F.when(F.col("copy") > 0, F.col("copy"))  # hashes skip nulls
    rows = unfolded(counted(df, key, text), "n", "copy", ["key", "text_crc32"], LOT).drop("n")
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("key", "text_crc32", salt), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, records: at most n_slots rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _deal(items: Column, loads: Column) -> Column:
    """Deals items (structs with bytes, largest first) to the shard that holds least so far; an array of shards."""

    def step(acc: Column, item: Column) -> Column:
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        put = F.transform(F.array(least), lambda k: F.struct(F.transform(acc["loads"], lambda x, i: F.when(i == k, x + item["bytes"]).otherwise(x)).alias("loads"), F.concat(acc["out"], F.array(k)).alias("out")))
        return put[0]

    return F.aggregate(items, F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def edit_map(totals: DataFrame, n_shards: int, old: DataFrame | None = None) -> DataFrame:
    """A slot map (virtual_slot, bytes, records, shard) for n_shards. With an old map, each shard gives
    up small slots until it is down to the new mean; these, and slots that the old map lacks, are dealt anew."""
    mean = totals.agg((F.sum("bytes") / n_shards).alias("mean"))
    if old is None:
        held = totals.withColumn("kept", F.lit(None).cast("int"))
    else:
        shard = Window.partitionBy("shard")
        before = F.coalesce(F.sum("bytes").over(shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = totals.join(F.broadcast(old.select("virtual_slot", "shard")), "virtual_slot", "left").withColumn("before", before).withColumn("load", F.sum("bytes").over(shard)).crossJoin(F.broadcast(mean))
        stays = (F.col("shard") < n_shards) & (F.col("before") >= F.col("load") - F.col("mean"))
        held = held.withColumn("kept", F.when(stays, F.col("shard"))).drop("before", "load", "mean", "shard")
    item = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "records", "kept")
    one = held.agg(F.array_sort(F.collect_list(F.when(F.col("kept").isNull(), item))).alias("free"), F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), item))).alias("held"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.when(x["kept"] == k, x["bytes"]).otherwise(F.lit(0).cast("long"))))
    dealt = one.withColumn("dealt", _deal(F.col("free"), loads))
    both = F.concat(F.transform("free", lambda x, i: F.struct(x["virtual_slot"].alias("virtual_slot"), x["bytes"].alias("bytes"), x["records"].alias("records"), F.get("dealt", i).alias("shard"))), F.transform("held", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["bytes"].alias("bytes"), x["records"].alias("records"), x["kept"].alias("shard"))))
    return dealt.select(F.inline(both))


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Adds a version to the store; an existing version is never overwritten."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named version, or the latest."""
    versions = spark.read.parquet(path)
    latest = version if version is not None else versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == latest)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and place, gapless from 0 in each shard: the records of earlier slots of the shard, then the place in
    the own slot. No task sees more than one slot's rows, which hold a key, a size and a checksum only."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", "version", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size", "copy")
    return rows.withColumn("place", F.row_number().over(inside).cast("long") - 1).join(F.broadcast(offsets), "virtual_slot").withColumn("place", F.col("place") + F.col("before")).drop("before")


def shard(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, store: str | None = None) -> DataFrame:
    """Puts all rows into n_shards of nearly equal bytes: key, size, text_crc32, virtual_slot, shard, version, place.
    The map is stored under `store` (default: a new folder in the shared one) as version 1, or, where the store has
    versions, edited from its latest one."""
    spark = df.sparkSession
    rows = stage(slotted(df, key, text, n_slots), "slots")
    totals = slot_totals(rows)
    old = read_map(spark, store) if store else None
    version = old.agg(F.max("version")).first()[0] + 1 if old is not None else 1
    store = store or shared_path(spark, "slot-map")
    write_map(edit_map(totals, n_shards, old), store, version)
    return placed(rows, read_map(spark, store, version))
