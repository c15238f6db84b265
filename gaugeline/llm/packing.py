"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a tail. Lengths fall into reciprocal-capacity classes: class k holds
pieces of at most capacity // k ids, and each of its bins takes k of them, whatever they are, so each worker fills bins
from counts alone. A tail that would waste more than `waste` of its share of a bin is cut at the next class's exact size
first. A worker numbers its pieces by class; counts per (class, task) give each piece its rank in the class, and rank
div k its bin. Less than k pieces of each class are left over, a number bounded by the classes and not by the corpus:
those few lengths are packed by best fit on the driver.

Defined results: a null or empty text is the end id alone; equal rows are packed as separate documents; a text of any
length is cut; no rows give no sequences; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts, stage

CAPACITY = 4096
PIECES = "doc_id long, start long, length int, doc_tokens long, class int, task int, turn long, ids binary"


def classes(capacity: int = CAPACITY, fine: int = 64, ratio: float = 1.25) -> list[int]:
    """1 to `fine`, then growing by `ratio` up to the capacity."""
    out = list(range(1, min(fine, capacity) + 1))
    while out[-1] < capacity:
        out.append(min(capacity, max(out[-1] + 1, int(out[-1] * ratio))))
    return out


def cut(n: int, capacity: int, known: list[int], waste: float, fine: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of n ids."""
    out = [(s, capacity, 1) for s in range(0, n - capacity + 1, capacity)]
    start = len(out) * capacity
    while (left := n - start) > 0:
        k = known[bisect_left(known, capacity // left + 1) - 1]
        if k < fine and left * k < (1 - waste) * capacity:
            out.append((start, capacity // (k + 1), k + 1))
            start += capacity // (k + 1)
        else:
            out.append((start, left, k))
            break
    return out


def pieces(df: DataFrame, path: str, space: str, end: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, waste: float = 0.04, fine: int = 64) -> DataFrame:
    """One row per piece with its ids, and its turn among the pieces of its class that the same task made."""
    known = classes(capacity, fine)

    def run(found):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import batches, encoder

        enc, task, turns = encoder(path, space), TaskContext.get().partitionId(), dict.fromkeys(known, 0)
        for batch in in_parts(found):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in batches(texts):
                rows = []
                for i, raw in enumerate(enc.encode(some), at):
                    raw += end.to_bytes(4, "little")
                    n = len(raw) // 4
                    for start, length, k in cut(n, capacity, known, waste, fine):
                        rows.append((keys[i], start, length, n, k, task, turns[k], raw[4 * start : 4 * (start + length)]))
                        turns[k] += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stage(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES), "pieces")


@dataclass
class Packed:
    """pieces: with ids. places: the pieces with sequence_id and offset, without ids but with what was carried."""

    pieces: DataFrame
    places: DataFrame
    capacity: int

    def sequences(self, pad: int = 0) -> DataFrame:
        """sequence_id, ids: the packed sequences, padded to the capacity unless their length is a power of two."""
        piece = ["class", "task", "turn"]
        joined = self.places.select(*piece, "sequence_id", "offset").join(self.pieces.select(*piece, "ids"), piece)
        one = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
        n = F.octet_length("ids") / 4
        return one.select("sequence_id", ids.alias("ids")).withColumn("ids", F.when(F.bit_count(n.cast("long")) == 1, F.col("ids")).otherwise(F.concat("ids", F.unhex(F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', {self.capacity} - int(octet_length(ids) / 4))")))))


def best_fit(lengths: list[tuple[int, tuple]], capacity: int) -> dict[tuple, tuple[int, int]]:
    """(bin, offset) of each named length, longest first, each into the fullest bin that has room."""
    out, room, bins = {}, [], 0
    for length, name in sorted(lengths, key=lambda x: (-x[0], x[1])):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, bins = capacity, bins, bins + 1
        out[name] = (b, capacity - free)
        if free > length:
            insort(room, (free - length, b))
    return out


def place(found: DataFrame, capacity: int = CAPACITY, carry: tuple = ()) -> DataFrame:
    """Adds sequence_id and offset to pieces; only narrow columns and those in `carry` are moved."""
    spark = found.sparkSession
    narrow = found.select("doc_id", "start", "length", "doc_tokens", "class", "task", "turn", *carry)
    counts = stage(found.groupBy("class", "task").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row per class
    base, bins = {}, 0
    for k in sorted(totals):
        base[k], bins = bins, bins + totals[k] // k
    layout = F.broadcast(spark.createDataFrame([(k, base[k], totals[k] // k) for k in totals], "class int, base long, bins long"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = narrow.join(before, ["class", "task"]).withColumn("rank", F.col("before") + F.col("turn")).join(layout, "class").withColumn("bin", F.floor(F.col("rank") / F.col("class")))
    full = ranked.filter(F.col("bin") < F.col("bins"))
    run = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("sequence_id", F.col("base") + F.col("bin")).withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long"))
    rest = ranked.filter(F.col("bin") >= F.col("bins"))
    few = rest.select("class", "task", "turn", "length").collect()  # fewer than k of each class k
    fit = best_fit([(r["length"], (r["class"], r["task"], r["turn"])) for r in few], capacity)
    fits = spark.createDataFrame([(*name, bins + b, offset) for name, (b, offset) in fit.items()], "class int, task int, turn long, sequence_id long, offset long")
    rest = rest.join(F.broadcast(fits), ["class", "task", "turn"])
    keep = ["doc_id", "start", "length", "doc_tokens", "class", "task", "turn", *carry, "sequence_id", "offset"]
    return full.select(keep).unionByName(rest.select(keep))


def pack(df: DataFrame, path: str, space: str, end: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, digest=None) -> Packed:
    """digest: makes a named column of a piece's ids that goes along to the places."""
    found = pieces(df, path, space, end, key, text, capacity)
    carried = found if digest is None else found.withColumn("digest", digest(F.col("ids")))
    return Packed(found, place(carried, capacity, ("digest",) if digest is not None else ()), capacity)
