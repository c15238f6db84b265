"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct five-word shingles. Each shingle hash falls into one of 128 buckets by its highest
bits; a bucket keeps its smallest hash, compressed to a count of leading zeros and ten mantissa bits (HyperMinHash
registers, 16 bits each). That is the sketch of sets of at least FEW shingles. Smaller sets, which would leave buckets
empty, are defined by the same registers with a hash function each over the whole set, up to MANY shingles; sets between
FEW and MANY have both sketches, so any two sets that can be similar enough have one in common. Bands of four registers
are keys; documents that share a key are candidates. Candidate pairs whose similarity, estimated from equal registers
less the expected number of register collisions, is far below the threshold are left out (five standard deviations); the
others are confirmed on full sets of 64-bit shingle hashes.

Only texts with equal sets fall into one class beforehand. Large groups are not expanded into pairs: first each document
meets the first document of the keys it shares most, then the other keys' first ones as far as they are in
another component by then. What keys still hold several components is thinned without loss: two sets that are similar
enough share one of their rarest shingles (the first quarter, in an order of how many documents have them), so only
documents of different components that share such a shingle are compared, in blocks. So the components are those of all
links among candidates. A pair at similarity 0.75 shares no key of 32 with
probability (1 - 0.75 ** 4) ** 32, about 5e-6, for large sets, and less for small ones.

Keys that many rows meet in (a crowded band, a hub, a component) are salted from LOT rows on; what is sent to all
executors then is a row per LOT rows.

Defined results: words of fewer than five are one shingle; without words or text the set is empty and links to
nothing, and every such row stays; a null doc_id takes part, and is its component's smallest only if all are null; rows
that share an id are told apart by their texts; equal rows are copies; of several rows that could stay for a component,
the one with the smallest id, then text hash, then columns does; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_parts, ordered, unused

WORDS, BUCKET_BITS, MANTISSA_BITS, ROWS = 5, 7, 10, 4
#: Sizes of sets that have the sketch for large and that for small ones: 512 times 0.75, and 512 by 0.75.
FEW, MANY = 384, 683
#: The most documents and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 500_000
#: The most rows, of some 40 bytes each, that are sent to all executors; beyond it both sides are dealt out.
SEND = 1_000_000
#: Rows of a key beyond which it is salted.
LOT = 200_000
SIGNATURE = "doc_id long, text_id long, n_shingles long, set_id binary, bands array<long>"


def _shingles(text: str | None, known: dict):
    """The set of a text as sorted 64-bit hashes."""
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    w = min(WORDS, len(h))
    out = np.full(len(h) - w + 1, w, np.uint64)
    for i in range(w):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - w + 1 + i]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _word_hashes() -> dict:
    """The worker's memory of word hashes."""
    import xxhash

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            h = xxhash.xxh64_intdigest(word)
            if len(self) < 100_000 and len(word) < 64:
                self[word] = h
            return h

    if "words" not in _kept:
        _kept["words"] = Known()
    return _kept["words"]


_kept: dict = {}


def _register(smallest):
    """(leading zeros + 1) << 10 | mantissa of 64-bit hashes."""
    import numpy as np

    zeros = (64 - np.frexp(smallest.astype(np.float64))[1]).clip(0, 60).astype(np.uint64)
    mantissa = (smallest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)


def registers(shingles):
    """Two sketches of 128 registers each. For sets of at most MANY shingles, each register has a hash function of its own
    and sees the whole set; for sets of at least FEW, one hash deals the set out to 128 buckets, so the work doesn't grow
    with the registers. Sets between have both, and sets that are similar enough have one in common. 0: not there."""
    import numpy as np

    out = np.zeros(2 << BUCKET_BITS, np.uint16)
    n = len(shingles)
    if 0 < n <= MANY:
        odd = np.random.default_rng(11).integers(0, 2**63, 1 << BUCKET_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) if registers.odd is None else registers.odd
        registers.odd = odd
        out[: 1 << BUCKET_BITS] = _register((shingles[:, None] * odd).min(0) | np.uint64(1))
    if n >= FEW:
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        out[(1 << BUCKET_BITS) + bucket[first]] = _register((shingles[first] << np.uint64(BUCKET_BITS)) | np.uint64(1))
    return out


registers.odd = None


def estimate(a, b, n_a, n_b):
    """Similarity of pairs from their registers, corrected for registers that are equal by chance; and registers used."""
    import numpy as np

    half = 1 << BUCKET_BITS
    small = ((a[:, 0] != 0) & (b[:, 0] != 0))[:, None]
    a, b = np.where(small, a[:, :half], a[:, half:]), np.where(small, b[:, :half], b[:, half:])
    used = ((a != 0) | (b != 0)).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2  # Yu and Weber, HyperMinHash
    return np.maximum(0, equal - chance) / np.maximum(1, used), used


def _text_id(text: str) -> Column:
    """What tells rows that share an id, or have none, apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(found):
        import numpy as np
        import pyarrow as pa
        import xxhash

        known = _word_hashes()
        for batch in in_parts(found):
            n, ids, bands = [], [], []
            for t in batch.column(2):
                s = _shingles(t.as_py(), known)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(registers(s).view("<i8"))
            many = (2 << BUCKET_BITS) // ROWS
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * many), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists], names=["doc_id", "text_id", "n_shingles", "set_id", "bands"])

    return df.select(F.col(key).cast("long").alias("doc_id"), _text_id(text).alias("text_id"), F.col(text).alias("text")).mapInArrow(run, SIGNATURE)


def heavy_keys(rows: DataFrame, on: str) -> DataFrame | None:
    """Keys of more than LOT rows, with the number of lots; None if there are none."""
    found = rows.groupBy(on).agg(F.count("*").alias("rows")).filter(F.col("rows") > LOT).select(on, F.ceil(F.col("rows") / LOT).alias("lots"))
    return None if found.isEmpty() else F.broadcast(found)


def salted_join(many: DataFrame, one: DataFrame, on: str, by: str, heavy: DataFrame | None) -> DataFrame:
    """Inner join of many rows to one row per key; heavy keys are dealt out by another column, with a copy of the one row
    for each lot."""
    if heavy is None:
        return many.join(one, on)
    lots = F.coalesce("lots", F.lit(1).cast("long"))
    left = many.join(heavy, on, "left").withColumn("lot", F.pmod(F.xxhash64(by), lots)).drop("lots")
    right = one.join(heavy, on, "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).drop("lots")
    return left.join(right, [on, "lot"]).drop("lot")


def full_sets(scratch: Scratch, df: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """id, shingles of the classes in needed (id, doc_id, text_id, set_id), a row each; needed is sent to all executors only
    if it's small."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), _text_id(text).alias("text_id"), F.col(text).alias("text"))
    side = F.broadcast(needed) if needed.count() <= SEND else needed
    rows = docs.join(side, (docs["text_id"] == needed["text_id"]) & docs["doc_id"].eqNullSafe(needed["doc_id"])).select("id", "set_id", "text")

    def run(found):
        import numpy as np
        import pyarrow as pa
        import xxhash

        known = _word_hashes()
        for batch in in_parts(found):
            ids, sets = [], []
            for i, want, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = _shingles(t.as_py(), known)
                if xxhash.xxh3_128_digest(s.tobytes()) == want:  # texts that share a hash may differ
                    ids.append(i)
                    sets.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], names=["id", "shingles"])

    sets = scratch.stage(rows.mapInArrow(run, "id long, shingles array<long>"), "full-sets")
    if sets.groupBy("id").count().filter("count > 1").isEmpty():
        return sets
    return scratch.stage(sets.dropDuplicates(["id"]), "full-sets")  # equal rows


def confirmed(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b; a: a hub, in many of them) that are likely, with 100 * intersection >= percent * union,
    counted on full sets."""
    heavy = heavy_keys(pairs, "a")
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    rows = salted_join(likely(pairs, nodes, percent, heavy), a, "a", "b", heavy).join(b, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("all"))
    return scratch.stage(rows.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b").distinct(), "links")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, heavy: DataFrame | None) -> DataFrame:
    """Drops pairs whose estimate is five standard deviations below the threshold."""
    a, b = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"r_{c}")) for c in "ab")

    def run(found):
        import numpy as np

        for batch in found:
            r = [np.asarray(batch.column(c).values).view("<u2").reshape(-1, 2 << BUCKET_BITS) for c in ("r_a", "r_b")]
            j, used = estimate(*r, *(np.asarray(batch.column(c)) for c in ("n_a", "n_b")))
            p = percent / 100
            keep = j >= p - 5 * np.sqrt(p * (1 - p) / np.maximum(1, used))
            yield batch.select(["a", "b"]).filter(__import__("pyarrow").array(keep))

    return salted_join(pairs, a, "a", "b", heavy).join(b, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def rarest_shared(scratch: Scratch, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Documents (id, label) with the smallest label (hub) of those that share one of their rarest shingles, as far as it
    isn't their own. Of n shingles, a set that is similar enough to another shares some of any n - need + 1 of them, if
    both choose by one order: first those that no other component has, then those that the fewest documents have."""
    rows = left.select("id", "label").distinct().join(sets, "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("s", "rows")
    common = scratch.stage(common, "common-shingles")
    own = _of_shingles(rows, common).groupBy("id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "s"))).alias("found"))
    need = F.ceil(F.col("n") * percent / 100)
    take = (F.col("n") - need + 1 - (F.col("n") - F.size("found"))).cast("int")
    first = scratch.stage(own.filter(take > 0).select("id", "label", F.explode(F.slice("found", F.lit(1), F.greatest(take, F.lit(0)))).alias("t")).select("id", "label", F.col("t.s").alias("s")), "rarest")
    hubs = first.groupBy("s").agg(F.min("label").alias("hub"), F.max("label").alias("high"), F.count("*").alias("rows")).filter("hub <> high")
    hubs = scratch.stage(hubs.select("s", "hub", "rows"), "shingle-hubs")
    return scratch.stage(_of_shingles(first, hubs).select("id", "label", "hub").distinct(), "rarest-hubs")


def _of_shingles(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with what is known of their shingle (s, with the number of rows that have it): sent to all executors if it's
    small, else salted."""
    if known.count() <= SEND:
        return rows.join(F.broadcast(known), "s")
    heavy = known.filter(F.col("rows") > LOT).select("s", F.ceil(F.col("rows") / LOT).alias("lots"))
    return salted_join(rows, known, "s", "id", None if heavy.isEmpty() else F.broadcast(heavy))


def confirmed_in_blocks(scratch: Scratch, left: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components (id, label, hub: the smallest label of a shared shingle). Documents that
    shingles connect are a cluster; a cluster is cut into blocks of bounded size, and each pair of blocks is compared in one
    place: who shares a key, then whose estimate is near, then who is confirmed on full sets. Only links come out."""
    stars = left.select(F.col("hub").alias("a"), F.col("label").alias("b")).distinct()
    clusters = left.select("id", "label").distinct().join(components(scratch, stars).select(F.col("id").alias("label"), F.col("label").alias("cluster")), "label")
    members = clusters.join(nodes.select("id", "n", "bands"), "id")
    sized = clusters.join(nodes.select("id", "n"), "id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("many"))
    placed = members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "many").cast("int")).join(sets, "id")
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    sent = sent.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        half = 1 << BUCKET_BITS
        ids, labels, n = (np.asarray(table.column(c)) for c in ("id", "label", "n"))
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        regs = bands.view("<u2").reshape(len(ids), 2 * half)
        flat = table.column("shingles").combine_chunks()
        values, ends = np.asarray(flat.flatten()), np.concatenate(([0], np.cumsum(n)))
        block = np.asarray(table.column("block"))
        x, y = key[1].as_py(), key[2].as_py()
        rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
        p, out = percent / 100, ([], [])
        for i in rows:
            near = cols[(labels[cols] != labels[i]) & ((x != y) | (cols > i))]
            near = near[np.minimum(n[near], n[i]) * 100 >= percent * np.maximum(n[near], n[i])]
            near = near[((bands[near] == bands[i]) & (bands[i] != 0)).any(1)]
            if not len(near):
                continue
            j, used = estimate(np.broadcast_to(regs[i], (len(near), 2 * half)), regs[near], np.full(len(near), n[i]), n[near])
            near = near[j >= p - 5 * np.sqrt(p * (1 - p) / np.maximum(1, used))]
            if not len(near):
                continue
            mine = values[ends[i] : ends[i + 1]]
            theirs = np.concatenate([values[ends[k] : ends[k + 1]] for k in near])
            at = np.searchsorted(mine, theirs)
            same = mine[np.minimum(at, len(mine) - 1)] == theirs
            both = np.add.reduceat(same.astype(np.int64), np.concatenate(([0], np.cumsum(n[near])[:-1])))
            linked = near[100 * both >= percent * (n[i] + n[near] - both)]
            out[0].extend([ids[i]] * len(linked))
            out[1].extend(ids[linked])
        return pa.table({"a": pa.array(np.minimum(*map(np.array, out)) if out[0] else [], pa.int64()), "b": pa.array(np.maximum(*map(np.array, out)) if out[0] else [], pa.int64())})

    found = sent.select("cluster", "x", "y", "id", "label", "n", "block", "bands", F.array_sort("shingles").alias("shingles")).groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long")
    return scratch.stage(found.distinct(), "links")


def components(scratch: Scratch, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, label: the smallest id that is reachable. Each round points every node at its smallest neighbour, follows the
    pointers, and contracts the links to those between what they lead to; so links fall away from round to round. A
    component's smallest id always leads to itself. With earlier labels (id, label), links join what these stand for."""
    if labels is not None:
        x, y = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
        links = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    edges = scratch.stage(_contracted(links.select("a", "b")), "edges")
    found, made = None, []
    while not edges.isEmpty():
        ends = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("to")).distinct())
        up = ends.groupBy("id").agg(F.min("to").alias("to"))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
        up = scratch.stage(up, "pointers")
        made.append(up)
        found = up.select("id", F.col("to").alias("label")) if found is None else found.join(up.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        x, y = up.select(F.col("id").alias("a"), F.col("to").alias("x")), up.select(F.col("id").alias("b"), F.col("to").alias("y"))
        before, edges = edges, scratch.stage(_contracted(edges.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        scratch.drop(before)
    found = scratch.stage(found, "labels") if found is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    scratch.drop(*made)
    if labels is None:
        return found
    merged = labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return scratch.stage(merged.unionByName(found.join(labels.select("id"), "id", "left_anti")), "labels")


def _contracted(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether these ids are equal), text_id and first (whether the row, or one
    equal to it, stands for its component) of all rows."""
    scratch = Scratch(df.sparkSession)
    found = scratch.stage(signatures(df, key, text), "signatures")
    some = found.filter("set_id is not null")
    # who stands for a class: the smallest id, real ones first
    owner = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_id")
    some = some.groupBy("set_id").agg(F.min(owner).alias("owner"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    nodes = scratch.stage(some.withColumn("id", F.monotonically_increasing_id()), "sets")

    banded = nodes.select("id", F.posexplode("bands").alias("band", "key")).filter("key <> 0").select("id", F.xxhash64("band", "key").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    hubs = scratch.stage(hubs, "hubs")
    crowded = hubs.filter(F.col("rows") > LOT).select("key", F.ceil(F.col("rows") / LOT).alias("lots"))
    crowded = None if crowded.isEmpty() else F.broadcast(crowded)
    shared = scratch.stage(salted_join(banded, hubs.select("key", "hub"), "key", "id", crowded), "shared-keys")

    met = shared.filter("id <> hub").groupBy("hub", "id").agg(F.count("*").alias("n"))
    met = scratch.stage(met.select(F.col("hub").alias("a"), F.col("id").alias("b"), "n"), "hub-pairs")
    needed = shared.select("id").distinct().join(nodes.select("id", "owner.doc_id", "owner.text_id", "set_id"), "id")
    needed = scratch.stage(needed, "needed")
    sets = full_sets(scratch, df, needed, key, text)
    own = scratch.stage(met.groupBy("b").agg(F.max_by("a", F.struct("n", (-F.col("a")).alias("first"))).alias("a")).select("a", "b"), "first-pairs")
    labels = components(scratch, confirmed(scratch, own, nodes, sets, percent))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        x, y = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
        return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    others = scratch.stage(apart(met.select("a", "b").join(own, ["a", "b"], "left_anti"), labels), "other-pairs")
    labels = components(scratch, confirmed(scratch, others, nodes, sets, percent), labels)

    marked = shared.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    left = scratch.stage(salted_join(marked, mixed, "key", "id", crowded).select("id", "label").distinct(), "mixed-keys")
    left = rarest_shared(scratch, left, sets, percent)
    if not left.isEmpty():
        labels = components(scratch, confirmed_in_blocks(scratch, left, nodes, sets, percent), labels)

    top = nodes.select("id", "owner", "set_id", "rows").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    top = scratch.stage(top, "labelled")
    first = top.groupBy("label").agg(F.min("owner").alias("first"))
    top = salted_join(top, first, "label", "id", heavy_keys(top, "label")).select("set_id", "rows", F.col("first.doc_id").alias("component_id"), F.col("first.text_id").alias("first_text"))
    classes = scratch.stage(top, "classes")
    scratch.close(keep=[found, classes])

    columns = ["doc_id", "text_id", "n_shingles", "component_id", "first_text"]
    rows = found.filter("set_id is not null").drop("bands")
    crowds = classes.filter(F.col("rows") > LOT).drop("rows")
    if crowds.isEmpty():
        out = rows.join(classes.drop("rows"), "set_id").select(columns)
    else:  # a row per LOT rows at most
        out = rows.join(F.broadcast(crowds), "set_id").select(columns)
        out = out.unionByName(rows.join(F.broadcast(crowds.select("set_id")), "set_id", "left_anti").join(classes.drop("rows"), "set_id").select(columns))
    out = out.unionByName(found.filter("set_id is null").select("doc_id", "text_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_id").alias("first_text")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_id", (kept & (F.col("text_id") == F.col("first_text"))).alias("first"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of df that stay, one of each component. What goes is sent to all executors if it's small, so texts needn't
    move; only rows that occur several times are dealt out, and combined before they are."""
    scratch = Scratch(df.sparkSession)
    judged = scratch.stage(near_duplicates(df, key, text, percent).filter("n_shingles > 0").select("doc_id", "text_id", "first"), "judged")
    doc, hashed, first, many = unused(df, "doc", "hashed", "first", "many")
    ids = judged.groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(hashed)).agg(F.min("first").alias(first), (F.count("*") > 1).alias(many))
    odd = scratch.stage(ids.filter(~F.col(first) | F.col(many)), "odd")
    side = F.broadcast(odd) if odd.count() <= SEND else odd
    rows = df.join(side, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (_text_id(text) == F.col(hashed)), "left")
    once = rows.filter(F.col(first).isNull()).select(df.columns)
    if odd.filter(F.col(first) & F.col(many)).isEmpty():
        return once
    several = rows.filter(F.col(first) & F.col(many)).groupBy(doc, hashed).agg(F.min_by(F.struct(*df.columns), ordered(df)).alias(many))
    return once.unionByName(several.select(f"{many}.*"))
