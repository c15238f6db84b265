"""Token ids in ORC files.

Documents are dealt to tasks by ranges of their id and sorted, each task encodes its documents and writes a file. A row
is a document: its ids are a list of integers (run-length encoded in the stripes), and its place is a file number and
the ids before it in that file. Row indexes and Bloom filters on doc_id let readers skip stripes. A manifest, a row per
file with the least and greatest doc_id, rows, ids and the ids of all files before, says where a document starts in the
whole corpus, so a lookup of one document reads the manifest and the stripes that may hold it.

Layout: <out>/data/*.orc and <out>/manifest/*.parquet.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows of equal ids are ordered by
the text's hash, so a crowd of them can be dealt to several tasks; an empty table gives files without rows; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_parts

ROW = "doc_id long, file int, before long, n_tokens long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}


def write_token_ids(df: DataFrame, out: str, path: str, space: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    def run(found):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import batches, encoder

        enc, file, before = encoder(path, space), TaskContext.get().partitionId(), 0
        tail = end.to_bytes(4, "little")
        for batch in in_parts(found):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at, some in batches(texts):
                raw = [r + tail for r in enc.encode(some)]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(raw)), pa.array(np.full(len(raw), file, np.int32)), pa.array(before + ends - n), pa.array(n), ids], names=["doc_id", "file", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(run, ROW).write.options(**OPTIONS).orc(f"{out}/data")
    files = df.sparkSession.read.schema(ROW).orc(f"{out}/data").groupBy("file")
    found = files.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count("*").alias("rows"), F.sum("n_tokens").alias("n_tokens"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).coalesce(1).write.parquet(f"{out}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file int, least long, greatest long, rows long, n_tokens long, ahead long").parquet(f"{path}/manifest")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before. A filter on doc_id reaches the stripes."""
    rows = spark.read.schema(ROW).orc(f"{path}/data")
    ahead = F.broadcast(read_manifest(spark, path).select("file", "ahead"))  # a row per file
    return rows.join(ahead, "file").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def with_checksum(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(found):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in in_parts(found):
            ids = b.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).view("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
