"""What the operators of this subpackage share: tables, the shared folder, null-safe helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ship

#: A word: code points other than blank and x09 to x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of rows that goes to a Python worker, unless the session says otherwise: texts may be long, and both
#: sides hold a batch whole.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """Keeps batches for Python workers small in this session."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "", "67108864b", "64MB"):  # as Spark has it
        spark.conf.set(BATCH_SETTING, str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A cluster names it in spark.checkpoint.dir. Where that is unset,
    a session whose executors are threads of this process takes a temporary folder; any other one is refused."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeline-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/gaugeline/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, a lost executor repeats nothing that was
    written, and what reads it later prunes columns."""
    path = shared_path(bounded(df.sparkSession), name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stages tables, and removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = bounded(spark), {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """What was made of these tables must be staged itself."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            remove(self.spark, path)

    def close(self, keep: Iterable[DataFrame] = ()) -> None:
        """Removes all but some tables, which are left for the session's readers."""
        kept = {id(t) for t in keep}
        self.drop(*[t for i, (t, _) in self.paths.items() if i not in kept])


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def in_parts(batches, rows: int = 1000):
    """Arrow batches in parts, so what a worker makes of one stays small; afterwards Arrow gives back what it holds."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def ordered(df: DataFrame) -> Column:
    """A row's columns as one value that can be put in order: all but those that hold maps."""
    return F.struct(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def unfolded(df: DataFrame, n: str, number: str, by: Iterable[str], lot: int) -> DataFrame:
    """Each row as often as column n says, numbered from 0. Rows that unfold to more than a lot are dealt out, with the
    number of the lot, before they do."""
    (at,) = unused(df, "lot")
    one = df.filter(F.col(n) == 1).withColumn(number, F.lit(0).cast("long"))
    lots = df.filter(F.col(n) > 1).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / lot))))
    lots = lots.repartition(*by, at)
    numbers = F.sequence(F.col(at) * lot, F.least(F.col(at) * lot + lot, F.col(n)) - 1)
    return one.unionByName(lots.withColumn(number, F.explode(numbers)).drop(at))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
