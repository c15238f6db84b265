"""What is in the files of token ids: run-length encoded integers, row indexes, Bloom filters, stripes that are skipped."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import token_files
from gaugeline.llm.common import shared_path
from gaugeline.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.range(6000).selectExpr("id * 10 AS doc_id", "concat('word ', id, repeat(' and some more words', 40)) AS text")
    out = shared_path(spark, "test-layout")
    token_files.write_token_ids(docs, out, vocabulary("byte_bpe_50k.json"), "leading", 0)
    return out


def test_manifest(spark, written):
    rows = spark.read.schema(token_files.ROW).orc(f"{written}/data").toPandas()
    ahead = 0
    for m in token_files.read_manifest(spark, written).orderBy("file").collect():
        own = rows[rows["file"] == m.file]
        assert (m.least, m.greatest, m.rows, m.n_tokens, m.ahead) == (own["doc_id"].min(), own["doc_id"].max(), len(own), own["n_tokens"].sum(), ahead)
        ahead += m.n_tokens
    assert ahead == rows["n_tokens"].sum() == rows["ids"].map(len).sum()


def test_layout(spark, written):
    """Through the format's own reader."""
    jvm = spark._jvm
    for path in glob.glob(f"{written}/data/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getCompressionKind().toString() == "ZSTD"
        assert reader.getRowIndexStride() == 1000
        columns = {str(n): i + 1 for i, n in enumerate(reader.getSchema().getFieldNames())}
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = [(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()]
            assert (columns["doc_id"], "BLOOM_FILTER_UTF8") in streams
            assert [c for c, k in streams if k == "BLOOM_FILTER_UTF8"] == [columns["doc_id"]]
            assert (columns["doc_id"], "ROW_INDEX") in streams
            encodings = [e.getKind().toString() for e in footer.getColumnsList()]
            assert encodings[columns["doc_id"]] == "DIRECT_V2"  # run-length encoding, second version
            assert encodings[columns["ids"]] == encodings[columns["ids"] + 1] == "DIRECT_V2"
        rows.close()


def test_lookups_skip_what_cannot_hold_the_document(spark, written):
    one = token_files.read_token_ids(spark, written).filter(F.col("doc_id") == 31410)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,31410)" in plan or "EqualTo(doc_id,31410)" in plan
    row = one.select("doc_id", "start", "n_tokens", "ids").collect()
    every = token_files.read_token_ids(spark, written).orderBy("start").toPandas()
    want = every[every["doc_id"] == 31410].iloc[0]
    assert [tuple(map(int, (r.doc_id, r.start, r.n_tokens))) for r in row] == [(31410, want["start"], want["n_tokens"])]
    assert np.array_equal(row[0].ids, want["ids"])
    read = lambda df: sum(m.value() for m in [*_metrics(df, "numOutputRows")])
    scanned, rows = read(spark.read.schema(token_files.ROW).orc(f"{written}/data").filter("doc_id = 31410")), len(every)
    assert 0 < scanned <= 1000 < rows  # one row group of one file
    assert read(spark.read.schema(token_files.ROW).orc(f"{written}/data").filter("doc_id = 31415")) == 0  # in no file: Bloom filters


def _metrics(df, name):
    """The metric of the scan of a plan that was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, open_ = [], [plan]
    while open_:
        p = open_.pop()
        if p.nodeName().startswith("Scan"):
            found.append(p.metrics().apply(name))
        kids = p.children()
        open_ += [kids.apply(i) for i in range(kids.size())]
        if hasattr(p, "executedPlan") and p.nodeName() == "AdaptiveSparkPlan":
            open_.append(p.executedPlan())
    return found


def test_doc_ids_and_token_ids_come_back(spark, written):
    rows = token_files.read_token_ids(spark, written).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(0, 60000, 10))
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1].tolist()]
