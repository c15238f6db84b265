"""The pipeline's stages against plain Python, each on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from gaugeline.llm import mixing, quality

from .test_operators import WORD, _base, _components, _ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    for _, step in cp.STAGES:
        done = step(spark, docs, SF).cache()
        out.append((docs, done))
        docs = done
    return out


def test_columns(stages):
    assert 4 <= len(cp.STAGES) <= 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.dtypes == before.dtypes


def test_quality_stage(spark, stages):
    before, after = stages[0]
    scored = quality.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored.filter("kept").collect())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    want = {d for d, _, c in _components(before.collect()) if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_personal_data_stage(stages):
    before, after = stages[2]
    old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert old.keys() == new.keys()
    for k, text in old.items():
        spans = _base(text)
        assert new[k].n_chars == len(new[k].text)
        assert not _base(new[k].text)
        assert (new[k].text == text) == (not spans)


def test_mixing_stage(stages):
    before, after = stages[3]
    marked = Counter()
    for r in mixing.mix(before).collect():
        marked[r.key] += r.copies
    assert Counter(r.doc_id for r in after.collect()) == +marked
    taken, size, most = Counter(), Counter(), Counter()
    for r in before.collect():
        n = len(WORD.findall(r.text))
        size[r.source] += n
        most[r.source] = max(most[r.source], n)
    for r in after.collect():
        taken[r.source] += len(WORD.findall(r.text))
    want = mixing.targets(dict(size))
    assert all(abs(want[s] - taken[s]) <= max(1 + 0.01 * want[s], most[s] / 2) for s in size)


def test_packing_stage(stages):
    before, after = stages[4]
    ids = {r.doc_id: _ids("word_bpe_49k.json", r.text) + [2] for r in before.collect()}
    copies, got, sequences = Counter(r.doc_id for r in before.collect()), defaultdict(int), defaultdict(list)
    for r in after.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == {k: copies[k] * len(v) for k, v in ids.items()}
    for p in sequences.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096


def test_run_gives_the_same_pieces(spark, stages):
    """Which sequence a piece goes to depends on the tasks; the pieces don't."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, cp.run(spark, SF).select(columns).collect())) == sorted(map(tuple, stages[-1][1].select(columns).collect()))


def _written(folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_hostile_tables_through_all_stages(spark, docs, small, tmp_path):
    """Nulls, repeated rows, long texts and columns with the names that stages use."""
    names = ["pattern", "prio", "full", "last", "n", "copies", "at", "owner", "hashed", "spans", "doc", "first", "many", "lots", "lot"]
    table = docs.unionByName(small.filter("doc_id < 60").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    table = table.selectExpr("*", *[f"doc_id AS {c}" for c in names])
    sf = _written(tmp_path, table, spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 100 AS doc_id", "quality", "toxic", "1 AS kept"))
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in cp.STAGES[:-1]:
        before, at = at, step(spark, at, sf).cache()
        assert at.dtypes == before.dtypes, name
        for r in at.collect():
            assert all(r[c] == r.doc_id for c in names)
    pieces = cp.run(spark, sf).collect()
    copies = Counter(r.doc_id for r in at.collect())
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    ids = {r.doc_id: len(_ids("word_bpe_49k.json", r.text)) + 1 for r in at.collect()}
    assert total == {k: n * ids[k] for k, n in copies.items()}
    assert not {4, 5, 6, 7, 8} & set(copies)  # null, empty and short texts
    assert copies[None] <= 2


def test_empty_tables_through_all_stages(spark, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cp.run(spark, _written(tmp_path / "a", nothing, labels)).count() == 0
    one = spark.createDataFrame([(1, "twelve words of text that stand in a row and say nothing", "en", "a", 1)], nothing.schema)
    assert cp.run(spark, _written(tmp_path / "b", one, labels)).count() in (1, 2)
