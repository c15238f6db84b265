"""A training corpus from raw documents, in five stages.

Quality rules reject documents, near-duplicates leave one document of each group, personal data is replaced, sources are
mixed to their targets (documents are left out or repeated), and what is left is packed into sequences. Each stage works
on all rows that its predecessor kept and returns the columns of documents, the last one the places of pieces.

Defined results: each stage's are its operator's. Null and empty texts fail the quality rules and go no further; a null
doc_id is kept as such; of equal rows, one is left by the second stage; columns that documents has besides stay as they
are until the last stage, whatever their names; empty tables, also of labels, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import mixing, near_dup, packing, pii, quality
from gaugeline.llm.common import stage, table
from gaugeline.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that base rules and the isolation forest keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group."""
    return near_dup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans of personal data give way to their kind's name, and n_chars, where there is such a column, follows the
    text. A null text stays null, an empty one empty; equal rows stay equal."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times. Rows without a source are a source of their own; texts without
    words are taken as often as their source's others; equal rows differ by one copy at most."""
    return mixing.repeat_rows(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: document, place in it, length, checksum of its ids, sequence and offset there."""
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"), "dropped", end=2, digest=F.crc32)
    return packed.places.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("digest").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", source_mix),
    ("packing", sequence_packing),
]

#: The isolation forest and the tokenizer have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
