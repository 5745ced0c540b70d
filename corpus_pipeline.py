"""From raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents. Documents that
are empty have no language and go in the first stage; rows that repeat stay as
often as the stages' own rules let them (near-dedup keeps one of a group). Nulls
in other columns pass through, extra columns too. An empty table ends empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import _common, decontaminate, langid, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; learns from the rows that are not held out."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 0.8)."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with the benchmark."""
    return decontaminate.decontaminate(docs, _common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the network nor the fingerprints can be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again; a copy goes when the next is written."""
    docs, last = _common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(folder := _common.new_folder(spark, f"pipeline-{name}"))
            docs = spark.read.schema(docs.schema).parquet(folder)
            if last:
                _common.remove(spark, last)
            last = folder
    return docs
