"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Stages are written as Parquet and read again, so a lost
executor costs no more than the stage at work.  All stages but the last return the columns of documents; ``n_chars``
follows the text where a stage changes it.

 quality       documents that a rule rejects go
 near_dedup    one document of each near-duplicate class stays, the one with the least doc_id
 suffix_dedup  strings of 200 bytes that start elsewhere too lose their bytes, in all places
 pii           personal data is replaced by the name of its kind
 packing       pieces of documents are packed into sequences of several lengths

Defined results: empty tables pass through; null texts count as empty and go in the first stage; further columns pass
through the first four stages, and ``n_chars`` is left alone where a table has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import near_dup, packing, pii, quality, suffix
from lumenfield.llm.common import documents, stash


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the length of the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix.remove_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Near-duplicate classes and boosted trees are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
