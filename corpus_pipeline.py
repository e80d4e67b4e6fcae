"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, masking of personal
data, and packing. Each stage works on all that the one before it kept; its result is written as Parquet and read again.

An empty table of documents passes through all stages and gives no pieces; null texts have no language and go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import decontaminate, language, minhash, packing, pii
from hushframe.llm.common import Work

#: (name, function of spark, docs and sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", language.reject_unknown),
    ("near_dedup", minhash.dedup_stage),
    ("decontaminate", decontaminate.clean_stage),
    ("mask_pii", pii.mask_stage),
    ("pack", packing.pack_stage),
]

#: Learned language profiles and BM25 packing have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of a folder's documents."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
