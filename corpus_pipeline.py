"""A corpus from raw documents to piece ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runsieve.llm import minhash, mixing, pieces, quality, toxicity
from runsieve.llm.common import materialise, read_table

STAGES = [
    ("quality classifier", quality.stage),
    ("toxicity", toxicity.stage),
    ("minhash near-dedup", minhash.stage),
    ("mixing to target weights", mixing.stage),
    ("sentencepiece encoding", pieces.stage),
]

#: Fitted models and MinHash can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
