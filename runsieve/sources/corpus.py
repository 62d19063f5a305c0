"""Labelled examples in JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = (
    "corpus_version string, synthetic boolean, disclosure string, examples array<struct<id:string,label:string,"
    "rationale:string,adversarial:boolean,test_name:string,suite_path:string,outcome:string,failure_type:string,"
    "failure_message:string,stack_trace:string,history:struct<observations:bigint,windows:bigint,flake_rate:double,"
    "divergence_rate:double,intermittency_rate:double,retry_data_available:boolean,verdict:string,"
    "detector_confidence:string,signals:array<string>,failing_shards:array<string>,infra_excluded:bigint,"
    "merged_uncertain:boolean>,diff_paths:array<string>>>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A row per example."""
    return spark.read.schema(EXAMPLES).option("multiLine", True).json(path).select(F.explode("examples").alias("e")).select("e.*")
