"""The run history as columnar tables: appends that repeat nothing.

Facts are appended, partitioned by ingest date; small tables are replaced whole.
One writer at a time; a batch that is ingested again changes nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION

RUN_KEY = ("run_id", "attempt", "shard_id")
TABLES = {
    "runs": "run_pk string, run_id string, attempt int, shard_id string, commit_sha string, branch string, worker_id string, started_at timestamp_ntz, ingest_date date",
    "identities": "test_id long, fingerprint string, suite_path string, test_name string, parameters string, file_path string, first_seen timestamp_ntz, last_seen timestamp_ntz",
    "executions": (
        "execution_id string, run_pk string, fingerprint string, outcome string, duration_ms long, failure_type string, "
        "failure_message string, stack_trace string, rerun boolean, file_path string, position int, ingest_date date"
    ),
    "aliases": "old_id long, new_id long, similarity double, certain boolean",
    "changes": "commit_sha string, path string, old_path string, change_type string, binary boolean, new_ranges array<struct<start:bigint,end:bigint>>, old_ranges array<struct<start:bigint,end:bigint>>, run_pk string, ingest_date date",
    "warnings": "run_pk string, origin string, reason string, detail string, ingest_date date",
    "calls": "run_pk string, kind string, model string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, error string, ingest_date date",
    "classifications": "run_pk string, test_id long, cause string, confidence double, reasoning string, evidence array<string>, suggested_action string, abstained boolean, downgrade_reason string, cache_hit boolean, event_no long, ingest_date date",
    "quarantines": "record_id string, test_id long, state string, created_at timestamp_ntz, expires_at timestamp_ntz, closed_at timestamp_ntz, reason string, event_no long",
    "replies": "context_key string, reply string",
}


def key_of(*columns: str) -> Column:
    """A key over columns of which any may be null or empty, which count as the same."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def run_pk() -> Column:
    return key_of(*RUN_KEY)


def new_rows(batch: DataFrame, have: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The rows of a batch that a table lacks, the first of each key."""
    first = Window.partitionBy(*keys).orderBy(*(order or keys))
    batch = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    there = have.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return batch.join(there, [batch[k].eqNullSafe(there[f"_{k}"]) for k in keys], "left_anti")


def upsert_identities(have: DataFrame, seen: DataFrame) -> DataFrame:
    """Identities with those of a batch (fingerprint, suite_path, test_name, parameters, file_path, seen_at).

    A known one keeps its first and last sight up to date, whatever the order of
    ingestion, and its file unless a new one is given; new ones take the next
    numbers, by first sight and fingerprint.
    """
    batch = seen.groupBy("fingerprint").agg(
        F.max_by("suite_path", "seen_at").alias("suite_path"),
        F.max_by("test_name", "seen_at").alias("test_name"),
        F.max_by("parameters", "seen_at").alias("parameters"),
        F.max_by("file_path", F.when(F.col("file_path").isNotNull(), F.col("seen_at"))).alias("file_new"),
        F.min("seen_at").alias("first_new"),
        F.max("seen_at").alias("last_new"),
    )
    known = have.join(batch.select("fingerprint", "file_new", "first_new", "last_new"), "fingerprint", "left").select(
        "test_id",
        "fingerprint",
        "suite_path",
        "test_name",
        "parameters",
        F.coalesce("file_new", "file_path").alias("file_path"),
        F.least("first_seen", "first_new").alias("first_seen"),
        F.greatest("last_seen", "last_new").alias("last_seen"),
    )
    fresh = batch.join(have.select("fingerprint"), "fingerprint", "left_anti")
    top = have.agg(F.coalesce(F.max("test_id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.orderBy("first_new", "fingerprint"))  # a batch's new tests, not its executions
    fresh = fresh.withColumn("n", number).crossJoin(F.broadcast(top))  # top is one row
    fresh = fresh.select(
        (F.col("top") + F.col("n")).cast("long").alias("test_id"),
        "fingerprint",
        "suite_path",
        "test_name",
        "parameters",
        F.col("file_new").alias("file_path"),
        F.col("first_new").alias("first_seen"),
        F.col("last_new").alias("last_seen"),
    )
    return known.unionByName(fresh)


class Store:
    """Tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        meta = self._path("meta")
        if self._exists(meta):
            version = spark.read.schema("version int").json(meta).agg(F.max("version")).first()[0]
            if version > SCHEMA_VERSION:
                raise ValueError(f"the store has schema version {version}; this code knows {SCHEMA_VERSION}")
        else:
            spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.json(meta)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        """A table; those that are replaced whole are read from their newest version."""
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        if name in ("identities", "aliases"):
            versions = self._versions(name)
            if not versions:
                return self.spark.createDataFrame([], TABLES[name])
            return self.spark.read.schema(TABLES[name]).parquet(self._version(name, versions[-1]))
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        rows = rows.select(*[f.split()[0] for f in _columns(name)])
        if "ingest_date" in rows.columns:
            rows.write.mode("append").partitionBy("ingest_date").parquet(self._path(name))
        else:
            rows.write.mode("append").parquet(self._path(name))

    def _version(self, name: str, number: int) -> str:
        return f"{self._path(name)}/v-{number:010d}"

    def _versions(self, name: str) -> list[int]:
        """The numbers of the versions that were written whole, rising."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and self._exists(f"{self._path(name)}/{n}/_SUCCESS"))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the next version; the one before stays for those who read it, older ones go."""
        have = self._versions(name)
        number = have[-1] + 1 if have else 1
        rows = rows.select(*[f.split()[0] for f in _columns(name)])
        rows.write.mode("overwrite").parquet(self._version(name, number))
        for old in have[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._version(name, old))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def executions_of(self, run_pks: DataFrame) -> DataFrame:
        """The executions of runs (run_pk)."""
        return self.table("executions").join(run_pks.select("run_pk").distinct(), "run_pk", "left_semi")

    def identities_of(self, keys: DataFrame) -> DataFrame:
        """keys (test_id or fingerprint) with what is known of these tests; nulls where nothing is."""
        by = "fingerprint" if "fingerprint" in keys.columns else "test_id"
        return keys.join(self.table("identities"), by, "left")

    def counts(self) -> DataFrame:
        """(table, n) of every table, empty ones too."""
        rows = [self.table(t).agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t in TABLES]
        return functools.reduce(DataFrame.unionByName, rows)

    def fact(self) -> DataFrame:
        """Executions with their runs and test ids, in the shape that detection takes."""
        runs = self.table("runs").select("run_pk", "run_id", "attempt", "shard_id", "commit_sha", "branch", "started_at")
        ids = self.table("identities").select("test_id", "fingerprint")
        rows = self.table("executions").drop("ingest_date").join(runs, "run_pk").join(ids, "fingerprint")
        return rows.withColumnsRenamed({"shard_id": "shard", "file_path": "test_file"})


def _columns(name: str) -> list[str]:
    out, depth, start = [], 0, 0
    schema = TABLES[name]
    for k, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return out


def record_quarantines(events: DataFrame, decisions: DataFrame, now, number: int) -> DataFrame:
    """New events for recommendations (test_id, expires_at, recommended) of tests without an open quarantine."""
    from ..operators.policy import is_open, latest_state

    opened = latest_state(events).filter(is_open(F.col("state"))).select("test_id")
    fresh = decisions.filter("recommended").join(opened, "test_id", "left_anti").dropDuplicates(["test_id"])
    return fresh.select(
        F.sha2(F.concat_ws(":", "test_id", F.lit(str(number))), 256).alias("record_id"),
        "test_id",
        F.lit("recommended").alias("state"),
        now.cast("timestamp_ntz").alias("created_at"),
        F.col("expires_at").cast("timestamp_ntz").alias("expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(number).cast("long").alias("event_no"),
    )


def close_quarantines(events: DataFrame, which: DataFrame, state: str, why: str, now, number: int) -> DataFrame:
    """Closing events for the open quarantines among record_ids."""
    from ..operators.policy import is_open, latest_state

    rows = latest_state(events).filter(is_open(F.col("state"))).join(which.select("record_id").distinct(), "record_id", "left_semi")
    return rows.withColumns(
        {"state": F.lit(state), "closed_at": now.cast("timestamp_ntz"), "reason": F.lit(why), "event_no": F.lit(number).cast("long")}
    )
