"""An extension: verdicts kept up to date over a stream of executions.

Each micro-batch is merged into the recent rows of its tests, which are all that
a verdict needs; a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Detect
from ..operators.history import detect, recent


def keep_recent(stream: DataFrame, folder: str, checkpoint: str, config: Detect = Detect(), delay: str = "7 days") -> StreamingQuery:
    """Run over a stream of executions; folder/<batch> has the newest rows of every test after that batch."""
    columns = stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{folder}/{number - 1}"))
        rows = recent(rows.dropDuplicates(["execution_id"]), config.window_executions).drop("rn")
        rows.write.mode("overwrite").parquet(f"{folder}/{number}")

    once = stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["execution_id"]) if "event_time" in columns else stream
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_verdicts(rows: DataFrame, config: Detect = Detect()) -> DataFrame:
    return detect(rows, config).withColumn("as_of", F.current_timestamp())
