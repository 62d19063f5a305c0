import datetime

from runsieve.operators import history
from runsieve.streaming import recent as streaming

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "execution_id long, test_id string, outcome string, commit_sha string, started_at timestamp_ntz"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"t{k % 3}", "fail" if k % 5 == 0 else "pass", f"c{k // 6}", T0 + datetime.timedelta(hours=k)) for k in range(40)]
    source = str(tmp_path / "in")
    for part in (rows[:15], rows[10:30], rows[30:]):  # with rows that come twice
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streaming.keep_recent(stream, str(tmp_path / "kept"), str(tmp_path / "check")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "kept").iterdir())
    kept = spark.read.schema(SCHEMA).parquet(str(tmp_path / "kept" / str(last)))
    pick = lambda df: sorted((r["test_id"], r["verdict"], r["flake_rate"]) for r in df.collect())
    assert pick(streaming.current_verdicts(kept)) == pick(history.detect(spark.createDataFrame(rows, SCHEMA)))
