"""What several operators share: tables, shared scratch folders, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests, a single machine) is a fresh local
    folder made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            found = have.get()
        else:
            found = "file://" + tempfile.mkdtemp(prefix="runsieve-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; remove_scratch() deletes all of them."""
    path = f"{shared_dir(spark)}/runsieve-{uuid.uuid4().hex}/{name}"
    _MADE.append(path.rsplit("/", 1)[0])
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete this session's scratch tables, once their results have been used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    This cuts the lineage at a place that outlives any executor.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Hand freed memory back to the system; a Python worker would else keep it until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


class Forest:
    """Union-find over int64 ids in which the smallest id is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x] = top
            x = nxt
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches):
    """Each partition's edges become stars round the smallest id of their trees."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    ids = [x for x in forest.up if forest.root(x) != x]
    for at in range(0, len(ids), 65536):
        part = ids[at : at + 65536]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], names=["a", "b"]
        )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b); component is the smallest id reachable.

    Partitions contract their own edges first; then large-star and small-star
    rounds (each a group minimum and a join back) run until the edges are stars.
    Every round is written to the shared folder.  Self-loops and rows with a null
    end are ignored; no edges give no rows.
    """
    edges = edges.toDF("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    edges = materialise(edges, "stars")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
