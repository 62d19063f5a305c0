"""Operator 7: embedding near-duplicates by int8 tile products with error bounds.

A unit vector u is s*q + e with int8 q; |e| is known.  So a cosine differs from
s_u*s_w*(q_u . q_w) by at most |e_u| + (1 + |e_u|)*|e_w|.  Blocks of vectors are
written once to the shared folder; tasks read strips of blocks, multiply the
int8 parts (exactly: as floats, whose sums stay below 2**24), and recompute in
double precision only pairs that the bound leaves possibly above the threshold.

Equal vectors are one class before any product.  A strip returns, for each of its
vectors, how many it links with, and links that span its components: never the
pairs themselves.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, read_table, scratch
from .tokenfile import open_fs

THRESHOLD = 0.9
#: Vectors in a block, blocks in a strip, columns of one product.
BLOCK, STRIP, COLUMNS = 8192, 4, 1024
#: Allowance for the rounding of double precision itself.
SLACK = 1e-9

KEYED = "vec_id long, key binary, dim int, v binary"


def _key(batches):
    """The key and float64 bytes of every vector that can link; nulls for others."""
    for batch in batches:
        ids, col = batch.column("vec_id"), batch.column("embedding")
        n = len(ids)
        keys, raw, dims = [None] * n, [None] * n, [None] * n
        flat, off = col.values, col.offsets.to_numpy().astype(np.int64)
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        bad |= ~np.isfinite(values)
        holes = np.concatenate([[0], np.cumsum(bad)])
        some = col.is_valid().to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(some & (np.diff(off) > 0) & (holes[off[1:]] == holes[off[:-1]])):
            v = values[off[k] : off[k + 1]]
            if v.any():
                raw[k] = v.tobytes()
                keys[k] = xxhash.xxh3_128_digest(raw[k])
                dims[k] = len(v)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
            names=["vec_id", "key", "dim", "v"],
        )


def quantise(v: np.ndarray):
    """(unit vectors, int8 parts, scales, norms of the rest) of rows of finite, non-zero vectors."""
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the norm
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    e = np.sqrt(((u - q * s[:, None]) ** 2).sum(1)) + SLACK
    return u, q, s, e


def _pack(folder: str):
    """One file for each block: its vectors in order of scale, so that columns of a product have like scales."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        block = table.column("block").to_numpy()
        for b in np.unique(block):
            part = table.filter(pa.array(block == b))
            v = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(part.num_rows, -1)
            u, q, s, e = quantise(v)
            order = np.argsort(s, kind="stable")
            key = np.frombuffer(b"".join(part.column("key").to_pylist()), "V16")
            arrays = [key[order], *(part.column(c).to_numpy()[order] for c in ("rep", "n"))]
            arrays += [s[order], e[order], q[order], u[order]]
            own = f"{path}/block-{b}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own, compression=None) as out:
                out.write(np.array([len(order), v.shape[1]], "<i8").tobytes())
                for a in arrays:
                    out.write(np.ascontiguousarray(a).tobytes())
            fs.move(own, f"{path}/block-{b}")
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([int(b)], pa.int32()), "rows": pa.array([len(order)], pa.int64()), "task": pa.array([TaskContext.get().partitionId()], pa.int32())}
            )

    return run


def load_block(fs, path: str, b: int):
    """The arrays of a block, or None where no vector fell into it."""
    if fs.get_file_info(f"{path}/block-{b}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{path}/block-{b}", compression=None) as f:
        data = f.read()
    n, d = np.frombuffer(data, "<i8", 2)
    at, out = 16, []
    for kind, width in ((np.dtype("V16"), 1), (np.int64, 1), (np.int64, 1), (np.float64, 1), (np.float64, 1), (np.int8, d), (np.float64, d)):
        count = int(n * width)
        a = np.frombuffer(data, kind, count, at)
        at += count * a.itemsize
        out.append(a if width == 1 else a.reshape(int(n), int(d)))
    return out


def links_between(left, right, threshold: float, same: bool):
    """Index pairs (a of left, b of right) with cosine >= threshold, a piece at a time; a < b if same."""
    (*_, sa, ea, qa, ua), (*_, sb, eb, qb, ub) = left, right
    kind = np.float32 if qa.shape[1] * 127 * 127 < 2**24 else np.float64
    qa = qa.astype(kind)
    for at in range(0, len(sb), COLUMNS):
        to = min(at + COLUMNS, len(sb))
        rows = slice(0, to) if same else slice(None)
        p = qa[rows] @ qb[at:to].astype(kind).T
        s, e = sb[at:to], eb[at:to]
        need = threshold - ea[rows] - (1 + ea[rows]) * e.max()
        # Above zero the largest scale asks least of the product; else every pair may do.
        floor = np.where(need > 0, need / (sa[rows] * s.max()), -np.inf)
        a, b = np.nonzero(p >= np.floor(floor).astype(kind)[:, None])
        close = p[a, b] * sa[a] * s[b] + ea[a] + (1 + ea[a]) * e[b] >= threshold
        a, b = a[close], b[close] + at
        if same:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 200_000):
            x, y = a[k : k + 200_000], b[k : k + 200_000]
            hit = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            yield x[hit], y[hit]


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a and b: the smallest of each component."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]


FOUND = "key binary, a long, b long, n long"


def _compare(folder: str, threshold: float):
    """For each strip (i, first, last): (key, null, null, links) of classes and (null, rep, rep, null) of links that span."""

    def strip(fs, path, i, first, last):
        left = load_block(fs, path, i)
        if left is None:
            return
        blocks, starts, base = [left], {i: 0}, len(left[0])
        for j in range(first, last + 1):
            right = left if j == i else load_block(fs, path, j)
            if right is not None and j != i:
                starts[j], base = base, base + len(right[0])
                blocks.append(right)
        order_of = [i, *(j for j in starts if j != i)]
        key, rep, weight = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        order = np.argsort(rep, kind="stable")  # the label of a component is the place of its smallest id
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        label, n = np.arange(len(order)), np.zeros(len(order), np.int64)
        for j, right in zip(order_of, blocks, strict=True):
            if not first <= j <= last:
                continue
            for a, b in links_between(left, right, threshold, j == i):
                b = b + starts[j]
                n += np.bincount(a, weight[b], len(n)).astype(np.int64) + np.bincount(b, weight[a], len(n)).astype(np.int64)
                label = _settle(label, place[a], place[b])
        own = np.flatnonzero(n)
        moved = np.flatnonzero(label != np.arange(len(label)))
        none = lambda k: pa.nulls(k, pa.int64())
        counted = [pa.array([bytes(x) for x in key[own]], pa.binary()), none(len(own)), none(len(own)), pa.array(n[own])]
        yield pa.RecordBatch.from_arrays(counted, names=["key", "a", "b", "n"])
        ends = [pa.array(rep[order[moved]]), pa.array(rep[order[label[moved]]])]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(moved), pa.binary()), *ends, none(len(moved))], names=["key", "a", "b", "n"])

    def run(batches):
        fs, path = open_fs(folder)
        for batch in batches:
            for i, first, last in zip(*(batch.column(c).to_pylist() for c in ("i", "first", "last")), strict=True):
                yield from strip(fs, path, i, first, last)

    return run


def _strips(spark: SparkSession, begin: int, blocks: int, strip: int) -> DataFrame:
    """(i, first, last): each block with those from itself on, `strip` at a time, by arithmetic alone."""
    across = -(-blocks // strip)
    id_, n = F.col("id"), F.lit(across)
    i = F.floor(id_ / n)
    first = i + (id_ % n) * strip
    rows = spark.range(blocks * across).select(i.cast("int").alias("i"), first.cast("int").alias("first")).filter(F.col("first") < blocks)
    return rows.select(
        (F.col("i") + begin).alias("i"),
        (F.col("first") + begin).alias("first"),
        (F.least(F.col("first") + strip, F.lit(blocks)) - 1 + begin).cast("int").alias("last"),
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK, strip: int = STRIP
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of (vec_id, embedding).

    n_links counts the other rows whose cosine, in double precision, is at least
    the threshold (above 0); component_id is the smallest vec_id reachable,
    itself included; kept says that it is the own id.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link.  Rows that repeat a vec_id are rows
    of their own for n_links and one vertex for components; rows without a
    vec_id link with nothing and are kept.  Other columns don't matter; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = materialise(keyed.mapInArrow(_key, KEYED), "vec_keyed")
    keyed = keyed.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key")))
    classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim")
    )
    classes = materialise(classes, "vec_classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # lengths, not vectors
    first, count = {}, 0
    for dim in sorted(sizes):
        first[dim] = (count, -(-sizes[dim] // block_rows))
        count += first[dim][1]
    folder = scratch(spark, "vec_blocks")
    found = spark.createDataFrame([], FOUND)
    if count:
        own = F.coalesce(*[
            F.when(F.col("dim") == d, F.lit(at) + F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")) for d, (at, k) in first.items()
        ])
        one = keyed.select("key", "v", "vec_id").join(classes, "key").filter("vec_id = rep").dropDuplicates(["key"])
        blocks = one.select(own.alias("block"), "key", "rep", "n", "v").repartitionById(count, F.col("block"))
        materialise(blocks.mapInArrow(_pack(folder), "block int, rows long, task int"), "vec_index")
        strips = [_strips(spark, begin, k, strip) for begin, k in first.values()]
        strips = functools.reduce(DataFrame.unionByName, strips).repartition(count * 2, "i", "first")
        found = materialise(strips.mapInArrow(_compare(folder, threshold), FOUND), "vec_found")
    links = found.filter("n IS NOT NULL").groupBy("key").agg(F.sum("n").alias("links"))
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    # Rows that repeat an id with other vectors tie their classes together.
    rows = keyed.select("vec_id", "key").join(classes.select("key", "rep", F.col("n").alias("twins")), "key", "left")
    ties = rows.filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    again = keyed.filter("key IS NOT NULL").groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
    if again.limit(1).count():
        parts = connected_components(found.filter("b IS NOT NULL").select("a", "b").unionByName(ties))
        rows = rows.withColumn("rep", F.col("vec_id"))
    out = rows.join(links, "key", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("twins", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: The same in DuckDB, in double precision; vectors that can't link stand alone.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""
