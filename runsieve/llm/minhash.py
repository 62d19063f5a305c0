"""Operator 9: near-duplicates by min-max hashing.

Each of N_HASHES permutations of a document's shingle set keeps its minimum and
its maximum, so a signature of 2 * N_HASHES values costs half the evaluations.
BANDS bands of ROWS values bring documents with Jaccard similarity >= 0.8
together (a link at exactly 0.8 shares no band with probability 3e-5).

Documents with equal sets are one class before any banding.  Candidates are then
found in two steps, neither of which lists the pairs of a band:

1. stars: every class of a band against the band's smallest one;
2. bands whose members still lie in different components are compared inside, in
   tiles of TILE members: first by signatures alone, which leaves the members
   that could link across components; these meet again with their sets, and of
   the links found those that span the tile's components come out.

All candidates are confirmed on full shingle sets, in integers.  Documents whose
signatures agree on fewer than MIN_AGREE of 130 values are no candidates: a pair
at exactly 0.8 falls below that with probability 1e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, connected_components, materialise, mix64, read_table, text_bytes

N_HASHES, ROWS, BANDS = 65, 5, 26
SHINGLE_WORDS, PERCENT = 5, 80
#: Members of a tile's side, and shingles that one should hold.
TILE, TILE_SHINGLES = 512, 2_000_000
#: Of 130 values a pair at 0.8 agrees on 104 +- 4.6; below this it is no candidate (6 deviations).
MIN_AGREE = 76
WORD_CACHE = 300_000

_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 2**63, N_HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, N_HASHES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A-Z are lower-cased; words are runs of bytes other than space and \\t-\\r.
    Fewer than k words are one shingle as a whole; none give an empty set.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(words) > WORD_CACHE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = mix64(out + h[i : i + n] + np.uint64(i + 1))
    if len(h) < k:
        out = mix64(out + np.uint64(len(h)))
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """N_HASHES minima and maxima, interleaved, over one non-empty set."""
    low = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(N_HASHES, np.uint64)
    for at in range(0, len(s), 512):
        v = s[at : at + 512][None, :] * _MUL[:, None] + _ADD[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_hashes(sig: np.ndarray) -> np.ndarray:
    v = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix64(h + v[:, i])
    return h


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("fp", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("sig", pa.binary()),
    ]
)
SIGNED = "doc_id long, n_shingles long, fp binary, bands array<long>, sig binary"


def _sign(k: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            n, fp, bands, sigs = [], [], [], []
            for text in text_bytes(batch.column("text")):
                s = shingle_set(text, k, words)
                n.append(len(s))
                if not len(s):
                    fp.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                sig = signature(s)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_hashes(sig).view(np.int64))
                sigs.append((mix64(sig) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(fp, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                ],
                schema=_SIGNED,
            )

    return run


def _sets(k: int):
    """(fp, s) of texts, each set once in a task."""

    def run(batches):
        words, seen = WordHashes(), set()
        for batch in batches:
            fps, sets = [], []
            for text in text_bytes(batch.column("text")):
                s = shingle_set(text, k, words).tobytes()
                fp = xxhash.xxh3_128_digest(s)
                if fp not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "s"])

    return run


def _linked(percent: int):
    """Pairs (a, b) whose sets meet percent * union <= 100 * intersection."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))],
                names=["a", "b"],
            )

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, fa, b, fb) the links (a, b)."""
    full = pairs.join(sets.select(F.col("fp").alias("fb"), F.col("s").alias("sb")).hint("shuffle_hash"), "fb")
    full = full.join(sets.select(F.col("fp").alias("fa"), F.col("s").alias("sa")).hint("shuffle_hash"), "fa")
    return full.select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a long, b long")


def _open_pairs(rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) across components within one tile of a band that sizes and signatures leave open.

    A pair is looked at only in the first band that both hold.
    """
    side, comp, n, sig, bands = (rows[c] for c in ("side", "comp", "n", "sig", "bands"))
    diagonal = side[0] == 2
    left = np.flatnonzero(side != 1)
    right = left if diagonal else np.flatnonzero(side == 1)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in left:
        y = right[right > x] if diagonal else right
        y = y[comp[y] != comp[x]]
        y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
        y = y[(sig[y] == sig[x]).sum(1) >= MIN_AGREE] if len(y) else y
        if len(y):
            y = y[bands[x][(bands[y] == bands[x]).argmax(1)] == rows["band"]]
            xs.append(np.full(len(y), x))
            ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _tile_links(rows: dict, percent: int) -> list[tuple[int, int]]:
    """Links across components within one tile of a band, thinned to those that span them.

    Open pairs are confirmed on full sets: few one by one, many by products of
    the sets' incidence matrix.
    """
    x, y = _open_pairs(rows, percent)
    if not len(x):
        return []
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    sets = [np.frombuffer(rows["s"][k], np.uint64) for k in used]
    size = np.array([len(s) for s in sets])
    if len(x) <= 4 * len(used):
        both = np.array([size[a] + size[b] - len(np.unique(np.concatenate([sets[a], sets[b]]))) for a, b in zip(x, y, strict=True)])
    else:
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        row = np.repeat(np.arange(len(used)), size)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        shared = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, int(column[-1]) + 1, 4096):
            part = slice(*np.searchsorted(column, [lo, lo + 4096]))
            m = np.zeros((len(used), 4096), np.float32)
            m[row[part], column[part] - lo] = 1
            shared += m @ m.T
        both = shared[x, y].astype(np.int64)
    hit = 100 * both >= percent * (size[x] + size[y] - both)
    forest, out = Forest(), []
    ids = rows["id"][used]
    for a, b in zip(ids[x[hit]].tolist(), ids[y[hit]].tolist(), strict=True):
        if forest.join(a, b):
            out.append((min(a, b), max(a, b)))
    return out


def _columns(t: pa.Table) -> dict:
    out = {c: t.column(c).to_numpy() for c in ("side", "comp", "n", "id")}
    out["bands"] = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
    out["sig"] = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    if "s" in t.column_names:
        out["s"] = np.array(t.column("s").to_pylist(), object)
    return out


def _tiles(batches):
    """(table, columns) of every tile with two rows or more; rows come sorted by (band, i, j).

    side is 0, 1, or 2 on the diagonal, where both sides are the same rows.
    """
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held.column(c).to_numpy() for c in ("band", "i", "j")])
        start = 0
        for end in np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1:
            if end - start > 1:
                part = held.slice(start, end - start)
                yield part, _columns(part) | {"band": key[0, start]}
            start = end
        held = held.slice(start).combine_chunks() if start else held
    if held is not None and held.num_rows > 1:
        yield held, _columns(held) | {"band": held.column("band")[0].as_py()}


def _open_members(percent: int):
    """The rows of each tile that stand in an open pair."""

    def run(batches):
        for table, rows in _tiles(batches):
            some = np.unique(np.concatenate(_open_pairs(rows, percent)))
            if len(some):
                yield from table.take(pa.array(some)).combine_chunks().to_batches()

    return run


def _across(percent: int):
    """_tile_links of every tile."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def run(batches):
        found: list = []
        for _, rows in _tiles(batches):
            found += _tile_links(rows, percent)
            if len(found) > 50_000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    component_id is the smallest doc_id reachable over links (itself included),
    kept says that it is the own id.  Documents without words have an empty set
    and no links.  Rows that repeat a doc_id are one document: a link of one is
    a link of all, and all are kept if the id is.  Rows without an id are linked
    with nothing, have a null component_id and are kept.  Other columns of docs
    don't matter; an empty table gives no rows.

    BANDS, ROWS and MIN_AGREE are made for PERCENT: a lower percent would lose
    links and raises ValueError.
    """
    if percent < PERCENT:
        raise ValueError(f"percent must be at least {PERCENT}, for which the bands are made, not {percent}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(docs.mapInArrow(_sign(shingle_words), SIGNED), "minhash_signed")
    some = signed.filter("doc_id IS NOT NULL AND fp IS NOT NULL")

    # Documents with the same set are one class, named by its smallest id.
    classes = some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes, "minhash_classes")
    twins = some.select("doc_id", "fp").join(classes.filter("n > 1"), "fp").filter("doc_id <> rep")
    twins = materialise(twins.select("doc_id", "rep"), "minhash_twins")
    # A class is one row, however often its rows repeat.
    reps = some.join(classes.select("fp", F.col("rep").alias("doc_id")), ["fp", "doc_id"]).dropDuplicates(["fp"])
    reps = materialise(reps.select("fp", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sig"), "minhash_reps")

    banded = reps.select("fp", "id", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min(F.struct("id", "fp")).alias("hub"), F.count("*").alias("m"), F.sum("n").alias("w"))
    hubs = materialise(hubs.filter("m > 1").select("band", "hub", "m", "w"), "minhash_hubs")
    met = materialise(banded.drop("n").join(hubs, "band"), "minhash_met")
    stars = met.filter("fp <> hub.fp").select(F.col("hub.id").alias("a"), F.col("hub.fp").alias("fa"), F.col("id").alias("b"), F.col("fp").alias("fb"))
    stars = materialise(stars.distinct(), "minhash_stars")

    wanted = met.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(shingle_words), "fp binary, s binary"), "minhash_sets")
    repeats = sets.groupBy("fp").count().filter("count > 1").limit(1).count()
    if repeats:  # rows that repeat an id, in several tasks
        sets = materialise(sets.dropDuplicates(["fp"]), "minhash_sets")
    links = materialise(_confirm(stars, sets, percent), "minhash_links")
    first = connected_components(links)

    # Bands that the stars left in several components.
    where = met.join(first, "id", "left").select("band", "fp", "id", "m", "w", F.coalesce("component", "id").alias("comp"))
    where = materialise(where, "minhash_where")
    mixed = where.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    inside = where.join(mixed, "band", "left_semi").join(reps.drop("id"), "fp")
    tiles = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("w") / TILE_SHINGLES)).cast("int")
    inside = inside.withColumn("t", tiles).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"))
    inside = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    inside = inside.select(
        "band",
        F.least("c", "o").alias("i"),
        F.greatest("c", "o").alias("j"),
        F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).alias("side"),
        "fp",
        "id",
        "n",
        "comp",
        "sig",
        "bands",
    )
    tiled = lambda rows: rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    open_ = materialise(tiled(inside).mapInArrow(_open_members(percent), inside.schema), "minhash_open")
    more = tiled(open_.join(sets, "fp")).mapInArrow(_across(percent), "a long, b long")
    links = materialise(links.unionByName(more), "minhash_links")

    # Repeated ids with different sets tie their classes together.
    final = connected_components(links.unionByName(twins.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    out = signed.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def op9_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest id.

    All columns stay as they are, whatever their names.  Rows without words or
    without an id are kept; rows that repeat an id go or stay together; an empty
    table stays empty.
    """
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


_WORD, _UPPER, _LOWER = r"[^\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as op9_minmax in DuckDB: pairs that share a shingle, and all that is reachable over links.
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  least(doc_id, coalesce(b, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
