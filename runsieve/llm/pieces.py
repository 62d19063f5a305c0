"""Operator 10: SentencePiece encoding and decoding with exact N-best segmentation.

A text's segmentations are paths through the lattice of vocabulary pieces; a
path scores the sum of its pieces.  The forward Viterbi pass gives the best score
up to every position; read backwards from the end, these scores are an exact
heuristic, so that A-star pops whole paths in order of score and the first N are
the N best.

No piece crosses from another character into a space mark, and characters that
stand in no longer piece stand alone, so a text's lattice is a chain of
independent chunks.  Chunks are solved once each while they are remembered, many
at a time in numpy (best and second best); a document's N best can differ from
its best only in the N-1 chunks with the smallest loss, and A-star runs over
those: inside each chunk, and over the chain of their alternatives.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import read_table

N_BEST = 4
#: What the pipeline's rows say of their place in the mix.
PLACE = ("position", "slot", "in_mix")
MARK = "▁"
#: Chunks up to this length are solved together; longer ones, one by one.
WIDE = 32
REMEMBER = 250_000
GROUP_CHARS = 1_000_000


def nbest_paths(n_nodes: int, into: list[list], n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to node n_nodes - 1, as (score, edge payloads in order).

    into[j] lists the edges (i, score, payload) from i < j into j.  Paths of
    equal score come in a fixed order.  No path: an empty list.
    """
    best = [float("-inf")] * n_nodes
    best[0] = 0.0
    for j in range(1, n_nodes):
        for i, s, _ in into[j]:
            if best[i] + s > best[j]:
                best[j] = best[i] + s
    out: list = []
    tick = 0
    heap = [(-best[-1], n_nodes - 1, 0, 0.0, None)] if best[-1] > float("-inf") else []
    while heap and len(out) < n:
        _, j, _, behind, tail = heapq.heappop(heap)
        if j == 0:
            path = []
            while tail is not None:
                path.append(tail[0])
                tail = tail[1]
            out.append((behind, path))
            continue
        for i, s, payload in into[j]:
            if best[i] > float("-inf"):
                tick += 1
                heapq.heappush(heap, (-(best[i] + s + behind), i, tick, behind + s, (payload, tail)))
    return out


class PieceTable:
    """A vocabulary as arrays: a trie in one open-addressed table, scores, byte pieces.

    Chars without a piece fall back to their UTF-8 bytes at `unknown` a char.  A
    vocabulary in which a piece reaches from a character into a space mark raises.
    """

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], byte_ids: dict[int, int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = -float(len(pieces))
        self.key = zlib.crc32(repr((pieces, scores, plain, sorted(byte_ids.items()))).encode()), len(pieces)
        self.scores = np.array(scores, float)
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok and p}
        self.longest = max(map(len, self.ids), default=1)
        across = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if across:
            raise ValueError(f"pieces reach over a space mark, so texts don't fall into chunks: {across[:3]}")
        nodes, ends = {(): 0}, [-1]
        edges = []
        for p, i in self.ids.items():
            at = 0
            for c in p:
                key = (at << 21) | ord(c)
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                    edges.append(key)
                at = nodes[key]
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        bits = max(10, (2 * len(edges)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.next = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys, slots = self.keys.tolist(), self._slot(np.array(edges, np.int64)).tolist()
        for key, slot in zip(edges, slots, strict=True):
            while keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            keys[slot] = key
            self.next[slot] = nodes[key]
        self.keys = np.array(keys, np.int64)
        linked = sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK})
        one = "[" + "".join(map(re.escape, linked)) + "]" if linked else "(?!)"
        self.chunk = f"{MARK}+{one}*|{one}+|[^{MARK}]"
        # How id sequences read: each piece as bytes.
        raw = {i: bytes([b]) for b, i in byte_ids.items()}
        text = [raw.get(i, p.replace(MARK, " ").encode() if ok else b"") for i, (p, ok) in enumerate(zip(pieces, plain, strict=True))]
        self.as_bytes = np.array([*text, b""], object)[:-1]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after char, -1 where there is none."""
        key = (node.astype(np.int64) << 21) | char
        slot = self._slot(key).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == key, self.next[slot], -1)
        left = np.flatnonzero((got != key) & (got >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[left]]
            hit = got == key[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out

    def edges(self, chunk: str) -> list[list]:
        """into[j] of a chunk's lattice; payloads are tuples of ids."""
        into: list[list] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j in range(i + 1, min(len(chunk), i + self.longest) + 1):
                p = self.ids.get(chunk[i:j])
                if p is not None:
                    into[j].append((i, float(self.scores[p]), (p,)))
            if chunk[i] not in self.ids:
                into[i + 1].append((i, self.unknown, tuple(self.byte_ids[b] for b in chunk[i].encode())))
        return into

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a chunk: (score, ids)."""
        found = nbest_paths(len(chunk) + 1, self.edges(chunk), n)
        return [(score, [i for ids in path for i in ids]) for score, path in found]

    def solve(self, chunks: list[str]):
        """(scores, losses of the second best, id counts, ids end to end) of many chunks."""
        n = len(chunks)
        score, loss = np.zeros(n), np.full(n, np.inf)
        ids: list = [None] * n
        wide = [k for k, c in enumerate(chunks) if len(c) <= WIDE]
        rest = [k for k, c in enumerate(chunks) if len(c) > WIDE]
        if wide:
            rest += self._solve_wide(chunks, np.array(wide), score, loss, ids)
        for k in rest:
            two = self.nbest(chunks[k], 2)
            score[k], ids[k] = two[0][0], np.array(two[0][1], np.int32)
            if len(two) > 1:
                loss[k] = two[0][0] - two[1][0]
        return score, loss, np.array([len(x) for x in ids], np.int64), np.concatenate(ids or [np.zeros(0, np.int32)])

    def _solve_wide(self, chunks, at, score, loss, ids) -> list[int]:
        """Best two scores at every position of all chunks at once; returns those that need bytes."""
        size = np.array([len(chunks[k]) for k in at])
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        width = int(size[0])
        code = np.array([chunks[k] for k in at], f"U{width}").view(np.uint32).reshape(len(at), width).astype(np.int64)
        f1, f2 = np.full((len(at), width + 1), -np.inf), np.full((len(at), width + 1), -np.inf)
        from_, piece = np.zeros((len(at), width + 1), np.int16), np.full((len(at), width + 1), -1, np.int32)
        f1[:, 0] = 0
        for i in range(width):
            rows = np.arange(np.searchsorted(-size, -i, side="left"))  # chunks longer than i
            node = np.zeros(len(rows), np.int64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                alive = size[rows] >= j
                rows, node = rows[alive], node[alive]
                node = self.step(node, code[rows, j - 1])
                rows, node = rows[node >= 0], node[node >= 0]
                if not len(rows):
                    break
                end = self.ends[node]
                r, p = rows[end >= 0], end[end >= 0]
                s = self.scores[p]
                one, two = f1[r, i] + s, f2[r, i] + s
                old = f1[r, j]
                wins = one > old
                f2[r, j] = np.where(wins, np.maximum(old, two), np.maximum(f2[r, j], one))
                f1[r, j] = np.where(wins, one, old)
                from_[r[wins], j], piece[r[wins], j] = i, p[wins]
        last = np.arange(len(at))
        top, second = f1[last, size], f2[last, size]
        ok = np.isfinite(top)
        score[at], loss[at] = top, np.where(ok & np.isfinite(second), np.where(ok, top, 0) - second, np.inf)
        rows, pos, steps = last[ok], size[ok].copy(), []
        while len(rows):
            steps.append((rows, piece[rows, pos]))
            pos = from_[rows, pos].astype(np.int64)
            rows, pos = rows[pos > 0], pos[pos > 0]
        if steps:
            row, got = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
            depth = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
            by = np.lexsort((-depth, row))
            parts = np.split(got[by], np.cumsum(np.bincount(row, minlength=len(at)))[:-1])
            for k, good, part in zip(at, ok, parts, strict=True):
                if good:
                    ids[k] = part
        return [int(k) for k in at[~ok]]

    def split(self, text: str, find) -> list[str]:
        """Chunks of a whole text, marked as the model marks it: a space before it, spaces as marks."""
        return find(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text of ids, without the space that encoding put before it."""
        raw = b"".join(self.as_bytes[ids].tolist())
        return raw[1:] if raw[:1] == b" " else raw


def load(path: str | None = None) -> PieceTable:
    """The table of a SentencePiece model file; by default the public 32k one.

    Read on the driver; workers get the arrays and need no file.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    return PieceTable(pieces, [sp.get_score(i) for i in range(n)], plain, byte_ids)


class _Known:
    """Chunks solved lately: index of each, scores, losses and ids."""

    def __init__(self, table: PieceTable):
        self.table, self.find = table, re.compile(table.chunk, re.S).findall
        self.forget()

    def forget(self):
        self.at: dict[str, int] = {}
        self.more: dict[str, list] = {}
        self.score = self.loss = np.zeros(0)
        self.count = self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, chunks):
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        if not new:
            return
        score, loss, count, ids = self.table.solve(new)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])

    def nbest(self, chunk: str, n: int):
        if chunk not in self.more:
            self.more[chunk] = self.table.nbest(chunk, n)
        return self.more[chunk]


_MEMORY: dict = {}


def remembered(table: PieceTable) -> _Known:
    """What this Python worker knows of a table's chunks: the tasks of a worker share it."""
    if table.key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[table.key] = _Known(table)
    return _MEMORY[table.key]


def _encode_one(known: _Known, chunks: list[str], n: int):
    """(ids, scores of the n best, edits of the second best and on)."""
    if not chunks:
        return np.zeros(0, np.int32), [0.0], []
    at = np.fromiter(map(known.at.__getitem__, chunks), np.int64, len(chunks))
    count = known.count[at]
    ends = np.cumsum(count)
    ids = known.ids[np.repeat(known.start[at] - ends + count, count) + np.arange(ends[-1])]
    best = float(known.score[at].sum())
    if n == 1:
        return ids, [best], []
    loss = known.loss[at]
    few = np.sort(np.argsort(loss, kind="stable")[: n - 1]) if len(loss) >= n else np.arange(len(loss))
    few = few[np.isfinite(loss[few])]
    into: list[list] = [[]]
    for k, p in enumerate(few):
        options = known.nbest(chunks[p], n)
        into.append([(k, s - options[0][0], (int(p), alt, tuple(i))) for alt, (s, i) in enumerate(options)])
    found = nbest_paths(len(few) + 1, into, n)
    edits = [
        [{"at": int(ends[p] - count[p]), "drop": int(count[p]), "ids": list(i)} for p, alt, i in path if alt]
        for _, path in found[1:]
    ]
    return ids, [best + s for s, _ in found], edits


ENCODED = (
    "doc_id long, ids array<int>, scores array<double>, "
    "edits array<array<struct<at:int,drop:int,ids:array<int>>>>, text_crc32 long"
)
_EDITS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _encode(table: PieceTable, n: int, keep: tuple[str, ...] = ()):
    def emit(known, rows, texts):
        ids, scores, edits, crcs = [], [], [], []
        chunks = [table.split(t, known.find) if t else [] for t in texts]
        if len(known.at) > REMEMBER:
            known.forget()
        known.learn(c for doc in chunks for c in doc)
        for t, doc in zip(texts, chunks, strict=True):
            i, s, e = _encode_one(known, doc, n)
            ids.append(i)
            scores.append(s)
            edits.append(e)
            crcs.append(zlib.crc32((t or "").replace(MARK, " ").encode()))
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), flat, pa.array(scores, pa.list_(pa.float64())), pa.array(edits, _EDITS), pa.array(crcs, pa.int64())]
            + [rows.column(c) for c in keep],
            names=["doc_id", "ids", "scores", "edits", "text_crc32", *keep],
        )

    def run(batches):
        known = remembered(table)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = chars = 0
            for k, t in enumerate(texts):
                chars += len(t or "")
                if chars >= GROUP_CHARS or k + 1 == len(texts):
                    yield emit(known, batch.slice(start, k + 1 - start), texts[start : k + 1])
                    start, chars = k + 1, 0

    return run


def _schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)


def encode(docs: DataFrame, n_best: int = N_BEST, model_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, scores, edits, text_crc32): one row for each row of docs.

    ids: the best segmentation of the whole text; scores: of the n_best best
    (fewer if there are no more), falling; edits[k]: how the (k+2)-th differs
    from ids: at `at`, `drop` ids give way to `ids`.  Of equal scores, the one
    with the longer last piece is the best.  text_crc32 is that of the text that
    decoding should give: a space mark in the text itself reads as a space.  A
    null or empty text has no ids and the score 0.  The columns named in keep
    follow as they are; others don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    return docs.mapInArrow(_encode(load(model_path), n_best, keep), ENCODED + _schema(docs, keep))


def _decode(table: PieceTable, keep_text: bool, keep: tuple[str, ...] = ()):
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            rows = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            out = [table.decode(r) for r in rows]
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_pieces": pa.array([len(r) for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                "decoded_crc32": pa.array([zlib.crc32(t) for t in out], pa.int64()),
            }
            if keep_text:
                cols["text"] = pa.array([t.decode("utf-8", "replace") for t in out], pa.string())
            else:
                cols["scores"], cols["text_crc32"] = batch.column("scores"), batch.column("text_crc32")
            cols |= {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, text) of (doc_id, ids); null ids count as none."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(
        _decode(load(model_path), True), "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, text string"
    )


def encode_and_check(docs: DataFrame, n_best: int = N_BEST, model_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode, decode the ids again, and say of each document whether its text came back.

    keep: columns of encode's rows (ids, edits) or of docs that follow as they are.
    """
    table = load(model_path)
    own = tuple(c for c in keep if c not in ("ids", "edits"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own)
    there, back = _encode(table, n_best, own), _decode(table, False, keep)
    types = dict(x.split(" ", 1) for x in ENCODED.split(", ")) | {c: docs.schema[c].dataType.simpleString() for c in own}
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, scores array<double>, text_crc32 long"
    # One Python worker a task for both ways.
    rows = docs.mapInArrow(lambda batches: back(there(batches)), schema + "".join(f", {c} {types[c]}" for c in keep))
    return rows.select(
        "doc_id",
        "n_pieces",
        "ids_crc32",
        "scores",
        (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"),
        *keep,
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in piece ids with its N best segmentations, decoded again, and its place in the mixed stream.

    (doc_id, ids, n_pieces, score, scores, edits, round_trip, position, slot,
    in_mix); the last three as mixing.mix has them over all of docs, since a
    written table keeps no order.
    """
    placed = mixing.mix(docs, keep=("text",)).withColumnRenamed("id", "doc_id")
    rows = encode_and_check(placed, keep=("ids", "edits", *PLACE))
    return rows.select("doc_id", "ids", "n_pieces", F.get("scores", F.lit(0)).alias("score"), "scores", "edits", "round_trip", *PLACE)
