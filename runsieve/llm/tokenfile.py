"""Operator 3: token ids as flat unsigned integer files with 64-bit document offsets.

The file format is a folder in the shared store:

    part-NNNNN.ids   ids end to end, little-endian, 2 bytes each where every id fits, else 4
    part-NNNNN.off   64-bit offsets (in ids) of the part's documents, one more than documents
    part-NNNNN.doc   64-bit document ids (the least value stands for null)
    index/           a table: part, n_docs, n_tokens, doc_base, token_base, width

Parts follow ascending doc_id; a part's bases are prefix sums over the parts
before it, so any document's ids are found, memory-mapped, without reading
others.  A task writes under a name of its own and renames when whole, so that
lost or repeated tasks leave each part once.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch

END_ID = 1
#: Words that a worker remembers, text that it encodes at once, and bytes of text in a part.
REMEMBER, GROUP_CHARS, PART_BYTES = 600_000, 16_000_000, 32 << 20
#: Documents and ids that are read back at once.
READ_DOCS, READ_IDS = 20_000, 2_000_000
KINDS = ("ids", "off", "doc")
#: Characters whose lower case, class and composition no Unicode version changes; no white space, no combining mark.
LATIN = [c for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
#: Fixed by the model's pre-tokenizer; check() holds it against the model.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
NULL_ID = np.iinfo(np.int64).min


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a bare local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class FlatFile:
    """Ranges of a flat file as arrays: mapped where the store is local, else read by range."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: str):
        self.kind, self.file, self.map = np.dtype(kind), None, None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(path)
        elif os.path.getsize(path):
            self.map = np.memmap(path, kind, "r")

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return np.zeros(0, self.kind) if self.map is None else self.map[at]
        n = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(0, at.stop - at.start) * n, at.start * n), self.kind)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()


class SpaceCached:
    """Encodes whole texts with a tokenizers model, remembering words between spaces.

    It holds for models whose words never reach over a space and that drop
    spaces.  New words of common Latin letters are cut into the model's own
    pre-tokens here and merged by the library's model; others pass through the
    whole library.  check() refuses models for which this would differ.

    One of these lives as long as its Python worker (coder()), so that the tasks
    of a worker share what they know.  At most about REMEMBER words are kept:
    beyond that, those met only once since the last time are forgotten.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        kind = {c: unicodedata.category(chr(c))[0] for c in LATIN}
        some = lambda k: "".join(re.escape(chr(c)) for c in LATIN if kind[c] == k)
        letter, number = some("L"), some("N")
        self.cut = re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^\\s{letter}{number}]+|\n").findall
        self.plain = re.compile("[" + "".join(re.escape(chr(c)) for c in LATIN) + "]*").fullmatch
        self.bytes = {c: "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(chr(c))) for c in LATIN} if self.tok.pre_tokenizer else {}
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def check(self) -> bool:
        """Whether words stand alone in this model and the cutting here is the model's own."""
        probe = ["it's", "naïve", "é", "́x", "x1y2", "日本", "!?", "<|", "of", "WE'LL", "a's't", "x\u00a0y", "''", "½ß", *self.added]
        if self._ids(" " + "  ".join(probe) + "\n ") != [i for w in probe for i in self._ids(w)]:
            return False
        chars = [chr(c) for c in LATIN]
        words = [*probe, *chars, *(f"a{c}b{c}{c}1{c}'s" for c in chars)]
        count, ids = self._solve(words)
        return np.array_equal(count, [len(self._ids(w)) for w in words]) and ids.tolist() == [i for w in words for i in self._ids(w)]

    def forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.count, self.start, self.ids = np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(1, np.int64)

    def _trim(self) -> None:
        keep = self.met > 1
        if keep.sum() > REMEMBER // 2:
            return self.forget()
        keep[0] = True
        new = np.cumsum(keep) - 1
        words = [(w, int(new[k])) for w, k in self.at.items() if keep[k]]
        ids = self.ids[_spread(self.start[keep], self.count[keep])]
        self.at, self.count, self.ids = dict(words), self.count[keep], ids
        self.start, self.met = np.cumsum(self.count, dtype=np.int64) - self.count, np.zeros(len(words), np.int64)

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, the ids end to end)."""
        plain = [w for w in words if self.plain(w)]
        if self.special("\n".join(plain)):
            plain = [w for w in plain if not self.special(w)]
        count, parts = {}, {}
        if plain:
            pieces = pa.array(self.cut("\n".join(plain).lower())).dictionary_encode()
            code, merge, own = pieces.indices.to_numpy(), self.tok.model.tokenize, self.bytes
            one = [[] if p == "\n" else [t.id for t in merge(p if p.isascii() else p.translate(own))] for p in pieces.dictionary.to_pylist()]
            size = np.fromiter(map(len, one), np.int32, len(one))
            flat = np.fromiter(itertools.chain.from_iterable(one), np.uint32, int(size.sum()))
            flat = flat[_spread((np.cumsum(size) - size)[code], size[code])]
            cuts = np.cumsum(size[code])[code == one.index([])] if len(plain) > 1 else []
            bounds = np.concatenate([[0], cuts, [len(flat)]]).astype(np.int64)
            if len(plain) == len(words):
                return np.diff(bounds), flat
            for k, w in enumerate(plain):
                count[w], parts[w] = bounds[k + 1] - bounds[k], flat[bounds[k] : bounds[k + 1]]
        rest = [w for w in words if w not in count]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            parts[w] = np.array(e.ids, np.uint32)
            count[w] = len(parts[w])
        return np.array([count[w] for w in words], np.int64), np.concatenate([parts[w] for w in words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, the ids end to end); a null text has none."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        vocabulary, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        if len(self.at) > REMEMBER:
            self._trim()
        known = self.at
        place = np.fromiter(map(known.get, vocabulary, itertools.repeat(-1)), np.int32, len(vocabulary))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [vocabulary[k] for k in unknown]
            place[unknown] = np.arange(len(known), len(known) + len(new))
            count, ids = self._solve(new)
            known.update(zip(new, place[unknown].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[place] += np.bincount(code, minlength=len(place))
        # The words of these texts alone, so that what is gathered from stays small.
        count = self.count[place]
        ids = self.ids[_spread(self.start[place], count)]
        flat = ids[_spread((np.cumsum(count) - count)[code], count[code])]
        ends = np.concatenate([[0], np.cumsum(count[code], dtype=np.int64)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.diff(ends), flat


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start[k] .. start[k] + count[k] - 1 of every k, end to end."""
    total = int(count.sum(dtype=np.int64))
    kind = np.int32 if total < 2**31 and start.max(initial=0) < 2**31 - total else np.int64
    out = np.repeat((start - np.cumsum(count, dtype=np.int64) + count).astype(kind), count)
    out += np.arange(total, dtype=kind)
    return out


class WholeTexts:
    """The same for any model, without remembering."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        return np.array([len(i) for i in found], np.int64), np.array([i for ids in found for i in ids], np.uint32)


_CODERS: dict = {}


def coder(model: str, spaced: bool):
    """This Python worker's encoder for a model: made once, whatever tasks the worker runs."""
    key = spaced, hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = (SpaceCached if spaced else WholeTexts)(model)
    return _CODERS[key]


WRITTEN = "part int, n_docs long, n_tokens long, width int"


def groups(col: pa.Array, most: int):
    """(first, end) of runs of texts of at most so many bytes, or of one text."""
    size = pc.binary_length(col).fill_null(0).to_numpy()
    start, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(size):
        yield start, len(size)


def _write(model: str, spaced: bool, width: int, end_id: int, folder: str):
    def run(batches):
        code = coder(model, spaced)
        fs, path = open_fs(folder)
        part = TaskContext.get().partitionId()
        name, own = f"{path}/part-{part:05d}", f".{uuid.uuid4().hex}"
        n_docs = total = 0
        fs.create_dir(path, recursive=True)
        with contextlib.ExitStack() as open_:
            out = {k: open_.enter_context(fs.open_output_stream(f"{name}.{k}{own}")) for k in KINDS}
            out["off"].write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts = batch.column("text")
                for lo, hi in groups(texts, GROUP_CHARS):
                    count, flat = code.encode(texts.slice(lo, hi - lo))
                    flat = np.insert(flat, np.cumsum(count), end_id)
                    out["ids"].write(flat.astype(f"<u{width}").tobytes())
                    out["off"].write((total + np.cumsum(count + 1)).astype("<u8").tobytes())
                    total += len(flat)
                ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
                out["doc"].write(ids.astype("<i8").tobytes())
                n_docs += len(ids)
        for kind in KINDS:
            fs.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "n_docs": pa.array([n_docs], pa.int64()),
                "n_tokens": pa.array([total], pa.int64()),
                "width": pa.array([width], pa.int32()),
            }
        )

    return run


def _remove_leftovers(folder: str) -> None:
    """Delete what attempts that were lost on the way have left under names of their own."""
    fs, path = open_fs(folder)
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith("part-") and f.base_name.rsplit(".", 1)[-1] not in KINDS:
            fs.delete_file(f.path)


def write_tokens(
    docs: DataFrame, folder: str, model_path: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Encode every whole text and write the files; returns the index table.

    Documents stand in ascending doc_id order, those without one first, those
    with one id in an order of their texts (by hash, then by text).  A null or
    empty text is the end id alone.  The number of parts grows with the bytes of
    text, part_bytes to a part, and rows without an id, or of one id, spread over
    parts as others do; only groups of GROUP_CHARS are held.  An empty table gives
    a part without documents.  Other columns don't matter.
    """
    spark = docs.sparkSession
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("word_bpe_49k.json")
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(model).get_vocab(with_added_tokens=True).values(), default=0)
    width = 2 if max(largest, end_id) < 2**16 else 4
    spaced = SpaceCached(model).check()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(1 + size // part_bytes, *order).sortWithinPartitions(*order, "text")
    written = rows.mapInArrow(_write(model, spaced, width, end_id, folder), WRITTEN)
    written.write.parquet(f"{folder}/written")
    _remove_leftovers(folder)
    written = spark.read.schema(WRITTEN).parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # parts, not documents
    for base, of in (("doc_base", "n_docs"), ("token_base", "n_tokens")):
        written = written.withColumn(base, F.coalesce(F.sum(of).over(before), F.lit(0)))
    written.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = ("part", "n_docs", "token_base", "width")


def _read(folder: str):
    def run(batches):
        fs, path = open_fs(folder)
        for batch in batches:
            for part, n_docs, base, width in zip(*(batch.column(c).to_pylist() for c in INDEX), strict=True):
                name = f"{path}/part-{part:05d}"
                with FlatFile(fs, f"{name}.off", "<u8") as offs, FlatFile(fs, f"{name}.doc", "<i8") as ids, FlatFile(fs, f"{name}.ids", f"<u{width}") as flat:
                    for lo in range(0, n_docs, READ_DOCS):
                        hi = min(lo + READ_DOCS, n_docs)
                        off, docs = offs[lo : hi + 1].astype(np.int64), np.array(ids[lo:hi])
                        crc, k = [], 0
                        while k < hi - lo:  # groups of documents, or one
                            end = max(k + 1, int(np.searchsorted(off, off[k] + READ_IDS, side="right")) - 1)
                            some = flat[off[k] : off[end]].astype("<u4")
                            at = off[k : end + 1] - off[k]
                            crc += [zlib.crc32(some[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                            k = end
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs, pa.int64(), mask=docs == NULL_ID),
                                pa.array(base + off[:-1], pa.int64()),
                                pa.array(np.diff(off), pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, from the files."""
    index = spark.read.parquet(f"{folder}/index").select(*INDEX)
    return index.repartition(max(1, index.count()), "part").mapInArrow(_read(folder), READ)


def document_ids(spark: SparkSession, folder: str, number: int) -> np.ndarray:
    """The ids of the number-th document (from 0, in doc_id order), through the index and maps alone."""
    row = spark.read.parquet(f"{folder}/index").filter((F.col("doc_base") <= number) & (F.col("doc_base") + F.col("n_docs") > number))
    row = row.first()
    fs, path = open_fs(folder)
    name, k = f"{path}/part-{row['part']:05d}", number - row["doc_base"]
    with FlatFile(fs, f"{name}.off", "<u8") as offs, FlatFile(fs, f"{name}.ids", f"<u{row['width']}") as flat:
        a, b = offs[k : k + 2].tolist()
        return np.array(flat[a:b])


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder)
