"""Operator 4: toxicity by the nearest labelled examples.

A bounded sample of labelled documents becomes a block-max inverted index of
TF-IDF vectors over all their words; document frequencies count all documents.
A word's weight also grows with how surely it separates the classes in the
sample, or words that say nothing would rule the cosine; none is left out.
Every document is a query, and its nearest examples are exact (blockmax.py).
Their votes, weighted by distance, are calibrated on labelled documents that are
neither examples nor seen by the weights, and come with the examples and the
words they rest on.  A document that is itself an example, or has the label and
the text of one, never meets that example.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockmax import BlockMaxIndex
from .common import materialise, read_table
from .tokenfile import groups

#: Labelled rows used, at most; of them one in TUNE_EVERY calibrates, the others are examples.
LABELLED_ROWS, TUNE_EVERY, NEIGHBOURS = 4096, 5, 15
#: What a word that separates nothing weighs beside its idf, and how many standard errors a word must show.
LEAST_WEIGHT, ERRORS = 0.02, 2.0
#: Cosines count to so many decimals.
DIGITS = 9
TOGETHER, REMEMBER = 64, 100_000
#: Bytes of text whose words are counted at once.
GROUP_BYTES = 2_000_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the lower-cased runs of letters of whole texts end to end, the text of each); null has none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+")
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().dictionary_encode(), np.repeat(np.arange(len(sizes)), sizes)


def count_words(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) of the vocabulary's words in whole texts, by text and word."""
    words, text = words_of(texts)
    code = pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)[words.indices.to_numpy()]
    some = code >= 0
    key, count = np.unique(text[some] * max(1, len(vocabulary)) + code[some], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), count


def _bags(batches):
    """The words of the sample's texts, with counts."""
    for batch in batches:
        for lo, hi in groups(batch.column("text"), GROUP_BYTES):
            some = batch.slice(lo, hi - lo)
            words, text = words_of(some.column("text"))
            size = max(1, len(words.dictionary))
            key, count = np.unique(text * size + words.indices.to_numpy(), return_counts=True)
            word = words.dictionary.take(pa.array(key % size))
            offsets = pa.array(np.searchsorted(key, np.arange(hi - lo + 1) * size).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("h", "ids", "y")), pa.ListArray.from_arrays(offsets, word), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))],
                names=["h", "ids", "y", "words", "counts"],
            )


COUNTED = "doc_id long, terms array<int>, counts array<int>"


def _vectors(vocabulary: pa.Array):
    """Counts of the vocabulary's words in each whole text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in groups(texts, GROUP_BYTES):
                text, word, count = count_words(texts.slice(lo, hi - lo), vocabulary)
                offsets = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (word, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *lists], names=["doc_id", "terms", "counts"])

    return run


def separation(y: np.ndarray, text: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """How surely each word separates the classes: LEAST_WEIGHT plus the square of its log-odds beyond ERRORS standard errors."""
    n1, n0 = y.sum(), len(y) - y.sum()
    a = np.bincount(word[y[text] == 1], minlength=n_words) + 0.5
    b = np.bincount(word[y[text] == 0], minlength=n_words) + 0.5
    odds = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    return LEAST_WEIGHT + np.maximum(np.abs(odds) - ERRORS * np.sqrt(1 / a + 1 / b), 0) ** 2


@dataclass
class NearestExamples:
    """The fitted operator: all words of the examples, their weights, the index, labels, ids and calibration."""

    vocabulary: pa.Array
    weights: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    #: Of each labelled document of the sample, the example that has its text.
    own: dict
    prior: float
    coefficients: np.ndarray

    def query(self, terms: np.ndarray, counts: np.ndarray):
        """The unit vector of a document as lists and weights, the longest lists first."""
        w = (1 + np.log(counts)) * self.weights[terms]
        order = np.lexsort((terms, -self.index.df[terms]))
        return terms[order], (w / np.sqrt((w * w).sum()))[order] if len(w) else w

    def nearest(self, documents: list, without: list | None = None, k: int = NEIGHBOURS):
        """(positions, cosines) of the nearest examples of each (terms, counts)."""
        return self.index.top([self.query(t, c) for t, c in documents], k, None, without)

    def evidence(self, found) -> np.ndarray:
        """What the calibration sees of the voters: the weighted vote, how near they are, and both together."""
        at, sims = found
        if not len(at):
            return np.array([1.0, 0.0, 0.0, 0.0])
        weight = 1.0 / (1.02 - sims)
        vote, near = float((weight * self.labels[at]).sum() / weight.sum()), float(sims.mean())
        return np.array([1.0, vote, near, vote * near])

    def score(self, found) -> float:
        """The share of toxic documents that such voters mean; without voters, that of all labelled ones."""
        if not len(found[0]):
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.evidence(found) @ self.coefficients, -30, 30))))


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression with a little shrinkage, by Newton steps."""
    start = np.zeros(x.shape[1])
    start[0] = np.log(prior / (1 - prior))
    start[1] = 1.0  # without rows to learn from, votes still count
    beta, keep = start.copy(), 0.1 * np.eye(len(start))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + keep @ (beta - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, grad)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return beta


def _weighed(text, word, count, weights, n):
    """Unit vectors as postings (word, text, impact), sorted by word and text."""
    w = (1 + np.log(count)) * weights[word]
    norm = np.sqrt(np.bincount(text, w * w, n))
    order = np.lexsort((text, word))
    return word[order], text[order], (w / norm[text])[order]


def fit_and_vectors(docs: DataFrame, labels: DataFrame) -> tuple[NearestExamples, DataFrame]:
    """The fitted operator, and (doc_id, terms, counts) of all documents.

    Learns from at most LABELLED_ROWS labels with doc_id outside the held-out
    fifth; a document with several labels, or a text with several documents,
    counts once with the highest label.  Labels that are neither 0 nor 1, or of
    ids that docs lacks, are left out.
    """
    own = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    own = own.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(LABELLED_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = docs.join(F.broadcast(own), "doc_id").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))  # at most LABELLED_ROWS labels
    # Copies of one text are one example: an id may have several texts, a text several ids.
    sample = sample.groupBy("h").agg(F.collect_set("doc_id").alias("ids"), F.max("y").cast("int").alias("y"), F.first("text").alias("text"))
    sample = materialise(sample.select("h", "ids", "y", "text"), "toxic_sample")
    bags = sample.mapInArrow(_bags, "h string, ids array<long>, y int, words array<string>, counts array<int>")
    rows = materialise(bags, "toxic_bags").toArrow().sort_by("h")  # the bounded sample
    y = rows.column("y").to_numpy().astype(np.int64)
    lists = rows.column("words").combine_chunks()
    words = pc.unique(lists.flatten()).sort()
    word = pc.index_in(lists.flatten(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    count = rows.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    ids = rows.column("ids").to_pylist()

    # The words of the examples are the space; the others of the sample calibrate.
    tune = np.arange(len(y)) % TUNE_EVERY == TUNE_EVERY - 1
    example = np.cumsum(~tune) - 1
    mine = ~tune[text]
    used = np.unique(word[mine])
    code = np.full(len(words), -1)
    code[used] = np.arange(len(used))
    vocabulary = words.take(pa.array(used)).cast(pa.string())

    vectors = materialise(docs.mapInArrow(_vectors(vocabulary), COUNTED), "toxic_vectors")
    n_docs = docs.count()
    seen = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # words of the sample
    df = np.zeros(len(used))
    df[seen.column("t").to_numpy()] = seen.column("count").to_numpy()
    weights = (np.log((1 + n_docs) / (1 + df)) + 1) * separation(y[~tune], example[text[mine]], code[word[mine]], len(used))

    n = int((~tune).sum())
    term, doc, impact = _weighed(example[text[mine]], code[word[mine]], count[mine], weights, n)
    start = np.searchsorted(term, np.arange(len(used) + 1))
    del rows, lists, words, seen, term, mine  # the driver is small
    pa.default_memory_pool().release_unused()
    first = np.array([min(i) for i, t in zip(ids, tune, strict=True) if not t], np.int64)
    place = {i: int(example[k]) for k in np.flatnonzero(~tune) for i in ids[k]}
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = NearestExamples(vocabulary, weights, BlockMaxIndex(first, start, doc, impact, DIGITS), y[~tune], place, prior, np.zeros(4))
    x, truth = [], []
    at, known = np.searchsorted(text, np.arange(len(y) + 1)), code[word]
    for k in np.flatnonzero(tune):
        own_words = np.arange(at[k], at[k + 1])
        own_words = own_words[known[own_words] >= 0]
        own_words = own_words[np.argsort(known[own_words])]
        without = sorted({place[i] for i in ids[k] if i in place})
        found = model.nearest([(known[own_words], count[own_words])], [np.array(without, np.int64)])[0]
        if len(found[0]):
            x.append(model.evidence(found))
            truth.append(y[k])
    model.coefficients = _calibrate(np.array(x).reshape(-1, 4), np.array(truth, float), prior)
    return model, vectors


class Judge:
    """Judges documents by a fitted model, remembering what it said of equal vectors."""

    def __init__(self, model: NearestExamples, n_evidence: int):
        self.model, self.n_evidence, self.known = model, n_evidence, {}

    def __call__(self, ids: list, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """(score, nearest examples, telling words) of each document."""
        own = [self.model.own.get(i) for i in ids]
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        keys = [(o, xxhash.xxh3_128_digest(terms[a:b].tobytes() + counts[a:b].tobytes())) for o, (a, b) in zip(own, spans, strict=True)]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [k for k in {key: k for k, key in enumerate(keys)}.values() if keys[k] not in self.known]
        for lo in range(0, len(new), TOGETHER):
            some = new[lo : lo + TOGETHER]
            documents = [(terms[a:b], counts[a:b]) for a, b in (spans[k] for k in some)]
            without = [None if own[k] is None else np.array([own[k]]) for k in some]
            for k, document, found in zip(some, documents, self.model.nearest(documents, without), strict=True):
                self.known[keys[k]] = self._say(document, found)
        return [self.known[key] for key in keys]

    def _say(self, document, found):
        model, n = self.model, self.n_evidence
        near = [{"doc_id": int(model.index.ids[i]), "cosine": float(c), "toxic": int(model.labels[i])} for i, c in zip(found[0][:n], found[1][:n], strict=True)]
        terms, counts = document
        weight = (1 + np.log(counts)) * model.weights[terms] if n else np.zeros(0)
        best = terms[np.argsort(-weight, kind="stable")[:n]] if n else []
        return model.score(found), near, [model.vocabulary[int(t)].as_py() for t in best]


SCORED = "doc_id long, score double, predicted int, neighbours array<struct<doc_id:long,cosine:double,toxic:int>>, words array<string>"


def _judge(model: NearestExamples, n_evidence: int):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        judge = Judge(model, n_evidence)
        for batch in batches:
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            said = judge(batch.column("doc_id").to_pylist(), offsets, lists.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy())
            scores, near, words = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(near, kind),
                    pa.array(words, pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "predicted", "neighbours", "words"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, n_evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, neighbours, words): one row for each row of docs.

    neighbours: the n_evidence nearest examples with cosine and label (ties by
    id); words: the document's words with the largest weights.  A null, empty or
    wordless text, and any text without a word of the examples, has no neighbours
    and gets the share of toxic documents among the labelled ones.  Rows that
    repeat an id are judged each by its own text.  Other columns of docs don't
    matter; an empty table gives no rows.
    """
    model, vectors = fit_and_vectors(docs, labels)
    return vectors.mapInArrow(_judge(model, n_evidence), SCORED)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        "predicted",
        F.get("neighbours", F.lit(0))["doc_id"].alias("nearest_id"),
        F.get("neighbours", F.lit(0))["cosine"].alias("nearest_cosine"),
        F.array_join("words", " ").alias("words"),
    )


def _clean_rows(model: NearestExamples):
    """The rows of a batch whose whole texts are not predicted to be toxic."""

    def run(batches):
        judge = Judge(model, 0)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in groups(texts, GROUP_BYTES):
                text, word, count = count_words(texts.slice(lo, hi - lo), model.vocabulary)
                said = judge(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), np.searchsorted(text, np.arange(hi - lo + 1)), word, count)
                yield batch.slice(lo, hi - lo).filter(pa.array([s < 0.5 for s, _, _ in said], pa.bool_()))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted to be toxic; each row is judged by its own text, where it lies.

    All columns stay as they are, whatever their names.  A null or wordless text
    is kept unless most labelled documents are toxic; a null id or a repeated one
    changes nothing; an empty table stays empty.
    """
    model, _ = fit_and_vectors(docs, read_table(spark, sf_dir, "labels"))
    return docs.mapInArrow(_clean_rows(model), docs.schema)
