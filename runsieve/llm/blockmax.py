"""Exact top-k sums over inverted lists by block-max WAND, for cosine (BlockMaxIndex, operator 4) and BM25 (CountIndex, operator 5).

A query is a set of lists, each with a weight; a document's score is the sum of
weight * impact over the lists that hold it.  A query's lists are taken from the
longest to the shortest.  The pivot is the first at which the sum of the lists'
maxima reaches the floor (the k-th best score so far): no document can reach it
by the lists before the pivot alone.  Only the lists from the pivot on are read.
Those before it are not touched: the maxima of their blocks bound what they add,
and only documents whose sum with these maxima reaches the floor are scored in
full.  The first floor comes from a query's shortest lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Documents in a block; postings from which a first floor comes.
BLOCK_DOCS, SEED_POSTINGS = 4, 4_000
#: Lists with blocks, which may stand before the pivot: those with more than this share of the documents, up to so many.
LIST_SHARE, LISTS = 1 / 24, 256


class BlockMaxIndex:
    """Lists start[t] : start[t + 1] of postings (docs, ascending in a list; impact, above 0) over ids.

    digits: scores count to so many decimals, and equal ones rank by id.
    nobody: documents that are never answers.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, docs: np.ndarray, impact: np.ndarray, digits: int, nobody=()):
        self.ids, self.n, self.start, self.df, self.digits = ids, len(ids), start, np.diff(start), digits
        self.docs, self.impact = docs.astype(np.int64), impact
        self.maxima = np.maximum.reduceat(impact, start[:-1]) if len(impact) else np.zeros(len(self.df))
        listed = np.flatnonzero(self.df > self.n * LIST_SHARE)
        listed = listed[np.argsort(-self.df[listed], kind="stable")][:LISTS]
        #: Of each list its column in the table of those with blocks, or -1.
        self.column = np.full(len(self.df), -1)
        self.column[listed] = np.arange(len(listed))
        blocks = -(-self.n // BLOCK_DOCS)
        self.table = np.zeros((blocks * BLOCK_DOCS, len(listed)))
        for r, t in enumerate(listed):
            some = slice(start[t], start[t + 1])
            self.table[self.docs[some], r] = impact[some]
        tops = self.table.reshape(blocks, BLOCK_DOCS, len(listed)).max(1)
        self.tops = np.nextafter(tops.astype(np.float32), np.float32(np.inf))  # never below the maxima
        self.nobody = np.concatenate([np.asarray(nobody, np.int64), np.arange(self.n, len(self.table))])
        #: How many documents were scored in full, of how many.
        self.scored = self.asked = 0

    def __getstate__(self):
        return self.ids, self.start, self.docs.astype(np.int32), self.impact, self.digits, self.nobody[self.nobody < self.n]

    def __setstate__(self, state):
        self.__init__(*state)

    def _sum(self, lists: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """What lists add to each document."""
        starts, ends = self.start[lists].tolist(), self.start[lists + 1].tolist()
        if not starts:
            return np.zeros(len(self.table))
        docs = np.concatenate([self.docs[a:b] for a, b in zip(starts, ends, strict=True)])
        added = np.concatenate([self.impact[a:b] for a, b in zip(starts, ends, strict=True)])
        if weights is not None:
            added *= np.repeat(weights, self.df[lists])
        return np.bincount(docs, added, len(self.table))

    def _full(self, at: np.ndarray, part: np.ndarray, columns: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        rows = self.table[at][:, columns]
        return part[at] + (rows.sum(1) if weights is None else rows @ weights)

    def _floor(self, lists, weights, k: int, without) -> float:
        """A score that k documents reach: those best by the query's shortest lists, with the lists that have blocks."""
        if self.n < 4 * k:
            return 0.0
        short = np.flatnonzero(self.column[lists] < 0)
        short = short[np.argsort(self.df[lists[short]], kind="stable")]
        short = short[: np.searchsorted(np.cumsum(self.df[lists[short]]), SEED_POSTINGS) + 1]
        long = np.flatnonzero(self.column[lists] >= 0)
        some = lambda at: None if weights is None else weights[at]
        part = self._sum(lists[short], some(short))
        part[self.nobody] = -np.inf
        if without is not None:
            part[without] = -np.inf
        best = np.argpartition(-part, 4 * k - 1)[: 4 * k]
        score = self._full(best, part, self.column[lists[long]], some(long))
        return max(0.0, float(np.partition(score, 3 * k)[3 * k]))

    def top(self, queries: list, k: int, floors: list[float] | None = None, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best of each query, with scores above 0; ties by id.

        queries: (lists, weights) pairs with the longest lists first; weights of
        None are all 1.  floors: a score for each query below which nothing is
        wanted.  without: for each query, None or positions that are no answers.
        """
        slack = 10.0**-self.digits
        floors = [0.0] * len(queries) if floors is None else list(floors)
        parts, before = [], np.zeros((len(queries), self.tops.shape[1]), np.float32)
        for i, (lists, weights) in enumerate(queries):
            if floors[i] <= 0 and len(lists):
                floors[i] = self._floor(lists, weights, k, without and without[i]) - 2 * slack
            column = self.column[lists]
            blocked = np.flatnonzero(column >= 0)
            most = self.maxima[lists[blocked]] if weights is None else self.maxima[lists[blocked]] * weights[blocked]
            blocked = blocked[: np.searchsorted(np.cumsum(most), floors[i] * (1 - 1e-9) - slack)]
            before[i, column[blocked]] = 1 if weights is None else weights[blocked]
            rest = np.delete(np.arange(len(lists)), blocked)
            part = self._sum(lists[rest], None if weights is None else weights[rest])
            part[self.nobody] = -np.inf
            if without and without[i] is not None:
                part[without[i]] = -np.inf
            parts.append((part, column[blocked], None if weights is None else weights[blocked]))
        highest = before @ self.tops.T
        out = []
        for i, (part, columns, weights) in enumerate(parts):
            bound = (part.reshape(-1, BLOCK_DOCS) + highest[i][:, None]).ravel()
            floor = floors[i] - slack
            reach = np.flatnonzero((bound >= floor - 1e-5 * abs(floor)) & (bound > 0))
            if len(reach) > 4 * k:  # the most promising raise the floor
                best = reach[np.argpartition(-bound[reach], 4 * k - 1)[: 4 * k]]
                floor = max(floor, float(np.partition(self._full(best, part, columns, weights), 3 * k)[3 * k]) - slack)
                reach = reach[bound[reach] >= floor - 1e-5 * abs(floor)]
            self.scored, self.asked = self.scored + len(reach), self.asked + self.n
            score = np.round(self._full(reach, part, columns, weights), self.digits)
            reach, score = reach[score > 0], score[score > 0]
            best = np.lexsort((self.ids[reach], -score))[:k]
            out.append((reach[best], score[best]))
        return out


#: The same for CountIndex.  The share of a list's maximum that its blocks' maxima come to, in the search for a pivot.
PAIR, COUNT_SHARE, COUNT_LISTS, TIGHTER = 2, 1 / 48, 1024, 0.5
#: Maxima are used of lists whose postings read for each query asked would be more than this share of the documents.
WORTH = 1 / 480
#: What is copied at once: postings weighed, lists whose maxima are multiplied, documents scored in full.
WEIGHED, MULTIPLIED, FULL = 500_000, 128, 512


def _as_bytes(values: np.ndarray, start: np.ndarray) -> pa.LargeBinaryArray:
    values = np.ascontiguousarray(values)
    offsets = np.ascontiguousarray(start, np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _joined(lists: pa.LargeBinaryArray, which: pa.Array, kind) -> np.ndarray:
    _, offsets, data = lists.take(which).buffers()
    size = np.frombuffer(offsets, np.int64, len(which) + 1)[-1] if len(which) else 0
    return np.frombuffer(data, kind, size // np.dtype(kind).itemsize) if size else np.zeros(0, kind)


class CountIndex:
    """Block-max WAND for sums of weight * count / (count + norm[document]), over four times the lists of BlockMaxIndex.

    Large queries have most of their postings in lists of middling length, so
    these have blocks too, of PAIR documents, and a pivot lies where the blocks'
    maxima, not the lists', should reach the floor.  Wherever it lies, each
    document's bound is made of its block's maxima and what the lists read give
    it, so nothing is lost; a pivot too far back costs documents scored in full.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, docs: np.ndarray, tf: np.ndarray, norm: np.ndarray, weight: np.ndarray, digits: int, nobody=()):
        self.ids, self.n, self.df, self.digits = ids, len(ids), np.diff(start), digits
        self.weight = weight
        impact = np.empty(len(docs))
        ends = [0, *np.searchsorted(start, np.arange(WEIGHED, len(docs), WEIGHED)).tolist(), len(self.df)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):  # lists of about WEIGHED postings at once
            some = slice(start[a], start[b])
            part = np.take(norm, docs[some])
            part += tf[some]
            np.divide(tf[some], part, out=part)
            np.multiply(part, np.repeat(weight[a:b], self.df[a:b]), out=impact[some])
        self.impact = impact
        self.maxima = np.maximum.reduceat(impact, start[:-1]) if len(impact) else np.zeros(len(self.df))
        listed = np.flatnonzero((self.df > self.n * COUNT_SHARE) & (weight > 0))
        listed = listed[np.argsort(-self.df[listed], kind="stable")][:COUNT_LISTS]
        #: Of each list its row in the table of maxima, or -1.
        self.row, self.listed = np.full(len(self.df), -1), listed
        self.row[listed] = np.arange(len(listed))
        padded = -(-self.n // PAIR) * PAIR
        self.norm = np.concatenate([norm, np.ones(padded - self.n)])
        #: Each list's documents and impacts as one value of bytes: Arrow joins many short lists faster.
        self.postings_of, self.kind = [_as_bytes(a, start) for a in (docs, impact)], docs.dtype
        #: Counts of the lists with blocks in each document, and their blocks' maxima (never below them).
        self.counts = np.zeros((padded, len(listed)), np.min_scalar_type(int(tf.max()) if len(tf) else 0))
        self.tops = np.zeros((len(listed), padded // PAIR), np.float32)
        row = np.zeros(padded)
        for r, t in enumerate(listed.tolist()):
            some = slice(start[t], start[t + 1])
            row[:] = 0
            row[docs[some]] = impact[some]
            self.tops[r] = np.maximum(row[::PAIR], row[1::PAIR])
            np.nextafter(self.tops[r], np.float32(np.inf), out=self.tops[r], where=self.tops[r] > 0)
            self.counts[docs[some], r] = tf[some]
        self.nobody = np.concatenate([np.asarray(nobody, np.int64), np.arange(self.n, padded)])
        #: How many documents were scored in full, of how many; how many postings were read, of how many.
        self.scored = self.asked = self.read = self.postings = 0

    def _sum(self, lists: np.ndarray) -> np.ndarray:
        """What lists add to each document."""
        lists = pa.array(lists)
        docs, added = _joined(self.postings_of[0], lists, self.kind), _joined(self.postings_of[1], lists, np.float64)
        self.read += len(docs)
        part = np.bincount(docs, added, len(self.counts)).astype(float, copy=False)  # of nothing: whole numbers
        part[self.nobody] = -np.inf
        return part

    def _full(self, at: np.ndarray, part: np.ndarray, rows: np.ndarray) -> np.ndarray:
        weight, out = self.weight[self.listed[rows]], part[at]
        for lo in range(0, len(at), FULL):
            some = at[lo : lo + FULL]
            tf = self.counts[some][:, rows].astype(float)
            out[lo : lo + FULL] += (tf / (tf + self.norm[some][:, None])) @ weight
        return out

    def _floor(self, lists: np.ndarray, k: int) -> float:
        """A score that k documents reach: those best by the query's shortest lists, with the lists that have blocks."""
        if self.n < 4 * k:
            return 0.0
        short = lists[self.row[lists] < 0]
        short = short[np.argsort(self.df[short], kind="stable")]
        part = self._sum(short[: np.searchsorted(np.cumsum(self.df[short]), SEED_POSTINGS) + 1])
        best = np.argpartition(-part, 4 * k - 1)[: 4 * k]
        rows = self.row[lists]
        score = self._full(best, part, rows[rows >= 0])
        return max(0.0, float(np.partition(score, 3 * k)[3 * k]))

    def top(self, queries: list[np.ndarray], k: int, floors: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best of each query, with scores above 0; ties by id.

        queries: lists, the longest first.  floors: a score for each query below
        which nothing is wanted.
        """
        slack = 10.0**-self.digits
        floors = [0.0] * len(queries) if floors is None else list(floors)
        before, blocked = np.zeros((len(queries), len(self.listed)), np.float32), []
        for i, lists in enumerate(queries):
            if floors[i] <= 0 and len(lists):
                floors[i] = self._floor(lists, k) - 2 * slack
            rowed = np.flatnonzero(self.row[lists] >= 0)
            most = np.cumsum(self.maxima[lists[rowed]]) * TIGHTER
            blocked.append(rowed[: np.searchsorted(most, floors[i])])
            before[i, self.row[lists[blocked[i]]]] = 1
        # A list that few of these queries have is read after all: a product with its maxima would cost more.
        worth = before.sum(0) * self.df[self.listed] > len(queries) * self.n * WORTH
        highest, rows = np.zeros((len(queries), self.tops.shape[1]), np.float32), np.flatnonzero(worth)
        for lo in range(0, len(rows), MULTIPLIED):
            some = rows[lo : lo + MULTIPLIED]
            highest += before[:, some] @ self.tops[some]
        out = []
        for i, lists in enumerate(queries):
            some = blocked[i][worth[self.row[lists[blocked[i]]]]]
            rows, part = self.row[lists[some]], self._sum(np.delete(lists, some))
            bound = (part.reshape(-1, PAIR) + highest[i][:, None]).ravel()
            # Sums of up to COUNT_LISTS float32 err by less than 1e-4 of them.
            low = lambda floor: max(floor - slack - 1e-4 * abs(floor), 1e-300)
            floor, some = floors[i], 4 * k
            reach = np.flatnonzero(bound >= low(floor))
            while len(reach) > some:  # the most promising raise the floor
                best = reach[np.argpartition(-bound[reach], some - 1)[:some]]
                floor = max(floor, float(np.partition(self._full(best, part, rows), some - k)[some - k]))
                reach, some = reach[bound[reach] >= low(floor)], 8 * some
            self.scored, self.asked, self.postings = self.scored + len(reach), self.asked + self.n, self.postings + int(self.df[lists].sum())
            score = np.round(self._full(reach, part, rows), self.digits)
            reach, score = reach[score > 0], score[score > 0]
            best = np.lexsort((self.ids[reach], -score))[:k]
            out.append((reach[best], score[best]))
        return out
