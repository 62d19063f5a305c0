"""Operator 2: quality classifier as a sparse rule ensemble.

Small trees are boosted on text statistics of a bounded labelled sample; every
tree path becomes a conjunctive rule; lasso logistic regression keeps few rules
and gives their weights.  The rules are then compiled into one Spark column
expression, so that scoring the corpus runs inside generated JVM code and only
the statistics of the sample ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Labelled rows used for fitting, at most (their statistics, not their texts).
SAMPLE_ROWS = 8192
N_TREES, DEPTH, MIN_LEAF, SHRINK = 60, 3, 5, 0.3
MAX_RULES = 48
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)

STATS = (
    "n_words", "word_chars", "distinct_share", "distinct_power", "pipes", "bangs", "marks", "capitals", "digits", "punctuation", "line_words", "distinct_lines"
)


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the statistics of each whole text; a null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns(
        {
            "_n": F.length(t).cast("double"),
            "_w": F.split(F.btrim(t, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"),
            "_s": F.regexp_replace(t, r"[^!|$%&*#]+", ""),
            "_u": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("double"),
            "_g": F.length(F.regexp_replace(t, r"[^0-9]+", "")).cast("double"),
            "_p": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")).cast("double"),
            "_l": F.split(t, "\n"),
        }
    )
    df = df.withColumns(
        {
            "_k": F.size("_w").cast("double"),
            "_d": F.size(F.array_distinct("_w")).cast("double"),
            "_pipes": F.length(F.regexp_replace("_s", r"[^|]+", "")).cast("double"),
            "_bangs": F.length(F.regexp_replace("_s", r"[^!]+", "")).cast("double"),
            "_all": F.length("_s").cast("double"),
        }
    )
    k = F.col("_k")
    df = df.withColumns(
        {
            "n_words": k,
            "word_chars": F.col("_n") / k,
            "distinct_share": F.col("_d") / k,
            "distinct_power": F.ln(F.col("_d") + 1) / F.ln(k + 1),
            "pipes": F.col("_pipes") / k,
            "bangs": F.col("_bangs") / k,
            "marks": (F.col("_all") - F.col("_pipes") - F.col("_bangs")) / k,
            "capitals": F.col("_u") / F.greatest(F.col("_n"), F.lit(1.0)),
            "digits": F.col("_g") / F.greatest(F.col("_n"), F.lit(1.0)),
            "punctuation": F.col("_p") / F.greatest(F.col("_n"), F.lit(1.0)),
            "line_words": k / F.size("_l"),
            "distinct_lines": F.size(F.array_distinct("_l")) / F.size("_l"),
        }
    )
    return df.drop("_n", "_w", "_s", "_u", "_k", "_d", "_pipes", "_bangs", "_all", "_g", "_p", "_l")


@dataclass(frozen=True)
class RuleEnsemble:
    """bias + sum of the weights of the rules that hold, as log-odds.

    A rule is a tuple of (statistic, threshold, above): above is `>`, else `<=`.
    """

    bias: float = 0.0
    rules: tuple = field(default_factory=tuple)

    def log_odds(self) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, threshold, above in conditions:
                c = F.col(name)
                holds = holds & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds()))

    def describe(self) -> list[str]:
        sign = {True: ">", False: "<="}
        return [f"{w:+.3f} if " + " and ".join(f"{n} {sign[a]} {t:.4g}" for n, t, a in c) for c, w in self.rules]


def _grow(x, edges, grad, hess, rows, depth, path, out, rng):
    """One regression tree on gradients by exact search over threshold bins.

    out gets (path, rows of the leaf, value) of leaves and the path of every node.
    """
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        out["paths"].append(tuple(path))
    best = (1e-6, None)
    if depth and len(rows) >= 2 * MIN_LEAF:
        for f in rng.choice(x.shape[1], size=max(2, x.shape[1] * 2 // 3), replace=False):
            bins = x[rows, f]
            n = len(edges[f]) + 1
            gs, hs = np.bincount(bins, grad[rows], n).cumsum(), np.bincount(bins, hess[rows], n).cumsum()
            cs = np.bincount(bins, minlength=n).cumsum()
            ok = (cs >= MIN_LEAF) & (cs <= len(rows) - MIN_LEAF)
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
            gain[~ok] = -1
            at = int(gain[:-1].argmax()) if n > 1 else 0
            if n > 1 and gain[at] > best[0]:
                best = (gain[at], (int(f), at))
    if best[1] is None:
        out["leaves"].append((rows, -g / (h + 1)))
        return
    f, at = best[1]
    low = x[rows, f] <= at
    for side, above in ((low, False), (~low, True)):
        _grow(x, edges, grad, hess, rows[side], depth - 1, [*path, (f, at, above)], out, rng)


def _lasso(r, y, penalty, steps=600):
    """Logistic regression with an L1 penalty and a free bias, by FISTA."""
    n, k = r.shape
    lip = 0.25 * max(1.0, np.linalg.eigvalsh(r.T @ r / n)[-1] + 1) if k else 1.0
    w = z = np.zeros(k)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = zb = float(np.log(p0 / (1 - p0)))
    t = 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ z + zb))) - y
        w1 = z - (r.T @ e / n) / lip
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - penalty / lip, 0)
        b1 = zb - e.mean() / lip
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit_rules(stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> RuleEnsemble:
    """Fit on a (rows, STATS) array and 0/1 labels; few rows or one class give a bare prior."""
    n = len(labels)
    prior = (labels.sum() + 1.0) / (n + 2.0)
    if n < 4 * MIN_LEAF or labels.min() == labels.max():
        return RuleEnsemble(float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(stats.shape[1])]
    x = np.stack([np.searchsorted(e, stats[:, f], side="left") for f, e in enumerate(edges)], 1)
    rng, out, y = np.random.default_rng(seed), {"paths": [], "leaves": []}, labels.astype(float)
    f_hat = np.full(n, np.log(prior / (1 - prior)))
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-f_hat))
        rows = rng.permutation(n)[: max(4 * MIN_LEAF, n // 2)]
        tree = {"paths": [], "leaves": []}
        _grow(x, edges, p - y, p * (1 - p), rows, DEPTH, [], tree, rng)
        out["paths"] += tree["paths"]
        # Residuals of all rows move by the mean response of the leaf they fall in.
        delta = np.zeros(n)
        for (leaf_rows, value), path in zip(tree["leaves"], _leaf_paths(tree["paths"], len(tree["leaves"])), strict=True):
            delta[_holds(x, path) if path else np.ones(n, bool)] = value
            del leaf_rows
        f_hat += SHRINK * delta
    rules = list(dict.fromkeys(tuple(sorted(_tight(p))) for p in out["paths"]))
    r = np.stack([_holds(x, p) for p in rules], 1).astype(float) if rules else np.zeros((n, 0))
    keep = [j for j in range(r.shape[1]) if MIN_LEAF <= r[:, j].sum() <= n - MIN_LEAF]
    rules, r = [rules[j] for j in keep], r[:, keep]
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold on the same rows
    rules, r = [rules[j] for j in sorted(first)], r[:, sorted(first)]
    test = rng.permutation(n) % 4 == 0
    loss = []
    for pen in PENALTIES:
        w, b = _lasso(r[~test], y[~test], pen)
        p = np.clip(1 / (1 + np.exp(-(r[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss.append(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))
    best = min(loss)
    pen = next(p for p, v in zip(PENALTIES, loss, strict=True) if v <= best * 1.02 + 1e-4)
    w, b = _lasso(r, y, pen)
    top = [j for j in np.argsort(-np.abs(w))[:MAX_RULES] if abs(w[j]) > 1e-6]
    if len(top) < (np.abs(w) > 1e-6).sum():
        w_top, b = _lasso(r[:, top], y, pen)
    else:
        w_top = w[top]
    name = lambda f, at, above: (STATS[f], float(edges[f][at]), above)
    return RuleEnsemble(
        float(b), tuple((tuple(name(*c) for c in rules[j]), float(v)) for j, v in zip(top, w_top, strict=True) if v)
    )


def _leaf_paths(paths, n_leaves):
    """Of the paths of all nodes, in the order of growth, those of the leaves."""
    inner = {p[:-1] for p in paths}
    return [p for p in paths if p not in inner] or [()] * n_leaves


def _holds(x, path):
    ok = np.ones(len(x), bool)
    for f, at, above in path:
        ok &= (x[:, f] > at) if above else (x[:, f] <= at)
    return ok


def _tight(path):
    """A path without conditions that another one on the same statistic implies."""
    best: dict = {}
    for f, at, above in path:
        key = (f, above)
        best[key] = at if key not in best else (max if above else min)(best[key], at)
    return [(f, at, above) for (f, above), at in best.items()]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from at most sample_rows labelled rows outside the held-out third.

    The sample is the labels with the smallest seeded hashes; a document with
    several labels counts with the lowest, an id with several texts with that of
    the least statistics.  Labels that are null, or of ids that docs lacks, are
    left out.
    """
    own = labels.filter(~held_out() & F.col("quality").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("_y"))
    own = own.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most sample_rows rows
    rows = with_stats(rows).groupBy("doc_id").agg(F.min(F.struct("_y", *STATS)).alias("s")).select("s.*").collect()
    data = np.array([[float(v) for v in r] for r in rows]).reshape(len(rows), 1 + len(STATS))
    data = data[np.lexsort(data.T)]  # the same fit whatever the order of arrival
    return fit_rules(data[:, 1:], data[:, 0])


def _scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with its columns renamed in_0, in_1, ... and _score.

    _score is bound to the row's number, which keeps filters on it above this
    projection: pushed below, they would compute the statistics anew for each rule.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    return with_stats(named, f"in_{docs.columns.index('text')}").withColumn(
        "_score", F.when(F.monotonically_increasing_id() >= 0, model.score())
    )


def _own(docs: DataFrame, leave_out: tuple = ()) -> list[Column]:
    return [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in leave_out]


def score_quality(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5), which replace columns of those names.

    One row for each row of docs; a null or empty text gets the score of an empty text.
    """
    return _scored(docs, model).select(
        *_own(docs, ("score", "predicted")),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, each row by its own text.

    All columns stay as they are, whatever their names; a null text counts as
    empty; null or repeated ids change nothing; an empty table stays empty.
    """
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return _scored(docs, model).filter("_score >= 0.5").select(*_own(docs))
