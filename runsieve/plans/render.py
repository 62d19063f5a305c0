"""Reports from small, already ordered results; rounding happens here and nowhere before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import VERDICTS

MARKER = "<!-- runsieve-report -->"


def report_order(detections: DataFrame, name: str = "test_id") -> DataFrame:
    """Regressions first, then by falling rate and name."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    return detections.orderBy(rank, F.desc("flake_rate"), name)


def as_json(detections: DataFrame, causes: DataFrame | None = None, name: str = "test_id") -> str:
    rows = detections if causes is None else detections.join(causes.select("test_id", "cause", "confidence"), "test_id", "left")
    records = [r.asDict(True) for r in report_order(rows, name).collect()]
    for r in records:
        for key in ("flake_rate", "divergence_rate", "intermittency_rate"):
            r[key] = round(r[key], 4)
    summary = {v: sum(r["verdict"] == v for r in records) for v in VERDICTS} | {"total": len(records)}
    return json.dumps({"schema_version": 1, "summary": summary, "detections": records}, indent=2, default=str, sort_keys=True)


def write_json(detections: DataFrame, path: str, causes: DataFrame | None = None, name: str = "test_id") -> None:
    """The same records for any number of tests: JSON lines in parts, in report order, written where the rows lie."""
    rows = detections if causes is None else detections.join(causes.select("test_id", "cause", F.col("confidence").alias("cause_confidence")), "test_id", "left")
    rates = {c: F.round(c, 4) for c in ("flake_rate", "divergence_rate", "intermittency_rate")}
    ordered = report_order(rows.withColumns(rates), name)
    ordered.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def _signal(s) -> str:
    data = s.asDict()
    more = [f"at {data['commit_sha'][:12]}"] if data.get("commit_sha") else []
    more += [f"attempts {', '.join(map(str, data['attempts']))}"] if data.get("attempts") else []
    return f"{data['signal']} ({', '.join([str(data['observations']), *more])})"


def as_markdown(detections: DataFrame, rows: int = 10, name: str = "test_id", causes: DataFrame | None = None) -> str:
    """A comment: what was found, a table of the first rows, their evidence, and how many were left out."""
    from ..operators.metrics import verdict_counts

    found = detections if causes is None else detections.join(causes.select("test_id", "cause"), "test_id", "left")
    found = found if "cause" in found.columns else found.withColumn("cause", F.lit(None).cast("string"))
    found = found if "merged_uncertain" in found.columns else found.withColumn("merged_uncertain", F.lit(False))
    found = found.persist()  # one detection run for the counts and the rows
    counts = verdict_counts(found).first()
    n = counts["total"] - counts["healthy"]
    top = report_order(found.filter("verdict <> 'healthy'"), name).limit(rows).collect()
    found.unpersist()
    said = [f"{counts[v]} {v.replace('_', ' ')}" for v in VERDICTS if v != "healthy" and counts[v]]
    lines = [MARKER, "## Test stability", "", f"{n} of {counts['total']} tests need a look" + (f": {', '.join(said)}." if said else "."), ""]
    if top:
        lines += ["| test | verdict | confidence | flake rate | observations | cause |", "|---|---|---|---|---|---|"]
        clean = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
        mark = lambda r: " (merged)" if r["merged_uncertain"] else ""
        lines += [f"| `{clean(r[name])}`{mark(r)} | {r['verdict']} | {r['confidence']} | {r['flake_rate']:.1%} | {r['observations']} | {r['cause'] or '-'} |" for r in top]
        lines += ["", "<details><summary>Evidence</summary>", ""]
        lines += [f"- `{clean(r[name])}`: " + (", ".join(map(_signal, r["signals"])) or r["verdict"]) for r in top]
        lines += ["", "</details>"]
        if any(r["merged_uncertain"] for r in top):
            lines += ["", "(merged): the past was joined over a guessed rename and may be that of two tests."]
    if n > len(top):
        lines += ["", f"{n - len(top)} further tests are not shown."]
    return "\n".join(lines) + "\n"


def as_table(detections: DataFrame, healthy: bool = False, name: str = "test_id", rows: int = 500) -> str:
    """The first rows in report order; how many were left out, if any."""
    shown = report_order(detections if healthy else detections.filter("verdict <> 'healthy'"), name).limit(rows + 1).collect()
    cells = [("verdict", "test", "rate", "obs")] + [(r["verdict"], str(r[name]), f"{r['flake_rate']:.1%}", str(r["observations"])) for r in shown[:rows]]
    width = [max(len(c[k]) for c in cells) for k in range(4)]
    lines = ["  ".join(c[k].ljust(width[k]) for k in range(4)).rstrip() for c in cells]
    return "\n".join([*lines, *([f"only the first {rows} are shown"] if len(shown) > rows else [])]) + "\n"


def as_quarantines(listed: DataFrame, rows: int = 500) -> str:
    """Open quarantines by expiry, with a mark on those that end soon."""
    lines = []
    for r in listed.limit(rows).collect():
        own = f"[{r['parameters']}]" if r["parameters"] else ""
        lines.append(f"{r['expires_at']}  {r['suite_path']}::{r['test_name']}{own}  {r['state']}" + ("  (ends soon)" if r["expiring"] else ""))
    return "\n".join(lines or ["no open quarantines"]) + "\n"


def as_prometheus(totals: DataFrame, by_cause: DataFrame | None = None, prefix: str = "runsieve") -> str:
    """Text exposition of one row of totals, and of counts by cause."""
    row = totals.first().asDict()
    lines = [x for k in sorted(row) for x in (f"# TYPE {prefix}_{k} gauge", f"{prefix}_{k} {float(row[k] or 0):g}")]
    if by_cause is not None:
        lines.append(f"# TYPE {prefix}_causes gauge")
        lines += [f'{prefix}_causes{{cause="{r["cause"]}"}} {r["n"]:g}' for r in by_cause.orderBy(F.desc("n"), "cause").collect()]
    return "\n".join(lines) + "\n"


def as_scores(scores: DataFrame, totals: DataFrame, rows: DataFrame | None = None, other: DataFrame | None = None, run: DataFrame | None = None, misses: int = 50) -> str:
    """Markdown of an evaluation: totals, classes, and as far as given the confusion and misses of rows
    (id, truth, predicted), classes with a better recall than in `other`, and what a run took."""
    from ..operators.metrics import confusion, where_better

    t = totals.first().asDict()
    shares = ("accuracy", "abstention_rate", "accuracy_when_answering", "dangerous_error_rate", "adversarial_accuracy")
    lines = ["| measure | value |", "|---|---|", *[f"| {k.replace('_', ' ')} | {t[k]:.1%} |" for k in shares], ""]
    lines += ["| cause | support | precision | recall | F1 |", "|---|---|---|---|---|"]
    lines += [f"| {r['class']} | {r['support']} | {r['precision']:.0%} | {r['recall']:.0%} | {r['f1']:.3f} |" for r in scores.orderBy("class").collect()]
    if rows is not None:
        short = lambda c: text.initialism(F.col(c)).alias(f"{c}_short")
        met = confusion(rows).select("truth", short("predicted"), "predicted", "n").orderBy("truth", "predicted").collect()  # classes by classes
        lines += ["", "| truth | predicted as |", "|---|---|"]
        lines += [f"| {c} | {', '.join(f'{r['predicted_short']} {r['n']}' for r in met if r['truth'] == c)} |" for c in sorted({r["truth"] for r in met})]
        wrong = rows.filter("truth <> predicted").orderBy("id").limit(misses).collect()
        lines += ["", *[f"- {r['id']}: {r['truth']}, predicted {r['predicted']}" for r in wrong]]
    if other is not None:
        better = where_better(scores, other).orderBy("class").collect()
        lines += ["", *[f"- better than the other at {r['class']}: {r['recall_a']:.0%} over {r['recall_b']:.0%}" for r in better]]
    if run is not None:
        took = run.first().asDict()
        lines += ["", "| run | value |", "|---|---|", *[f"| {k.replace('_', ' ')} | {v:g} |" for k, v in took.items()]]
    return "\n".join(lines) + "\n"
