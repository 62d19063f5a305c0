"""From executions to verdicts, one shuffle by test.

executions has execution_id, test_id, outcome, commit_sha, branch, attempt,
shard, started_at, rerun, failure_type, failure_message, stack_trace, test_file;
what is missing counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Detect
from ..functions import text
from ..functions.series import changes, ewma

_OPTIONAL = {
    "branch": "string",
    "attempt": "int",
    "shard": "string",
    "rerun": "boolean",
    "failure_type": "string",
    "failure_message": "string",
    "stack_trace": "string",
    "test_file": "string",
}


def complete(executions: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in executions.columns}
    return executions.withColumns(missing) if missing else executions


def is_failure(outcome: Column) -> Column:
    return outcome.isin("fail", "error")


def is_infra(config: Detect = Detect()) -> Column:
    """An error that names a platform failure; never a plain failure."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("failure_type", "failure_message", "stack_trace")]
    said = F.lower(F.concat_ws(" ", *parts))
    return F.coalesce((F.col("outcome") == "error") & text.any_of(said, [p.lower() for p in config.infra_error_patterns]), F.lit(False))


def recent(executions: DataFrame, n: int = 50) -> DataFrame:
    """Each test's n newest executions, whatever their outcome."""
    newest = Window.partitionBy("test_id").orderBy(F.desc("started_at"), F.desc("execution_id"))
    return executions.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def commit_windows(executions: DataFrame, config: Detect = Detect()) -> DataFrame:
    """One row per test and commit; rows of platform failures are counted and otherwise left out.

    A window's branch is that of its newest row; its failure and first
    observation are the oldest ones.
    """
    rows = complete(executions).withColumn("infra", is_infra(config))
    kept, outcome = ~F.col("infra"), F.col("outcome")
    fails, passes = kept & is_failure(outcome), kept & (outcome == "pass")
    seen = kept & (outcome != "skip")
    at = F.struct("started_at", "execution_id")
    out = rows.groupBy("test_id", "commit_sha").agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if("infra").alias("n_infra"),
        F.count_if(kept & (outcome == "skip")).alias("n_skipped"),
        F.count_if(seen).alias("n_observed"),
        F.count_if(passes).alias("n_pass"),
        F.count_if(fails).alias("n_fail"),
        F.min(F.when(kept, F.col("started_at"))).alias("started_at"),
        F.max_by(F.coalesce("branch", F.lit("")), F.when(kept, at)).alias("branch"),
        F.coalesce(F.bool_or(kept & F.coalesce("rerun", F.lit(False))), F.lit(False)).alias("rerun"),
        F.array_sort(F.collect_set(F.when(kept, F.col("attempt")))).alias("attempts"),
        F.array_sort(F.collect_set(F.when(passes, F.col("attempt")))).alias("pass_attempts"),
        F.array_sort(F.collect_set(F.when(fails, F.col("attempt")))).alias("fail_attempts"),
        F.array_sort(F.collect_set(F.when(fails & (F.col("shard") != ""), F.col("shard")))).alias("failing_shards"),
        F.min_by(F.struct("outcome", "failure_type", "failure_message", "stack_trace", "test_file"), F.when(fails, at)).alias("failure"),
        F.min_by("outcome", F.when(seen, at)).alias("first_outcome"),
        F.max_by("test_file", at).alias("test_file"),
    )
    diverged = ((F.col("n_pass") > 0) & (F.col("n_fail") > 0)) | F.col("rerun")
    out = out.withColumn("diverged", diverged)
    apart = (F.size(F.array_except("pass_attempts", "fail_attempts")) > 0) | (
        F.size(F.array_except("fail_attempts", "pass_attempts")) > 0
    )
    return out.withColumns(
        {
            "cross_attempt": F.col("diverged")
            & (F.size("attempts") >= 2)
            & (F.size("pass_attempts") > 0)
            & (F.size("fail_attempts") > 0)
            & apart,
            "status": F.when(F.col("diverged"), "diverged")
            .when(F.col("n_observed") == 0, "no_data")
            .when(F.col("n_fail") > 0, "failed")
            .otherwise("passed"),
        }
    )


_WINDOW = (
    "started_at",
    "commit_sha",
    "branch",
    "n_observed",
    "n_fail",
    "attempts",
    "failing_shards",
    "failure",
    "first_outcome",
    "diverged",
    "cross_attempt",
    "status",
    "test_file",
)


def histories(windows: DataFrame) -> DataFrame:
    """One row per test: its windows in order of time, and its counters."""
    some = F.col("n_kept") > 0
    out = windows.groupBy("test_id").agg(
        F.array_sort(F.collect_list(F.when(some, F.struct(*_WINDOW)))).alias("w"),
        F.sum("n_observed").alias("observations"),
        F.sum("n_infra").alias("infra_excluded"),
        F.sum("n_skipped").alias("skipped"),
    )
    return out.withColumns(
        {
            "windows": F.size("w").cast("long"),
            "latest": F.try_element_at("w", F.lit(-1)),
            "measured": F.filter("w", lambda w: w["status"] != "no_data"),
            "retry_data": F.exists("w", lambda w: w["n_observed"] >= 2),
        }
    )


def with_rates(history: DataFrame, config: Detect = Detect()) -> DataFrame:
    """Flake rate: smoothed divergence where commits ran twice, else smoothed flips between commits."""
    status = F.transform("measured", lambda w: w["status"])
    hits = F.transform("measured", lambda w: F.when(w["diverged"], 1.0).otherwise(0.0))
    out = history.withColumns(
        {
            "divergence_rate": ewma(hits, config.ewma_alpha),
            "intermittency_rate": ewma(changes(status, "diverged"), config.ewma_alpha),
        }
    )
    return out.withColumn("flake_rate", F.when(F.col("retry_data"), F.col("divergence_rate")).otherwise(F.col("intermittency_rate")))


def with_regression(history: DataFrame, config: Detect = Detect()) -> DataFrame:
    """Trailing failures right after passes, in a history without divergence.

    The statuses are read as a word of P, F and D, which a pattern takes apart.
    """
    word = F.array_join(F.transform("measured", lambda w: F.upper(F.left(w["status"], F.lit(1)))), "")
    out = history.withColumn("word", word)
    out = out.withColumns(
        {
            "pass_streak": F.length(F.regexp_extract("word", "(P*)(F+)$", 1)),
            "fail_streak": F.length(F.regexp_extract("word", "(F+)$", 1)),
        }
    )
    found = (
        ~F.contains("word", F.lit("D"))
        & (F.col("fail_streak") >= config.regression_fail_streak)
        & (F.col("pass_streak") >= config.regression_pass_streak)
    )
    pivot = F.get("measured", F.size("measured") - F.col("fail_streak"))["commit_sha"]
    return out.withColumn("regression", found).withColumn("regression_sha", F.when(F.col("regression"), pivot))


def with_verdict(history: DataFrame, config: Detect = Detect(), diffs: DataFrame | None = None) -> DataFrame:
    """Signals, verdict and confidence; diffs: (commit_sha, paths array<string>) of changes, if known."""
    failures = F.filter("w", lambda w: w["n_fail"] > 0)
    out = history.withColumn("failure", F.try_element_at(failures, F.lit(-1))["failure"])
    out = out.withColumn(
        "footprint",
        text.footprint(F.coalesce("failure.test_file", "latest.test_file"), F.col("failure.stack_trace"), F.col("failure.failure_message")),
    )
    if diffs is None:
        out = out.withColumn("diff_paths", F.array().cast("array<string>"))
    else:
        paths = diffs.select(F.col("commit_sha").alias("_sha"), F.col("paths").alias("diff_paths"))
        out = out.join(paths, out["latest.commit_sha"] == paths["_sha"], "left").drop("_sha")
        out = out.withColumn("diff_paths", F.coalesce("diff_paths", F.array().cast("array<string>")))
    apart, across = F.filter("w", lambda w: w["diverged"]), F.filter("w", lambda w: w["cross_attempt"])
    on_main = F.filter("w", lambda w: (w["branch"] == config.main_branch) & (w["status"] == "passed"))
    failing = F.coalesce(F.col("latest.n_fail") > 0, F.lit(False))
    elsewhere = (
        ~F.col("regression")
        & failing
        & ~F.col("latest.branch").isin(config.main_branch, "")
        & (F.size("diff_paths") > 0)
        & (F.size("footprint") > 0)
        & ~text.touches(F.col("diff_paths"), F.col("footprint"))
        & (F.size(on_main) > 0)
    )
    unstable = (
        ~F.col("regression")
        & (F.col("observations") >= config.min_observations)
        & (F.col("flake_rate") > config.flake_rate_threshold)
    )
    total = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + w["n_observed"])

    newest = lambda ws: F.try_element_at(ws, F.lit(-1))

    def signal(when, name, n, sha=None, attempts=None):
        sha = F.lit(None).cast("string") if sha is None else sha
        attempts = F.array().cast("array<int>") if attempts is None else attempts
        return F.when(when, F.struct(F.lit(name).alias("signal"), n.cast("long").alias("observations"), sha.alias("commit_sha"), attempts.alias("attempts")))

    out = out.withColumns({"n_diverged": F.size(apart), "branch_signal": F.coalesce(elsewhere, F.lit(False)), "instability": unstable})
    out = out.withColumn(
        "signals",
        F.array_compact(
            F.array(
                signal(F.size(apart) > 0, "same_sha_divergence", total(apart), newest(apart)["commit_sha"]),
                signal(F.size(across) > 0, "cross_attempt_divergence", total(across), newest(across)["commit_sha"], newest(across)["attempts"].cast("array<int>")),
                signal(F.col("branch_signal"), "branch_independent", F.size(on_main)),
                signal(F.col("instability"), "historical_instability", F.col("observations")),
            )
        ),
    )
    weak = F.col("branch_signal") | F.col("instability")
    enough = F.col("observations") >= config.min_observations
    verdict = (
        F.when(F.col("n_diverged") > 0, "flaky")
        .when(F.col("regression"), "regression")
        .when(~failing, "healthy")
        .when(weak, "flaky")
        .when(F.col("windows") <= 1, "new_failure")
        .otherwise("persistent_failure")
    )
    steady = F.col("retry_data") & (F.col("observations") >= 2 * config.min_observations)
    confidence = (
        F.when(F.col("n_diverged") >= 2, "high")
        .when(F.col("n_diverged") == 1, "medium")
        .when(F.col("regression"), F.when(F.col("pass_streak") >= 2 * config.regression_pass_streak, "high").otherwise("medium"))
        .when(~failing, "high")
        .when(F.col("instability") & steady, "medium")
        .when(weak | (F.col("windows") <= 1), "low")
        .otherwise(F.when(enough, "medium").otherwise("low"))
    )
    return out.withColumns(
        {
            "verdict": verdict,
            "confidence": confidence,
            "latest_sha": F.col("latest.commit_sha"),
            "latest_outcome": F.when(failing, F.col("failure.outcome")).otherwise(F.col("latest.first_outcome")),
            "failing_shards": F.coalesce("latest.failing_shards", F.array().cast("array<string>")),
            "failure_type": F.col("failure.failure_type"),
            "failure_message": F.col("failure.failure_message"),
            "stack_trace": F.col("failure.stack_trace"),
        }
    )


DETECTION = (
    "test_id",
    "verdict",
    "confidence",
    "signals",
    "flake_rate",
    "divergence_rate",
    "intermittency_rate",
    "retry_data",
    "observations",
    "windows",
    "infra_excluded",
    "skipped",
    "latest_outcome",
    "latest_sha",
    "regression_sha",
    "failure_type",
    "failure_message",
    "stack_trace",
    "footprint",
    "failing_shards",
)


def detect(
    executions: DataFrame,
    config: Detect = Detect(),
    since=None,
    groups: DataFrame | None = None,
    diffs: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """A verdict for every logical test.

    groups: (test_id, group_id, uncertain) of tests that are one; only: test_ids
    to look at.  The newest rows are taken first, then those before `since` go,
    then platform failures: skips and platform failures use up the window.
    """
    rows = complete(executions)
    if groups is not None:
        rows = rows.join(groups, "test_id", "left").withColumn("test_id", F.coalesce("group_id", "test_id")).drop("group_id", "uncertain")
    if only is not None:
        keep = only.select("test_id").distinct()
        if groups is not None:
            keep = keep.join(groups, "test_id", "left").select(F.coalesce("group_id", "test_id").alias("test_id")).distinct()
        rows = rows.join(keep, "test_id", "left_semi")
    rows = recent(rows, config.window_executions)
    if since is not None:
        rows = rows.filter(F.col("started_at") >= since)
    out = with_verdict(with_regression(with_rates(histories(commit_windows(rows, config)), config), config), config, diffs)
    out = out.select(*DETECTION)
    if groups is None:
        return out.withColumn("merged_uncertain", F.lit(False))
    merged = groups.groupBy(F.col("group_id").alias("test_id")).agg(F.bool_or("uncertain").alias("merged_uncertain"))
    return out.join(merged, "test_id", "left").withColumn("merged_uncertain", F.coalesce("merged_uncertain", F.lit(False)))


def failing_at(executions: DataFrame, commit_sha: str) -> DataFrame:
    return executions.filter((F.col("commit_sha") == commit_sha) & is_failure(F.col("outcome"))).select("test_id").distinct()


def clean_runs(executions: DataFrame, n: int = 50) -> DataFrame:
    """(test_id, clean_runs): passes in a row from the newest of n observations; any error ends them."""
    seen = recent(executions.filter("outcome <> 'skip'"), n)
    flags = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rn"), (F.col("outcome") == "pass").alias("ok")))), lambda r: r["ok"]
    )
    out = seen.groupBy("test_id").agg(flags.alias("f"))
    at = F.array_position("f", F.lit(False))
    return out.select("test_id", F.when(at > 0, at - 1).otherwise(F.size("f")).cast("long").alias("clean_runs"))


def needs_cause(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("verdict").isin("flaky", "persistent_failure"))
