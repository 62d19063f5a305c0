"""Verdicts against a plain loop, and the order rules by name."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from runsieve.config import Detect
from runsieve.operators import history

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "execution_id long, test_id string, outcome string, commit_sha string, branch string, attempt int, shard string, started_at timestamp_ntz, rerun boolean, failure_message string"


def rows_of(test, windows, branch="main", message=None, by="shard"):
    """windows: [(sha, outcomes)] from the oldest on, an hour apart."""
    out = []
    for h, (sha, outcomes) in enumerate(windows):
        for k, o in enumerate(outcomes):
            out.append((len(out), test, o, sha, branch, 1 + k if by == "attempt" else 1, f"s{k}", T0 + datetime.timedelta(hours=h, seconds=k), False, message))
    return out


def letters(word):
    names = {"P": "pass", "F": "fail", "S": "skip", "E": "error"}
    return [(f"c{k:02d}", [names[x] for x in w]) for k, w in enumerate(word.split())]


CASES = {
    "P PF": ("flaky", "medium"),
    "PF PF": ("flaky", "high"),
    "P P P F F": ("regression", "medium"),
    "P P P P P P F F": ("regression", "high"),
    "P F F": ("persistent_failure", "low"),
    "P P P F": ("persistent_failure", "low"),
    "F F P P P": ("healthy", "high"),
    "P P S P F F": ("regression", "medium"),
    "F": ("new_failure", "low"),
    "S F": ("persistent_failure", "low"),  # a window of skips counts as one
    "P F S": ("healthy", "high"),  # and hides a failure when it is the last
    "P P P F F S": ("regression", "medium"),  # but not a regression
    "P F P F P F P F P F P F P F": ("flaky", "low"),
    "F F F F F F F F F F F F": ("persistent_failure", "medium"),
}


def test_verdicts_by_pattern(spark):
    rows = [r for w in CASES for r in rows_of(w, letters(w))]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = {r["test_id"]: (r["verdict"], r["confidence"]) for r in history.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == CASES


def test_rate_of_a_divergence_at_the_end(spark):
    df = spark.createDataFrame(rows_of("t", letters("P P P P P P P P P PF")), SCHEMA)
    assert history.detect(df).first()["flake_rate"] == pytest.approx(0.3)


def test_order_of_cuts(spark):
    """Skips and platform failures use up the newest rows before anything is left out."""
    rows = rows_of("t", letters("F F F P S S"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert history.detect(df, Detect(window_executions=3)).first()["observations"] == 1
    late = T0 + datetime.timedelta(hours=3)
    assert history.detect(df, since=F.lit(late)).first()["observations"] == 1
    assert history.detect(df, since=F.lit(T0 + datetime.timedelta(days=9))).count() == 0


def test_infra_counts_for_nothing(spark):
    rows = rows_of("t", [("a", ["pass"])]) + [(9, "t", "error", "a", "main", 1, "s1", T0, False, "No space LEFT on device")]
    got = history.detect(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["verdict"], got["infra_excluded"], got["flake_rate"]) == ("healthy", 1, 0.0)
    rows[-1] = (*rows[-1][:2], "fail", *rows[-1][3:])  # a plain failure is never the platform's
    assert history.detect(spark.createDataFrame(rows, SCHEMA)).first()["verdict"] == "flaky"


def test_rerun_flag_diverges_with_one_row(spark):
    r = (0, "t", "pass", "a", "main", 1, "s", T0, True, None)
    got = history.detect(spark.createDataFrame([r], SCHEMA)).first()
    assert (got["verdict"], got["retry_data"], got["flake_rate"]) == ("flaky", False, 0.0)


def test_failure_is_the_oldest_of_the_newest_failing_commit(spark):
    rows = [(k, "t", "fail", "a", b, 1, "s", T0 + datetime.timedelta(hours=k), False, m) for k, (b, m) in enumerate([("main", "first"), ("side", "second")])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert history.detect(df).first()["failure_message"] == "first"
    assert history.commit_windows(df).first()["branch"] == "side"


def test_branch_signal(spark):
    rows = rows_of("t", [("a", ["pass"])]) + [(5, "t", "fail", "b", "side", 1, "s", T0 + datetime.timedelta(hours=5), False, 'File "src/x.py"')]
    df = spark.createDataFrame(rows, SCHEMA)
    other = spark.createDataFrame([("b", ["docs/y.md"])], "commit_sha string, paths array<string>")
    own = spark.createDataFrame([("b", ["a/src/x.py"])], "commit_sha string, paths array<string>")
    assert history.detect(df, diffs=other).first()["verdict"] == "flaky"
    assert history.detect(df, diffs=own).first()["verdict"] == "persistent_failure"
    assert history.detect(df).first()["verdict"] == "persistent_failure"


def test_merged_tests_are_one(spark):
    rows = rows_of("old", letters("P P P")) + rows_of("new", [("x", ["fail"])])
    groups = spark.createDataFrame([("old", "new", True), ("new", "new", True)], "test_id string, group_id string, uncertain boolean")
    got = history.detect(spark.createDataFrame(rows, SCHEMA), groups=groups).collect()
    assert [(r["test_id"], r["observations"], r["merged_uncertain"]) for r in got] == [("new", 4, True)]


def plain_verdict(windows, c=Detect()):
    """The rules as a loop over [(sha, outcomes)]."""
    st = []
    for _, o in windows:
        f, p = any(x in ("fail", "error") for x in o), "pass" in o
        n = [x for x in o if x != "skip"]
        st.append("D" if f and p else "N" if not n else "F" if f else "P")
    m = [s for s in st if s != "N"]
    obs = sum(x != "skip" for _, o in windows for x in o)
    retry = any(sum(x != "skip" for x in o) >= 2 for _, o in windows)

    def smooth(v):
        s = v[0] if v else 0.0
        for x in v[1:]:
            s = c.ewma_alpha * x + (1 - c.ewma_alpha) * s
        return s

    rate = smooth([float(s == "D") for s in m]) if retry else smooth([float(a != b or "D" in (a, b)) for a, b in zip(m, m[1:])])
    fails = passes = 0
    while fails < len(m) and m[-1 - fails] == "F":
        fails += 1
    while fails + passes < len(m) and m[-1 - fails - passes] == "P":
        passes += 1
    regress = "D" not in m and fails >= c.regression_fail_streak and passes >= c.regression_pass_streak
    failing = any(x in ("fail", "error") for x in windows[-1][1])
    if "D" in st:
        return "flaky", rate
    if regress:
        return "regression", rate
    if not failing:
        return "healthy", rate
    if obs >= c.min_observations and rate > c.flake_rate_threshold:
        return "flaky", rate
    return ("new_failure" if len(windows) <= 1 else "persistent_failure"), rate


def test_verdicts_of_random_histories(spark):
    rng, want, rows = random.Random(5), {}, []
    for k in range(300):
        bias = rng.choice([0.05, 0.5, 0.9])
        w = [(f"c{j:02d}", [rng.choices(["pass", "fail", "skip"], [1 - bias, bias, 0.1])[0] for _ in range(rng.choice([1, 1, 1, 2]))]) for j in range(rng.randint(1, 14))]
        if rng.random() < 0.3:
            w = [(s, ["pass" if j < len(w) - 2 else "fail"]) for j, (s, _) in enumerate(w)]
        want[f"t{k}"] = plain_verdict(w)
        rows += rows_of(f"t{k}", w)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = history.detect(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["test_id"]: (r["verdict"], r["flake_rate"]) for r in got} == want
    assert len({v for v, _ in want.values()}) >= 4


def test_plan_shuffles_once_by_test(spark):
    df = history.histories(history.commit_windows(history.recent(spark.createDataFrame(rows_of("t", letters("P F")), SCHEMA))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert history.detect(none).count() == 0 and history.clean_runs(none).count() == 0
