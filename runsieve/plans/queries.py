"""Registered queries: every operator on the driver tables, with DuckDB SQL of the same result.

The tables are no test history, so projections give them that shape: a user of
`events` is a test, a day is a commit, and the rest follows from ids and types.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Cause, Policy
from ..functions import series, text
from ..operators import causes, history, identity, metrics, policy
from ..sources import codeowners, diff, junit
from . import render, store

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- shapes -----------------------------------------------------------------

_OUTCOME = """CASE WHEN event_type = 'signup' THEN 'skip'
  WHEN user_id % 5 = 0 THEN CASE WHEN day(ts) >= 20 THEN 'fail' ELSE 'pass' END
  WHEN user_id % 5 = 1 THEN CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END
  WHEN user_id % 5 = 2 THEN 'pass' WHEN user_id % 5 = 3 THEN 'error'
  ELSE CASE WHEN day(ts) % 2 = 0 THEN 'fail' ELSE 'pass' END END"""
_COMMON = f"""event_id AS execution_id, user_id AS test_id, ts AS started_at,
  CAST(CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS INT) AS attempt,
  concat('s', event_id % 4) AS shard, CASE WHEN event_id % 7 = 0 THEN 'feature' ELSE 'main' END AS branch,
  {_OUTCOME} AS outcome,
  CASE WHEN event_id % 11 = 0 THEN 'No space left on device' ELSE concat('failed in src/mod', user_id % 7, '.py') END AS failure_message"""

E = f"e AS (SELECT {_COMMON}, strftime(ts, '%Y-%m-%d') AS commit_sha FROM events)"
E_SPARSE = f"e AS (SELECT {_COMMON}, concat('c', event_id) AS commit_sha FROM events)"
E_ONE_DAY = f"""e AS (SELECT {_COMMON}, strftime(ts, '%Y-%m-%d') AS commit_sha FROM events
  WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events))"""


def executions(spark: SparkSession, d: str) -> DataFrame:
    return _executions(read(spark, d, "events"))


def _executions(events: DataFrame, sha: str = "date_format(ts, 'yyyy-MM-dd')") -> DataFrame:
    return events.selectExpr(*_columns(_COMMON), f"{sha} AS commit_sha")


def _columns(select: str) -> list[str]:
    """The items of a select list."""
    out, depth, start, quoted = [], 0, 0, False
    for k, c in enumerate(select + ","):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(select[start:k].strip())
            start = k + 1
    return out


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a commit of its own: no commit runs twice."""
    return _executions(read(spark, d, "events"), "concat('c', event_id)")


def one_day(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    last = events.agg(F.max(F.to_date("ts")).alias("last"))
    return _executions(events.join(F.broadcast(last), F.to_date("ts") == F.col("last"), "left_semi"))  # one row


RECENT = """r AS (SELECT *, CAST(row_number() OVER (PARTITION BY test_id ORDER BY started_at DESC, execution_id DESC) AS INT) AS rn FROM e),
recent AS (SELECT * FROM r WHERE rn <= 50)"""
WINDOWS = (
    RECENT
    + """,
k AS (SELECT *, outcome = 'error' AND contains(lower(failure_message), 'no space left on device') AS infra FROM recent),
w AS (SELECT test_id, commit_sha,
  count(*) FILTER (NOT infra) AS n_kept, count(*) FILTER (infra) AS n_infra,
  count(*) FILTER (NOT infra AND outcome = 'skip') AS n_skipped,
  count(*) FILTER (NOT infra AND outcome <> 'skip') AS n_observed,
  count(*) FILTER (NOT infra AND outcome = 'pass') AS n_pass,
  count(*) FILTER (NOT infra AND outcome IN ('fail', 'error')) AS n_fail,
  min(started_at) FILTER (NOT infra) AS started_at,
  last(branch ORDER BY started_at, execution_id) FILTER (NOT infra) AS branch,
  count(DISTINCT attempt) FILTER (NOT infra) AS n_attempts,
  list(DISTINCT attempt) FILTER (NOT infra AND outcome = 'pass') AS pa,
  list(DISTINCT attempt) FILTER (NOT infra AND outcome IN ('fail', 'error')) AS fa,
  coalesce(array_to_string(list_sort(list(DISTINCT shard) FILTER (NOT infra AND outcome IN ('fail', 'error'))), ','), '') AS failing_shards,
  first(outcome ORDER BY started_at, execution_id) FILTER (NOT infra AND outcome IN ('fail', 'error')) AS f_outcome,
  first(failure_message ORDER BY started_at, execution_id) FILTER (NOT infra AND outcome IN ('fail', 'error')) AS f_message,
  first(outcome ORDER BY started_at, execution_id) FILTER (NOT infra AND outcome <> 'skip') AS first_outcome
  FROM k GROUP BY 1, 2),
ws AS (SELECT *, n_pass > 0 AND n_fail > 0 AS diverged,
  n_pass > 0 AND n_fail > 0 AND n_attempts >= 2 AND list_sort(pa) <> list_sort(fa) AS cross_attempt,
  CASE WHEN n_pass > 0 AND n_fail > 0 THEN 'diverged' WHEN n_observed = 0 THEN 'no_data'
    WHEN n_fail > 0 THEN 'failed' ELSE 'passed' END AS status FROM w)"""
)
HISTORY = (
    WINDOWS
    + """,
h0 AS (SELECT test_id, CAST(sum(n_observed) AS BIGINT) AS observations, CAST(sum(n_infra) AS BIGINT) AS infra_excluded,
  CAST(sum(n_skipped) AS BIGINT) AS skipped, count(*) FILTER (n_kept > 0) AS windows,
  coalesce(bool_or(n_kept > 0 AND n_observed >= 2), false) AS retry_data,
  coalesce(string_agg(CASE WHEN n_kept > 0 THEN upper(left(status, 1)) END, '' ORDER BY started_at, commit_sha), '') AS word0,
  list(CASE WHEN diverged THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY started_at, commit_sha) FILTER (n_kept > 0 AND status <> 'no_data') AS hits,
  list(commit_sha ORDER BY started_at, commit_sha) FILTER (n_kept > 0 AND status <> 'no_data') AS shas,
  list(status ORDER BY started_at, commit_sha) FILTER (n_kept > 0 AND status <> 'no_data') AS sts,
  last({'sha': commit_sha, 'branch': branch, 'n_fail': n_fail, 'first_outcome': first_outcome, 'shards': failing_shards}
    ORDER BY started_at, commit_sha) FILTER (n_kept > 0) AS latest,
  last({'outcome': f_outcome, 'message': f_message, 'sha': commit_sha} ORDER BY started_at, commit_sha) FILTER (n_fail > 0) AS failure,
  count(*) FILTER (diverged) AS n_diverged, count(*) FILTER (branch = 'main' AND status = 'passed') AS n_main
  FROM ws GROUP BY 1),
h1 AS (SELECT *, replace(word0, 'N', '') AS word,
  list_transform(range(1, len(sts)), lambda i: CASE WHEN sts[i] <> sts[i + 1] OR sts[i] = 'diverged' OR sts[i + 1] = 'diverged' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS flips FROM h0),
h2 AS (SELECT *,
  CASE WHEN len(hits) > 0 THEN list_reduce(hits, lambda s, v: 0.3::DOUBLE * v + (1.0::DOUBLE - 0.3::DOUBLE) * s) ELSE 0.0::DOUBLE END AS divergence_rate,
  CASE WHEN len(flips) > 0 THEN list_reduce(flips, lambda s, v: 0.3::DOUBLE * v + (1.0::DOUBLE - 0.3::DOUBLE) * s) ELSE 0.0::DOUBLE END AS intermittency_rate,
  CAST(length(regexp_extract(word, '(P*)(F+)$', 1)) AS INT) AS pass_streak, CAST(length(regexp_extract(word, '(F+)$', 1)) AS INT) AS fail_streak FROM h1),
h AS (SELECT *, CASE WHEN retry_data THEN divergence_rate ELSE intermittency_rate END AS flake_rate,
  NOT contains(word, 'D') AND fail_streak >= 2 AND pass_streak >= 3 AS regression,
  CASE WHEN NOT contains(word, 'D') AND fail_streak >= 2 AND pass_streak >= 3 THEN shas[len(shas) - fail_streak + 1] END AS regression_sha FROM h2)"""
)
VERDICT = (
    HISTORY
    + """,
v0 AS (SELECT *, coalesce(latest.n_fail > 0, false) AS failing, NOT regression AND observations >= 10 AND flake_rate > 0.05 AS instability,
  false AS branch_signal FROM h),
v AS (SELECT *, CASE WHEN n_diverged > 0 THEN 'flaky' WHEN regression THEN 'regression' WHEN NOT failing THEN 'healthy'
    WHEN instability THEN 'flaky' WHEN windows <= 1 THEN 'new_failure' ELSE 'persistent_failure' END AS verdict,
  CASE WHEN n_diverged >= 2 THEN 'high' WHEN n_diverged = 1 THEN 'medium'
    WHEN regression THEN CASE WHEN pass_streak >= 6 THEN 'high' ELSE 'medium' END WHEN NOT failing THEN 'high'
    WHEN instability AND retry_data AND observations >= 20 THEN 'medium' WHEN instability OR windows <= 1 THEN 'low'
    WHEN observations >= 10 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN failing THEN failure.outcome ELSE latest.first_outcome END AS latest_outcome FROM v0)"""
)
_SHOWN = """test_id, verdict, confidence, flake_rate, observations, windows, infra_excluded, latest.sha AS latest_sha,
  regression_sha, latest_outcome, coalesce(latest.shards, '') AS failing_shards"""


def _shown(found: DataFrame) -> DataFrame:
    plain = ("test_id", "verdict", "confidence", "flake_rate", "observations", "windows", "infra_excluded", "latest_sha", "regression_sha", "latest_outcome")
    return found.select(*plain, F.array_join("failing_shards", ",").alias("failing_shards"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return history.detect(executions(spark, d))


def past(spark: SparkSession, d: str) -> DataFrame:
    return history.with_regression(history.with_rates(history.histories(history.commit_windows(history.recent(executions(spark, d))))))


# ---- scans, predicates, windows ---------------------------------------------


@query(f"WITH {E} SELECT execution_id, test_id, commit_sha, attempt, shard, branch, outcome, started_at FROM e")
def fact_view(spark, d):
    """Executions joined with their runs."""
    e = executions(spark, d)
    runs = e.select("commit_sha", "attempt", "shard").distinct().withColumn("run_pk", store.key_of("commit_sha", "attempt", "shard"))
    facts = e.withColumn("run_pk", store.key_of("commit_sha", "attempt", "shard")).drop("commit_sha", "attempt", "shard")
    return facts.join(runs, "run_pk").select("execution_id", "test_id", "commit_sha", "attempt", "shard", "branch", "outcome", "started_at")


@query(
    f"""WITH {E} SELECT outcome, count(*) AS n, count(*) FILTER (outcome IN ('fail', 'error')) AS failures,
    count(*) FILTER (outcome = 'pass') AS passes, count(*) FILTER (outcome <> 'skip') AS observations FROM e GROUP BY 1"""
)
def outcome_predicates(spark, d):
    o = F.col("outcome")
    return executions(spark, d).groupBy("outcome").agg(
        F.count("*").alias("n"), F.count_if(history.is_failure(o)).alias("failures"), F.count_if(o == "pass").alias("passes"), F.count_if(o != "skip").alias("observations")
    )


@query(f"WITH {E} SELECT execution_id, test_id FROM e WHERE outcome = 'error' AND contains(lower(failure_message), 'no space left on device')")
def infra_exclusion(spark, d):
    return history.complete(executions(spark, d)).filter(history.is_infra()).select("execution_id", "test_id")


@query(f"WITH {E}, {RECENT} SELECT execution_id, test_id, rn FROM recent")
def recent_n(spark, d):
    return history.recent(executions(spark, d)).select("execution_id", "test_id", "rn")


@query(f"WITH {E}, {RECENT} SELECT execution_id, test_id FROM recent WHERE started_at >= (SELECT max(CAST(ts AS DATE)) - INTERVAL 5 DAY FROM events)")
def since_filter(spark, d):
    cut = read(spark, d, "events").agg((F.max(F.to_date("ts")) - F.expr("INTERVAL 5 DAY")).cast("timestamp_ntz").alias("cut"))
    rows = history.recent(executions(spark, d)).join(F.broadcast(cut), F.col("started_at") >= F.col("cut"))  # one row
    return rows.select("execution_id", "test_id")


@query(f"WITH {E} SELECT DISTINCT test_id FROM e WHERE commit_sha LIKE '%-10' AND outcome IN ('fail', 'error')")
def failing_at_commit(spark, d):
    e = executions(spark, d).withColumn("commit_sha", F.right("commit_sha", F.lit(3)))
    return history.failing_at(e, "-10")


@query(f"WITH {E}, {WINDOWS} SELECT test_id, commit_sha, branch, n_observed, n_pass, n_fail, n_skipped, n_infra, diverged, status FROM ws")
def commit_windows(spark, d):
    w = history.commit_windows(history.recent(executions(spark, d)))
    return w.select("test_id", "commit_sha", "branch", "n_observed", "n_pass", "n_fail", "n_skipped", "n_infra", "diverged", "status")


@query(f"WITH {E}, {WINDOWS} SELECT test_id, commit_sha, n_attempts FROM ws WHERE cross_attempt")
def cross_attempt(spark, d):
    w = history.commit_windows(history.recent(executions(spark, d))).filter("cross_attempt")
    return w.select("test_id", "commit_sha", F.size("attempts").cast("long").alias("n_attempts"))


@query(f"WITH {E}, {WINDOWS} SELECT test_id, commit_sha, failing_shards FROM ws WHERE n_fail > 0")
def failing_shards(spark, d):
    w = history.commit_windows(history.recent(executions(spark, d))).filter("n_fail > 0")
    return w.select("test_id", "commit_sha", F.array_join("failing_shards", ",").alias("failing_shards"))


@query(f"WITH {E}, {HISTORY} SELECT test_id, observations, infra_excluded, skipped, windows, retry_data FROM h")
def history_counters(spark, d):
    return past(spark, d).select("test_id", "observations", "infra_excluded", "skipped", "windows", "retry_data")


@query(f"WITH {E}, {HISTORY} SELECT test_id, word FROM h")
def window_status(spark, d):
    return past(spark, d).select("test_id", "word")


@query(f"WITH {E}, {HISTORY} SELECT test_id, divergence_rate FROM h")
def ewma_divergence(spark, d):
    return past(spark, d).select("test_id", "divergence_rate")


@query(f"WITH {E_SPARSE}, {HISTORY} SELECT test_id, intermittency_rate FROM h")
def intermittency(spark, d):
    return history.with_rates(history.histories(history.commit_windows(history.recent(sparse(spark, d))))).select("test_id", "intermittency_rate")


@query(f"WITH {E}, {HISTORY} SELECT test_id, flake_rate, retry_data FROM h")
def flake_rate(spark, d):
    return past(spark, d).select("test_id", "flake_rate", "retry_data")


@query(f"WITH {E}, {HISTORY} SELECT test_id, pass_streak, fail_streak, regression, regression_sha FROM h")
def regression_pivot(spark, d):
    return past(spark, d).select("test_id", "pass_streak", "fail_streak", "regression", "regression_sha")


@query(f"WITH {E_SPARSE}, {VERDICT} SELECT test_id, observations FROM v WHERE instability")
def instability(spark, d):
    rows = history.detect(sparse(spark, d)).filter(F.exists("signals", lambda s: s["signal"] == "historical_instability"))
    return rows.select("test_id", "observations")


@query(
    f"""WITH {E}, {HISTORY} SELECT test_id, n_main AS observations FROM h WHERE NOT regression AND latest.n_fail > 0 AND latest.branch <> 'main' AND n_main > 0
    AND regexp_extract(failure.message, 'src/mod[0-9]+.py') <> '' AND regexp_extract(failure.message, 'src/mod[0-9]+.py') <> 'src/mod3.py'"""
)
def branch_independent(spark, d):
    """Every commit is taken to change src/mod3.py."""
    e = executions(spark, d)
    diffs = e.select("commit_sha").distinct().withColumn("paths", F.array(F.lit("a/src/mod3.py"), F.lit("./src/mod3.py")))
    rows = history.detect(e, diffs=diffs).withColumn("s", F.filter("signals", lambda s: s["signal"] == "branch_independent"))
    return rows.filter(F.size("s") > 0).select("test_id", F.get("s", F.lit(0))["observations"].alias("observations"))


@query(f"WITH {E}, {VERDICT} SELECT {_SHOWN} FROM v")
def verdicts(spark, d):
    """The flagship: executions to verdicts."""
    return _shown(found(spark, d))


@query(f"WITH {E_SPARSE}, {VERDICT} SELECT {_SHOWN} FROM v")
def verdicts_sparse(spark, d):
    return _shown(history.detect(sparse(spark, d)))


@query(f"WITH {E_ONE_DAY}, {VERDICT} SELECT {_SHOWN} FROM v")
def verdicts_one_day(spark, d):
    return _shown(history.detect(one_day(spark, d)))


@query(
    f"""WITH {E}, {VERDICT} SELECT count(*) FILTER (verdict = 'regression') AS regression, count(*) FILTER (verdict = 'flaky') AS flaky,
    count(*) FILTER (verdict = 'persistent_failure') AS persistent_failure, count(*) FILTER (verdict = 'new_failure') AS new_failure,
    count(*) FILTER (verdict = 'healthy') AS healthy, count(*) AS total, CAST(0 AS BIGINT) AS merged_uncertain FROM v"""
)
def verdict_counts(spark, d):
    return metrics.verdict_counts(found(spark, d))


@query(f"WITH {E}, {HISTORY} SELECT test_id, failure.outcome AS outcome, failure.message AS failure_message FROM h WHERE failure IS NOT NULL")
def latest_failure(spark, d):
    out = past(spark, d).withColumn("f", F.try_element_at(F.filter("w", lambda w: w["n_fail"] > 0), F.lit(-1))["failure"])
    return out.filter("f IS NOT NULL").select("test_id", F.col("f.outcome").alias("outcome"), F.col("f.failure_message").alias("failure_message"))


_CLEAN = """c AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY started_at DESC, execution_id DESC) AS n FROM e WHERE outcome <> 'skip'),
clean AS (SELECT test_id, coalesce(min(n) FILTER (outcome <> 'pass') - 1, count(*)) AS clean_runs FROM c WHERE n <= 50 GROUP BY 1)"""


@query(f"WITH {E}, {_CLEAN} SELECT test_id, clean_runs FROM clean")
def clean_runs(spark, d):
    return history.clean_runs(executions(spark, d))


@query(
    f"""WITH {E}, {VERDICT}, o AS (SELECT *, CASE verdict WHEN 'regression' THEN 1 WHEN 'flaky' THEN 2 WHEN 'persistent_failure' THEN 3 WHEN 'new_failure' THEN 4 ELSE 5 END AS rank FROM v)
    SELECT test_id, verdict, row_number() OVER (ORDER BY rank, flake_rate DESC, test_id) AS place FROM o"""
)
def report_order(spark, d):
    rows = render.report_order(found(spark, d)).withColumn("k", F.monotonically_increasing_id())
    return rows.select("test_id", "verdict", F.row_number().over(Window.orderBy("k")).cast("long").alias("place"))  # one row a test


@query(
    f"""WITH {E}, {VERDICT}, o AS (SELECT test_id, CAST(row_number() OVER (ORDER BY flake_rate DESC, observations DESC, test_id) AS INT) AS rank FROM v WHERE verdict IN ('flaky', 'persistent_failure'))
    SELECT test_id, CASE WHEN rank <= 25 THEN rank ELSE 0 END AS rank, CASE WHEN rank > 25 THEN 'budget_exhausted' END AS skip_reason FROM o"""
)
def batch_cap(spark, d):
    rows = causes.batch(history.needs_cause(found(spark, d)), Cause().max_tests)
    return rows.select("test_id", F.coalesce("rank", F.lit(0)).alias("rank"), "skip_reason")


# ---- policy -----------------------------------------------------------------

_CAUSE = "CASE WHEN test_id % 9 = 4 THEN 'REAL_REGRESSION' WHEN test_id % 9 = 5 THEN 'INFRA_FLAKE' ELSE 'RACE_CONDITION' END"
_REFUSAL = f"""CASE WHEN verdict = 'regression' THEN 'verdict_regression' WHEN verdict = 'new_failure' THEN 'verdict_ineligible'
  WHEN {_CAUSE} = 'REAL_REGRESSION' THEN 'cause_regression' WHEN {_CAUSE} = 'INFRA_FLAKE' THEN 'cause_infra'
  WHEN verdict <> 'flaky' THEN 'not_flaky' WHEN test_id % 8 = 1 THEN 'already_quarantined'
  WHEN observations < 10 THEN 'insufficient_observations' WHEN flake_rate <= 0.05 THEN 'below_threshold' END"""
NOW = datetime.datetime(1996, 6, 1)


@query(
    f"""WITH {E}, {VERDICT}, q AS (SELECT test_id, {_REFUSAL} AS refusal FROM v)
    SELECT test_id, refusal, refusal IS NULL AS recommended, CASE WHEN refusal IS NULL THEN TIMESTAMP '1996-06-15' END AS expires_at FROM q"""
)
def quarantine_decisions(spark, d):
    rows = found(spark, d).withColumns({"cause": F.expr(_CAUSE), "already_open": F.expr("test_id % 8 = 1")})
    return policy.decide(rows, Policy(), F.lit(NOW).cast("timestamp_ntz")).select("test_id", "refusal", "recommended", "expires_at")


def _quarantines(spark, d):
    o = read(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "expired").otherwise("recommended")
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("test_id"),
        state.alias("state"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(14))).alias("expires_at"),
        F.col("o_orderkey").alias("event_no"),
    )


_Q = """q AS (SELECT o_orderkey AS record_id, o_custkey AS test_id,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE 'recommended' END AS state,
  o_orderdate + INTERVAL 14 DAY AS expires_at FROM orders)"""


@query(
    f"""WITH {_Q} SELECT record_id, expires_at <= TIMESTAMP '1996-06-04' AS expiring, expires_at <= TIMESTAMP '1996-06-01' AS expired
    FROM q WHERE state IN ('active', 'recommended')"""
)
def expiring(spark, d):
    rows, now = _quarantines(spark, d).filter(policy.is_open(F.col("state"))), F.lit(NOW)
    return rows.select("record_id", policy.expiring(F.col("expires_at"), now).alias("expiring"), policy.expired(F.col("expires_at"), now).alias("expired"))


@query(f"WITH {_Q} SELECT state, count(*) AS n FROM q GROUP BY 1")
def state_counts(spark, d):
    return metrics.tally(_quarantines(spark, d), "state")


@query(f"WITH {E}, {_CLEAN} SELECT test_id FROM clean WHERE clean_runs >= 20")
def release(spark, d):
    return history.clean_runs(executions(spark, d)).filter(policy.should_release(F.col("clean_runs"))).select("test_id")


@query(f"WITH {E}, {VERDICT}, {_Q} SELECT v.test_id, verdict, EXISTS (SELECT 1 FROM q WHERE q.test_id = v.test_id AND state IN ('active', 'recommended')) AS is_open FROM v")
def open_flag(spark, d):
    opened = policy.latest_state(_quarantines(spark, d)).filter(policy.is_open(F.col("state"))).select("test_id", F.lit(True).alias("o")).distinct()
    return found(spark, d).join(opened, "test_id", "left").select("test_id", "verdict", F.coalesce("o", F.lit(False)).alias("is_open"))


@query("SELECT o_custkey AS test_id, max(o_orderkey) AS event_no, arg_max(o_orderpriority, o_orderkey) AS cause FROM orders GROUP BY 1")
def latest_classification(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("event_no"), F.col("o_orderpriority").alias("cause"))
    return policy.latest_state(o).select(F.col("record_id").alias("test_id"), "event_no", "cause")


# ---- metrics ----------------------------------------------------------------

_CALLS = """calls AS (SELECT event_id AS call_id, user_id AS run_id, CASE event_type WHEN 'view' THEN 'classify' WHEN 'click' THEN 'gate' ELSE 'repair' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'small-1-2024' WHEN event_id % 3 = 1 THEN 'large' ELSE 'other' END AS model,
  event_id % 500 AS input_tokens, event_id % 70 AS output_tokens, CASE WHEN event_id % 13 = 0 THEN 'timeout' END AS error, round(value) AS latency_ms FROM events)"""
_PRICED = f"""{_CALLS}, priced AS (SELECT *, CASE model WHEN 'small-1-2024' THEN (input_tokens * 1.0::DOUBLE + output_tokens * 5.0::DOUBLE) / 1000000
  WHEN 'large' THEN (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 ELSE 0.0::DOUBLE END AS cost_usd FROM calls)"""


def calls(spark, d):
    return read(spark, d, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "view", "classify").when(F.col("event_type") == "click", "gate").otherwise("repair").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, "small-1-2024").when(F.col("event_id") % 3 == 1, "large").otherwise("other").alias("model"),
        (F.col("event_id") % 500).alias("input_tokens"),
        (F.col("event_id") % 70).alias("output_tokens"),
        F.when(F.col("event_id") % 13 == 0, "timeout").alias("error"),
        F.rint("value").alias("latency_ms"),
    )


def _prices(spark):
    table = [(1, "small-1", 1.0, 5.0), (2, "large-2", 3.0, 15.0), (3, "large", 9.0, 9.0), (4, "small", 7.0, 7.0)]
    return spark.createDataFrame(table, "price_no int, model string, usd_in double, usd_out double")


def priced(spark, d):
    return causes.price(calls(spark, d), _prices(spark))


@query(f"WITH {_PRICED} SELECT call_id, cost_usd FROM priced")
def token_cost(spark, d):
    return priced(spark, d).select("call_id", "cost_usd")


@query(
    f"""WITH {_CALLS}, p(price_no, m, usd_in, usd_out) AS (VALUES (1, 'small-1', 1.0::DOUBLE, 5.0::DOUBLE), (2, 'large-2', 3.0, 15.0), (3, 'large', 9.0, 9.0), (4, 'small', 7.0, 7.0)),
    best AS (SELECT model, min(price_no) AS price_no FROM (SELECT DISTINCT model FROM calls) c JOIN p ON starts_with(model, m) OR starts_with(m, model) GROUP BY 1)
    SELECT model, count(*) AS n, max(usd_in) AS usd_in, max(usd_out) AS usd_out FROM calls LEFT JOIN best USING (model) LEFT JOIN p USING (price_no) GROUP BY 1"""
)
def price_prefix(spark, d):
    """The price that each model's calls meet: by prefix either way, the first of several, none for some."""
    million = calls(spark, d).select("model").withColumns({"input_tokens": F.lit(1_000_000), "output_tokens": F.lit(0)})
    table = _prices(spark)
    both = causes.price(million, table).withColumnRenamed("cost_usd", "usd_in").withColumns({"input_tokens": F.lit(0), "output_tokens": F.lit(1_000_000)})
    rows = causes.price(both, table).withColumnRenamed("cost_usd", "usd_out")
    none = lambda c: F.nullif(F.max(c), F.lit(0.0)).alias(c)
    return rows.groupBy("model").agg(F.count("*").alias("n"), none("usd_in"), none("usd_out"))


@query(
    f"""WITH {_PRICED} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(round(sum(CAST(round(cost_usd * 1000000) AS BIGINT))) AS BIGINT) AS micro_usd, count(*) FILTER (error IS NOT NULL) AS errors FROM priced"""
)
def call_totals(spark, d):
    """Costs are whole millionths of a dollar here, so that their sum has no rounding of its own."""
    out = metrics.call_totals(priced(spark, d))
    return out.select("calls", "input_tokens", "output_tokens", F.round(F.col("cost_usd") * 1e6).cast("long").alias("micro_usd"), "errors")


@query(
    f"""WITH {_PRICED}, c AS (SELECT round(sum(cost_usd) * 1000000) AS s, count(*) AS n FROM priced)
    SELECT CAST(round(s / (SELECT count(*) FROM events WHERE event_type = 'view')) AS BIGINT) AS micro_usd FROM c"""
)
def cost_per_classification(spark, d):
    views = read(spark, d, "events").filter("event_type = 'view'")
    out = metrics.cost_per_classification(priced(spark, d), views)
    return out.select(F.round(F.col("cost_per_classification") * 1e6).cast("long").alias("micro_usd"))


@query(
    """SELECT o_orderpriority AS cause, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS BIGINT) AS place FROM orders GROUP BY 1"""
)
def cause_map(spark, d):
    """Map-valued summary: how often each value stands, and their order by falling count."""
    m = metrics.as_map(read(spark, d, "orders"), "o_orderpriority")
    return m.select("counts", F.posexplode("ranked").alias("k", "cause")).select("cause", F.col("counts")[F.col("cause")].alias("n"), (F.col("k") + 1).cast("long").alias("place"))


_STATES = """q AS (SELECT o_orderkey AS record_id, o_custkey AS test_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'released' ELSE 'recommended' END AS state,
  CAST(o_orderdate AS TIMESTAMP) AS expires_at FROM orders), i AS (SELECT c_custkey AS test_id, c_name AS test_name FROM customer)"""


@query(
    f"""WITH {_STATES} SELECT record_id, test_name, state, expires_at <= TIMESTAMP '1996-06-04' AS expiring, row_number() OVER (ORDER BY expires_at, record_id) AS place
    FROM q JOIN i USING (test_id) WHERE state <> 'released'"""
)
def quarantine_listing(spark, d):
    o = read(spark, d, "orders").selectExpr(
        "o_orderkey AS record_id", "o_custkey AS test_id", "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'released' ELSE 'recommended' END AS state", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS expires_at", "1L AS event_no"
    )
    ids = read(spark, d, "customer").selectExpr("c_custkey AS test_id", "'' AS suite_path", "c_name AS test_name", "'' AS parameters")
    listed = policy.numbered_listing(o, ids, F.lit(NOW).cast("timestamp_ntz"), 3)
    return listed.select("record_id", "test_name", "state", "expiring", "place")


@query("SELECT o_orderpriority AS code, array_to_string(list_transform(string_split(replace(substr(o_orderpriority, 3), ' ', '_'), '_'), lambda x: x[1]), '') AS short FROM orders GROUP BY 1, 2")
def initialisms(spark, d):
    code = F.replace(F.substr("o_orderpriority", F.lit(3)), F.lit(" "), F.lit("_"))
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), text.initialism(code).alias("short")).distinct()


@query(
    f"""WITH {_CALLS}, s AS (SELECT list_sort(list(latency_ms) FILTER (kind = 'classify' AND error IS NULL)) AS l FROM calls)
    SELECT l[CAST(round_even(0.5 * (len(l) - 1), 0) AS BIGINT) + 1] AS p50_ms, l[CAST(round_even(0.95 * (len(l) - 1), 0) AS BIGINT) + 1] AS p95_ms FROM s"""
)
def nearest_rank_percentiles(spark, d):
    return metrics.call_totals(priced(spark, d)).select("p50_ms", "p95_ms")


@query(f"WITH {_CALLS} SELECT kind, count(*) AS n FROM calls WHERE kind <> 'gate' GROUP BY 1")
def by_cause(spark, d):
    return metrics.tally(calls(spark, d), "kind", "gate")


@query(
    """SELECT count(*) AS classifications, count(*) FILTER (event_type = 'error') AS abstained, count(*) FILTER (event_type = 'view') AS cache_hits,
    count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS abstention_rate, count(*) FILTER (event_type = 'view') / count(*)::DOUBLE AS cache_hit_rate FROM events"""
)
def classification_totals(spark, d):
    e = read(spark, d, "events").select((F.col("event_type") == "error").alias("abstained"), (F.col("event_type") == "view").alias("cache_hit"))
    return metrics.classification_totals(e)


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS run_id, event_id AS call_id, (event_id % 500) / 1000000.0::DOUBLE AS cost,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT run_id, call_id, n, true AS ran, cost AS spent, CAST(1 AS BIGINT) AS k FROM c WHERE n = 1
      UNION ALL SELECT c.run_id, c.call_id, c.n, r.ok, f.spent + CASE WHEN r.ok THEN c.cost ELSE 0.0::DOUBLE END, f.k + CASE WHEN r.ok THEN 1 ELSE 0 END
      FROM f JOIN c ON c.run_id = f.run_id AND c.n = f.n + 1,
      LATERAL (SELECT NOT (f.spent >= 0.005::DOUBLE OR ((CASE WHEN f.k > 0 THEN f.spent / f.k ELSE 0.0::DOUBLE END) > 0
        AND f.spent + (CASE WHEN f.k > 0 THEN f.spent / f.k ELSE 0.0::DOUBLE END) > 0.005::DOUBLE)) AS ok) r)
    SELECT run_id, call_id, ran FROM f"""
)
def budget_fold(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("call_id"), (F.col("event_id") % 500 / F.lit(1000000.0)).alias("cost_usd"))
    return causes.within_budget(rows, 0.005)


# ---- evaluation -------------------------------------------------------------

_LABELS = """lp AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'REAL_REGRESSION' WHEN quality = 1 THEN 'RACE_CONDITION' ELSE 'UNKNOWN' END AS truth,
  CASE WHEN n_chars % 5 = 0 THEN 'UNKNOWN' WHEN n_chars % 5 = 1 THEN 'REAL_REGRESSION' WHEN n_chars < 300 THEN 'TIMING_DEPENDENCY' ELSE 'RACE_CONDITION' END AS predicted,
  doc_id % 4 = 0 AS adversarial FROM labels JOIN documents USING (doc_id))"""


def labelled(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "REAL_REGRESSION").when(F.col("quality") == 1, "RACE_CONDITION").otherwise("UNKNOWN")
    m = F.col("n_chars") % 5
    guess = F.when(m == 0, "UNKNOWN").when(m == 1, "REAL_REGRESSION").when(F.col("n_chars") < 300, "TIMING_DEPENDENCY").otherwise("RACE_CONDITION")
    return rows.select("doc_id", truth.alias("truth"), guess.alias("predicted"), (F.col("doc_id") % 4 == 0).alias("adversarial"))


@query(f"WITH {_LABELS} SELECT truth, predicted, count(*) AS n FROM lp GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(labelled(spark, d))


@query(
    f"""WITH {_LABELS}, c AS (SELECT unnest(['RACE_CONDITION', 'TIMING_DEPENDENCY', 'TEST_ORDER_DEPENDENCY', 'EXTERNAL_DEPENDENCY', 'SHARED_STATE_LEAK',
      'RESOURCE_EXHAUSTION', 'INFRA_FLAKE', 'REAL_REGRESSION', 'UNKNOWN']) AS class),
    s AS (SELECT class, (SELECT count(*) FROM lp WHERE truth = class) AS support, (SELECT count(*) FROM lp WHERE lp.predicted = class) AS predicted,
      (SELECT count(*) FROM lp WHERE truth = class AND lp.predicted = class) AS true_positives FROM c),
    p AS (SELECT *, CASE WHEN predicted > 0 THEN true_positives / predicted::DOUBLE ELSE 0.0::DOUBLE END AS precision,
      CASE WHEN support > 0 THEN true_positives / support::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM s)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM p"""
)
def class_prf(spark, d):
    return metrics.class_scores(labelled(spark, d))


@query(
    f"""WITH {_LABELS}, a AS (SELECT count(*) AS n, count(*) FILTER (truth = predicted) AS n_right, count(*) FILTER (predicted = 'UNKNOWN') AS n_abstained,
      count(*) FILTER (predicted <> 'UNKNOWN') AS n_answered, count(*) FILTER (predicted <> 'UNKNOWN' AND truth = predicted) AS n_answered_right,
      count(*) FILTER (truth = 'REAL_REGRESSION') AS n_regressions,
      count(*) FILTER (truth = 'REAL_REGRESSION' AND predicted NOT IN ('REAL_REGRESSION', 'INFRA_FLAKE', 'UNKNOWN')) AS n_dangerous,
      count(*) FILTER (adversarial) AS n_adversarial, count(*) FILTER (adversarial AND truth = predicted) AS n_adversarial_right FROM lp)
    SELECT *, n_right / n::DOUBLE AS accuracy, n_abstained / n::DOUBLE AS abstention_rate, n_answered_right / n_answered::DOUBLE AS accuracy_when_answering,
      n_dangerous / n_regressions::DOUBLE AS dangerous_error_rate, n_adversarial_right / n_adversarial::DOUBLE AS adversarial_accuracy FROM a"""
)
def report_scores(spark, d):
    return metrics.report_scores(labelled(spark, d))


# ---- identities -------------------------------------------------------------

_NAME = "concat('test_', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN concat('[size=', p_size, ']') ELSE '' END)"
_CLASS = "concat('pkg.', lower(replace(p_type, ' ', '_')), CASE WHEN p_partkey % 2 = 0 THEN '.Case' ELSE '.case' END)"


def cases(spark, d):
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("test_id"),
        F.expr(_NAME).alias("name"),
        F.expr(_CLASS).alias("classname"),
        F.lit("outer/inner").alias("suite_path"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("./src\\\\"), F.lower("p_brand"), F.lit(".py"))).alias("file_path"),
    )


_BASE = "CASE WHEN p_partkey % 3 = 0 THEN concat('test_', replace(p_name, ' ', '_')) ELSE concat('test_', replace(p_name, ' ', '_')) END"
_PARAMS = "CASE WHEN p_partkey % 3 = 0 THEN concat('size=', p_size) ELSE '' END"
_SUITE = """CASE WHEN p_partkey % 5 = 0 THEN concat('src//', lower(p_brand), '.py', CASE WHEN p_partkey % 2 = 0 THEN '::Case' ELSE '' END)
  ELSE concat('pkg/', lower(replace(p_type, ' ', '_')), CASE WHEN p_partkey % 2 = 0 THEN '::Case' ELSE '/case' END) END"""
_IDS = f"ids AS (SELECT p_partkey AS test_id, {_BASE} AS test_name, {_PARAMS} AS parameters, {_SUITE} AS suite FROM part)"


@query(f"WITH {_IDS} SELECT test_id, test_name, parameters FROM ids")
def split_parameters(spark, d):
    return identity.identities(cases(spark, d)).select("test_id", "test_name", "parameters")


@query(f"WITH {_IDS} SELECT test_id, suite FROM ids")
def suite_paths(spark, d):
    return identity.identities(cases(spark, d)).select("test_id", "suite")


@query(f"WITH {_IDS} SELECT test_id, left(sha256(concat(suite, chr(31), test_name, chr(31), parameters)), 16) AS fingerprint FROM ids")
def fingerprints(spark, d):
    return identity.identities(cases(spark, d)).select("test_id", "fingerprint")


def _sides(spark, d):
    p = read(spark, d, "part").select(
        (F.col("p_partkey") % 50).alias("run_pk"),
        F.col("p_partkey").cast("string").alias("fingerprint"),
        F.col("p_name").alias("test_name"),
        F.lower("p_type").alias("suite_path"),
        F.col("p_brand").alias("parameters"),
    )
    return p.filter("CAST(fingerprint AS BIGINT) % 100 < 50"), p.filter("CAST(fingerprint AS BIGINT) % 100 >= 50")


_PAIRS = """s AS (SELECT p_partkey % 50 AS run_pk, CAST(p_partkey AS VARCHAR) AS fp, p_name AS n, lower(p_type) AS s, p_brand AS b, p_partkey % 100 < 50 AS old FROM part),
pairs AS (SELECT * FROM (SELECT x.run_pk, x.fp AS old_fingerprint, y.fp AS new_fingerprint,
  0.5::DOUBLE * (levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n))::DOUBLE) + 0.5::DOUBLE * (levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s))::DOUBLE) AS distance
  FROM s x JOIN s y ON x.run_pk = y.run_pk AND x.b = y.b AND x.old AND NOT y.old) WHERE distance <= 0.7)"""
_LOOSE = identity.Identity(alias_max_distance=0.7)


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def similar_names(spark, d):
    return identity.similar_pairs(*_sides(spark, d), _LOOSE).select("run_pk", "old_fingerprint", "new_fingerprint", "distance")


@query()
def rename_matches(spark, d):
    """No SQL: rounds of tied ranks; tests hold it against a plain loop."""
    return identity.renames(*_sides(spark, d), _LOOSE)


def _edges(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("old_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2 + 1).alias("new_id"), (F.col("o_orderkey") % 100 / F.lit(100.0)).alias("similarity"), (F.col("o_orderkey") % 10 > 0).alias("certain")
    )


_EDGES = "ed AS (SELECT o_custkey AS old_id, o_custkey + o_orderkey % 2 + 1 AS new_id, (o_orderkey % 100) / 100.0::DOUBLE AS similarity, o_orderkey % 10 > 0 AS certain FROM orders)"


@query(f"WITH {_EDGES} SELECT old_id, new_id, max(similarity) AS similarity, bool_or(certain) AS certain FROM ed GROUP BY 1, 2")
def alias_upsert(spark, d):
    e = _edges(spark, d)
    return identity.upsert_aliases(e.filter("similarity < 0.5"), e.filter("similarity >= 0.5"))


@query()
def alias_groups(spark, d):
    """No SQL: chains through the ids of all orders; tests hold it against a plain loop."""
    return identity.groups(_edges(spark, d))


_RUNS = """rx AS (SELECT CAST(event_id % 40 AS INT) AS run_pk, user_id AS test_id FROM events), rs AS (SELECT DISTINCT run_pk, run_pk // 2 AS ord FROM rx),
first AS (SELECT test_id, min(ord) AS f FROM rx JOIN rs USING (run_pk) GROUP BY 1)"""


def _runs(spark, d):
    ex = read(spark, d, "events").select((F.col("event_id") % 40).cast("int").alias("run_pk"), F.col("user_id").alias("test_id"))
    runs = ex.select("run_pk").distinct().withColumn("started_at", F.expr("run_pk div 2"))
    return ex, runs


@query(f"WITH {_RUNS} SELECT DISTINCT run_pk, test_id FROM rs JOIN first ON f < ord WHERE NOT EXISTS (SELECT 1 FROM rx WHERE rx.run_pk = rs.run_pk AND rx.test_id = first.test_id)")
def disappeared(spark, d):
    return identity.disappeared(*_runs(spark, d))


@query(f"WITH {_RUNS} SELECT DISTINCT rx.run_pk, rx.test_id FROM rx JOIN rs USING (run_pk) JOIN first ON first.test_id = rx.test_id AND f = ord")
def appeared(spark, d):
    return identity.appeared(*_runs(spark, d))


@query(f"WITH {_RUNS} SELECT test_id, max(ord) AS last_seen FROM rx JOIN rs USING (run_pk) GROUP BY 1")
def last_seen(spark, d):
    return metrics.last_seen(*_runs(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS new_rows, count(DISTINCT (o_custkey, o_orderstatus)) AS rows_kept FROM orders")
def reingest_noop(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    have = store.new_rows(o, o.limit(0), ["o_custkey", "o_orderstatus"], ["o_orderkey"])
    again = store.new_rows(o, have, ["o_custkey", "o_orderstatus"], ["o_orderkey"])
    return have.agg(F.count("*").alias("rows_kept")).join(again.agg(F.count("*").alias("new_rows")), F.lit(True))  # one row each


# ---- strings, ranges, owners ------------------------------------------------

_TRACE = """concat('File "./src/', lower(replace(p_brand, '#', '')), '.pyi", line ', p_size, chr(10), 'at java.util.Foo(Foo.java:3)', chr(10),
  'in lib/site-packages/x/y.py', chr(10), 'near web/', p_partkey % 7, '.json and web/', p_partkey % 7, '.tsx')"""


@query("SELECT p_partkey, concat('src/', lower(replace(p_brand, '#', '')), '.py,web/', p_partkey % 7, '.js,web/', p_partkey % 7, '.ts') AS paths FROM part")
def extract_paths(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(text.source_paths(F.expr(_TRACE)), ",").alias("paths"))


@query("""SELECT p_partkey, concat('src/', lower(replace(p_brand, '#', '')), '.py,tests/t.py,web/', p_partkey % 7, '.js,web/', p_partkey % 7, '.ts') AS footprint FROM part""")
def footprint_union(spark, d):
    f = text.footprint(F.lit("./tests\\t.py"), F.expr(_TRACE), F.lit("see tests/t.py"))
    return read(spark, d, "part").select("p_partkey", F.array_join(f, ",").alias("footprint"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)shutdown signal|preempted') THEN 'INFRA_FLAKE' WHEN regexp_matches(text, '(?i)licen[cs]ed') THEN 'EXTERNAL_DEPENDENCY'
    WHEN regexp_matches(text, '(?i)token|[a-z]+@[a-z]+') THEN 'TIMING_DEPENDENCY' WHEN n_chars % 6 = 1 AND length(trim(coalesce(text, ''))) > 0 THEN 'TEST_ORDER_DEPENDENCY' ELSE 'UNKNOWN' END AS cause FROM documents"""
)
def keyword_causes(spark, d):
    rules = (("INFRA_FLAKE", "shutdown signal|preempted"), ("EXTERNAL_DEPENDENCY", "licen[cs]ed"), ("TIMING_DEPENDENCY", "token|[a-z]+@[a-z]+"))
    guess = text.keyword_cause(F.lit(None).cast("string"), F.col("text"), F.lit(""), F.col("n_chars") % 6, rules)
    return read(spark, d, "documents").select("doc_id", guess.alias("cause"))


_SAID = {
    "INFRA_FLAKE": "No space left on device", "RESOURCE_EXHAUSTION": "java.lang.OutOfMemoryError", "EXTERNAL_DEPENDENCY": "got status code 503", "SHARED_STATE_LEAK": "duplicate key value",
    "RACE_CONDITION": "WARNING: DATA RACE", "TIMING_DEPENDENCY": "deadline exceeded", "TEST_ORDER_DEPENDENCY": "passes when run with others",
}
_SAYS = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_SAID.values())) + " WHEN 7 THEN 'timed out: address already in use' ELSE 'odd' END"
_MEANT = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_SAID)) + " WHEN 7 THEN 'RESOURCE_EXHAUSTION' ELSE CASE WHEN event_id % 2 = 1 THEN 'TEST_ORDER_DEPENDENCY' ELSE 'UNKNOWN' END END"


@query(f"SELECT event_id, {_MEANT} AS cause FROM events")
def default_causes(spark, d):
    """The rules as they come, by whole messages; the earlier of two rules, and failures on one shard alone."""
    e = read(spark, d, "events").withColumn("m", F.expr(_SAYS))
    return e.select("event_id", text.keyword_cause(F.lit(None).cast("string"), F.col("m"), F.lit(""), F.col("event_id") % 2).alias("cause"))


_RANGE = "l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(floor(l_quantity) AS INT) % 15 AS e"


@query(
    f"""WITH l AS (SELECT {_RANGE} FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
    SELECT k, CAST(min(s) AS BIGINT) AS range_start, CAST(max(e) AS BIGINT) AS range_end FROM g GROUP BY k, i"""
)
def merge_ranges(spark, d):
    l = read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _RANGE.split(", ")])
    spans = F.collect_list(F.struct(F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("end")))
    out = l.groupBy("k").agg(series.merge_ranges(spans).alias("r")).select("k", F.explode("r").alias("r"))
    return out.select("k", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(f"WITH l AS (SELECT {_RANGE} FROM lineitem) SELECT a.k, a.s AS a, b.s AS b FROM l a JOIN l b ON a.k = b.k AND a.s < b.s AND a.s <= b.e AND b.s <= a.e")
def line_range_overlap(spark, d):
    l = read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _RANGE.split(", ")])
    x, y = (l.select("k", F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias(n)) for n in "ab")
    met = x.join(y, "k").filter(series.overlaps(F.col("a"), F.col("b")) & (F.col("a.start") < F.col("b.start")))  # an order has few lines
    return met.select("k", F.col("a.start").alias("a"), F.col("b.start").alias("b"))


@query(f"WITH l AS (SELECT {_RANGE} FROM lineitem) SELECT k, s, e, s <= 30 AND 30 <= e AS holds FROM l")
def line_in_range(spark, d):
    l = read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _RANGE.split(", ")])
    return l.select("k", "s", "e", series.contains(F.struct(F.col("s").alias("start"), F.col("e").alias("end")), F.lit(30)).alias("holds"))


@query(
    """WITH l AS (SELECT DISTINCT l_suppkey AS k, l_linenumber + CAST(floor(l_quantity) AS INT) AS n FROM lineitem),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM l) SELECT k, CAST(min(n) AS BIGINT) AS range_start, CAST(max(n) AS BIGINT) AS range_end FROM g GROUP BY k, i"""
)
def line_runs(spark, d):
    return _line_runs(read(spark, d, "lineitem"))


def _line_runs(lines):
    l = lines.select(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") + F.floor("l_quantity").cast("int")).cast("long").alias("n")).distinct()
    out = l.groupBy("k").agg(series.merge_ranges(F.collect_list(F.struct(F.col("n").alias("start"), F.col("n").alias("end")))).alias("r")).select("k", F.explode("r").alias("r"))
    return out.select("k", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


_OWNERS = "* @all\n/en/ @en\nde/ @de @lead\n*.html @web\n/fr/*5 @five\n# none\nes @es\n"
_PATHOF = r"regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"


@query(
    f"""WITH p AS (SELECT page_id, {_PATHOF} AS path FROM pages) SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)es(/|$)') THEN '@es'
    WHEN regexp_matches(path, '^fr/[^/]*5$') THEN '@five' WHEN regexp_matches(path, '(^|/)[^/]*\\.html$') THEN '@web'
    WHEN regexp_matches(path, '(^|/)de/') THEN '@de @lead' WHEN regexp_matches(path, '^en/') THEN '@en' ELSE '@all' END AS owner FROM p"""
)
def owner_last_match(spark, d):
    rules = spark.createDataFrame(codeowners.parse(_OWNERS), codeowners.RULES)
    paths = read(spark, d, "pages").select("page_id", F.expr(_PATHOF).alias("path"))
    return policy.resolve_owner(paths, rules).select("page_id", "owner")


_PLACES = "chg AS (SELECT DISTINCT concat('a/mod', p_size, '/', lower(replace(p_brand, '#', '')), '.py') AS path FROM part), wanted AS (SELECT DISTINCT concat(CASE WHEN p_partkey % 2 = 0 THEN concat('./mod', p_size, '/') ELSE '' END, lower(replace(p_brand, '#', '')), '.py') AS path FROM part)"


@query(
    f"""WITH {_PLACES}, n AS (SELECT path, regexp_replace(path, '^\\./', '') AS m FROM wanted), c AS (SELECT path AS change_path, substr(path, 3) AS m FROM chg),
    j AS (SELECT n.path, min(CASE WHEN c.m = n.m THEN change_path END) AS exact, count(*) AS k, min(change_path) AS one FROM n JOIN c ON c.m = n.m OR ends_with(c.m, '/' || n.m) GROUP BY 1)
    SELECT wanted.path, coalesce(exact, CASE WHEN k = 1 THEN one END) AS change_path FROM wanted LEFT JOIN j USING (path)"""
)
def unique_suffix_lookup(spark, d):
    p = read(spark, d, "part").withColumn("b", F.concat(F.lower(F.translate("p_brand", "#", "")), F.lit(".py")))
    changes = p.select(F.concat(F.lit("a/mod"), "p_size", F.lit("/"), "b").alias("path"), F.lit(None).cast("string").alias("old_path")).distinct()
    wanted = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("./mod"), "p_size", F.lit("/"), "b")).otherwise(F.col("b")).alias("path")).distinct()
    return diff.find_changes(wanted, changes).select("path", "change_path")


@query("SELECT p_partkey, p_size % 7 = 3 OR p_size % 7 = p_partkey % 7 AS touched FROM part")
def suffix_path_match(spark, d):
    p = read(spark, d, "part")
    changed = F.array(F.lit("a/b/mod3.py"), F.concat(F.lit("mod"), F.col("p_partkey") % 7, F.lit(".py")))
    known = F.array(F.concat(F.lit("b/mod"), F.col("p_size") % 7, F.lit(".py")))
    return p.select("p_partkey", text.touches(changed, known).alias("touched"))


# ---- replies ----------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'model_abstained' WHEN event_id % 9 = 8 THEN 'none' WHEN event_id % 4 = 0 THEN 'no_evidence'
    WHEN (event_id % 100) / 100.0::DOUBLE < 0.55 THEN 'below_confidence_floor' ELSE 'none' END AS downgrade_reason,
    CASE WHEN event_id % 7 = 0 OR event_id % 9 = 8 OR event_id % 4 = 0 OR (event_id % 100) / 100.0::DOUBLE < 0.55 THEN 'UNKNOWN'
    ELSE 'RACE_CONDITION' END AS final_cause FROM events"""
)
def guardrails(spark, d):
    i = F.col("event_id")
    rows = read(spark, d, "events").select(
        "event_id",
        F.when(i % 9 == 8, "UNKNOWN").otherwise("RACE_CONDITION").alias("cause"),
        (i % 100 / F.lit(100.0)).alias("confidence"),
        F.when(i % 4 == 0, F.array(F.lit("  "))).otherwise(F.array(F.lit(" seen "))).alias("evidence"),
        (i % 7 == 0).alias("abstained"),
    )
    return causes.guard(rows, Cause().confidence_floor).select("event_id", "downgrade_reason", "final_cause")


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'unknown_cause' WHEN 3 THEN 'schema_invalid'
    WHEN 4 THEN CASE WHEN (event_id % 100) / 100.0::DOUBLE < 0.55 THEN 'below_confidence_floor' ELSE 'none' END ELSE 'schema_invalid' END AS downgrade_reason FROM events"""
)
def validate_reply(spark, d):
    i = F.col("event_id")
    good = F.concat(F.lit('```json\n{"cause": "RACE_CONDITION", "confidence": '), (i % 100 / F.lit(100.0)).cast("string"), F.lit(', "reasoning": "r", "evidence": ["e"], "suggested_action": "a", "abstained": false}\n```'))
    reply = (
        F.when(i % 6 == 0, " ")
        .when(i % 6 == 1, "{not json")
        .when(i % 6 == 2, '{"cause": "GREMLINS"}')
        .when(i % 6 == 3, '{"cause": "race_condition", "confidence": 0.9}')
        .when(i % 6 == 4, good)
        .otherwise("[1, 2]")
    )
    rows = read(spark, d, "events").select("event_id", reply.alias("reply"))
    return causes.check_replies(rows, Cause().confidence_floor).select("event_id", "downgrade_reason")


@query(
    """SELECT concat('user-', user_id) AS source_file, concat('t', event_id) AS name, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'pass' END AS outcome,
    event_id % 5000 AS duration_ms, CASE WHEN event_type = 'error' THEN concat('m<', event_id, '>') END AS failure_message,
    CASE WHEN event_type = 'error' THEN concat('trace & ', event_id) END AS stack_trace FROM events"""
)
def junit_parse(spark, d):
    """An XML file for each user's events, with escapes; parsed again, the rows are the events."""
    e = read(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('><failure message="m&lt;'), "id", F.lit('&gt;">trace &amp; '), "id", F.lit("</failure></testcase>")))
        .when(F.col("event_type") == "signup", "><skipped/></testcase>")
        .otherwise("/>")
    )
    took = F.format_string("%d.%03d", (F.col("event_id") % 5000 / 1000).cast("int"), F.col("event_id") % 1000)
    case = F.concat(F.lit('<testcase name="t'), "id", F.lit('" time="'), took, F.lit('"'), body)
    files = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(case)), "").alias("x"))
    files = files.select(F.concat(F.lit("user-"), "user_id").alias("origin"), F.encode(F.concat(F.lit('<testsuite name="s">'), "x", F.lit("</testsuite>")), "UTF-8").alias("content"))
    return junit.parse_files(files)[0].select("source_file", "name", "outcome", "duration_ms", "failure_message", "stack_trace")


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber, max(CAST(floor(l_quantity) AS INT)) AS n FROM lineitem WHERE l_quantity >= 1 GROUP BY 1, 2)
    SELECT concat('o', k) AS origin, concat('src/f', k, '.py') AS path, count(*) AS n_ranges, CAST(sum(n) AS BIGINT) AS n_lines FROM l GROUP BY k"""
)
def diff_parse(spark, d):
    """A patch for each order, a bare hunk for each line; hunks that overlap would merge, so they are kept apart."""
    l = read(spark, d, "lineitem").filter("l_quantity >= 1").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("int").alias("n"))
    at = (F.col("l_linenumber") * 1000).cast("string")
    hunk = F.concat(F.lit("@@ -1,0 +"), at, F.lit(","), F.col("n").cast("string"), F.lit(" @@"))
    p = l.groupBy(F.col("l_orderkey").cast("string").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", hunk.alias("h")))), lambda x: x["h"]), "\n").alias("h"))
    head = F.concat(F.lit("diff --git a/src/f"), "k", F.lit(".py b/src/f"), "k", F.lit(".py\n--- a/src/f"), "k", F.lit(".py\n+++ b/src/f"), "k", F.lit(".py\n"), "h")
    changes, _ = diff.parse_patches(p.select(F.concat(F.lit("o"), "k").alias("origin"), head.alias("body")))
    total = F.aggregate("new_ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"] + 1)
    return changes.select("origin", "path", F.size("new_ranges").cast("long").alias("n_ranges"), total.alias("n_lines"))


_LINE = "lower(replace(p_brand, '#', ''))"
_BODY = f"""concat('diff --git a/src/', {_LINE}, p_partkey, '.py b/', CASE p_partkey % 4 WHEN 2 THEN 'new' ELSE 'src' END, '/', {_LINE}, p_partkey, '.py', chr(10),
  CASE p_partkey % 4 WHEN 0 THEN concat('new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/src/', {_LINE}, p_partkey, '.py')
    WHEN 1 THEN concat('deleted file mode 100644', chr(10), '--- a/src/', {_LINE}, p_partkey, '.py', chr(10), '+++ /dev/null')
    WHEN 2 THEN concat('rename from src/', {_LINE}, p_partkey, '.py', chr(10), 'rename to new/', {_LINE}, p_partkey, '.py')
    ELSE concat('Binary files a/src/', {_LINE}, p_partkey, '.py and b/src/', {_LINE}, p_partkey, '.py differ') END, chr(10),
  CASE WHEN p_partkey % 4 < 3 THEN concat('@@ -', p_size, ',4 +', p_size, ',5 @@ def f', chr(10), ' same', chr(10), '-gone', chr(10), '+one', chr(10), '+two', chr(10), '', chr(10), '-last', chr(10), '+x') ELSE '' END)"""


@query(
    f"""SELECT p_partkey % 30 AS origin, concat(CASE p_partkey % 4 WHEN 2 THEN 'new/' ELSE 'src/' END, {_LINE}, p_partkey, '.py') AS path,
    CASE WHEN p_partkey % 4 = 2 THEN concat('src/', {_LINE}, p_partkey, '.py') END AS old_path,
    CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS change_type, p_partkey % 4 = 3 AS is_binary,
    CASE WHEN p_partkey % 4 < 3 THEN concat(p_size + 1, '-', p_size + 2, ',', p_size + 4, '-', p_size + 4) ELSE '' END AS new_ranges,
    CASE WHEN p_partkey % 4 < 3 THEN concat(p_size + 1, '-', p_size + 1, ',', p_size + 3, '-', p_size + 3) ELSE '' END AS old_ranges FROM part"""
)
def diff_files(spark, d):
    """Patches of many files: added, deleted, renamed and binary ones, with lines added, removed and in common."""
    p = read(spark, d, "part").select((F.col("p_partkey") % 30).cast("string").alias("origin"), "p_partkey", F.expr(_BODY.replace("chr(10)", "'\\n'")).alias("b"))
    p = p.groupBy("origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))), lambda x: x["b"]), "\n").alias("body"))
    changes, _ = diff.parse_patches(p)
    spans = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias(c)
    return changes.select(F.col("origin").cast("long").alias("origin"), "path", "old_path", "change_type", F.col("binary").alias("is_binary"), spans("new_ranges"), spans("old_ranges"))
