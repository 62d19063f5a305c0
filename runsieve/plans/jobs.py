"""Whole jobs over a store: ingest, detect, triage, policy, stats."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import log
from ..config import Config
from ..functions import text
from ..operators import history, identity, metrics, policy
from ..sources import diff as diffs
from ..sources import junit
from .store import Store, close_quarantines, new_rows, record_quarantines, run_pk, upsert_identities

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def duration(value: str) -> datetime.timedelta:
    """`30d`, `12h`, `15m` (minutes), `2w`, `90s`, in either case."""
    v = value.strip().lower()
    if len(v) < 2 or v[-1] not in _UNITS or not v[:-1].isdigit():
        raise ValueError(f"not a duration: {value!r}")
    return datetime.timedelta(**{_UNITS[v[-1]]: int(v[:-1])})


def instant(value: str) -> datetime.datetime:
    """ISO 8601 as naive UTC; without a zone it is UTC already."""
    at = datetime.datetime.fromisoformat(value)
    return at.astimezone(datetime.UTC).replace(tzinfo=None) if at.tzinfo else at


def ingest(store: Store, files: DataFrame, run: dict, patches: DataFrame | None = None, config: Config = Config()) -> dict:
    """Put a run's result files (origin, content) and patches into the store; returns counts.

    run: run_id, commit_sha, started_at, and attempt, shard_id, branch,
    worker_id if known.  Ingesting the same run again adds nothing and keeps the
    commit that it first had.
    """
    if not run.get("run_id") or not run.get("commit_sha") or run.get("attempt", 1) < 1:
        raise ValueError("a run needs run_id, commit_sha and an attempt of at least 1")
    spark, today = store.spark, F.current_date().alias("ingest_date")
    row = {k: run.get(k) or "" for k in ("run_id", "shard_id", "commit_sha", "branch", "worker_id")}
    schema = "run_id string, shard_id string, commit_sha string, branch string, worker_id string, attempt int, started_at timestamp_ntz"
    one = spark.createDataFrame([(*row.values(), run.get("attempt", 1), run["started_at"])], schema).withColumn("run_pk", run_pk())
    pk = one.first()["run_pk"]
    store.append("runs", new_rows(one, store.table("runs"), ["run_pk"]).select("*", today))
    cases, warnings = junit.parse_files(files)
    cases = identity.identities(cases).cache()
    seen = cases.select("fingerprint", F.col("suite").alias("suite_path"), "test_name", "parameters", F.col("file").alias("file_path"))
    seen = seen.withColumn("seen_at", F.lit(run["started_at"]).cast("timestamp_ntz"))
    store.replace("identities", upsert_identities(store.table("identities"), seen))
    batch = cases.select(
        F.concat(F.date_format(F.lit(run["started_at"]).cast("timestamp_ntz"), "yyyyMMddHHmmss"), F.lit("-"), F.lit(pk[:12]), F.lit("-"), F.lpad(F.col("position").cast("string"), 9, "0")).alias("execution_id"),
        F.lit(pk).alias("run_pk"),
        "fingerprint",
        "outcome",
        "duration_ms",
        "failure_type",
        "failure_message",
        "stack_trace",
        F.col("rerun_observed").alias("rerun"),
        F.col("file").alias("file_path"),
        "position",
        today,
        "source_file",
    )
    fresh = new_rows(batch, store.table("executions").filter(F.col("run_pk") == pk), ["run_pk", "fingerprint"], ["source_file", "position"]).cache()
    n_cases, n_new = cases.count(), fresh.count()
    store.append("executions", fresh)
    renames = reconcile(store, pk, config)
    if patches is not None:
        changed, more = diffs.parse_patches(patches)
        changed = changed.select(F.lit(run["commit_sha"]).alias("commit_sha"), "*", F.lit(pk).alias("run_pk"), today)
        store.append("changes", new_rows(changed, store.table("changes"), ["run_pk", "path"]))
        warnings = warnings.unionByName(more)
    warnings = warnings.select(F.lit(pk).alias("run_pk"), "*", today)
    known = store.table("warnings").filter(F.col("run_pk") == pk)
    warnings = new_rows(warnings, known, ["run_pk", "origin", "reason", "detail"]).cache()
    n_warnings = warnings.count()
    store.append("warnings", warnings)
    for rows in (cases, fresh, warnings):
        rows.unpersist()
    log.event("ingest", "run ingested", run_pk=pk, cases=n_cases, inserted=n_new, renames=renames, warnings=n_warnings)
    return {"run_pk": pk, "cases": n_cases, "inserted": n_new, "skipped": n_cases - n_new, "renames": renames, "warnings": n_warnings}


def reconcile(store: Store, pk: str, config: Config = Config()) -> int:
    """Aliases between what a run lost and what is new in it."""
    ids, run = store.table("identities"), store.table("runs").filter(F.col("run_pk") == pk)
    started = run.first()["started_at"]
    current = store.executions_of(run).select("run_pk", "fingerprint").distinct()
    edges = identity.reconcile_run(ids, current, started, config.identity)
    number = lambda side: ids.select(F.col("fingerprint").alias(f"{side}_fingerprint"), F.col("test_id").alias(f"{side}_id"))
    edges = edges.join(number("old"), "old_fingerprint").join(number("new"), "new_fingerprint")
    edges = edges.select("old_id", "new_id", (1 - F.col("distance")).alias("similarity"), "certain").cache()
    n = edges.count()
    if n:
        store.replace("aliases", identity.upsert_aliases(store.table("aliases"), edges))
    edges.unpersist()
    return n


def detect(store: Store, since: datetime.datetime | None = None, commit_sha: str | None = None, config: Config = Config()) -> DataFrame:
    """The verdicts, with names; one DataFrame for every report."""
    fact, aliases = store.fact(), store.table("aliases")
    groups = identity.groups(aliases) if aliases.limit(1).count() else None
    changes = diffs.changed_paths(store.table("changes"))
    only = history.failing_at(fact, commit_sha) if commit_sha else None
    out = history.detect(fact, config.detect, since, groups, changes, only)
    ids = store.table("identities").select("test_id", "suite_path", "test_name", "parameters", "file_path")
    return out.join(ids, "test_id").withColumn(
        "display_name", F.concat("suite_path", F.lit("::"), "test_name", F.when(F.col("parameters") != "", F.concat(F.lit("["), "parameters", F.lit("]"))).otherwise(""))
    )


def decisions(store: Store, found: DataFrame, rules: DataFrame, now: datetime.datetime, config: Config = Config(), committers: DataFrame | None = None) -> DataFrame:
    """A quarantine decision for each detection, with its owner."""
    latest = store.table("classifications").groupBy("test_id").agg(F.max_by("cause", "event_no").alias("cause"))
    opened = policy.latest_state(store.table("quarantines")).filter(policy.is_open(F.col("state"))).select("test_id", F.lit(True).alias("already_open"))
    rows = found.join(latest, "test_id", "left").join(opened.distinct(), "test_id", "left")
    rows = policy.decide(rows, config.policy, F.lit(now).cast("timestamp_ntz"))
    return policy.resolve_owner(rows, rules, committers, "file_path")


def apply_policy(store: Store, decided: DataFrame, now: datetime.datetime, config: Config = Config()) -> dict:
    """Expire what is overdue, record recommendations, release what has run clean, in this order."""
    at, count = F.lit(now).cast("timestamp_ntz"), {}
    number = lambda: (store.table("quarantines").agg(F.max("event_no")).first()[0] or 0) + 1

    def add(name, rows):
        rows = rows.cache()
        count[name] = rows.count()
        if count[name]:
            store.append("quarantines", rows)
        rows.unpersist()

    events = store.table("quarantines")
    overdue = policy.latest_state(events).filter(policy.is_open(F.col("state")) & policy.expired(F.col("expires_at"), at))
    add("expired", close_quarantines(events, overdue, "expired", "ttl", at, number()))
    add("recorded", record_quarantines(store.table("quarantines"), decided, at, number()))
    events = store.table("quarantines")
    clean = history.clean_runs(store.fact()).filter(policy.should_release(F.col("clean_runs"), config.policy))
    done = policy.latest_state(events).filter(policy.is_open(F.col("state"))).join(clean, "test_id", "left_semi")
    add("released", close_quarantines(events, done, "released", "clean runs", at, number()))
    return count


def stats(store: Store) -> tuple[DataFrame, DataFrame]:
    """(totals of calls, totals of classifications with their cost), one row each."""
    calls, classified = store.table("calls"), store.table("classifications")
    totals = metrics.classification_totals(classified)
    return metrics.call_totals(calls), totals.join(metrics.cost_per_classification(calls, classified), F.lit(True))


def tallies(store: Store) -> dict[str, DataFrame]:
    """Classifications by cause and by reason to abstain, the most frequent first, and the sizes of all tables."""
    rows = store.table("classifications")
    return {
        "causes": metrics.tally(rows, "cause").orderBy(F.desc("n"), "cause"),
        "reasons": metrics.tally(rows, "downgrade_reason", "none").orderBy(F.desc("n"), "downgrade_reason"),
        "tables": store.counts().orderBy("table"),
    }


def quarantines(store: Store, now: datetime.datetime, config: Config = Config(), open_only: bool = True) -> DataFrame:
    """Quarantines with names, by expiry."""
    at = F.lit(now).cast("timestamp_ntz")
    return policy.listing(store.table("quarantines"), store.table("identities"), at, config.policy.expiring_days, open_only)


def triage(store: Store, found: DataFrame, proposer=None, config: Config = Config(), now: datetime.datetime | None = None, enabled: bool = True) -> DataFrame:
    """Causes for the detections that need one, kept in the store with the calls they took; without a proposer, the keyword guesses."""
    from ..operators import causes  # detection and policy never need it

    todo = history.needs_cause(found)
    made, nothing = None, F.lit(None).cast("string").alias("run_pk")
    if proposer is None:
        out = causes.keyword_classification(todo)
        empty = F.array().cast("array<string>")
        out = out.withColumns({"reasoning": F.lit(""), "evidence": empty, "suggested_action": F.lit(""), "cache_hit": F.lit(False)})
    else:
        out = made = causes.propose(todo, proposer, config.cause, store.table("replies"), enabled, store.table("changes")).persist()
        store.append("replies", causes.keep_replies(out).dropDuplicates(["context_key"]))
        store.append("calls", causes.model_calls(out).select(nothing, "*", F.current_date().alias("ingest_date")))
        took = metrics.proposal_totals(out).first().asDict()
        log.event("triage", "causes proposed", **took)
    number = (store.table("classifications").agg(F.max("event_no")).first()[0] or 0) + 1
    rows = out.withColumns({"run_pk": F.lit(None).cast("string"), "event_no": F.lit(number).cast("long"), "ingest_date": F.current_date()})
    store.append("classifications", rows)
    if made is not None:
        made.unpersist()
    return store.table("classifications").filter(F.col("event_no") == number)


def triage_from_config(store: Store, found: DataFrame, config: Config = Config(), clients: dict | None = None) -> DataFrame:
    """triage() with the proposer that the settings name: `keywords`, or one of clients by the model's name."""
    if config.cause.model == "keywords":
        return triage(store, found, None, config)
    client = (clients or {}).get(config.cause.model)
    if client is None:
        raise ValueError(f"no client for the model {config.cause.model!r}")
    return triage(store, found, client, config)


def guesses(examples: DataFrame) -> DataFrame:
    """(id, truth, predicted, adversarial): labelled examples with the keyword guess."""
    guess = text.keyword_cause(
        F.col("failure_type"), F.col("failure_message"), F.col("stack_trace"), F.size(F.coalesce("history.failing_shards", F.array().cast("array<string>")))
    )
    return examples.select("id", F.col("label").alias("truth"), guess.alias("predicted"), F.coalesce("adversarial", F.lit(False)).alias("adversarial"))


def evaluate(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, class scores) of the keyword rules on labelled examples."""
    rows = guesses(examples)
    return metrics.report_scores(rows), metrics.class_scores(rows)
