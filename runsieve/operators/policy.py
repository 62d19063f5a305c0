"""Quarantine decisions, owners and the life of quarantines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Policy

from ..schemas import OPEN_STATES


def decide(rows: DataFrame, config: Policy = Policy(), now: Column | None = None) -> DataFrame:
    """rows (verdict, cause, already_open, observations, flake_rate) with recommended, refusal, expires_at.

    The first reason to refuse counts.
    """
    now = F.current_timestamp() if now is None else now
    refusal = (
        F.when(F.col("verdict") == "regression", "verdict_regression")
        .when(F.col("verdict") == "new_failure", "verdict_ineligible")
        .when(F.col("cause") == "REAL_REGRESSION", "cause_regression")
        .when(F.col("cause") == "INFRA_FLAKE", "cause_infra")
        .when(F.col("verdict") != "flaky", "not_flaky")
        .when(F.coalesce("already_open", F.lit(False)), "already_quarantined")
        .when(F.col("observations") < config.quarantine_min_observations, "insufficient_observations")
        .when(F.col("flake_rate") <= config.quarantine_flake_rate, "below_threshold")
    )
    out = rows.withColumn("refusal", refusal).withColumn("recommended", F.col("refusal").isNull())
    expires = now + F.make_dt_interval(F.lit(config.quarantine_ttl_days))
    return out.withColumns(
        {
            "expires_at": F.when(F.col("recommended"), expires),
            "exit_condition": F.when(F.col("recommended"), F.lit(f"{config.dequarantine_clean_runs} consecutive clean runs")),
        }
    )


def notable(decisions: DataFrame) -> DataFrame:
    """Refusals worth showing."""
    return decisions.filter(F.col("refusal").isNotNull() & ~F.col("refusal").isin("not_flaky", "verdict_ineligible"))


def is_open(state: Column) -> Column:
    return state.isin(*OPEN_STATES)


def expiring(expires_at: Column, now: Column, days: int = 3) -> Column:
    return F.coalesce(F.try_to_timestamp(expires_at.cast("string")) <= now + F.make_dt_interval(F.lit(days)), F.lit(False))


def expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(expires_at.cast("string")) <= now, F.lit(False))


def should_release(clean_runs: Column, config: Policy = Policy()) -> Column:
    return clean_runs >= config.dequarantine_clean_runs


def owner_regex(pattern: str) -> str | None:
    """A code-owner pattern as a regular expression to be found in a path; None matches nothing.

    The pattern is read folder by folder, as the published rules have it: `**`
    stands for any folders, `*` for anything within a name; a slash in front ties
    to the root, one at the end means all below; a pattern without `*` names a
    file or a folder with all below it.
    """
    given = pattern.strip()
    if given in ("", "*"):
        return None if not given else ""
    names = given.strip("/").split("/")
    open_end = given.endswith("/")
    steps = []
    for depth, name in enumerate(names):
        last = depth == len(names) - 1
        if name == "**" and not last:
            steps.append("(?:[^/]+/)*")
            continue
        pieces = [".*".join(re.escape(x) for x in part.split("**")) if "**" in part else re.escape(part) for part in _stars(name)]
        steps.append("[^/]*".join(pieces) + ("" if last else "/"))
    if open_end:
        end = "/"
    else:
        end = "$" if "*" in given else "(/|$)"
    return ("^" if given.startswith("/") else "(^|/)") + "".join(steps) + end


def _stars(name: str) -> list[str]:
    """What single stars part; double ones stay."""
    return [x.replace("\0", "**") for x in name.replace("**", "\0").split("*")]


def owners(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """paths with owners and rule_no: of the rules (rule_no, regex, owners) that a path meets, the last.

    A code-owners file holds few rules: they become one expression, the last rule first.
    """
    own = F.ltrim(F.translate(F.col(path_col), "\\", "/"), F.lit("./"))
    hit = F.lit(None).cast("struct<owners:array<string>,rule_no:int>")
    for r in rules.orderBy("rule_no").collect():  # the lines of one file
        found = F.struct(F.array(*[F.lit(o) for o in r["owners"]]).alias("owners"), F.lit(r["rule_no"]).alias("rule_no"))
        hit = F.when(own.rlike(r["regex"]), found).otherwise(hit)
    out = paths.withColumn("_hit", hit)
    return out.withColumns({"owners": F.col("_hit.owners"), "rule_no": F.col("_hit.rule_no")}).drop("_hit")


def resolve_owner(paths: DataFrame, rules: DataFrame, committers: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """paths with owner and where it comes from: the rules, else the last committer, else nowhere."""
    out = owners(paths, rules, path_col)
    if committers is None:
        out = out.withColumn("committer", F.lit(None).cast("string"))
    else:
        out = out.join(committers.select(F.col("path").alias(path_col), "committer"), path_col, "left")
    named = F.size(F.coalesce("owners", F.array().cast("array<string>"))) > 0
    return out.withColumns(
        {
            "owner": F.when(named, F.array_join("owners", " ")).otherwise(F.col("committer")),
            "owner_source": F.when(named, "codeowners").when(F.col("committer").isNotNull(), "last_committer").otherwise("unresolved"),
        }
    )


def latest_state(events: DataFrame) -> DataFrame:
    """The last event (by event_no) of each quarantine (record_id)."""
    return events.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "record_id"]), "event_no").alias("e")).select("record_id", "e.*")


def listing(events: DataFrame, identities: DataFrame, now: Column, days: int = 3, open_only: bool = True) -> DataFrame:
    """Quarantines with the names of their tests, by expiry and record; expiring says which end within so many days."""
    rows = latest_state(events)
    rows = rows.filter(is_open(F.col("state"))) if open_only else rows
    return _listed(rows, identities, now, days).orderBy("expires_at", "record_id")


def _listed(rows: DataFrame, identities: DataFrame, now: Column, days: int) -> DataFrame:
    rows = rows.join(identities.select("test_id", "suite_path", "test_name", "parameters"), "test_id")
    return rows.withColumn("expiring", is_open(F.col("state")) & expiring(F.col("expires_at"), now, days))


def numbered_listing(events: DataFrame, identities: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """The open quarantines of listing with their places in it, from 1: numbered day by day, after all of the days before."""
    rows = latest_state(events).filter(is_open(F.col("state"))).withColumn("day", F.to_date("expires_at"))
    rows = _listed(rows, identities, now, days)
    sums = rows.groupBy("day").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("day")) - F.col("n")  # days, not quarantines
    sums = sums.select(F.col("day").alias("of"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("day").orderBy("expires_at", "record_id"))
    out = rows.withColumn("own", own).join(sums, F.col("day").eqNullSafe(F.col("of")))
    return out.withColumn("place", F.col("before") + F.col("own")).drop("day", "of", "before", "own")


def reason(rows: DataFrame) -> DataFrame:
    """rows with a sentence for each decision."""
    said = F.when(
        F.col("recommended"), F.concat(F.lit("quarantine: flaky over "), F.col("observations").cast("string"), F.lit(" observations"))
    ).otherwise(F.concat(F.lit("no quarantine: "), F.regexp_replace("refusal", "_", " ")))
    return rows.withColumn("reason", said)


