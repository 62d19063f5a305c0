import datetime
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from runsieve import log
from runsieve.config import Cause, Config
from runsieve.functions import series, text
from runsieve.operators import causes, metrics, policy
from runsieve.plans import jobs, render
from runsieve.plans.store import Store

NOW = datetime.datetime(2024, 5, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_refusals_in_order(spark):
    rows = [
        ("regression", "INFRA_FLAKE", True, 1, 0.0, "verdict_regression"),
        ("new_failure", "REAL_REGRESSION", True, 1, 0.0, "verdict_ineligible"),
        ("healthy", "REAL_REGRESSION", True, 1, 0.0, "cause_regression"),
        ("healthy", "INFRA_FLAKE", True, 1, 0.0, "cause_infra"),
        ("healthy", None, True, 1, 0.0, "not_flaky"),
        ("flaky", None, True, 1, 0.0, "already_quarantined"),
        ("flaky", "RACE_CONDITION", False, 9, 0.0, "insufficient_observations"),
        ("flaky", None, None, 10, 0.05, "below_threshold"),
        ("flaky", None, None, 10, 0.051, None),
    ]
    df = spark.createDataFrame(rows, "verdict string, cause string, already_open boolean, observations long, flake_rate double, want string")
    got = policy.reason(policy.decide(df, now=F.lit(NOW).cast("timestamp_ntz"))).collect()
    assert [r["refusal"] for r in got] == [r[-1] for r in rows]
    assert got[-1]["expires_at"] == NOW + datetime.timedelta(days=14) and got[-1]["reason"].startswith("quarantine")


def test_expiry(spark):
    df = spark.createDataFrame([(str(NOW + datetime.timedelta(days=n)),) for n in (-1, 0, 1, 10)] + [("junk",), (None,)], "at string")
    at = F.lit(NOW)
    got = df.select(policy.expiring(F.col("at"), at), policy.expired(F.col("at"), at)).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (True, False), (False, False), (False, False), (False, False)]


GOOD = {"cause": "RACE_CONDITION", "confidence": 0.9, "reasoning": "r", "evidence": [" e ", ""], "suggested_action": "a", "abstained": False}


@pytest.mark.parametrize(
    ("reply", "reason"),
    [
        (None, "empty_response"),
        (" ", "empty_response"),
        ("{", "invalid_json"),
        ("[]", "schema_invalid"),
        ("3", "schema_invalid"),
        (json.dumps(GOOD | {"cause": "GHOSTS"}), "unknown_cause"),
        (json.dumps(GOOD | {"cause": "race_condition"}), "schema_invalid"),
        (json.dumps(GOOD | {"cause": 5}), "schema_invalid"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "evidence"}), "schema_invalid"),
        (json.dumps(GOOD | {"confidence": 1.5}), "schema_invalid"),
        (json.dumps(GOOD | {"reasoning": "x" * 601}), "schema_invalid"),
        (json.dumps(GOOD | {"evidence": [1]}), "schema_invalid"),
        (json.dumps(GOOD | {"abstained": True}), "model_abstained"),
        (json.dumps(GOOD | {"cause": "UNKNOWN"}), "none"),
        (json.dumps(GOOD | {"evidence": ["  "]}), "no_evidence"),
        (json.dumps(GOOD | {"confidence": 0.54}), "below_confidence_floor"),
        (json.dumps(GOOD | {"confidence": "0.55"}), "none"),
        ("```json\n" + json.dumps(GOOD) + "\n```", "none"),
    ],
)
def test_replies(reply, reason):
    got = causes.check_reply(reply)
    assert got["downgrade_reason"] == reason
    assert (got["cause"] == "RACE_CONDITION") == (reason == "none" and not got["abstained"])


class Scripted:
    """Replies in turn; every call costs 0.2."""

    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, context, failure):
        return {"reply": self.replies.pop(0), "cost": 0.2}


SEEN = "test_id long, verdict string, flake_rate double, observations long, signals array<struct<signal:string,observations:bigint>>, failure_type string, failure_message string, stack_trace string, failing_shards array<string>"


def detections(spark, n):
    return spark.createDataFrame([(k, "flaky", 0.9 - k / 10, 10, [], None, f"m{k}", None, []) for k in range(n)], SEEN)


def test_proposals(spark):
    found = detections(spark, 4)
    plain = Cause(gate_enabled=False)
    got = {r["test_id"]: r for r in causes.propose(found, Scripted("{", json.dumps(GOOD), json.dumps(GOOD)), plain).collect()}
    assert (got[0]["cause"], got[0]["calls"]) == ("RACE_CONDITION", 2)  # repaired once; 0.4 are spent
    assert [got[k]["downgrade_reason"] for k in (1, 2, 3)] == ["budget_exhausted"] * 3
    off = causes.propose(found, Scripted(), plain, enabled=False).collect()
    assert {r["downgrade_reason"] for r in off} == {"llm_disabled"}
    few = causes.propose(found, Scripted(json.dumps(GOOD)), Cause(gate_enabled=False, max_tests=1)).collect()
    assert sorted(r["downgrade_reason"] for r in few) == ["budget_exhausted"] * 3 + ["none"]
    kept = causes.keep_replies(causes.propose(found.limit(1), Scripted(json.dumps(GOOD)), plain))
    again = causes.propose(found.limit(1), Scripted(), plain, cache=spark.createDataFrame(kept.collect(), kept.schema)).first()
    assert again["cache_hit"] and again["cause"] == "RACE_CONDITION"
    gated = causes.propose(found.limit(1), Scripted("false"), Cause()).first()
    assert gated["downgrade_reason"] == "prefiltered"


def plain_shorten(trace, budget, share, own):
    """What the fold should give, by plain loops over the lines."""
    whole = (trace or "").strip()
    if len(whole) <= budget:
        return whole
    lines = whole.split("\n")
    cut = next((k for k in range(len(lines)) if sum(len(x) + 1 for x in lines[: k + 1]) > int(budget * share)), len(lines))
    spent, rest = sum(len(x) + 1 for x in lines[:cut]), []
    for line in (x for x in lines[cut:] if own(x)):
        spent += len(line) + 1
        if spent > budget:
            break
        rest.append(line)
    return "\n".join([*lines[:cut], *([causes.LEFT_OUT, *rest] if rest else [])])


def test_shortened_traces(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["Error: x", "    at node_modules/a.js:1", "    at src/own.js:5", "in lib/site-packages/q.py", "  web/b.ts line 3"])
    traces = ["\n".join(line() for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, " a ", "x" * 300]
    df = spark.createDataFrame(list(enumerate(traces)), "k int, t string")
    own = lambda x: "src/" in x or "web/" in x
    for budget in (120, 200):
        got = [r[0] for r in df.orderBy("k").select(causes.shorten(F.col("t"), budget, 0.6)).collect()]
        assert got == [plain_shorten(t, budget, 0.6, own) for t in traces]


def test_calls_are_recorded_and_priced(spark, tmp_path):
    """Tokens become costs by the first price that matches, and triage keeps the calls beside the classifications."""
    class Told:
        def complete(self, context, failure):
            reply = "yes" if failure["kind"] == "gate" else json.dumps(GOOD)
            return {"reply": reply, "input_tokens": 1000, "output_tokens": 100, "latency_ms": 7.0, "model": "big-1" if failure["kind"] == "classify" else None}

    conf = Cause(prices={"big": (3.0, 15.0), "gate": (1.0, 5.0)})
    store = Store(spark, str(tmp_path / "s"))
    found = detections(spark, 2).withColumns({"latest_sha": F.lit("c"), "footprint": F.array(F.lit("a.py"))})
    kept = jobs.triage(store, found, Told(), Config(cause=conf))
    assert kept.count() == 2 and store.table("calls").count() == 4
    total = jobs.stats(store)
    got = total[0].first()
    assert (got["calls"], got["input_tokens"], got["errors"], got["p50_ms"]) == (4, 4000, 0, 7.0) and abs(got["cost_usd"] - 2 * (0.0045 + 0.0015)) < 1e-12
    assert abs(total[1].first()["cost_per_classification"] - 0.006) < 1e-12
    again = jobs.triage(store, found, Scripted(), Config(cause=conf))
    assert again.filter("cache_hit").count() == 2 and store.table("calls").count() == 4
    sizes = {r["table"]: r["n"] for r in jobs.tallies(store)["tables"].collect()}
    assert sizes["calls"] == 4 and sizes["classifications"] == 4 and sizes["runs"] == 0
    with pytest.raises(ValueError, match="no client"):
        jobs.triage_from_config(store, found, Config(cause=Cause(model="m")))


def test_corrupt_cache_entries_are_misses(spark):
    found = detections(spark, 1)
    plain = Cause(gate_enabled=False)
    key = causes.context(found, plain).first()["context_key"]
    cache = spark.createDataFrame([(key, "{broken")], "context_key string, reply string")
    got = causes.propose(found, Scripted(json.dumps(GOOD)), plain, cache=cache).first()
    assert not got["cache_hit"] and got["cause"] == "RACE_CONDITION" and got["calls"] == 1


def test_context_has_its_sections(spark):
    found = detections(spark, 3).withColumns(
        {"latest_sha": F.concat(F.lit("c"), "test_id"), "footprint": F.when(F.col("test_id") < 2, F.array(F.lit("src/a.py"), F.lit("b.py"))).otherwise(F.array().cast("array<string>")), "retry_data": F.lit(True), "divergence_rate": F.lit(0.25), "windows": F.lit(4), "merged_uncertain": F.lit(True), "confidence": F.lit("low")}
    )
    span = "array<struct<start:bigint,end:bigint>>"
    changes = spark.createDataFrame(
        [("c0", "src/a.py", None, "modified", [(3, 5), (9, 9)]), ("c0", "lib/b.py", None, "added", []), ("c0", "x/b.py", None, "added", []), ("c1", "other.py", None, "modified", [])],
        f"commit_sha string, path string, old_path string, change_type string, new_ranges {span}",
    )
    sources = spark.createDataFrame([(0, "def test(): pass")], "test_id long, source string")
    got = {r["test_id"]: r["context"] for r in causes.context(found, Cause(), changes, sources).collect()}
    assert "## changes\n- src/a.py: modified, lines 3-5, 9-9\n\n## source\ndef test" in got[0]  # two files end in b.py
    assert "no file that this failure names was changed" in got[1] and "## changes" not in got[2]
    assert "90.0% of 10 observations on 4 commits" in got[0] and "25.0% of the commits" in got[0] and "guessed" in got[0] and "## source" not in got[1]


def test_small_predicates(spark):
    row = spark.createDataFrame([(("RACE_CONDITION", False), (3, 5), (5, 9), (6, 7))], "c struct<cause:string,gone:boolean>, a struct<start:int,end:int>, b struct<start:int,end:int>, d struct<start:int,end:int>")
    got = row.select(
        causes.is_actionable(F.col("c.cause"), F.col("c.gone")),
        causes.is_actionable(F.lit("REAL_REGRESSION"), F.lit(False)),
        series.contains(F.col("a"), F.lit(5)),
        series.contains(F.col("a"), F.lit(6)),
        series.overlaps(F.col("a"), F.col("b")),
        series.overlaps(F.col("a"), F.col("d")),
        text.initialism(F.lit("TEST_ORDER_DEPENDENCY")),
    ).first()
    assert tuple(got) == (True, False, True, False, True, False, "TOD")
    refused = spark.createDataFrame([("not_flaky",), ("below_threshold",), (None,), ("verdict_ineligible",)], "refusal string")
    assert [r[0] for r in policy.notable(refused).collect()] == ["below_threshold"]


def test_comparisons_and_maps(spark):
    rows = spark.createDataFrame([("1", "UNKNOWN", "UNKNOWN", False), ("2", "INFRA_FLAKE", "UNKNOWN", True), ("3", "INFRA_FLAKE", "INFRA_FLAKE", False)], "id string, truth string, predicted string, adversarial boolean")
    scores, totals = metrics.class_scores(rows), metrics.report_scores(rows)
    other = metrics.class_scores(rows.withColumn("predicted", F.lit("UNKNOWN")))
    assert [r["class"] for r in metrics.where_better(scores, other).collect()] == ["INFRA_FLAKE"]
    took = causes.propose(detections(spark, 2), Scripted("{", json.dumps(GOOD), json.dumps(GOOD)), Cause(gate_enabled=False, budget_usd=9.0))
    run = metrics.proposal_totals(spark.createDataFrame(took.collect(), took.schema))
    r = run.first()
    assert (r["proposals"], r["calls"], r["repairs"], r["schema_failures"]) == (2, 3, 1, 0) and abs(r["mean_cost_usd"] - 0.3) < 1e-12
    out = render.as_scores(scores, totals, rows, other, run)
    assert "| INFRA_FLAKE | IF 1, U 1 |" in out and "- 2: INFRA_FLAKE, predicted UNKNOWN" in out and "better than the other at INFRA_FLAKE" in out and "| repairs | 1 |" in out
    m = metrics.as_map(rows, "predicted").first()
    assert m["counts"] == {"UNKNOWN": 2, "INFRA_FLAKE": 1} and m["ranked"] == ["UNKNOWN", "INFRA_FLAKE"]


def test_quarantine_listing(spark):
    at = lambda d: NOW + datetime.timedelta(days=d)
    events = [("a", 1, "recommended", at(9), 1), ("b", 2, "active", at(2), 2), ("c", 1, "recommended", at(5), 1), ("c", 1, "released", at(5), 3), ("d", 9, "active", at(1), 1)]
    df = spark.createDataFrame(events, "record_id string, test_id long, state string, expires_at timestamp_ntz, event_no long")
    ids = spark.createDataFrame([(1, "s/a", "t1", ""), (2, "s/b", "t2", "x=1")], "test_id long, suite_path string, test_name string, parameters string")
    listed = policy.listing(df, ids, F.lit(NOW).cast("timestamp_ntz"))
    assert [(r["record_id"], r["expiring"]) for r in listed.collect()] == [("b", True), ("a", False)]
    assert render.as_quarantines(listed).splitlines()[0].endswith("s/b::t2[x=1]  active  (ends soon)")
    assert policy.listing(df, ids, F.lit(NOW).cast("timestamp_ntz"), open_only=False).count() == 3


def test_keyword_causes(spark):
    rows = [("", "No space left on device", "", ["a"]), (None, "OutOfMemoryError", None, []), (None, "status code 503", None, []), ("KeyError", "", "", []), (None, "odd", None, ["s1"]), (None, "odd", None, ["a", "b"]), (None, None, None, ["s1"])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "test_id int, failure_type string, failure_message string, stack_trace string, failing_shards array<string>")
    got = [r["cause"] for r in causes.keyword_classification(df).orderBy("test_id").collect()]
    assert got == ["INFRA_FLAKE", "RESOURCE_EXHAUSTION", "EXTERNAL_DEPENDENCY", "TEST_ORDER_DEPENDENCY", "TEST_ORDER_DEPENDENCY", "UNKNOWN", "UNKNOWN"]


def test_nearest_rank_and_zero_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    got = metrics.nearest_rank(df.filter("x <> 2 OR x IS NULL"), "x", {"a": 0.5, "b": 0.95}).first()
    assert tuple(got) == (3.0, 4.0)
    assert tuple(metrics.nearest_rank(df, "x", {"a": 0.0, "b": 0.5, "c": 0.62, "d": 1.0}).first()) == (1.0, 2.0, 2.0, 4.0)
    assert tuple(metrics.nearest_rank(df.limit(0), "x", {"a": 0.5}).first()) == (0.0,)
    none = spark.createDataFrame([], "truth string, predicted string, adversarial boolean")
    assert metrics.report_scores(none).first()["accuracy"] == 0.0
    assert metrics.macro_f1(metrics.class_scores(none)).first()[0] == 0.0


def test_reports(spark, tmp_path):
    rows = [(f"t{k}", v, "high", 0.123456, 0.0, 0.0, 5, []) for k, v in enumerate(("healthy", "flaky", "regression"))]
    df = spark.createDataFrame(rows, "test_id string, verdict string, confidence string, flake_rate double, divergence_rate double, intermittency_rate double, observations long, signals array<struct<signal:string,observations:bigint>>")
    data = json.loads(render.as_json(df))
    assert [r["test_id"] for r in data["detections"]] == ["t2", "t1", "t0"] and data["detections"][0]["flake_rate"] == 0.1235
    found = spark.createDataFrame([("t2", "REAL_REGRESSION", 0.9)], "test_id string, cause string, confidence double")
    said = render.as_markdown(df, rows=1, causes=found)
    assert "`t2` | regression" in said and "| REAL_REGRESSION |" in said and "1 further" in said and "t0" not in said and "1 regression, 1 flaky" in said
    assert "only the first 1" in render.as_table(df, True, rows=1)
    render.write_json(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["test_id"] for r in lines] == ["t2", "t1", "t0"] and lines[0]["flake_rate"] == 0.1235
    assert render.as_table(df).splitlines()[1].startswith("regression")
    assert "runsieve_total 3\n" in render.as_prometheus(df.selectExpr("'x' AS verdict", "false AS merged_uncertain").agg(F.count("*").alias("total")))


def test_reply_schema_and_logs(capsys):
    assert set(causes.reply_schema()["properties"]) == set(GOOD) and set(causes.GUIDANCE) == set(causes.CAUSES)
    assert causes.instructions_version() == causes.instructions_version()
    log.configure()
    log.event("x", "done", n=3)
    assert json.loads(capsys.readouterr().err)["n"] == 3


def test_listing_is_numbered_by_days(spark):
    at = [None if k % 11 == 0 else datetime.datetime(2024, 1, 1 + k * 7 % 5, k % 3) for k in range(60)]
    events = spark.createDataFrame([(k, k % 4, ("active", "released")[k % 6 == 0], t, 1) for k, t in enumerate(at)], "record_id long, test_id long, state string, expires_at timestamp_ntz, event_no long")
    ids = spark.createDataFrame([(k, "", f"t{k}", "") for k in range(4)], "test_id long, suite_path string, test_name string, parameters string")
    got = policy.numbered_listing(events, ids, F.lit(datetime.datetime(2024, 1, 2)).cast("timestamp_ntz"))
    listed = policy.listing(events, ids, F.lit(datetime.datetime(2024, 1, 2)).cast("timestamp_ntz")).collect()
    assert [r["record_id"] for r in got.orderBy("place").collect()] == [r["record_id"] for r in listed]
    assert sorted(r["place"] for r in got.collect()) == list(range(1, len(listed) + 1))
    assert "windowspecdefinition(day" in got._jdf.queryExecution().executedPlan().toString()  # no task has all rows
