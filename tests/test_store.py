import datetime

import pytest

from runsieve.operators import metrics, policy
from runsieve.plans import jobs, render
from runsieve.plans.store import Store
from runsieve.sources import codeowners, diff

T0 = datetime.datetime(2024, 1, 1)


def xml(*cases):
    body = "".join(f'<testcase classname="pkg.mod" name="{n}">{"" if o == "pass" else f"<{o} message=%r/>" % "m"}</testcase>' for n, o in cases)
    return f'<testsuite name="s" file="tests/t.py">{body}</testsuite>'.replace("'", '"').encode()


def put(store, n, *cases, sha=None, **more):
    files = store.spark.createDataFrame([(f"f{n}.xml", bytearray(xml(*cases)))], "origin string, content binary")
    return jobs.ingest(store, files, {"run_id": f"r{n}", "commit_sha": sha or f"c{n}", "started_at": T0 + datetime.timedelta(hours=n), "branch": "main"} | more)


def test_from_files_to_verdicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = put(store, 0, ("test_a", "pass"), ("test_a", "failure"), ("test_long_name_one", "pass"))
    assert (first["cases"], first["inserted"], first["skipped"]) == (3, 2, 1)
    store.append("warnings", spark.createDataFrame([(first["run_pk"], "f0.xml", "odd", None, T0.date())], store.table("warnings").schema))
    again = put(store, 0, ("test_a", "failure"), sha="other")
    assert (again["inserted"], store.table("runs").count(), store.table("runs").first()["commit_sha"]) == (0, 1, "c0")
    put(store, 1, ("test_a", "failure"), ("test_long_name_one", "pass"), sha="c0", attempt=2)
    renamed = put(store, 2, ("test_a", "pass"), ("test_long_name_two", "pass"))
    assert renamed["renames"] == 1
    found = jobs.detect(store)
    got = {r["test_name"]: (r["verdict"], r["observations"], r["merged_uncertain"]) for r in found.collect()}
    assert got == {"test_a": ("flaky", 3, False), "test_long_name_two": ("healthy", 3, True)}
    assert [r["test_name"] for r in jobs.detect(store, commit_sha="c0").collect()] == ["test_a"]
    assert jobs.detect(store, since=T0 + datetime.timedelta(days=1)).count() == 0
    assert "test_a" in render.as_markdown(found, name="display_name")
    rules = spark.createDataFrame(codeowners.parse("tests/ @team"), codeowners.RULES)
    decided = jobs.decisions(store, found, rules, T0)
    row = decided.filter("test_name = 'test_a'").first()
    assert (row["refusal"], row["owner"], row["owner_source"]) == ("insufficient_observations", "@team", "codeowners")
    forced = decided.filter("test_name = 'test_a'").selectExpr("test_id", "TIMESTAMP_NTZ '2024-01-02' AS expires_at", "true AS recommended")
    assert jobs.apply_policy(store, forced, T0)["recorded"] == 1
    assert jobs.apply_policy(store, forced, T0)["recorded"] == 0  # one open quarantine a test
    assert jobs.apply_policy(store, forced.limit(0), T0 + datetime.timedelta(days=2))["expired"] == 1
    assert [r["state"] for r in policy.latest_state(store.table("quarantines")).collect()] == ["expired"]
    assert jobs.stats(store)[0].first()["calls"] == 0


def test_repeated_ingest_changes_nothing(spark, tmp_path):
    """Warnings with null details too; small tables come in numbered versions, of which the last two stay."""
    store = Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("bad.xml", bytearray(b"<testsuite>")), ("none.xml", None)], "origin string, content binary")
    run = {"run_id": "r", "commit_sha": "c", "started_at": T0}
    patches = diff.read_patches(spark, str(tmp_path / "missing.patch"))
    for n in range(4):
        got = jobs.ingest(store, files, run, patches)
        assert got["warnings"] == (0 if n else store.table("warnings").count()) and got["inserted"] == 0
    reasons = [r["reason"] for r in store.table("warnings").collect()]
    assert sorted(reasons) == ["malformed_xml", "unreadable_file", "unreadable_file"]
    assert [p.name for p in sorted((tmp_path / "store" / "identities").glob("v-*"))] == ["v-0000000003", "v-0000000004"]


def test_newest_version_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n in range(3):  # within the clock's grain
        store.replace("aliases", spark.createDataFrame([(n, n + 1, 0.5, True)], store.table("aliases").schema))
        assert store.table("aliases").first()["old_id"] == n
    (tmp_path / "store" / "aliases" / "v-0000000009").mkdir()  # a version that was not written whole
    assert store.table("aliases").first()["old_id"] == 2


def test_lookups(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pk = put(store, 0, ("test_a", "pass"), ("test_b", "failure"))["run_pk"]
    put(store, 1, ("test_a", "pass"))
    one = spark.createDataFrame([(pk,)], "run_pk string")
    assert store.executions_of(one).count() == 2
    prints = store.table("identities").select("fingerprint").unionByName(spark.createDataFrame([("none",)], "fingerprint string"))
    assert sorted(str(r["test_name"]) for r in store.identities_of(prints).collect()) == ["None", "test_a", "test_b"]
    ids = store.table("identities").select("test_id")
    assert store.identities_of(ids).count() == 2
    ex = store.table("executions").join(store.table("identities"), "fingerprint").select("run_pk", "test_id")
    seen = {r["test_id"]: r["last_seen"] for r in metrics.last_seen(ex, store.table("runs"), T0 + datetime.timedelta(hours=1)).collect()}
    assert set(seen.values()) == {T0} and len(seen) == 2
    assert jobs.quarantines(store, T0).count() == 0


def test_late_runs_move_the_first_sight(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    put(store, 5, ("test_a", "pass"))
    put(store, 2, ("test_a", "pass"))
    row = store.table("identities").first()
    assert (row["first_seen"], row["last_seen"]) == (T0 + datetime.timedelta(hours=2), T0 + datetime.timedelta(hours=5))


def test_newer_store_is_refused(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "m.json").write_text('{"version": 99}\n')
    with pytest.raises(ValueError, match="99"):
        Store(spark, str(tmp_path))


def test_bad_runs_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        put(Store(spark, str(tmp_path / "s")), 0, ("a", "pass"), attempt=0)
