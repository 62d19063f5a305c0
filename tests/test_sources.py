import pandas as pd
import pytest

from runsieve.config import load
from runsieve.functions.series import merge_ranges
from runsieve.plans import jobs
from runsieve.sources import codeowners, diff, junit

PYTEST = b"""<testsuites><testsuite name="unit" file="tests/test_a.py">
<testcase classname="tests.test_a" name="test_x[1-2]" time="1,5" line="7"/>
<testcase classname="tests.test_a" name="test_y" time="NaN"><failure type="AssertionError" message="boom">File "src/a.py", line 3</failure><system-err>own</system-err></testcase>
<testcase classname="tests.test_a" name="test_z"><error message="dead"/></testcase>
<testcase classname="tests.test_a" name="test_s" time="inf"><skipped/></testcase>
<system-err>shared</system-err></testsuite></testsuites>"""
NESTED = b"""<r:testsuite xmlns:r="urn:x" name="outer" file="spec.ts"><r:testsuite name="inner">
<r:testcase name="adds"/><r:testcase name="fails"><r:failure>text only</r:failure></r:testcase></r:testsuite></r:testsuite>"""
SUREFIRE = b"""<testsuite name="com.x.OrderTest"><properties/><testcase classname="com.x.OrderTest" name="again" time="0">
<flakyFailure message="first time" type="T">trace</flakyFailure></testcase></testsuite>"""


def test_dialects():
    cases, warnings = junit.parse(PYTEST, "p.xml")
    assert not warnings and [c["outcome"] for c in cases] == ["pass", "fail", "error", "skip"]
    assert [c["duration_ms"] for c in cases] == [1500, None, None, None]
    assert [c["stderr"] for c in cases] == ["shared", "own", "shared", "shared"]
    assert cases[1]["stack_trace"] == 'File "src/a.py", line 3' and cases[0]["line"] == 7 and cases[0]["file_path"] == "tests/test_a.py"
    cases, _ = junit.parse(NESTED)
    assert [(c["suite_path"], c["file_path"], c["outcome"]) for c in cases] == [("outer/inner", "spec.ts", "pass"), ("outer/inner", "spec.ts", "fail")]
    case = junit.parse(SUREFIRE)[0][0]
    assert case["rerun_observed"] and case["outcome"] == "pass" and case["failure_message"] == "first time"


@pytest.mark.parametrize(
    ("content", "n", "reason"),
    [
        (b"  \n", 0, "empty_file"),
        (b"<!doctype x><testsuite/>", 0, "doctype_rejected"),
        (b"hello", 0, "not_xml"),
        (b"<testsuite/>", 0, "no_testcases"),
        (PYTEST[: PYTEST.index(b"test_z")], 2, "malformed_xml"),
    ],
)
def test_broken_files(content, n, reason):
    cases, warnings = junit.parse(content)
    assert len(cases) == n and [w["reason"] for w in warnings] == [reason]


@pytest.mark.parametrize(("text", "ms"), [("1.5", 1500), ("0", 0), ("1,5", 1500), ("", None), ("NaN", None), ("-1", None), ("fast", None), (None, None), ("inf", None)])
def test_durations(text, ms):
    assert junit.millis(text) == ms


def test_files_of_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.xml").write_bytes(PYTEST)
    (tmp_path / "a" / "y.xml").write_bytes(b"")
    (tmp_path / "a" / "z.txt").write_bytes(b"no")
    files = junit.result_files(spark, str(tmp_path / "a"))
    cases, warnings = junit.parse_files(files)
    assert files.count() == 2 and cases.count() == 4
    assert [r["reason"] for r in warnings.collect()] == ["empty_file"]


PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,4 +1,5 @@
 one
-two
+2
+zwei
 three
@@ -20 +22,2 @@
+x
+y
diff --git a/old.py b/new.py
rename from old.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/pic.png b/pic.png
new file mode 100644
Binary files /dev/null and b/pic.png differ
diff --git a/z.py b/z.py
@@ -3,0 +4,2 @@
@@ -9 +6,1 @@\r
"""


def test_patches(spark):
    patches = spark.createDataFrame([("p", PATCH), ("bad", "diff --git nonsense"), ("none", "just words"), ("blank", " \n")], "origin string, body string")
    changes, warnings = diff.parse_patches(patches)
    span = lambda rs: [(r["start"], r["end"]) for r in rs]
    got = {r["path"]: (r["old_path"], r["change_type"], r["binary"], span(r["new_ranges"]), span(r["old_ranges"])) for r in changes.collect()}
    assert got == {
        "src/a.py": (None, "modified", False, [(2, 3), (22, 23)], [(2, 2)]),
        "new.py": ("old.py", "renamed", False, [], []),
        "gone.py": (None, "deleted", False, [], [(1, 2)]),
        "pic.png": (None, "added", True, [], []),
        "z.py": (None, "modified", False, [(4, 6)], [(9, 9)]),
    }
    assert {(r["origin"], r["reason"]) for r in warnings.collect()} == {("bad", "bad_diff_header"), ("none", "no_file_changes_found")}


def test_find_changes(spark):
    changes = spark.createDataFrame([("src/x/s.py", None), ("src/b/s.py", None), ("src/q.py", "src/old.py")], "path string, old_path string")
    wanted = spark.createDataFrame([("s.py",), ("x/s.py",), ("./src/b/s.py",), ("old.py",), ("x.py",)], "path string")
    got = {r["path"]: r["change_path"] for r in diff.find_changes(wanted, changes).collect()}
    assert got == {"s.py": None, "x/s.py": "src/x/s.py", "./src/b/s.py": "src/b/s.py", "old.py": "src/q.py", "x.py": None}


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*", "any/x", True),
        ("/docs/", "docs/a.md", True),
        ("/docs/", "x/docs/a.md", False),
        ("docs/", "x/docs/a.md", True),
        ("*.py", "a/b.py", True),
        ("/*.py", "a/b.py", False),
        ("src/*/x.py", "src/a/x.py", True),
        ("src/*/x.py", "src/a/b/x.py", False),
        ("src/**/x.py", "src/a/b/x.py", True),
        ("a/b", "a/b/c.py", True),
        ("b", "a/b/c.py", True),
        ("/b", "a/b/c.py", False),
        ("a.py", "x/aXpy", False),
    ],
)
def test_owner_patterns(pattern, path, hit):
    import re

    rules = codeowners.parse(f"{pattern} @o")
    assert bool(re.search(rules[0][2], path)) == hit


def test_owner_files(spark, tmp_path):
    assert codeowners.load(spark, str(tmp_path)).count() == 0
    (tmp_path / "CODEOWNERS").write_text("# x\n* @a\n/src/ @b @c # later wins\nlonely\n")
    assert [r["owners"] for r in codeowners.load(spark, str(tmp_path)).orderBy("rule_no").collect()] == [["@a"], ["@b", "@c"]]


def test_merged_ranges(spark):
    df = spark.createDataFrame([([(5, 6), (1, 2), (3, 3), (9, 9), (5, 5)],), ([],)], "r array<struct<start:bigint,end:bigint>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(merge_ranges(df["r"])).collect()]
    assert got == [[(1, 3), (5, 6), (9, 9)], []]


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "runsieve.toml"
    f.write_text("[detect]\newma_alpha = 0.5\ninfra_error_patterns = ['x']\n")
    assert load(str(f)).detect.infra_error_patterns == ("x",)
    monkeypatch.setenv("RUNSIEVE_MODEL", "m")
    assert load(str(f)).cause.model == "m"
    for bad in ("[detect]\nalpha = 1\n", "[nowhere]\n", "[detect]\newma_alpha = 2.0\n", "[policy]\nquarantine_ttl_days = 0\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            load(str(f))


def test_durations_and_instants():
    assert jobs.duration("2W").days == 14 and jobs.duration("15m").seconds == 900
    assert jobs.instant("2024-01-01T02:00:00+02:00") == jobs.instant("2024-01-01T00:00:00")
    with pytest.raises(ValueError):
        jobs.duration("soon")


def test_cases_are_handed_over_in_small_lots(spark):
    """A worker holds few rows at once, however many files a batch has."""

    class Files:
        def mapInPandas(self, f, schema):
            self.run = f
            return spark.createDataFrame([], schema)

    files = Files()
    junit.parse_files(files)
    body = b"<testsuite>" + b"".join(b'<testcase name="t%d"/>' % k for k in range(100)) + b"</testsuite>"
    given = pd.DataFrame({"origin": [f"f{k}" for k in range(70)], "content": [body] * 69 + [None]})
    lots = list(files.run([given]))
    assert sum(map(len, lots)) == 6901 and max(map(len, lots)) <= 2000
    assert [c["source_file"] for p in lots for c in p["case"] if c is not None] == [f"f{k}" for k in range(69) for _ in range(100)]
