"""Unified diffs as tables: patches split into files and hunks, ranges by a fold over a hunk's lines.

Everything about a file is worked out within its row, so that parsing needs no shuffle.
"""

from __future__ import annotations

import functools
import operator
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.series import merge_ranges

HEADER = r"^diff --git (?:a/)?(.+?) (?:b/)?(.+)$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def read_patches(spark: SparkSession, *paths: str) -> DataFrame:
    """(origin, body, problem) of patch files; one that is missing or no UTF-8 has no body and the problem `unreadable_file`."""
    there, missing = [], []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        (there if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else missing).append(p)
    out = spark.createDataFrame([(p, None, "unreadable_file") for p in missing], "origin string, body string, problem string")
    if not there:
        return out
    raw = spark.read.format("binaryFile").load(there).select(F.col("path").alias("origin"), F.try_validate_utf8(F.col("content").cast("string")).alias("body"))
    return raw.withColumn("problem", F.when(F.col("body").isNull(), "unreadable_file")).unionByName(out)


def from_git(spark: SparkSession, base: str, head: str, cwd: str | None = None, timeout: int = 30) -> DataFrame:
    """(origin, body, problem) of `git diff` between two commits, run on the driver."""
    origin, body, problem = f"{base}..{head}", "", None
    try:
        done = subprocess.run(["git", "diff", "--unified=0", origin], cwd=cwd, capture_output=True, text=True, timeout=timeout, check=False)
        body, problem = (done.stdout, None) if done.returncode == 0 else ("", "git_diff_failed")
    except (OSError, subprocess.TimeoutExpired):
        problem = "git_unavailable"
    return spark.createDataFrame([(origin, body, problem)], "origin string, body string, problem string")


_MARKS = ("diff --git ", "new file mode", "deleted file mode", "Binary files", "GIT binary patch", "rename from ", "rename to ", "--- ", "+++ ")
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _files(patches: DataFrame) -> DataFrame:
    """(origin, header, marks, hunks): a row for each file of a patch, and one for what stands before the first."""
    blob = F.explode(F.split(F.coalesce("body", F.lit("")), f"{text.LINE_END}(?=diff --git )")).alias("blob")
    rows = patches.select("origin", blob)
    marked = lambda l: functools.reduce(operator.or_, [F.startswith(l, F.lit(m)) for m in _MARKS])
    hunks = F.filter(F.split("blob", f"{text.LINE_END}(?={HUNK[1:]})"), lambda h: h.rlike(HUNK))
    rows = rows.withColumns({"marks": F.filter(F.split("blob", text.LINE_END), marked), "hunks": hunks}).drop("blob")
    first = F.get("marks", F.lit(0))
    return rows.withColumn("header", F.when(F.startswith(first, F.lit("diff --git ")), first))


def _named(rows: DataFrame) -> DataFrame:
    """rows with old_path, path, change_type and binary, from the lines that say so."""
    starts = lambda *p: lambda l: functools.reduce(operator.or_, [F.startswith(l, F.lit(x)) for x in p])
    body = lambda n: lambda l: text.trim(F.substr(l, F.lit(n)))
    nowhere = lambda l: body(5)(l) == "/dev/null"
    here = lambda k: F.filter("marks", lambda l: starts(k)(l) & ~nowhere(l))
    moved = lambda k, n: F.try_element_at(F.filter(F.transform(F.filter("marks", starts(k)), lambda l: F.substr(l, F.lit(n))), lambda p: (p != "") & (p != "/dev/null")), F.lit(-1))
    head = lambda n: F.nullif(text.diff_path(F.regexp_extract("header", HEADER, n)), F.lit(""))

    def change(l):
        gone_old, gone_new = starts("--- ")(l) & nowhere(l), starts("+++ ")(l) & nowhere(l)
        return (
            F.when(starts("new file mode")(l) | gone_old, "added")
            .when(starts("deleted file mode")(l) | gone_new, "deleted")
            .when(l.rlike("^rename (from|to) .+$"), "renamed")
        )

    out = rows.withColumns(
        {
            "old_path": F.coalesce(text.diff_path(moved("rename from ", 13)), head(1), text.diff_path(body(5)(F.get(here("--- "), F.lit(0))))),
            "path": F.coalesce(text.diff_path(moved("rename to ", 11)), head(2), text.diff_path(body(5)(F.get(here("+++ "), F.lit(0))))),
            "change_type": F.coalesce(F.try_element_at(F.array_compact(F.transform("marks", change)), F.lit(-1)), F.lit("modified")),
            "binary": F.exists("marks", starts("Binary files", "GIT binary patch")),
            "gone": F.exists("marks", lambda l: starts("+++ ")(l) & nowhere(l)),
        }
    )
    return out.withColumn("path", F.coalesce("path", F.when(F.col("gone"), F.col("old_path")))).drop("gone").filter("path IS NOT NULL")


def _hunk_ranges(hunk):
    """struct(new, old): runs of added and removed lines of one hunk, or what its header says if it has none."""
    number = lambda n: F.nullif(F.regexp_extract(hunk, HUNK, n), F.lit("")).cast("long")
    old_at, new_at = F.greatest(number(1), F.lit(1)), F.greatest(number(3), F.lit(1))
    lines = F.split(hunk, text.LINE_END)
    lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    none, zero = F.array().cast(_SPAN), F.lit(0).cast("long")
    side = lambda at: F.struct(at.alias("at"), zero.alias("start"), zero.alias("end"), none.alias("done"))
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    closed = lambda s: F.when(s["start"] > 0, F.concat(s["done"], F.array(span(s)))).otherwise(s["done"])

    def put(s, hit, moves):
        """A side after a line: a hit is part of a run; hits and lines in common move it on."""
        joins = s["end"] == s["at"] - 1
        return F.struct(
            F.when(moves, s["at"] + 1).otherwise(s["at"]).alias("at"),
            F.when(hit & ~(joins & (s["start"] > 0)), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(hit, s["at"]).otherwise(s["end"]).alias("end"),
            F.when(hit & ~joins, closed(s)).otherwise(s["done"]).alias("done"),
        )

    def step(s, l):
        plus = F.startswith(l, F.lit("+")) & ~F.startswith(l, F.lit("+++"))
        minus = F.startswith(l, F.lit("-")) & ~F.startswith(l, F.lit("---"))
        same = F.startswith(l, F.lit(" ")) | F.startswith(l, F.lit("\t")) | (l == "")
        return F.struct(put(s["new"], plus, plus | same).alias("new"), put(s["old"], minus, minus | same).alias("old"))

    count = lambda n: F.coalesce(number(n), F.lit(1).cast("long"))
    said = lambda at, n: F.when(count(n) > 0, F.array(F.struct(at.alias("start"), (at + count(n) - 1).alias("end")))).otherwise(none)

    def end(s):
        bare = (s["new"]["start"] == 0) & (s["old"]["start"] == 0)
        return F.struct(F.when(bare, said(new_at, 4)).otherwise(closed(s["new"])).alias("new"), F.when(bare, said(old_at, 2)).otherwise(closed(s["old"])).alias("old"))

    return F.aggregate(lines, F.struct(side(new_at).alias("new"), side(old_at).alias("old")), step, end)


def parse_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, warnings) of patches (origin, body): a row per changed file, with its merged line ranges."""
    rows = _files(patches)
    files = _named(rows).withColumn("r", F.transform("hunks", _hunk_ranges))
    changes = files.select(
        "origin",
        "path",
        F.when(F.col("old_path") != F.col("path"), F.col("old_path")).alias("old_path"),
        "change_type",
        "binary",
        merge_ranges(F.flatten(F.transform("r", lambda h: h["new"]))).alias("new_ranges"),
        merge_ranges(F.flatten(F.transform("r", lambda h: h["old"]))).alias("old_ranges"),
    )
    unread = patches.filter("problem IS NOT NULL") if "problem" in patches.columns else patches.limit(0).withColumn("problem", F.lit(""))
    unread = unread.select("origin", F.col("problem").alias("reason"), F.lit(None).cast("string").alias("detail"))
    bad = rows.filter(F.col("header").isNotNull() & ~F.col("header").rlike(HEADER))
    bad = bad.select("origin", F.lit("bad_diff_header").alias("reason"), F.left("header", F.lit(200)).alias("detail"))
    empty = patches.filter(text.trim(F.coalesce("body", F.lit(""))) != "").select("origin")
    empty = empty.join(_named(rows).select("origin").distinct(), "origin", "left_anti").join(bad.select("origin").distinct(), "origin", "left_anti")
    empty = empty.select("origin", F.lit("no_file_changes_found").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return changes, bad.unionByName(empty).unionByName(unread)


def all_paths(changes: DataFrame, by: str = "commit_sha") -> DataFrame:
    """(by, paths): every path of each commit's changes, those before a rename too."""
    both = F.explode(F.array_compact(F.array("path", "old_path"))).alias("p")
    return changes.select(by, both).groupBy(by).agg(F.array_sort(F.collect_set("p")).alias("paths"))


def changed_paths(changes: DataFrame, by: str = "commit_sha") -> DataFrame:
    """(by, paths): the new paths of each commit's changes."""
    return changes.groupBy(by).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def find_changes(wanted: DataFrame, changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """wanted (by, path) with change_path: the change of that very path (old or new), else the only one that ends in it.

    Only changes with the same `by` are looked at.  Paths meet on their last part, so that the join is an equality.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    w = wanted.select(*by, "path").distinct().withColumn("n", text.lookup_path(F.col("path"))).withColumn("k", last(F.col("n")))
    c = changes.select(*by, F.col("path").alias("change_path"), F.explode(F.array_compact(F.array("path", "old_path"))).alias("p")).distinct()
    c = c.withColumn("m", text.lookup_path(F.col("p"))).withColumn("k", last(F.col("m"))).drop("p")
    met = w.join(c, [*by, "k"]).filter((F.col("n") == F.col("m")) | F.endswith("m", F.concat(F.lit("/"), F.col("n"))))
    met = met.groupBy(*by, "path").agg(
        F.min(F.when(F.col("n") == F.col("m"), F.col("change_path"))).alias("exact"),
        F.count_distinct("change_path").alias("n_found"),
        F.min("change_path").alias("any"),
    )
    found = F.coalesce("exact", F.when(F.col("n_found") == 1, F.col("any")))
    return wanted.join(met, [*by, "path"], "left").withColumn("change_path", found).drop("exact", "n_found", "any")
