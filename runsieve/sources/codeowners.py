"""Code-owner files."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.policy import owner_regex

#: Where the file may stand, in the order of looking.
PLACES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
RULES = "rule_no int, pattern string, regex string, owners array<string>"


def parse(text: str) -> list[tuple[int, str, str, list[str]]]:
    """Rules in their order; comments, and lines without owners, are left out."""
    lines = (line.split("#", 1)[0].split() for line in text.splitlines())
    rules = [(w[0], w[1:]) for w in lines if len(w) >= 2]
    return [(n, p, owner_regex(p), own) for n, (p, own) in enumerate(rules) if owner_regex(p) is not None]


def load(spark: SparkSession, root: str) -> DataFrame:
    found = next((Path(root, p) for p in PLACES if Path(root, p).is_file()), None)
    return spark.createDataFrame(parse(found.read_text(encoding="utf-8")) if found else [], RULES)


def last_committers(spark: SparkSession, root: str, paths: list[str], timeout: int = 15) -> DataFrame:
    """(path, committer): who last committed each path of the checkout at root, asked of git on the driver.

    Paths that git does not know, or cannot say in time, have no row.
    """
    rows = []
    for path in dict.fromkeys(paths):
        try:
            said = subprocess.run(["git", "log", "-1", "--format=%an", "--", path], cwd=root, capture_output=True, text=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired):
            break
        if said.returncode == 0 and said.stdout.strip():
            rows.append((path, said.stdout.strip()))
    return spark.createDataFrame(rows, "path string, committer string")
