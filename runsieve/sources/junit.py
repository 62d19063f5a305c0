"""Test result files in JUnit XML, in whichever dialect."""

from __future__ import annotations

import io
import math
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CASE, WARNING

#: How elements of a case read.
_OUTCOME = {"failure": "fail", "error": "error", "skipped": "skip"}
_RERUN = ("flakyfailure", "flakyerror", "rerunfailure", "rerunerror")
_HEAD = 8192
#: Rows that a worker holds, beyond those of one file, and hands over at once.
_ROWS = 2000


def result_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(origin, content) of result files: folders are searched for *.xml at any depth, files and globs are read as they are.

    Each file stands once, however many paths reach it.  The binary reader leaves
    out files of zero bytes; these come from the listing.
    """
    found, bare = spark.createDataFrame([], "origin string, content binary"), []
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        reader, folder = spark.read.format("binaryFile"), fs.exists(at) and fs.getFileStatus(at).isDirectory()
        if folder:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
            files, listed = fs.listFiles(at, True), []
            while files.hasNext():
                listed.append(files.next())
            listed = [f for f in listed if f.getPath().getName().endswith(".xml")]
        else:
            listed = list(fs.globStatus(at) or [])
        bare += [(f.getPath().toString(), bytearray()) for f in listed if f.getLen() == 0]
        found = found.unionByName(reader.load(path).select(F.col("path").alias("origin"), "content"))
    if bare:
        found = found.unionByName(spark.createDataFrame(bare, "origin string, content binary"))
    return found.dropDuplicates(["origin"])


def _said(value: str | None) -> str | None:
    return (value or "").strip() or None


def _whole(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def millis(value: str | None) -> int | None:
    """Seconds (with a point or a comma) as milliseconds; what is no finite, non-negative number is nothing."""
    try:
        seconds = float((value or "").replace(",", "."))
    except ValueError:
        return None
    return round(seconds * 1000) if math.isfinite(seconds) and seconds >= 0 else None


@dataclass
class _Suite:
    name: str = ""
    file: str | None = None
    cases: list[dict] = field(default_factory=list)
    output: dict[str, str | None] = field(default_factory=dict)


def _case(node: ET.Element, open_suites: list[_Suite], origin: str, position: int) -> dict:
    case = {
        "name": node.get("name", "").strip(),
        "classname": node.get("classname", node.get("class", "")).strip(),
        "suite_path": "/".join(s.name for s in open_suites if s.name),
        "file_path": _said(node.get("file")) or next((s.file for s in reversed(open_suites) if s.file), None),
        "line": _whole(node.get("line")),
        "duration_ms": millis(node.get("time")),
        "outcome": "pass",
        "failure_type": None,
        "failure_message": None,
        "stack_trace": None,
        "stdout": None,
        "stderr": None,
        "rerun_observed": False,
        "source_file": origin,
        "position": position,
    }
    for part in node:
        kind = _plain(part.tag)
        details = {"failure_type": _said(part.get("type")), "failure_message": _said(part.get("message")), "stack_trace": _said(part.text)}
        if kind in _OUTCOME and case["outcome"] == "pass":
            case |= details | {"outcome": _OUTCOME[kind]}
        elif kind in _RERUN:
            case |= {"rerun_observed": True} | (details if case["failure_message"] is None else {})
        elif kind in ("system-out", "system-err"):
            case["stdout" if kind == "system-out" else "stderr"] = _said(part.text)
    return case


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def parse(content: bytes, origin: str = "<memory>") -> tuple[list[dict], list[dict]]:
    """(cases, warnings) of one file; what stands before a fault is kept."""
    warn = lambda reason, detail=None: [{"origin": origin, "reason": reason, "detail": detail}]
    head = content[:_HEAD]
    if not head.strip():
        return [], warn("empty_file")
    if b"<!DOCTYPE" in head.upper():
        return [], warn("doctype_rejected")
    if b"<" not in head:
        return [], warn("not_xml")
    outer = _Suite()  # takes the cases outside any suite, and those of closed ones
    stack, in_case, n = [outer], 0, 0

    def close() -> None:
        suite = stack.pop()
        for case in suite.cases:
            for key, text in suite.output.items():
                if case[key] is None:
                    case[key] = text
        stack[-1].cases += suite.cases

    fault = None
    try:
        for event, node in ET.iterparse(io.BytesIO(content), ("start", "end")):
            kind = _plain(node.tag)
            match event, kind:
                case "start", "testsuite":
                    stack.append(_Suite(node.get("name", "").strip(), _said(node.get("file"))))
                case "start", "testcase":
                    in_case += 1
                case "end", "testcase":
                    in_case -= 1
                    stack[-1].cases.append(_case(node, stack[1:], origin, n))
                    n += 1
                    node.clear()
                case "end", "testsuite":
                    close()
                    node.clear()
                case "end", "system-out" | "system-err" if len(stack) > 1 and not in_case:
                    stack[-1].output["stdout" if kind == "system-out" else "stderr"] = _said(node.text)
                    node.clear()
    except ET.ParseError as e:
        fault = str(e)
    while len(stack) > 1:
        close()
    if fault is not None:
        return outer.cases, warn("malformed_xml", fault)
    return outer.cases, [] if outer.cases else warn("no_testcases")


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, warnings) of files (origin, content); a file is one row and one worker's work.

    Rows of content that could not be read (null) are warned of as unreadable.
    """
    case_names, warning_names = ([x.split()[0] for x in s.split(", ")] for s in (CASE, WARNING))

    def held(rows: list[tuple]):
        for lo in range(0, len(rows), _ROWS):
            yield pd.DataFrame(rows[lo : lo + _ROWS], columns=["case", "warning"])

    def run(parts: Iterable[pd.DataFrame]):
        for p in parts:
            rows = []
            for origin, content in zip(p["origin"], p["content"], strict=True):
                cases, warnings = parse(bytes(content), origin) if content is not None else ([], [{"origin": origin, "reason": "unreadable_file", "detail": None}])
                rows += [(c, None) for c in cases] + [(None, w) for w in warnings]
                del cases, warnings
                if len(rows) >= _ROWS:
                    yield from held(rows)
                    rows = []
            yield from held(rows)

    struct = lambda s: "struct<" + ", ".join(f"{a}:{b}" for a, b in (x.split() for x in s.split(", "))) + ">"
    both = files.mapInPandas(run, f"case {struct(CASE)}, warning {struct(WARNING)}")
    cases = both.filter("case IS NOT NULL").select(*[F.col(f"case.{c}").alias(c) for c in case_names])
    return cases, both.filter("warning IS NOT NULL").select(*[F.col(f"warning.{c}").alias(c) for c in warning_names])
