"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source extensions in the order in which they are tried.
_EXTENSIONS = "py|pyi|pyx|js|jsx|mjs|cjs|ts|tsx|java|kt|kts|go|rb|cs|php|scala|rs|swift"
PATH_TOKEN = r"(?U)(?:[\w.\-]+[/\\])*[\w.\-]+\.(?:" + _EXTENSIONS + ")"
#: Parts of paths that are not the project's own.
FOREIGN_PATHS = (
    "site-packages/",
    "dist-packages/",
    "node_modules/",
    "/usr/lib/",
    "/usr/local/lib/",
    "_pytest/",
    "pluggy/",
    "unittest/case.py",
    "runpy.py",
    "asyncio/base_events.py",
    "jest-circus/",
    "jest-runtime/",
    "jest-each/",
    "internal/process/",
    "internal/modules/",
    "playwright-core/",
    "/gems/",
    "vendor/bundle/",
)
#: Parts of lines that stand for the runtime, not the project.
RUNTIME_LINES = (
    "java.base/",
    "java.util.",
    "java.lang.reflect",
    "java.lang.thread",
    "jdk.internal",
    "jdk.proxy",
    "sun.nio",
    "sun.reflect",
    "org.junit.",
    "org.gradle.",
    "org.apache.maven.surefire",
    "org.testng.",
    "kotlin.coroutines",
)
#: Suffixes that make a class name a path.
SOURCE_SUFFIX = r"\.(py|js|jsx|ts|tsx|java|kt|go|rb)$"
CLASS_NAME = "^[A-Z][A-Za-z0-9_]*$"
#: The line ends that Python's splitlines knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def any_of(c: Column, phrases) -> Column:
    """Whether c holds one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def base_name(name: Column) -> Column:
    """`name[parameters]` without its parameters; `[tag]` alone is a name."""
    t = trim(name)
    base = trim(F.regexp_extract(t, r"(?s)^(.*?)\[(.*)\]$", 1))
    return F.when(base != "", base).otherwise(t)


def parameters(name: Column) -> Column:
    t = trim(name)
    base = trim(F.regexp_extract(t, r"(?s)^(.*?)\[(.*)\]$", 1))
    return F.when(base != "", trim(F.regexp_extract(t, r"(?s)^(.*?)\[(.*)\]$", 2))).otherwise("")


def file_path(path: Column) -> Column:
    p = F.regexp_replace(F.translate(trim(path), "\\", "/"), r"^(\./)+", "")
    return F.btrim(p, F.lit("/"))


def _bare(classname: Column) -> Column:
    return F.btrim(trim(classname), F.lit("."))


def dotted_path(classname: Column) -> Column:
    """`a.b.C` as `a/b::C`, `a.b.c` as `a/b/c`; what is a path already stays one."""
    c = _bare(classname)
    parts = F.split(c, r"\.")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), "/")
    last = F.element_at(parts, -1)
    named = (n > 1) & last.rlike(CLASS_NAME)
    return (
        F.when(F.contains(c, F.lit("/")) | c.rlike(SOURCE_SUFFIX), file_path(c))
        .when(named, F.concat(head, F.lit("::"), last))
        .otherwise(F.array_join(parts, "/"))
    )


def class_qualifier(classname: Column) -> Column:
    last = F.element_at(F.split(_bare(classname), "[./]"), -1)
    return F.when(last.rlike(CLASS_NAME), last).otherwise("")


def suite_path(classname: Column, suites: Column, path: Column) -> Column:
    """The file with its class, else the class name as a path, else the names of the suites."""
    classname, path = F.coalesce(classname, F.lit("")), F.coalesce(path, F.lit(""))
    q = class_qualifier(classname)
    with_file = F.when(q != "", F.concat(file_path(path), F.lit("::"), q)).otherwise(file_path(path))
    return F.when(path != "", with_file).when(classname != "", dotted_path(classname)).otherwise(file_path(F.coalesce(suites, F.lit(""))))


def fingerprint(suite: Column, name: Column, params: Column) -> Column:
    return F.left(F.sha2(F.concat(suite, F.lit("\x1f"), name, F.lit("\x1f"), params), 256), F.lit(16))


def display_name(suite: Column, name: Column, params: Column) -> Column:
    return F.concat(suite, F.lit("::"), name, F.when(params != "", F.concat(F.lit("["), params, F.lit("]"))).otherwise(""))


def frame_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(trim(path), "\\", "/"), r"^(\./)+", "")


def diff_path(path: Column) -> Column:
    """Without blanks, quotes and one of a/, b/ and ./ in front."""
    return F.regexp_replace(F.btrim(trim(path), F.lit('"')), r"^(a/|b/|\./)", "")


def lookup_path(path: Column) -> Column:
    """For looking changes up: every leading dot and slash goes, then a/, then b/."""
    p = F.ltrim(F.translate(path, "\\", "/"), F.lit("./"))
    return F.regexp_replace(F.regexp_replace(p, "^a/", ""), "^b/", "")


def is_runtime_line(line: Column) -> Column:
    return any_of(F.lower(line), RUNTIME_LINES)


def is_project_path(path: Column) -> Column:
    return ~any_of(F.lower(F.translate(path, "\\", "/")), FOREIGN_PATHS)


def source_paths(text: Column, project_only: bool = True) -> Column:
    """Source files that a trace names, in order of first appearance."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    if project_only:
        lines = F.filter(lines, lambda l: ~is_runtime_line(l))
    found = F.flatten(F.transform(lines, lambda l: F.regexp_extract_all(l, F.lit(PATH_TOKEN), F.lit(0))))
    found = F.filter(F.transform(found, frame_path), lambda p: p != "")
    if project_only:
        found = F.filter(found, is_project_path)
    return F.array_distinct(found)


def footprint(test_file: Column, trace: Column, message: Column) -> Column:
    """The test's file and the project's files that trace and message name, sorted."""
    own = F.when(F.coalesce(test_file, F.lit("")) != "", F.array(frame_path(test_file))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(own, F.array_union(source_paths(trace), source_paths(message))))


def same_place(a: Column, b: Column) -> Column:
    """Equal paths, or one the end of the other from a slash on."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def touches(changed: Column, known: Column) -> Column:
    return F.exists(changed, lambda c: F.exists(known, lambda k: same_place(frame_path(c), frame_path(k))))


def distance(a: Column, b: Column, chars: int = 512) -> Column:
    """Edit distance of the first chars characters, as a share of the longer one; 0 of two empty ones."""
    a, b = F.left(a, F.lit(chars)), F.left(b, F.lit(chars))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.levenshtein(a, b) / longer).otherwise(0.0)


def initialism(code: Column) -> Column:
    """The first letters of the parts of a code: REAL_REGRESSION is RR."""
    return F.array_join(F.transform(F.split(code, "_"), lambda p: F.left(p, F.lit(1))), "")


#: Ordered rules of the keyword guess; the first that matches wins.
CAUSE_RULES = (
    (
        "INFRA_FLAKE",
        r"no space left on device|imagepullbackoff|error pulling image|manifest unknown|shutdown signal|spot instance"
        r"|received sigkill|exited with code 137|lost communication|preempted|agentlost",
    ),
    (
        "RESOURCE_EXHAUSTION",
        r"outofmemoryerror|out of memory|heap space|heap limit|too many open files|address already in use|errno 24"
        r"|errno 98|cannot allocate memory",
    ),
    (
        "EXTERNAL_DEPENDENCY",
        r"connectionreset|connection refused|connection reset|unknownhost|name or service not known|sslerror|tlsv1"
        r"|status code 5\d\d|service unavailable|econnrefused|dial tcp|i/o timeout|did not become healthy"
        r"|containernotready",
    ),
    (
        "SHARED_STATE_LEAK",
        r"uniqueviolation|duplicate key|unique constraint|fileexistserror|already exists|stale|never reset|module-level",
    ),
    (
        "RACE_CONDITION",
        r"data race|threadpoolexecutor|goroutine|concurrent\.futures|race condition|interleav|same instance",
    ),
    (
        "TIMING_DEPENDENCY",
        r"timeout|timed out|deadline exceeded|time\.sleep|jest\.settimeout|waiting for|date\.today|monotonic",
    ),
    (
        "TEST_ORDER_DEPENDENCY",
        r"passes when run with|only fails when scheduled|still installed|set by a prior test|keyerror",
    ),
)


def keyword_cause(kind: Column, message: Column, trace: Column, n_shards: Column, rules=CAUSE_RULES) -> Column:
    """The keyword guess at a cause; a failure on one shard alone points to the order of tests."""
    text = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (kind, message, trace)])
    guess = F.when(trim(text) == "", "UNKNOWN")
    for cause, pattern in rules:
        guess = guess.when(text.rlike(f"(?i){pattern}"), cause)
    return guess.when(n_shards == 1, "TEST_ORDER_DEPENDENCY").otherwise("UNKNOWN")
