import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runsieve.functions import text
from runsieve.operators import identity


def column(spark, expr, *values):
    df = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], "k int, " + ", ".join(f"c{j} string" for j in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_parameters(spark):
    names = ["test_a[x=1]", " test_b ", "[tag]", "t[a][b]", "t[", "t[]", "a\nb[c]"]
    assert column(spark, text.base_name(F.col("c0")), *names) == ["test_a", "test_b", "[tag]", "t", "t[", "t", "a\nb"]
    assert column(spark, text.parameters(F.col("c0")), *names) == ["x=1", "", "", "a][b", "", "", "c"]


def test_suite_paths(spark):
    cases = [("tests.unit.test_login", "s", None), ("com.example.OrderTest", "", None), ("x.Case", "", "./src\\a.py"), ("", "a/b", None), ("web/x.ts", "", None), ("mod", "", "t.py"), ("Only", "", None)]
    got = column(spark, text.suite_path(F.col("c0"), F.col("c1"), F.col("c2")), *cases)
    assert got == ["tests/unit/test_login", "com/example::OrderTest", "src/a.py::Case", "a/b", "web/x.ts", "t.py", "Only"]


def test_traces(spark):
    trace = 'at java.util.Foo(Foo.java:3)\nFile "./src/a.pyi"\x0bin lib/site-packages/x.py\nsrc\\b.json src/a.py /usr/lib/z.py'
    assert column(spark, F.array_join(text.source_paths(F.col("c0")), ","), trace, "") == ["src/a.py,src/b.js,usr/lib/z.py", ""]
    assert column(spark, text.lookup_path(F.col("c0")), ".github/x", "./a/b/y", "b/z") == ["github/x", "y", "z"]
    assert column(spark, text.diff_path(F.col("c0")), '"a/x y"', "./q", "b/a/z") == ["x y", "q", "a/z"]


def test_distances(spark):
    pairs = [("", ""), ("abc", "abd"), ("a", ""), ("é", "e"), ("kitten", "sitting")]
    assert column(spark, text.distance(F.col("c0"), F.col("c1")), *pairs) == [0.0, 1 / 3, 1.0, 1.0, 3 / 7]


def test_distance_laws(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab_c") for _ in range(rng.randint(0, 9)))
    rows = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    d = df.select("a", "b", text.distance(F.col("a"), F.col("b")).alias("x"), text.distance(F.col("b"), F.col("a")).alias("y"), text.distance(F.col("a"), F.col("a")).alias("z"))
    assert d.filter("x <> y OR z <> 0 OR x < 0 OR x > 1 OR (x = 0) <> (a = b)").count() == 0


def plain_match(pairs):
    used, out = set(), []
    for rank in sorted({round(d, 9) for _, _, d in pairs}):
        live = [p for p in pairs if round(p[2], 9) == rank and p[0] not in used and p[1] not in used]
        a, b = Counter(p[0] for p in live), Counter(p[1] for p in live)
        for p in live:
            if a[p[0]] > 1 or b[p[1]] > 1:
                used |= {p[0], p[1]}
        for p in sorted(live):
            if p[0] not in used and p[1] not in used:
                used |= {p[0], p[1]}
                out.append((p[0], p[1]))
    return sorted(out)


def test_matching(spark):
    rng = random.Random(1)
    rows = [(run, f"o{a}", f"n{b}", rng.choice([0.01, 0.1, 0.1, 0.2, 0.05])) for run in range(20) for a in range(5) for b in range(5) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "run_pk int, old_fingerprint string, new_fingerprint string, distance double")
    got = identity.match_renames(df).collect()
    for run in range(20):
        want = plain_match([r[1:] for r in rows if r[0] == run])
        assert sorted((r["old_fingerprint"], r["new_fingerprint"]) for r in got if r["run_pk"] == run) == want
    assert all(r["certain"] == (r["distance"] <= 0.03) for r in got)


def test_disappeared_meets_by_equality(spark):
    rng = random.Random(4)
    runs = spark.createDataFrame([(r, r // 2) for r in range(20)], "run_pk int, started_at int")
    rows = [(rng.randrange(20), rng.randrange(30)) for _ in range(150)]
    ex = spark.createDataFrame(rows, "run_pk int, test_id int")
    got = identity.disappeared(ex, runs)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    first = {}
    for r, t in rows:
        first[t] = min(first.get(t, 99), r // 2)
    want = {(r, t) for r in range(20) for t in first if first[t] < r // 2 and (r, t) not in rows}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_long_chains_close(spark):
    edges = spark.createDataFrame([(k, k + 1, True) for k in range(400)], "old_id long, new_id long, certain boolean")
    assert {r["group_id"] for r in identity.groups(edges).collect()} == {400}


def test_groups(spark):
    edges = spark.createDataFrame([(1, 5, True), (5, 3, True), (7, 8, False), (9, 7, True)], "old_id long, new_id long, certain boolean")
    got = {r["test_id"]: (r["group_id"], r["uncertain"]) for r in identity.groups(edges).collect()}
    assert got == {1: (5, False), 5: (5, False), 3: (5, False), 7: (9, True), 8: (9, True), 9: (9, True)}


@pytest.mark.parametrize("n", [0, 1])
def test_one_char_rename(spark, n):
    old = spark.createDataFrame([(1, "f1", "test_login_works_fine", "tests/a", "")], "run_pk int, fingerprint string, test_name string, suite_path string, parameters string")
    new = spark.createDataFrame([(1, "f2", "test_login_works_fine"[:-n or None] + "x" * n, "tests/a", "")], old.schema)
    got = identity.match_renames(identity.similar_pairs(old, new)).collect()
    assert len(got) == 1 and got[0]["certain"]


def test_choose_keeps_pandas_columns():
    p = pd.DataFrame({"old_fingerprint": ["a"], "new_fingerprint": ["b"], "distance": [0.1]})
    assert list(identity._choose(p, 9).columns) == list(p.columns)


def sides(spark, rng, n, names=("login", "logout", "lodge", "cart", "carts")):
    row = lambda k, s: (rng.randrange(3), f"{s}{k}", rng.choice(names), rng.choice(["a/b", "a/c"]), rng.choice(["", "x=1"]))
    schema = "run_pk int, fingerprint string, test_name string, suite_path string, parameters string"
    rows = [[row(k, s) for k in range(n)] for s in "on"]
    own = [(9, f"both{k}", f"name{k % 3}", "a/b", "") for k in range(3)]  # on both sides
    return [spark.createDataFrame(r + own, schema) for r in rows]


@pytest.mark.parametrize("n", [40, 300])
def test_equal_names_meet_once(spark, n):
    config = identity.Identity(alias_max_distance=0.6)
    old, new = sides(spark, random.Random(n), n)
    pairs = identity.similar_pairs(old, new, config)
    got = [(r["run_pk"], r["old_fingerprint"], r["new_fingerprint"]) for r in pairs.collect()]
    plain = old.alias("o").join(new.alias("n"), ["run_pk", "parameters"]).filter("o.fingerprint <> n.fingerprint")
    d = 0.5 * text.distance(F.col("o.test_name"), F.col("n.test_name")) + 0.5 * text.distance(F.col("o.suite_path"), F.col("n.suite_path"))
    want = [tuple(r) for r in plain.filter(d <= 0.6).select("run_pk", "o.fingerprint", "n.fingerprint").collect()]
    assert sorted(got) == sorted(want) and len(want) > n / 8
    assert {tuple(r) for r in identity.renames(old, new, config).collect()} == {tuple(r) for r in identity.match_renames(pairs, config).collect()}


def test_renames_of_singles(spark):
    letters = [f"{a}{b}est_{b}{a}" for a in "pqrst" for b in "vwxyz"]
    old, new = sides(spark, random.Random(7), 30, letters)
    got = identity.renames(old, new, identity.Identity(alias_max_distance=0.6))
    want = identity.match_renames(identity.similar_pairs(old, new, identity.Identity(alias_max_distance=0.6)))
    assert {tuple(r)[:4] for r in got.collect()} == {tuple(r)[:4] for r in want.collect()} and got.count() > 3


def test_pairs_meet_in_many_tasks(spark):
    old, new = sides(spark, random.Random(5), 400)
    assert identity.similar_pairs(old, new).rdd.getNumPartitions() >= 16
