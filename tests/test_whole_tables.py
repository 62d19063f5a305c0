"""Queries over whole tables: nothing of a table is left out, and chains are closed."""

import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not there")


def plain_groups(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, _ in edges:
        a, b = root(a), root(b)
        up[min(a, b)] = max(a, b)
    doubt = {root(a) for a, _, certain in edges if not certain}
    return {(x, root(x), root(x) in doubt) for x in list(up)}


def edges_of(orders):
    return [(r["o_custkey"], r["o_custkey"] + r["o_orderkey"] % 2 + 1, r["o_orderkey"] % 10 > 0) for r in orders.collect()]


def test_alias_groups(spark):
    edges = edges_of(spark.read.parquet(f"{SMALL}/orders.parquet"))
    assert {b for _, b, _ in edges} & {a for a, _, _ in edges}  # chains
    got = __spark_entry__.queries()["alias_groups"](spark, SMALL).collect()
    assert len(got) == len({r["test_id"] for r in got})
    assert {(r["test_id"], r["group_id"], r["uncertain"]) for r in got} == plain_groups(edges)


def test_alias_groups_all_chains(spark, tmp_path):
    # Long chains with gaps between them, some with an uncertain edge.
    rows = [(k, n) for start in range(10, 800, 40) for n in range(start, start + 3 + start % 34) for k in (n * 20 + 2 * (n % 3 == 0) + 1,)]
    rows += [(10 * n + 10, n) for n in (130, 450)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = __spark_entry__.queries()["alias_groups"](spark, str(tmp_path)).collect()
    want = plain_groups(edges_of(orders))
    assert len({g for _, g, _ in want}) > 5 and {u for _, _, u in want} == {True, False}
    assert {(r["test_id"], r["group_id"], r["uncertain"]) for r in got} == want


def test_all_rows_have_their_say(spark):
    q, tables = __spark_entry__.queries(), {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("orders", "lineitem", "events")}
    ids = lambda df, c: {r[0] for r in df.select(c).distinct().collect()}
    assert ids(q["line_runs"](spark, SMALL), "k") == ids(tables["lineitem"], "l_suppkey")
    assert ids(q["alias_upsert"](spark, SMALL), "old_id") == ids(tables["orders"], "o_custkey")
    assert ids(q["appeared"](spark, SMALL), "test_id") == ids(tables["events"], "user_id")
