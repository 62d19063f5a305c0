"""What the pipeline's rows say, against plain loops."""

import hashlib
import os

import pytest

from runsieve.llm import mixing, pieces

SMALL = "/root/testdata/sf0.001"


def plain_schedule(rows):
    """[(doc_id, source)] -> sorted (doc_id, position, slot, in_mix), slot by slot."""
    rows = [(i, s or "") for i, s in rows]
    names = sorted({s for _, s in rows})
    weight = [1 + int(s[3:]) % 5 if s[:3] == "src" and s[3:].isdigit() else 1 for s in names]
    key = lambda i: (hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest(), i or 0)
    left = [sorted((i for i, s in rows if s == n), key=key) for n in names]
    done, q, out, slot, in_mix = [0] * len(names), sum(weight), [], 0, True
    while any(left):
        released = [j for j, w in enumerate(weight) if done[j] * q // w <= slot]
        j = min(released, key=lambda j: (-(-(done[j] + 1) * q // weight[j]), j))
        block, left[j] = left[j][: mixing.BLOCK_ROWS], left[j][mixing.BLOCK_ROWS :]
        in_mix = in_mix and len(block) == mixing.BLOCK_ROWS
        out += [(i, len(out) + n, slot, in_mix) for n, i in enumerate(block)]
        done[j] += 1
        slot += 1
    return sorted(out, key=lambda r: r[1])


def places(df):
    return sorted(((r["doc_id"], r["position"], r["slot"], r["in_mix"]) for r in df.collect()), key=lambda r: r[1])


def test_last_stage_keeps_the_schedule(spark):
    rows = [(k, f"text {k}", "src1" if k % 3 == 0 else f"src{k % 5}") for k in range(1500)]
    rows += [(7, "text 7 b", "src2"), (7, "text 7 c", "src2"), (None, "none a", None), (None, "none b", None), (9000, None, "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = pieces.stage(spark, docs, SMALL)
    want = plain_schedule([(i, s) for i, _, s in rows])
    assert places(got) == want
    assert {r[3] for r in want} == {True, False} and len({r[2] for r in want}) > 15
    # Each row keeps its own text where ids repeat.
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())
    assert texts(pieces.decode(got)) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not there")
def test_pipeline_keeps_the_schedule(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = [r["doc_id"] for r in got.collect()]
    assert places(got) == plain_schedule([(i, source[i]) for i in kept])


def test_last_stage_is_all_of_op10(spark):
    rows = [(k, f"the quick brown fox number {k} jumps over", "src1") for k in range(40)]
    rows += [(40, None, "src1"), (41, "", "src2"), (42, "x\x00y ￾ 🎉 ́ <|endoftext|>", "src2"), (43, "a" * 5_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in pieces.stage(spark, docs, SMALL).collect()}
    alone = {r["doc_id"]: r for r in pieces.encode(docs).collect()}
    checked = {r["doc_id"]: r for r in pieces.encode_and_check(docs).collect()}
    assert got.keys() == alone.keys() == {i for i, _, _ in rows}
    for i, r in got.items():
        assert (r["ids"], r["scores"], r["edits"]) == (alone[i]["ids"], alone[i]["scores"], alone[i]["edits"])
        assert (r["n_pieces"], r["round_trip"]) == (checked[i]["n_pieces"], checked[i]["round_trip"]) and r["round_trip"]
        assert r["score"] == r["scores"][0] and len(r["edits"]) == len(r["scores"]) - 1
    assert max(len(r["scores"]) for r in got.values()) == pieces.N_BEST
