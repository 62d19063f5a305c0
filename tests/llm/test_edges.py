"""Every operator and stage on empty tables, nulls, empty and long texts, repeated rows, and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from runsieve.llm import licenses, minhash, mixing, pieces, quality, search, tokenfile, toxicity, vectors, warc
from runsieve.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = "id score predicted _y _id _n position r h k n rep comp fp sig bands ids term terms block s slot source_row held_out".split()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    rows = [(k, words(rng, 40), "en", f"src{k % 3}") for k in range(20)]
    rows += [(20, None, None, None), (21, "", "en", ""), (22, " \n\t", "en", "src1"), (23, words(rng, 30_000), "en", "src0")]
    rows += [(24, "one", "en", "src1"), (3, rows[3][1], "en", "src0"), (3, rows[3][1], "en", "src0"), (25, rows[5][1], "de", "src2")]
    rows += [(None, rows[1][1], "en", "src1"), (None, None, None, None), (26, "x\x00y ￾ 🎉 ́ <|endoftext|>", "en", "src1"), (27, "a" * 70_000, "en", "src9")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.withColumns({c: F.lit("7") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(20)] + [(None, 1, 1), (1, None, None), (2, 0, 1), (2, 1, 0), (99, 1, 0), (5, 9, 9)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def counts(df, key="doc_id"):
    return sorted((str(r[key]), r["count"]) for r in df.groupBy(key).count().collect())


def test_mix(docs, empty):
    got = mixing.mix(docs)
    n = docs.count()
    assert sorted(r["position"] for r in got.collect()) == list(range(n))
    assert counts(got.withColumnRenamed("id", "doc_id")) == counts(docs)
    assert got.filter("source IS NULL").count() == 0 and got.filter("source = ''").count() == 3
    assert mixing.mix(empty).count() == 0


def test_quality(docs, empty, labels):
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model)
    assert counts(got) == counts(docs) and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    blank = got.filter("text IS NULL OR text = ''").select("score").distinct().count()
    assert blank == 1  # null and empty are one
    assert got.filter("predicted <> CASE WHEN score >= 0.5 THEN 1 ELSE 0 END").count() == 0
    assert quality.score_quality(empty, quality.fit(empty, labels)).count() == 0
    assert quality.fit(docs, labels.limit(0)).rules == ()


def test_toxicity(docs, empty, labels):
    got = toxicity.score_toxicity(docs, labels)
    assert counts(got) == counts(docs) and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = scratch(spark, "t")
    index = tokenfile.write_tokens(docs, folder, part_bytes=100_000)
    assert index.count() > 2  # parts grow in number with the bytes
    got = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
    order = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    want = [[*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in order]
    assert [r["n_tokens"] for r in got] == [len(w) for w in want]
    assert [r["start"] for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    for k in (0, 5, len(want) - 1):
        assert tokenfile.document_ids(spark, folder, k).tolist() == want[k]
    folder = scratch(spark, "t")
    assert tokenfile.write_tokens(empty, folder).agg(F.sum("n_tokens")).first()[0] in (0, None)
    assert tokenfile.read_tokens(spark, folder).count() == 0


def test_search(docs, empty):
    queries = docs.select(F.col("doc_id").alias("query_id"), "text", "lang").filter("query_id < 5").dropDuplicates()
    got = search.search(docs, queries, k=3, shard_docs=9)
    top = {r["query_id"]: r["doc_id"] for r in got.filter("rank = 1").collect()}
    assert top == {k: k for k in range(5)}
    assert search.search(empty, queries).count() == 0 and search.search(docs, queries.limit(0)).count() == 0


def test_warc(spark):
    big = "x" * 200_000
    rows = [(1, "http://a", "same"), (5, "http://b\nc", "same"), (3, None, "same"), (None, "u", "same"), (7, "u", None), (8, "u", ""), (9, "u", big), (9, "u", big), (10, "é", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("no")).withColumn("payload", F.lit(1))
    folder = scratch(spark, "w")
    warc.write_archives(pages, folder)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.resolve_revisits(warc.read_headers(spark, folder)).collect()}
    assert got == {
        (1, "revisit", 5, 4),
        (5, "response", None, 4),
        (3, "revisit", 5, 4),
        (None, "revisit", 5, 4),
        (7, "revisit", 8, 0),
        (8, "response", None, 0),
        (9, "response", None, 200_000),
        (10, "response", None, 14),
    }
    folder = scratch(spark, "w")
    warc.write_archives(pages, folder, min_bytes=5)
    assert warc.resolve_revisits(warc.read_headers(spark, folder)).filter("record_type = 'revisit'").count() == 0
    folder = scratch(spark, "w")
    warc.write_archives(pages.limit(0), folder)
    assert warc.resolve_revisits(warc.read_headers(spark, folder)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1.0, None])]
    rows += [(10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (12, [1e300, 1e300]), (13, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    one = {1: 3, 2: 3, 11: 3}  # 1, both rows of 2, and 11 link with each other
    want = [(str(i), one.get(i, 1 if i in (12, 13) else 0), 1 if i in one else 12 if i == 13 else i, i in (None, 1, 12) or i not in (2, 11, 13)) for i, _ in rows]
    assert got == sorted(want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_licenses(docs, empty):
    got = licenses.scan_licenses(docs)
    assert counts(got) == counts(docs) and got.filter("license IS NOT NULL").count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs, {"none": " .. "}).filter("license IS NOT NULL").count() == 0


def test_minhash(docs, empty):
    got = minhash.near_duplicates(docs)
    assert counts(got) == counts(docs)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()}
    assert rows[25] == (36, 5, False) and rows[5] == (36, 5, True) and rows[3][2]
    assert rows[20] == (0, 20, True) == (0, rows[20][1], True) and rows[21][0] == rows[22][0] == 0 and rows[24] == (1, 24, True)
    assert got.filter("doc_id IS NULL AND component_id IS NULL AND kept").count() == 2
    assert minhash.near_duplicates(empty).count() == 0


def test_pieces(docs, empty):
    got = pieces.encode_and_check(docs)
    assert counts(got) == counts(docs) and got.filter("NOT round_trip").count() == 0
    assert {(r["n_pieces"], tuple(r["scores"])) for r in got.filter("doc_id IN (20, 21)").collect()} == {(0, (0.0,))}
    text = pieces.decode(pieces.encode(docs)).filter("doc_id = 26").first()["text"]
    assert text == odd_rows()[-2][1]
    assert pieces.encode_and_check(empty).count() == 0


STAGES = [quality.stage, toxicity.stage, minhash.stage, mixing.stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__module__.rsplit(".", 1)[1])
def test_stages(spark, docs, empty, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert got.exceptAll(docs).count() == 0  # whole rows of the input
    if stage is mixing.stage:
        assert got.count() == docs.count()
    if stage is minhash.stage:
        assert docs.exceptAll(got).select("doc_id").distinct().collect()[0][0] == 25
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_last_stage(spark, docs, empty, tmp_path):
    got = pieces.stage(spark, docs, str(tmp_path))
    assert counts(got) == counts(docs) and got.filter("NOT round_trip").count() == 0
    assert sorted(r["position"] for r in got.collect()) == list(range(docs.count()))
    assert pieces.stage(spark, empty, str(tmp_path)).count() == 0


def test_vectors_at_the_threshold(spark):
    """Cosines of exactly 0.9, and a little below, by vectors whose products are exact."""
    rows = [(1, [10.0, 0.0, 0.0]), (2, [9.0, 3.0, 10.0**0.5]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.4358898943540673, 0.0]), (5, [0.8999999, 0.43589010, 0.0])]
    import numpy as np

    unit = {i: np.array(v) / np.sqrt((np.array(v) / max(map(abs, v))) @ (np.array(v) / max(map(abs, v)))) / max(map(abs, v)) for i, v in rows}
    links = {i: sum(j != i and float(unit[i] @ unit[j]) >= 0.9 for j in unit) for i in unit}
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == links and links[1] >= 1
