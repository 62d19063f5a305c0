"""The bands are made for 80 percent: nothing below it is answered with links missing."""

import pytest

from runsieve.llm import minhash


@pytest.mark.parametrize("percent", [0, 60, 79])
def test_low_percent_raises(spark, percent):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at least 80"):
        minhash.near_duplicates(docs, percent=percent)


def test_higher_percent_still_works(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent=95).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
