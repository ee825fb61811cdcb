"""Columns with the names that operators use inside come back as they were, and the session stays whole."""

import pytest
from pyspark.errors import AnalysisException

from termwright.llm import common, exact, mixing, shingles, simhash, substring

NAMES = ["__at", "__here", "__gone", "__from", "__spans", "at", "here", "gone", "row", "of", "spans", "locator", "slot", "digest", "h", "k.l"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the cat sat on the mat today and slept there all day long, too", "the cat sat on the mat today and slept there all day long, too", "another text that stands once and is about nothing at all", None, ""]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "a", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)], schema)


@pytest.mark.parametrize(
    "drop",
    [exact.drop_exact_duplicates, shingles.drop_near_duplicates, simhash.drop_near_duplicates, substring.drop_repeats, mixing.pfair_mix],
    ids=["exact", "shingles", "simhash", "substring", "mixing"],
)
def test_columns_of_any_name(docs, drop):
    found = drop(docs)
    rows = found.collect()
    assert rows and set(docs.columns) <= set(found.columns)
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}{r['doc_id']}" for n in NAMES]
    with pytest.raises(AnalysisException):
        docs.select("nothing_of_this_name").collect()


def test_located_leaves_the_logger_alone(spark):
    common.located(spark.range(3).selectExpr("id % 2 AS x").distinct())
    with pytest.raises(AnalysisException):
        spark.range(1).select("missing").collect()
