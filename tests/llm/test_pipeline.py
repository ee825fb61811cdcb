"""The pipeline's stages, each against its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termwright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == names and docs.exceptAll(before).isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 100
    assert docs.where(~F.col("round_trip")).isEmpty()


def test_registered():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))


def test_op9_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.oracle_sql()['op9_stream_dedup']})").fetchall()
    found = [tuple(r) for r in queries.queries()["op9_stream_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(found) == sorted(want)


def test_encoding_keeps_the_schedule(spark, make_docs, tmp_path):
    """Rows that come in any order leave at the places that the target weights give them."""
    docs = make_docs([(i, f"text {i}", "b" if i % 5 == 0 else "a") for i in range(600)])
    want = {r["doc_id"]: r["position"] for r in corpus_pipeline.mixing.pfair_mix(docs).select("doc_id", "__mix.position").collect()}
    corpus_pipeline.encode(spark, docs.orderBy("text").repartition(3), SF).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(600)) and all(want[r["doc_id"]] == r["position"] for r in rows)
    share = sum(r["doc_id"] % 5 == 0 for r in rows[:120]) / 120
    assert abs(share - 1 / 3) < 0.1  # square roots of 120 and 480 rows


def test_rows_without_ids_are_encoded_where_mixing_put_them(spark, make_docs, tmp_path):
    """The schedule that mixing wrote is the one that encoding returns, however the table's files are cut in between."""
    import hashlib

    rows = [(None, f"text {i}", "b" if i % 5 == 0 else "a") for i in range(300)] + [(None, "copy", "a")] * 60 + [(None, None, "b"), (None, "", "b"), (None, "", "b")]
    rows += [(i, f"text {i}", "a") for i in range(100)] + [(5, "text 5", None)] * 3
    mixed = corpus_pipeline.mix(spark, make_docs(rows), SF)
    mixed.write.parquet(str(tmp_path / "mixed"))
    order = [r["text"] or "" for r in spark.read.parquet(str(tmp_path / "mixed")).select("text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert sorted(order) == sorted(t or "" for _, t, _ in rows)
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    docs.orderBy("text").repartition(3).write.parquet(str(tmp_path / "dealt"))
    for name in ("mixed", "dealt"):
        corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / name)), SF).write.parquet(str(tmp_path / f"{name}-out"))
        found = spark.read.parquet(str(tmp_path / f"{name}-out")).orderBy("position").collect()
        assert [r["position"] for r in found] == list(range(len(rows)))
        assert [r["decoded_sha256"] for r in found] == [hashlib.sha256(t.encode()).hexdigest() for t in order]


def test_rows_without_ids_keep_their_own_hashes(make_docs):
    """Copies without an id don't meet in one bucket of the shuffle."""
    found = corpus_pipeline.mixing.pfair_mix(make_docs([(None, "same", "a")] * 500), block_rows=1)
    assert sorted(r["position"] for r in found.select("__mix.position").collect()) == list(range(500))
    narrow = make_docs([(None, "same", "a")] * 500).select(F.lit(1).cast("long").alias("__h"), F.lit("=a").alias("__src"), F.monotonically_increasing_id().cast("string").alias("__at"), F.lit(True).alias("__nameless"))
    assert corpus_pipeline.mixing._told_apart(narrow, 7).select("__h").distinct().count() == 500
