"""The one pass of a scan: stored once, counted on the way, progress told."""

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from termwright.plans import cli
from termwright.sources import onepass, transcripts
from termwright.streaming import terms as streaming

LINES = '{"type":"user","cwd":"/w/%s","message":{"content":"字幕を見る %d"}}\n'


@pytest.fixture
def root(tmp_path):
    for p in ("a", "b"):
        folder = tmp_path / "projects" / f"-w-{p}"
        folder.mkdir(parents=True)
        for k in range(3):
            (folder / f"{k}.jsonl").write_text("".join(LINES % (p, n) for n in range(k + 1)), encoding="utf-8")
    return str(tmp_path)


def test_counts_are_those_of_the_table(spark, root):
    said = transcripts.read_utterances(spark, root)
    kept = onepass.stored(spark, said)
    assert kept.metrics == transcripts.metrics(said).first().asDict() == transcripts.metrics(kept.utterances).first().asDict()
    assert kept.metrics["utterances"] == 12 and kept.metrics["projects"] == 2
    assert sorted(map(tuple, kept.utterances.collect())) == sorted(map(tuple, said.collect()))


def test_the_corpus_is_read_once(spark, root, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touched(text):
        calls.add(1)
        return text

    said = transcripts.read_utterances(spark, root).withColumn("text", touched("text"))
    kept = onepass.stored(spark, said)
    kept.utterances.groupBy("project").count().collect()
    assert calls.value == kept.metrics["utterances"] == 12
    plan = kept.utterances._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and ".jsonl" not in plan


def test_odd_tables(spark):
    schema = "project string, text string, metrics string, utterances long"
    empty = onepass.stored(spark, spark.createDataFrame([], schema))
    assert empty.metrics == {"utterances": 0, "characters": 0, "projects": 0} and empty.utterances.count() == 0
    rows = [("p", None, "m", 1), (None, "", None, None), ("p", "字" * 70_000, "m", 1), ("p", None, "m", 1)]
    kept = onepass.stored(spark, spark.createDataFrame(rows, schema))
    assert kept.metrics == {"utterances": 4, "characters": 70_000, "projects": 1}
    assert sorted(map(repr, map(tuple, kept.utterances.collect()))) == sorted(map(repr, rows))
    kept.drop()
    with pytest.raises(Exception):  # noqa: B017  # gone
        kept.utterances.collect()


def test_progress_is_told_and_the_job_group_put_back(spark):
    sc, heard = spark.sparkContext, []
    sc.setJobGroup("mine", "what I do")
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    with onepass.told(spark, lambda done, tasks: heard.append((done, tasks)), every=0.1):
        spark.range(0, 8, 1, 8).select(slow("id")).write.format("noop").mode("overwrite").save()
    assert sc.getLocalProperty("spark.jobGroup.id") == "mine"
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert heard[-1] == (8, 8) and [d for d, _ in heard] == sorted(d for d, _ in heard) and len(heard) > 1


def test_an_error_of_the_report_is_raised_after_the_jobs(spark):
    def bad(done, tasks):
        raise ValueError("mine")

    out = []
    with pytest.raises(ValueError, match="mine"), onepass.told(spark, bad, every=0.05):
        out.append(spark.range(1000).count())
    assert out == [1000]
    with pytest.raises(AnalysisException), onepass.told(spark, bad):
        spark.range(1).select("none")


def test_streams_tell_their_counts(spark, root, tmp_path):
    heard = []
    listener = onepass.Counts(lambda n, c: heard.append((n, c)))
    spark.streams.addListener(listener)
    try:
        q = onepass.counted(streaming.stream_utterances(spark, root)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 20
        while sum(n for n, _ in heard) < 12 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    m = transcripts.metrics(transcripts.read_utterances(spark, root)).first()
    assert (sum(n for n, _ in heard), sum(c for _, c in heard)) == (m["utterances"], m["characters"])


def test_command_line_tells(spark, root, tmp_path, capsys):
    folder = tmp_path / "projects" / "-bad"
    folder.mkdir()
    (folder / "b.jsonl").write_text(LINES % ("c", 1) * 50, encoding="utf-8")
    (folder / ".b.jsonl.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1" * 40)  # a checksum that doesn't fit
    assert cli.main(["scan", "--root", root, "--min-count", "1", "--progress", "--report-unreadable", "-o", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().err
    assert "read: 12 utterances" in said and "2 projects" in said and "reading: " in said
    assert "-bad/b.jsonl: unreadable" in said and said.count("warning") == 1
