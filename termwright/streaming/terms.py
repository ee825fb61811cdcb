"""Transcripts as a stream: utterances as files arrive, and running counts of ASCII terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..operators import candidates as ops
from ..operators import state, tokens
from ..sources import transcripts


def stream_utterances(spark: SparkSession, root: str, japanese_only: bool = True, **options) -> DataFrame:
    """Cleaned utterances of projects/*/*.jsonl, each new file once."""
    transcripts.session(spark)
    lines = (
        spark.readStream.text(f"{root}/projects/*/*.jsonl")
        .withColumn("path", F.col("_metadata.file_path"))
        .select(
            F.make_valid_utf8("value").alias("value"),
            F.url_decode(F.replace(F.regexp_extract("path", "([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B"))).alias("slug"),
            F.struct(F.lit(0).alias("source"), F.col("path")).alias("utt"),
        )
    )
    return transcripts.cleaned(transcripts.parse_transcript(lines, **options), japanese_only)


def running_forms(utterances: DataFrame, cfg: ops.ExtractConfig | None = None) -> DataFrame:
    """lower, form, project and n so far: the state that the casing choice needs, one small row
    per form and project. Write it in update or complete mode."""
    rows = tokens.exploded_chunks(tokens.with_script_runs(utterances))
    cfg = cfg or ops.ExtractConfig()
    word = tokens.surface_of(F.col("chunk"))
    forms = rows.where(F.get("chunk", F.lit(0))["kind"] == "ascii").select(word.alias("form"), "project").where(ops.accept_ascii(F.col("form"), cfg))
    # A long stop list is a table, which the stream is joined with.
    kept = words.drop_stop_words(forms, cfg.stop, "form")
    return kept.groupBy(F.lower("form").alias("lower"), "form", "project").agg(F.count(F.lit(1)).alias("n"))


def merge_into(terms: DataFrame, dictionary: state.Dictionary, checkpoint: str):
    """A writer (not started) that appends the stream's new pairs (word, reading, hint, ord) to a dictionary. A
    batch that comes again after a failure changes nothing."""
    return terms.writeStream.option("checkpointLocation", checkpoint).foreachBatch(dictionary.merge_batch)
