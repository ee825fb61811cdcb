"""Removal of repeated passages by hashing their lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, located, written, whole_row

_LINE = re.compile("[^\r\n\x0b\x0c\x85\u2028\u2029]+")
_SENTENCE = re.compile(r"\S(?:[^.!?…\n]++|[.!?…]++(?!\s))*+[.!?…]*+")  # runs of marks are taken whole: time grows with the length
_WORD = re.compile(r"\w+")

#: Words of the shortest passage that is removed.
PASSAGE = 12

SPANS = "array<struct<start:int,end:int>>"


def units(text: str) -> Iterator[tuple[bytes, bool, int, int, int, int, int, int]]:
    """digest, whether it is a whole line, start and end (code points), first and last sentence (numbered through the text) and
    words before it and up to its end: of a text's lines, and of the sentences of lines that
    hold several. A unit's normal form is its words in lower case, joined by blanks. What has
    no word is no unit."""
    number = total = 0
    for line in _LINE.finditer(text):
        first, before, words = number, total, []
        sentences = []
        for m in _SENTENCE.finditer(text, line.start(), line.end()):
            own = _WORD.findall(m[0].lower())
            if own:
                sentences.append((own, m.start(), m.start() + len(m[0].rstrip()), number, total))
                words += own
                number += 1
                total += len(own)
        if not sentences:
            continue
        begin, end = sentences[0][1], sentences[-1][2]
        if len(sentences) > 1:
            for own, a, b, k, n in sentences:
                yield _digest(own), False, a, b, k, k, n, n + len(own)
        yield _digest(words), True, begin, end, first, number - 1, before, total


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


_NONE = bytes(16)
_INTS = ("start", "end", "first", "last", "before", "after")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per unit: unit (true), hi, lo (the digest), rid (the document row's number in this job), doc_id, the
    places, and again (further places of a unit in its own document). One more row per
    document, no unit, has its locator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, again, lines, rids, ids, where = [], [], [], [], [], []
            ints: list[list[int]] = [[] for _ in _INTS]

            def flush():
                halves = np.frombuffer(b"".join(d or _NONE for d in digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
                unit = [d is not None for d in digests]
                arrays = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(again, pa.bool_()), pa.array(lines, pa.bool_()), pa.array(where, pa.string()), *[pa.array(x, pa.int32()) for x in ints]]
                out = pa.RecordBatch.from_arrays([*arrays, pa.array(unit, pa.bool_())], ["hi", "lo", "rid", "doc_id", "again", "line", "locator", *_INTS, "unit"])
                for column in (digests, rids, ids, again, lines, where, *ints):
                    column.clear()
                return out

            for rid, doc_id, locator, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                digests.append(None)
                again.append(False)
                lines.append(False)
                rids.append(rid)
                ids.append(doc_id)
                where.append(locator)
                for column in ints:
                    column.append(0)
                seen = set()
                found = units(value.as_py() or "")
                while own := list(islice(found, 20_000)):
                    n = len(own)
                    digest, line, *places = zip(*own)
                    digests += digest
                    lines += line
                    for d in digest:
                        again.append(d in seen)
                        seen.add(d)
                    rids += [rid] * n
                    ids += [doc_id] * n
                    where += [None] * n
                    for column, place in zip(ints, places, strict=True):
                        column += place
                    if len(digests) >= 50_000:
                        yield flush()
            yield flush()

    docs, where = located(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), where.alias("locator"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "hi long, lo long, rid long, doc_id long, again boolean, line boolean, locator string, " + ", ".join(f"{c} int" for c in _INTS) + ", unit boolean")


def repeated_units(docs: DataFrame, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, locator, spans (places that repeat an earlier unit of the
    corpus, as start and end in code points of the original text, sorted, disjoint), n_lines and
    n_sentences (how many of the spans are whole lines, and sentences within lines), and n_left.

    Units are lines, and the sentences of lines with several, of any length. Of equal units (same
    words, without regard to case, punctuation and white space) the earliest ranked one stays:
    that of the smallest id (null ids last), of rows that share it the first, there at its first
    place. Repeated units that follow each other make a passage; a passage of ``passage`` words
    or more is removed, whatever the length of its lines. A shorter one is a phrase that texts
    share by chance; n_left counts such units, and ``passage=1`` removes them as well.

    Null and empty texts have no units. Other columns may have any name. An empty table gives
    no rows. A row is known by its place in the files, so ids may be null or repeat.
    """
    last = F.lit(2**63 - 1)
    found = written(_digests(docs, id_col, text_col), "units")
    heads = found.where(~F.col("unit")).select("rid", "doc_id", "locator")
    every = found.where("unit").drop("locator", "unit").withColumn("doc_id", F.coalesce("doc_id", last))
    first = every.where(~F.col("again"))
    with Scratch(docs.sparkSession) as scratch:
        # Counts and minima are pre-aggregated before the shuffle: a line of a third of all
        # documents sends one row per task.
        groups = first.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper")).where("n > 1").select("hi", "lo", "keeper")
        met = scratch.written(first.join(scratch.written(groups, "repeated"), ["hi", "lo"]), "met")
        # Rows that share the keeper's id: the first of them keeps the unit.
        tied = met.where("doc_id = keeper").groupBy("hi", "lo").agg(F.min("rid").alias("kept"), F.count(F.lit(1)).alias("m")).where("m > 1").select("hi", "lo", "kept")
        also = met.where("doc_id = keeper").join(tied, ["hi", "lo"]).where("rid > kept")
        places = ["rid", "line", *_INTS]
        later = met.where("doc_id > keeper").select(*places).unionByName(also.select(*places)).unionByName(every.where("again").select(*places))
        own = Window.partitionBy("rid").orderBy("first", F.desc("last"))
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        ranged = later.withColumn("reach", F.coalesce(F.max("last").over(before), F.lit(-2)))
        ranged = ranged.where(F.col("last") > F.col("reach"))  # a sentence of a line that goes goes with it
        runs = ranged.withColumn("run", F.sum((F.col("first") > F.col("reach") + 1).cast("int")).over(own))
        words = F.max("after").over(Window.partitionBy("rid", "run")) - F.min("before").over(Window.partitionBy("rid", "run"))
        judged = runs.withColumn("gone", words >= passage)
        gone = F.col("gone")
        lists = judged.groupBy("rid").agg(
            F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end")))).cast(SPANS).alias("spans"),
            F.count(F.when(gone & F.col("line"), 1)).alias("n_lines"),
            F.count(F.when(gone, 1)).alias("n_gone"),
            F.count(F.when(~gone, 1)).alias("n_left"),
        )
        lists = written(lists, "spans")
    zero = F.lit(0).cast("long")
    return heads.join(lists, "rid", "left").select(
        "doc_id",
        "locator",
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce(F.col("n_gone") - F.col("n_lines"), zero).alias("n_sentences"),
        F.coalesce("n_left", zero).alias("n_left"),
    )


def written_out(spans):
    """Spans as text: start-end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def cut_spans(text, spans):
    """The text without the spans; what stays is joined as it stands."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, each row once, with repeated passages cut from the text, and ``removed_spans`` with
    their places in the original text (an empty list if there are none)."""
    names = docs.columns
    docs, where = located(docs)
    spans = repeated_units(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).select(F.col("locator").alias("of"), "spans")
    rows = docs.select(where.alias("at"), whole_row(docs).alias("row")).join(spans, F.col("at") == F.col("of"), "left")
    text = F.col("row").getField(text_col)
    cut = F.when(F.col("spans").isNotNull(), cut_spans(text, F.col("spans"))).otherwise(text).alias(text_col)
    return rows.select(*[cut if c == text_col else F.col("row").getField(c).alias(c) for c in names], F.coalesce("spans", F.array().cast(SPANS)).alias("removed_spans"))
