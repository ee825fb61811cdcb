"""Stored state that new batches are merged into: a dictionary that only grows, and counts of terms.

A batch that has been merged is known by its key: merging it again, as a stream does after a failure,
changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..sources.store import Batches, numbered
from . import candidates as ops

ITEMS = "word string, reading string, id string, hint string, ord long"


class Dictionary:
    """word, reading, id, hint and ord of the items, in a folder. What is there stays as it is; new
    pairs of reading and word come behind it, each once, numbered without gaps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.batches = Batches(spark, folder)

    def items(self) -> DataFrame:
        """All items, with the batch that brought each."""
        return self.batches.read("items", ITEMS)

    def start(self, existing: DataFrame, *order: str) -> None:
        """Take over existing items (word, reading, id, hint) as they are, in the given order; repeated ones too."""
        if self.batches.done():
            raise ValueError("the dictionary has items already")
        name = self.batches.next_name("existing")
        self.batches.write(name, "items", numbered(self.batches, name, existing, *order).select("word", "reading", "id", "hint", "ord"))
        self._finish(name)

    def merge(self, offered: DataFrame, key: str | int, *order: str) -> DataFrame:
        """Append the offered pairs (word, reading, hint) that the dictionary lacks, in the given order (``ord`` if
        none is given), each as its first row says. Returns added, skipped and total. A null reading or word is
        an empty one, as in the items; an empty hint is none."""
        key, order = str(key), order or ("ord",)
        offered = offered.withColumns({"reading": F.coalesce("reading", F.lit("")), "word": F.coalesce("word", F.lit(""))})
        name = next((n for n in self.batches.done() if n.split("-", 1)[1] == key), None)
        if name is None:
            name = self.batches.next_name(key)
            known = self.items().select(F.coalesce("reading", F.lit("")).alias("reading"), F.coalesce("word", F.lit("")).alias("word")).distinct()
            first = F.min(F.struct(*order, F.col("hint").alias("__hint"))).alias("first")
            once = offered.groupBy("reading", "word").agg(first).join(known, ["reading", "word"], "left_anti")
            rows = once.select("word", "reading", words.stable_id(F.col("word"), F.col("reading")).alias("id"), F.expr("nullif(first.__hint, '')").alias("hint"), F.col("first"))
            size = self.items().count()
            self.batches.write(name, "items", numbered(self.batches, name, rows, "first", "reading", "word", start=size).select("word", "reading", "id", "hint", "ord"))
            self._finish(name)
        done = self.batches.done()
        added = self.batches.read("items", ITEMS, [name]).count()
        total = self.batches.read("items", ITEMS, done[: done.index(name) + 1]).count()
        return self.batches.spark.createDataFrame([(added, offered.count() - added, total)], "added long, skipped long, total long")

    def merge_batch(self, offered: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: rows with word, reading, hint and ord."""
        self.merge(offered, f"stream-{batch}")

    def _finish(self, name: str) -> None:
        self.batches.finish(name)
        self.batches.drop(f"{name}/_placed-ord")


FORMS = "lower string, form string, n long"
BITS = "lower string, chunk long, bits long"
NAMES = "project string, number long"


class TermCounts:
    """What the choice of a spelling and the counts of its term need, in a folder: per form its count and first
    place; per term the projects it occurs in as bits, 64 to a row, so that a term of few projects is a few
    bytes; and the number of each project. Old texts aren't read again. All parts are merged by sums, minima
    and bitwise or, in any order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.batches = Batches(spark, folder)

    def add(self, forms: DataFrame, key: str | int) -> None:
        """Merge counted forms (lower, form, project, n, first_seq; see ``candidates.ascii_forms_of``) of new texts."""
        if self.batches.has(str(key)):
            return
        done, name = self.batches.done(), self.batches.next_name(str(key))
        forms = self.batches.write(name, "_new", forms.select("lower", "form", F.coalesce(F.concat(F.lit("="), "project"), F.lit("")).alias("project"), "n", "first_seq"))
        place = forms.schema["first_seq"].dataType.simpleString()
        names = self._read("names", NAMES, done)
        new = forms.select("project").distinct().join(names, "project", "left_anti")
        names = names.unionByName(numbered(self.batches, name, new, "project", column="number", start=names.count()))
        names = self.batches.write(name, "names", names)
        counts = forms.select("lower", "form", "n", "first_seq").unionByName(self._read("forms", f"{FORMS}, first_seq {place}", done))
        self.batches.write(name, "forms", counts.groupBy("lower", "form").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number").bitwiseAND(F.lit(63)).cast("int"))
        seen = forms.select("lower", "project").distinct().join(names, "project").select("lower", F.shiftright("number", 6).alias("chunk"), bit.alias("bits"))
        self.batches.write(name, "bits", seen.unionByName(self._read("bits", BITS, done)).groupBy("lower", "chunk").agg(F.bit_or("bits").alias("bits")))
        self.batches.finish(name)
        for spare in ("_new", "_placed-number"):
            self.batches.drop(f"{name}/{spare}")
        for old in done[:-1]:  # the last but one stays for readers that have begun
            self.batches.drop(old)

    def _read(self, table: str, schema: str, done: list[str] | None = None) -> DataFrame:
        return self.batches.read(table, schema, (self.batches.done() if done is None else done)[-1:]).drop("batch")

    def canonical(self) -> DataFrame:
        """lower, word, count, projects and first_seq, as ``candidates.canonical_forms`` gives them for all texts."""
        done = self.batches.done()
        if not done:
            raise ValueError("no batch has been added")
        path = f"{self.batches.folder}/{done[-1]}/forms"
        forms = self.batches.spark.read.parquet(path)
        projects = self._read("bits", BITS).groupBy("lower").agg(F.sum(F.bit_count("bits").cast("long")).alias("projects"))
        return ops.spelled(forms).join(projects, "lower").select("lower", "word", "count", "projects", "first_seq")
