"""Helpers shared by the training-data operators: scratch tables in the shared folder and
a distributed rank that never gathers a group into one task."""

from __future__ import annotations

import atexit
import contextlib
import logging
import math
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only on one machine (a local master), where it is unset, is a temporary folder made and
    set. A cluster without the setting is refused: executors would write to folders of their
    own, and later reads would miss those files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif context.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="termwright-")
            context.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


BATCH = 1000  # rows at a time that Python workers get while a scratch table is made
_used: set[str] = set()  # applications that have a scratch folder


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/termwright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder, which goes when the driver ends."""
    root = _scratch_root(spark)
    if root not in _used:
        _used.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        unlink(spark, root)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. Results that read them must be written
    or collected before."""
    unlink(spark, _scratch_root(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, is
    computed once, and survives lost executors."""
    return _written(df, scratch_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(int(before), BATCH) if int(before) > 0 else BATCH)  # for this job only: rows may be whole texts
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only the inside of an operator reads: they go at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            unlink(self.spark, path)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        return _written(df, self.paths[-1])


def unlink(spark: SparkSession, path: str) -> None:
    """Remove a superseded scratch table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and the locator of its rows: file and row number. Ids may be null or repeat;
    a locator is one row's own. A frame that isn't a plain file scan is written to the
    shared folder first, so that locators are stable."""
    where = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index"))
    if "_metadata" in docs.columns:
        raise ValueError("a column named _metadata hides the place of rows")
    quiet = PySparkLogger.getLogger("DataFrameQueryContextLogger")  # a plain logger of that name would break PySpark's own use of it
    level = quiet.level
    quiet.setLevel(logging.CRITICAL)
    try:
        docs.select(where.alias("w")).schema  # noqa: B018
    except AnalysisException:
        docs = written(docs, "located")
    finally:
        quiet.setLevel(level)
    return docs, where


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (see ``located``) whose locator isn't in ``gone`` (column locator)."""
    docs, where = located(docs)
    rows = docs.select(where.alias("at"), whole_row(docs).alias("row"))
    return rows.join(gone.select(F.col("locator").alias("gone")), F.col("at") == F.col("gone"), "left_anti").select("row.*")


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct: beside it no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


#: Keys (64-bit) that may be sent to all executors: 8 bytes each, some 32 in the hash table.
MOST_BROADCAST = 1_000_000


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is one of ``keys`` (a written table of distinct hashes). Keys of a
    checked number go to the rows, so that only rows that stay are moved later. More of them
    meet the rows by a shuffle, before which a map of 2^26 bits (2^20 rows at most, whatever
    the number of keys) leaves out most rows whose key none of them has; with 2^26 keys and
    more it leaves out few. The last join is an inner one: a semi-join would be moved below
    the map's join, and the shuffle with it."""
    if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(keys), column, "left_semi")
    place = lambda c: F.pmod(F.col(c), F.lit(1 << 26))
    bit = lambda c: place(c).bitwiseAND(F.lit(63)).cast("int")
    bits = keys.groupBy(F.shiftright(place(column), 6).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(column))).alias("__bits"))
    near = rows.withColumn("__w", F.shiftright(place(column), 6)).join(F.broadcast(bits), "__w")
    near = near.where(F.call_function("getbit", F.col("__bits"), bit(column)) == 1).drop("__w", "__bits")
    return near.join(keys, column)


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks under ``name``. Anything kept under another
    name is dropped: a worker that has served one operator doesn't hold its memory in the next."""
    store = sys.modules.setdefault("_termwright_worker", types.ModuleType("_termwright_worker"))
    if store.__dict__.get("name") != name:
        store.__dict__.update(name=name, kept=None)
        store.__dict__["kept"] = make()
    return store.__dict__["kept"]


def source_key(source: Column) -> Column:
    """A non-null key of a nullable label: null and the empty label stay apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shuffled_hash(seed: int, row_id: Column, text: Column | None, where: Column) -> Column:
    """A signed 64-bit key of a seeded shuffle: the head of the SHA-256 of seed, id and text. A row
    without an id takes its place in the files instead, so that such rows don't all meet."""
    parts = [F.lit(f"{seed}|"), F.coalesce(row_id.cast("string"), where), F.lit("|")]
    if text is not None:
        parts.append(F.coalesce(text.cast("string"), F.lit("")))
    head = F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16)
    return F.conv(head, 16, -10).cast("long")


def bucket_bits(rows: int, per_bucket: int = 128, most: int = 16) -> int:
    """Bits of the hash that number the buckets of a distributed rank."""
    return min(most, max(4, math.ceil(math.log2(max(rows, 1) / per_bucket + 1))))


def shuffled_rank(df: DataFrame, key: str, hash_col: str, order: list[str], bits: int, counted: DataFrame | None = None) -> DataFrame:
    """Add ``__rank`` (from 0, in the order of ``hash_col`` then ``order``) within ``key``
    and ``__group_rows``.

    A row's bucket is the top ``bits`` of its hash. Rows are numbered within (bucket, key)
    and moved up by the counts of the lower buckets, so a key that holds a third of all
    rows is spread over all tasks. ``counted``: the frame to count on, if a cheaper scan
    than ``df`` gives the same key and hash.
    """
    bucket = F.shiftright(F.col(hash_col), 64 - bits)
    lower = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        (df if counted is None else counted)
        .select(F.col(key).alias("__key"), bucket.alias("__bucket"))
        .groupBy("__key", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            F.col("__key").alias(key),
            "__bucket",
            F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy("__key")).alias("__group_rows"),
        )
    )
    within = Window.partitionBy(key, "__bucket").orderBy(hash_col, *order)
    return (
        df.withColumn("__bucket", bucket)
        .withColumn("__in_bucket", F.row_number().over(within) - 1)
        .join(sizes, [key, "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__in_bucket"))
        .drop("__bucket", "__in_bucket", "__before")
    )
