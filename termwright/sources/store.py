"""Tables that grow by batches: each batch is a folder of its own, which counts once it is marked as done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="termwright-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


class Batches:
    """The batches of a folder: ``000000-key/<table>/*.parquet`` each. A batch without its mark (its writer failed)
    is as if it weren't there, and is overwritten by the next attempt. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self) -> list[str]:
        """The names of the finished batches in their order."""
        path, files = self._path("")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return [n for n in sorted(names) if files.exists(self._path(f"{n}/_DONE")[0])]

    def has(self, key: str) -> bool:
        return any(n.split("-", 1)[1] == key for n in self.done())

    def next_name(self, key: str) -> str:
        return f"{len(self.done()):06d}-{key}"

    def write(self, name: str, table: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, name: str) -> None:
        path, files = self._path(f"{name}/_DONE")
        files.create(path, True).close()

    def drop(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def read(self, table: str, schema: str, names: list[str] | None = None) -> DataFrame:
        """The rows of a table in all finished batches, or in ``names``, with the batch's name."""
        found = self.done() if names is None else names
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit("").cast("string"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}/{table}" for n in found])
        return rows.withColumn("batch", F.element_at(F.split("_metadata.file_path", "/"), -3))


def numbered(batches: Batches, name: str, df: DataFrame, *order: str, column: str = "ord", start: int = 0) -> DataFrame:
    """``df`` with gapless numbers from ``start`` on in the given order. Rows are sorted in ranges, side by side; each
    range counts its own and adds the numbers of those before it, so no task ever holds all rows."""
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = batches.write(name, f"_placed-{column}", placed)  # once, so that both uses see the same ranges
    part = F.shiftright("__at", 33)
    before, total = {}, start
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per range
        before[r["part"]], total = total, total + r["count"]
    offsets = batches.spark.createDataFrame(list(before.items()), "__part long, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(column, rank).drop("__part", "__before", "__at")
