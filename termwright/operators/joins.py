"""Joins whose keys may be very uneven, and tables whose rows stand in few parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more rows than this part of a table are fewer than its inverse, so their rows of the other side may be broadcast.
PARTS = 1000
#: Fewer rows than this are no burden to a task.
LEAST = 100_000
#: Fewer rows than this are left to one task.
SPREAD = 1000


def join_uneven(left: DataFrame, right: DataFrame, key: str, how: str = "left", least: int = LEAST) -> DataFrame:
    """``left`` joined with ``right`` (one row per key). The rows of the few keys that hold more than a thousandth of
    ``left`` (and ``least`` rows) don't move: the keys' rows of ``right``, fewer than 1,000, go to them."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    bar = max(sizes["all"] // PARTS, least)
    if sizes["most"] <= bar:
        return left.join(right, key, how)
    frequent = [r[0] for r in counts.where((F.col("n") > bar) & F.col(key).isNotNull()).select(key).collect()]
    is_frequent = F.coalesce(F.col(key).isin(frequent), F.lit(False))
    usual = left.where(~is_frequent).join(right, key, how)
    return usual.unionByName(left.where(is_frequent).join(F.broadcast(right.where(is_frequent)), key, how))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its rows stand in few parts: what is one row group in a file is read by one task, however
    large. Only the numbers of rows are read to see that. Rows of a table that is well divided, or tiny, stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if sizes["all"] < SPREAD or sizes["most"] * cores <= 2 * sizes["all"]:
        return df
    return df.repartition(4 * cores, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
