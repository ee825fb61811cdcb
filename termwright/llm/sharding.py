"""Proportional stratified interleaving into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, located, shuffled_hash, shuffled_rank, source_key, written


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the row's frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def stratified_shards(docs: DataFrame, n_shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal all rows into ``n_shards`` shards that each match the corpus' mixture of sources.

    Rows of a source are ranked in a seeded shuffle; row r of n gets the fraction
    (r + 1/2) / n. All rows are put in the order of the fraction and that order is cut into
    equal runs, so that shards differ by one row at most and hold each source to within
    about one row of its share.

    Returns doc_id, source, size, text_crc32, shard, slot (place in the shard, from 0) and
    position (place in the whole order). Null texts count as empty; a null source is a
    source of its own; null ids are kept, and shuffled by their rows' places. Rows that agree in id, text and source are
    interchangeable; each has a place of its own. Only the named columns are read, so
    others may have any name. An empty table gives no rows; with fewer rows than shards
    some shards stay empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    docs, where = located(docs)
    row_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    narrow = written(
        docs.select(
            row_id.alias("doc_id"),
            source.alias("source"),
            source_key(source).alias("__src"),
            text_size(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            shuffled_hash(seed, row_id, text, where).alias("__h"),
        ),
        "shards",
    )
    rows = narrow.count()
    bits = bucket_bits(rows)
    ranked = shuffled_rank(narrow, "__src", "__h", ["doc_id", "text_crc32", "size"], bits)
    buckets = 1 << bits
    ranked = ranked.withColumn("__fraction", (F.col("__rank") + F.lit(0.5)) / F.col("__group_rows")).withColumn(
        "__slice", F.least(F.floor(F.col("__fraction") * buckets), F.lit(buckets - 1)).cast("int")
    )
    # One row per slice of the unit interval: at most 2^16 rows meet in the window below.
    lower = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranked.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__slice").orderBy("__fraction", "__src", "__rank")
    n, k = F.lit(rows).cast("long"), F.lit(n_shards).cast("long")
    return (
        ranked.withColumn("__at", F.row_number().over(within) - 1)
        .join(slices, "__slice")
        .withColumn("position", F.col("__before") + F.col("__at"))
        .withColumn("shard", F.expr(f"position * {n_shards}L div {max(rows, 1)}L").cast("int"))
        .withColumn("slot", F.col("position") - F.ceil(F.col("shard").cast("long") * n / k))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot", "position")
    )
