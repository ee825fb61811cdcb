"""Frequent spans of tokens, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Batches, shared_folder

#: Bits of a map of hashes that goes to all tasks: 2^20 rows of 64 bits at most, whatever the number of hashes.
MAP_BITS = 26
#: So many projects are a bit each of one number; more are counted by one more grouping.
MASKED = 64


def token_key(token: Column, seed: int) -> Column:
    """What a token is known by: 64 bits, which ``injective_seed`` holds against all tokens."""
    return F.xxhash64(F.lit(seed), token)


def injective_seed(tokens: DataFrame) -> int:
    """The first seed for which no two of the distinct tokens (column span) have the same key, so that keys can stand for them."""
    seed = 0
    while not tokens.groupBy(token_key(F.col("span"), seed).alias("k")).count().where("count > 1").isEmpty():
        seed += 1
    return seed


def bit_map(spans: DataFrame) -> DataFrame:
    """chunk and bits: the hashes of ``spans`` (column h), folded."""
    place = F.pmod("h", F.lit(1 << MAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return spans.groupBy(F.shiftright(place, 6).alias("chunk")).agg(F.bit_or(bit).alias("bits"))


def in_map(rows: DataFrame, bits: DataFrame, hashed: Column) -> DataFrame:
    """The rows whose hash is in the map; a few others may pass."""
    place = F.pmod(hashed, F.lit(1 << MAP_BITS))
    near = rows.withColumn("chunk", F.shiftright(place, 6)).join(F.broadcast(bits), "chunk")
    return near.where(F.call_function("getbit", "bits", place.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("chunk", "bits")


def _keys(size: int, first: int = 1) -> list[str]:
    return [f"k{n}" for n in range(first, first + size)]


def _runs(chunks: DataFrame, size: int, seed: int, spelled: bool = False) -> DataFrame:
    """All columns but ``chunk``, k1 to k<size> (the tokens' keys) and, if ``spelled``, the span of all runs of ``size`` tokens."""
    others = [F.col(c) for c in chunks.columns if c != "chunk"]
    starts = F.size("keys") - (size - 1)
    # The runs are made as one array: a row for each start would hold the whole chunk.
    parts = {f"k{n + 1}": F.slice("keys", n + 1, starts) for n in range(size)}
    if spelled:
        parts["span"] = F.transform(F.sequence(F.lit(1), starts), lambda i: F.array_join(F.slice("chunk", i, size), " "))
    keyed = chunks.where(F.size("chunk") >= size).select(*others, "chunk", F.transform("chunk", lambda t: token_key(t, seed)).alias("keys"))
    return keyed.select(*others, F.inline(F.arrays_zip(*[v.alias(k) for k, v in parts.items()])).alias(*parts))


def spans_of(chunks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The columns of ``chunks`` but chunk (an array of strings), the keys k1 to k<size> of the tokens and the span, of all runs of ``size`` tokens."""
    return _runs(chunks, size, seed, spelled=True)


def _likely(rows: DataFrame, size: int, frequent: DataFrame) -> DataFrame:
    """The rows whose first and whose last size - 1 tokens are probably spans of ``frequent`` (keys k1 to k<size - 1>). They are found
    where they stand, by a map of bounded size, so that rare spans are not shuffled."""
    bits = bit_map(frequent.select(F.xxhash64(*_keys(size - 1)).alias("h")))
    return in_map(in_map(rows, bits, F.xxhash64(*_keys(size - 1))), bits, F.xxhash64(*_keys(size - 1, 2)))


def candidate_spans(chunks: DataFrame, size: int, frequent: DataFrame | None) -> DataFrame:
    """The spans of ``size`` tokens that may be frequent: both spans of one token less are (``frequent``, column span)."""
    rows = spans_of(chunks, size)
    if frequent is not None:
        tokens = F.split("span", " ")
        rows = _likely(rows, size, frequent.select(*[token_key(F.get(tokens, F.lit(n)), 0).alias(f"k{n + 1}") for n in range(size - 1)]))
    return rows.drop(*_keys(size))


def _counted(rows: DataFrame, keys: list[str], masked: bool) -> DataFrame:
    """``keys``, count and projects. Rows have a project, or as ``mask`` its bit: then they are grouped, and shuffled, once only."""
    if masked:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.bit_or("mask").alias("mask"))
        return counts.select(*keys, "count", F.bit_count("mask").cast("long").alias("projects"))
    per_project = rows.groupBy(*keys, "project").agg(F.count(F.lit(1)).alias("n"))
    return per_project.groupBy(*keys).agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("projects"))


def _with_mask(chunks: DataFrame, projects: DataFrame) -> tuple[DataFrame, bool]:
    """``chunks`` with the bit of its project (a string) instead of it, if there are few projects."""
    found = [r[0] for r in projects.distinct().limit(MASKED + 1).collect()] if chunks.schema["project"].dataType.typeName() == "string" else []
    if not 0 < len(found) <= MASKED:
        return chunks.select("project", "chunk"), False
    known = F.array(*[F.lit(p) for p in found if p is not None]).cast("array<string>")
    at = F.coalesce(F.array_position(known, F.col("project")) - 1, F.lit(len(found) - 1))  # a null project's bit is the last
    return chunks.select(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")).alias("mask"), "chunk"), True


def frequent_spans(chunks: DataFrame, most: int = 3, min_count: int = 3, min_projects: int = 1, projects: DataFrame | None = None) -> DataFrame:
    """span (tokens joined by blanks; they hold none), size, count and projects of the runs of 1 to ``most`` tokens that
    stand ``min_count`` times in chunks (project, chunk: array of strings), and in ``min_projects`` projects.

    A span is as frequent as its parts at most, so a longer one is looked at only where both of its
    parts were found. The map may let rare spans pass; their exact counts drop them. Empty and null chunks hold none.
    Longer spans are counted by their tokens' keys and spelled once they were found frequent; each level is written below
    ``spark.checkpoint.dir`` and so made once. ``projects``: a cheaper table of the column project that has at least all those of ``chunks``."""
    spark = chunks.sparkSession
    batches = Batches(spark, shared_folder(spark))
    chunks, masked = _with_mask(chunks, (chunks if projects is None else projects).select("project"))
    enough = (F.col("count") >= min_count) & (F.col("projects") >= min_projects)
    owner = "mask" if masked else "project"
    tokens = chunks.select(owner, F.explode("chunk").alias("span"))
    counted = batches.write("tokens", "rows", _counted(tokens, ["span"], masked))
    seed = injective_seed(counted)
    last = words = batches.write("level-1", "rows", counted.where(enough).withColumn("k1", token_key(F.col("span"), seed)))
    batches.drop("tokens")
    levels = [words]
    for size in range(2, most + 1):
        keys = _keys(size)
        rows = _likely(_runs(chunks, size, seed), size, last)
        found = _counted(rows, keys, masked).where(enough)
        heads = last.select(*keys[:-1], F.col("span").alias("head"))
        tails = words.select(F.col("k1").alias(keys[-1]), F.col("span").alias("tail"))
        # A key that rare tokens share with none is no frequent token's: what the map let pass wrongly meets no row here.
        spelled = found.join(heads, keys[:-1]).join(tails, keys[-1]).select(*keys, F.concat_ws(" ", "head", "tail").alias("span"), "count", "projects")
        last = batches.write(f"level-{size}", "rows", spelled)
        levels.append(last)
    return reduce(DataFrame.unionByName, [level.select("span", F.lit(n).alias("size"), "count", "projects") for n, level in enumerate(levels, 1)])
