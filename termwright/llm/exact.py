"""Exact deduplication as a stateful stream (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, among, located, scratch_path, without, written

#: White space that doesn't count in a comparison, U+0020 and U+0009 to U+000D.
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(log: DataFrame, log_path: str, state_path: str, files_per_batch: int) -> DataFrame:
    """Run what is new in the digest log through a stream whose state is keyed by digest, and
    return the state's entries.

    State is kept on disk (RocksDB, with its change files in the shared folder) and never
    expires. A digest's entry is its best row so far (most code points, then smallest id,
    then locator) and how many rows had it. The stream stops at the end of the log; the
    entries are then read from the state itself.
    """
    spark = log.sparkSession
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    # Many small stores: files that are allocated ahead would take more room than the state.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    entries = (
        session.readStream.schema(log.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(log_path)
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    query = entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    state = spark.read.format("statestore").load(state_path)
    # Only final digests are kept in the value: its fields stand in the order of the aggregates.
    best, size = [f.name for f in state.schema["value"].dataType.fields]
    found = state.select(F.col("key.digest").alias("digest"), F.col(f"value.{best}").alias("best"), F.col(f"value.{size}").alias("group_size"))
    if found.isEmpty():
        raise RuntimeError(f"no state was found in {state_path}, though the digest log holds rows")
    return found


def _of_digests(rows: DataFrame, digests: DataFrame, digest: Column, scratch: Scratch) -> DataFrame:
    """The rows (with ``digest``) whose digest is listed; no other text is moved if the list is
    of a size that may be broadcast."""
    keys = scratch.written(digests.select(F.xxhash64("digest").alias("__k")).distinct(), "keys")
    rows = rows.withColumn("digest", digest).withColumn("__k", F.xxhash64("digest"))
    return among(rows, keys, "__k").drop("__k").join(digests, "digest", "left_semi")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int = 64,
    state_path: str | None = None,
) -> DataFrame:
    """Find documents whose texts agree in all but ASCII white space.

    Of equal texts the row with the most code points stays, then the one with the smallest
    id. A log of digests is streamed through keyed state (see ``keyed_state``). On hits, that is
    for digests that several rows have, the full bytes are compared; where a digest has more
    than one text (``digest`` may be weak) those rows are grouped by their texts instead.

    ``state_path``: a shared folder that keeps log and state. A later batch of documents with
    the same path is held against all batches before it: its rows' keep_id, keep_locator and
    group_size tell of them too, and the earlier texts of hits are read where their locators
    say, so those files must stay and name the text alike. Without it the state is scratch data.

    Returns doc_id, locator, digest, keep_id, keep_locator, group_size and kept, a row per
    input row. Null and white-space-only texts are equal to the empty text. A null id comes
    after all others. Rows that agree in id and text are copies like any other: the one
    with the smallest locator stays. Other columns may have any name. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    docs, where = located(docs)
    text = F.col(f"`{text_col}`")

    def narrowed(frame: DataFrame) -> DataFrame:
        at = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index"))
        return frame.select(at.alias("locator"), squeezed(text).alias("norm"), (-F.length(F.coalesce(text, F.lit("")))).alias("shorter"))

    base = state_path.rstrip("/") if state_path else scratch_path(spark, "dedup")
    path = f"{base}/log"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), where.alias("locator"), squeezed(text).alias("norm"), (-F.length(F.coalesce(text, F.lit("")))).alias("shorter"))
    fresh = rows.select("doc_id", "locator", "shorter", digest(F.col("norm")).alias("digest"))
    own = written(fresh, "digest-batch") if state_path else None
    (fresh if own is None else own).write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    own = log if own is None else own
    none = spark.createDataFrame([], "digest string, best struct<shorter:int,no_id:boolean,doc_id:bigint,locator:string>, group_size bigint")
    entries = none if log.isEmpty() else keyed_state(log, path, f"{base}/state", files_per_batch)
    if state_path:
        entries = written(entries.join(own.select("digest").distinct(), "digest", "left_semi"), "entries")
    columns = ["doc_id", "locator", "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size"]
    with Scratch(spark) as scratch:
        hits = scratch.written(entries.where("group_size > 1").select("digest"), "hits")
        # Full bytes: a digest's texts are the same if the least equals the greatest. Each task
        # sends one row per digest at most, so a group of any size is compared without skew.
        met = _of_digests(rows.select("norm"), hits, digest(F.col("norm")), scratch)
        if state_path:
            met = met.unionByName(_earlier(spark, log, own, hits, narrowed).select("norm", "digest"))
        torn = met.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where(F.col("least") != F.col("most")).select("digest")
        torn = written(torn, "torn-digests")
        if torn.isEmpty():
            return own.join(entries, "digest").select(*columns).withColumn("kept", F.col("locator") == F.col("keep_locator"))
        split = _of_digests(rows, torn, digest(F.col("norm")), scratch)
        every = split.select("digest", "norm", "shorter", "doc_id", "locator")
        if state_path:
            every = every.unionByName(_earlier(spark, log, own, torn, narrowed).select("digest", "norm", "shorter", "doc_id", "locator"))
        best = F.min(F.struct("shorter", F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("best")
        groups = every.groupBy("digest", "norm").agg(best, F.count(F.lit(1)).alias("group_size"))
        parted = written(split.join(groups, ["digest", "norm"]).select(*columns), "torn-rows")
    whole = own.join(torn, "digest", "left_anti").join(entries, "digest").select(*columns)
    return whole.unionByName(parted).withColumn("kept", F.col("locator") == F.col("keep_locator"))


def _earlier(spark: SparkSession, log: DataFrame, own: DataFrame, digests: DataFrame, narrowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """digest, doc_id, locator, shorter and norm of earlier batches' rows with these digests, their
    texts read from the files that the log names. One row per file comes to the driver."""
    old = log.join(digests, "digest", "left_semi").join(own.select("locator"), "locator", "left_anti")
    old = written(old.select("digest", "doc_id", "locator"), "earlier")
    files = [r[0] for r in old.select(F.url_decode(F.replace(F.regexp_replace("locator", "#[0-9]+$", ""), F.lit("+"), F.lit("%2B"))).alias("f")).distinct().collect()]
    if not files:
        return spark.createDataFrame([], "digest string, doc_id bigint, locator string, shorter int, norm string")
    return narrowed(spark.read.parquet(*files)).join(old, "locator")


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns: of each group of equal texts the
    one that ``exact_duplicates`` keeps. Rows are told apart by their place in the files."""
    docs, _ = located(docs)
    gone = exact_duplicates(docs, **options).where(~F.col("kept")).select("locator")
    return without(docs, written(gone, "exact-gone"))
