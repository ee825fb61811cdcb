"""Chat transcripts and prompt history as utterances.

Records are parsed to VARIANT, since a message's content is a string or an array of blocks.
A line that isn't a JSON object is skipped. Of a repeated key the last value counts (see
``session``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning

UTTERANCE = "utt struct<source:int,path:string,block:bigint,line:bigint,part:int>, project string, role string, text string"


def session(spark: SparkSession) -> SparkSession:
    """Let repeated keys in records stand, the last one counting."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def truthy(record: Column, path: str) -> Column:
    """Whether a member counts as true: not missing, null, false, zero or empty."""
    value = _get(record, path, "variant")
    kind = F.schema_of_variant(value)
    return F.coalesce(
        F.when(kind.isin("VOID", "OBJECT<>"), False)
        .when(kind == "BOOLEAN", _get(record, path, "boolean"))
        .when(kind == "STRING", _get(record, path, "string") != "")
        .when(kind.startswith("ARRAY"), F.size(_get(record, path, "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), True)
        .otherwise(_get(record, path, "double") != 0),
        F.lit(False),
    )


def message_texts(content: Column) -> Column:
    """The texts of a message: itself if it is a string, else those of its text blocks."""
    kind = F.schema_of_variant(content)
    blocks = F.filter(
        content.cast("array<variant>"),
        lambda b: F.schema_of_variant(b).startswith("OBJECT") & (_get(b, "$.type", "string") == "text"),
    )
    return F.when(kind == "STRING", F.array(content.cast("string"))).when(
        kind.startswith("ARRAY"), F.transform(blocks, lambda b: F.coalesce(_get(b, "$.text", "string"), F.lit("")))
    )


def parse_transcript(lines: DataFrame, include_assistant: bool = False, include_sidechain: bool = False) -> DataFrame:
    """Utterances (not yet cleaned) of raw transcript lines.

    ``lines``: value, slug (used where a record names no project) and utt (order key without
    the part). The line is searched for the type's key before it is parsed.
    """
    roles = ["user", "assistant"] if include_assistant else ["user"]
    records = lines.where(F.col("value").contains('"type"')).withColumn("r", F.try_parse_json("value"))
    r = F.col("r")
    kept = records.where(F.schema_of_variant(r).startswith("OBJECT") & _get(r, "$.type", "string").isin(*roles) & ~truthy(r, "$.isMeta"))
    if not include_sidechain:
        kept = kept.where(~truthy(r, "$.isSidechain"))
    kept = kept.where(F.schema_of_variant(_get(r, "$.message", "variant")).startswith("OBJECT"))
    cwd = _get(r, "$.cwd", "string")
    return kept.select(
        "utt",
        F.coalesce(F.when(cwd != "", cwd), F.col("slug")).alias("project"),
        _get(r, "$.type", "string").alias("role"),
        F.posexplode(message_texts(_get(r, "$.message.content", "variant"))).alias("part", "text"),
    )


def parse_history(lines: DataFrame) -> DataFrame:
    """Utterances (not yet cleaned) of raw prompt-history lines; the slash command is left off."""
    r = F.col("r")
    project = _get(r, "$.project", "string")
    return (
        lines.withColumn("r", F.try_parse_json("value"))
        .where(F.schema_of_variant(r).startswith("OBJECT"))
        .select(
            "utt",
            F.when(project != "", project).otherwise("?").alias("project"),
            F.lit("user").alias("role"),
            F.lit(0).alias("part"),
            cleaning.strip_slash_command(F.coalesce(_get(r, "$.display", "string"), F.lit(""))).alias("text"),
        )
    )


def cleaned(utterances: DataFrame, japanese_only: bool = True) -> DataFrame:
    """Utterances with cleaned text; blank ones go."""
    out = utterances.withColumn("text", cleaning.clean_text(F.col("text"), japanese_only))
    return out.where(cleaning.not_blank(F.col("text")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files. One that is gone or can't be read gives what could be read of it; ``file_report`` names it."""
    return spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").text(path)


def _lines(spark: SparkSession, path: str, source: int) -> DataFrame:
    parent = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    return (
        _raw(spark, path)
        .select(
            F.make_valid_utf8("value").alias("value"),
            F.url_decode(F.replace(parent, F.lit("+"), F.lit("%2B"))).alias("slug"),
            F.struct(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("utt"),
        )
    )


def splits(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where a split starts), lines, bytes (of lines, without their ends), first (the
    least running number) and before (lines of the file's earlier splits) of each split of the files.

    One pass counts all lines; the sums over splits run on one row a split, within a file.
    """
    counted = (
        _raw(spark, path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.octet_length("value").cast("long").alias("size"))
        .groupBy("path", "block")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("size").alias("bytes"), F.min("line").alias("first"))
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))


def with_line_numbers(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` (see ``_lines``) with the line's number in its file, from 0, as ``utt.line`` and 0 as
    ``utt.block``: the same however the files are split. ``found``: the files' ``splits``."""
    known = found.select(F.struct("path", "block").alias("at"), (F.col("before") - F.col("first")).alias("shift"))
    out = lines.withColumn("at", F.struct("utt.path", "utt.block")).join(known, "at")
    line = F.struct(F.col("utt.source"), F.col("utt.path"), F.lit(0).cast("long").alias("block"), (F.col("utt.line") + F.col("shift")).alias("line"))
    return out.withColumn("utt", line).drop("at", "shift")


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """path, size, lines, bytes_read and reason of every file that ``path`` (a glob) names and that isn't empty; reason is null
    where all of it was read.

    A file ends its lines with one byte or two, the last one perhaps with none, and may begin
    with a byte order mark: what is missing beyond that was not read ("unreadable": none of
    it was). Sizes come from the listing, no content is read for them.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    read = splits(spark, path).groupBy("path").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes_read"))
    uri = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  # the two readers write local paths differently
    plain = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    joined = listed.withColumn("at", uri(F.col("path"))).join(read.select(uri(plain(F.col("path"))).alias("at"), "lines", "bytes_read"), "at", "left")
    joined = joined.withColumns({"lines": F.coalesce("lines", F.lit(0)), "bytes_read": F.coalesce("bytes_read", F.lit(0))})
    missing = F.col("size") > F.col("bytes_read") + 2 * F.col("lines") + F.when(F.col("lines") > 0, 3).otherwise(0)
    return joined.select("path", "size", "lines", "bytes_read", F.when(missing, F.when(F.col("lines") == 0, "unreadable").otherwise("read in part")).alias("reason"))


def _numbered(df: DataFrame) -> DataFrame:
    key = F.struct(*[F.col(f"utt.{c}").alias(c) for c in ("source", "path", "block", "line")], F.col("part"))
    return df.select(key.cast("struct<source:int,path:string,block:bigint,line:bigint,part:int>").alias("utt"), "project", "role", "text")


def read_utterances(spark: SparkSession, root: str, include_assistant: bool = False, include_sidechain: bool = False, use_history: bool = True, japanese_only: bool = True, line_numbers: bool = False) -> DataFrame:
    """All utterances below ``root``: projects/*/*.jsonl and, if wanted, history.jsonl.

    A prompt that is in both counts twice. Missing files give no rows; unreadable ones are left
    out (see ``file_report``). ``utt`` orders utterances by file and place; with ``line_numbers`` it holds line numbers
    that don't depend on how files are split, for one more pass over the lines.
    """
    session(spark)

    def lines(path: str, source: int) -> DataFrame:
        found = _lines(spark, path, source)
        return with_line_numbers(found, splits(spark, path)) if line_numbers else found

    parts = []
    if _exists(spark, f"{root}/projects/*/*.jsonl"):
        parts.append(parse_transcript(lines(f"{root}/projects/*/*.jsonl", 0), include_assistant, include_sidechain))
    if use_history and _exists(spark, f"{root}/history.jsonl"):
        parts.append(parse_history(lines(f"{root}/history.jsonl", 1)))
    if not parts:
        return spark.createDataFrame([], UTTERANCE)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return cleaned(_numbered(out), japanese_only)


def metrics(utterances: DataFrame) -> DataFrame:
    """utterances, characters and projects, in one row."""
    return utterances.agg(F.count(F.lit(1)).alias("utterances"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters"), F.countDistinct("project").alias("projects"))
