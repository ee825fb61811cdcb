"""Cascading erasure: tables laid out as ordered files of equal length, and the rewrite of just those
files that hold rows of erased owners.

A table is sorted by a key and by all its columns; a row's place in that order is its rank, and file
``rank div rows_per_file`` holds it. The ranks of an erased owner's rows are collapsed into intervals
before anything is joined, so an owner with a third of all rows is a few intervals per partition, not a hot
key. Intervals are split at the files' borders by whole-number division, and each touched file is
streamed once: the slices of its Arrow batches between the intervals, none of them copied, make the
new file.

Tasks write under names of their own in a staging folder and only report them; the driver renames what
the winning attempts reported and removes what they replace. So a task that is lost and run again, or
run twice, never reads its own output and never leaves a second file. What the driver handles is one
name per file, ``files + 1`` per table at most, whatever the number of rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, unlink

FILES = 150
ROW_GROUP = 131_072  # rows


def client_key(owner: Column) -> Column:
    """CRC-32 of an id in decimal; of the empty string for a null one."""
    return F.crc32(F.coalesce(owner.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Layout:
    """A table that lies in ordered files."""

    name: str
    folder: str
    rows_per_file: int
    paths: dict[int, str]  # one name per file
    ranks: DataFrame  # part, rank and tag of each row, as written


class _Rows:
    """Writes batches to one new Parquet file, in row groups of ``ROW_GROUP`` rows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.name = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.files, self.path = fs.FileSystem.from_uri(self.name)
        self.files.create_dir(self.path.rpartition("/")[0])
        self.writer, self.waiting, self.n, self.n_waiting = None, [], 0, 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.waiting.append(rows)
        self.n += rows.num_rows
        self.n_waiting += rows.num_rows
        if self.n_waiting >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        import pyarrow.parquet as pq

        if self.waiting:
            table = pa.Table.from_batches(self.waiting)  # slices side by side; nothing is copied
            self.writer = self.writer or pq.ParquetWriter(self.path, table.schema, filesystem=self.files)
            self.writer.write_table(table, row_group_size=ROW_GROUP)
            self.waiting, self.n_waiting = [], 0

    def close(self) -> int:
        self._flush()
        if self.writer is not None:
            self.writer.close()
        return self.n


_REPORT = "file_no long, staged string, n long"


def _report(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file_no": [f for f, _, _ in found], "staged": [s for _, s, _ in found], "n": [n for _, _, n in found]}, schema=pa.schema([("file_no", pa.int64()), ("staged", pa.string()), ("n", pa.int64())]))


def _files_of(staging: str):
    """For mapInArrow: rows in the order of file_no and rank become one staged file per file_no."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        now, out = None, None
        for batch in batches:
            rows, numbers = pa.RecordBatch.from_struct_array(batch.column("row")), batch.column("file_no")
            start = 0
            while start < batch.num_rows:
                number = numbers[start].as_py()
                size = pc.sum(pc.equal(numbers.slice(start), number)).as_py()  # equal numbers stand together
                if number != now:
                    if out is not None:
                        yield _report([(now, out.name, out.close())])
                    now, out = number, _Rows(staging)
                out.add(rows.slice(start, size))
                start += size
        if out is not None:
            yield _report([(now, out.name, out.close())])

    return write


def survivors(batches: Iterator[pa.RecordBatch], spans: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The zero-copy slices of consecutive batches that no span [start, end) covers. Spans are ascending
    and may touch; both are streamed."""
    first, span = 0, next(spans, None)
    for batch in batches:
        end, at = first + batch.num_rows, first
        while span is not None and span[0] < end:
            if span[0] > at:
                yield batch.slice(at - first, span[0] - at)
            at = max(at, min(span[1], end))
            if span[1] > end:
                break
            span = next(spans, None)
        if at < end:
            yield batch.slice(at - first, end - at)
        first = end


def _rewrite(staging: str):
    """For mapInArrow: spans in the order of file_no and start, with the file's path."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file_no", "path", "start", "end")), strict=True))
        for (number, path), spans in itertools.groupby(rows, key=lambda r: r[:2]):
            files, inner = fs.FileSystem.from_uri(path)
            out = _Rows(staging)
            with files.open_input_file(inner) as source:
                for kept in survivors(pq.ParquetFile(source).iter_batches(ROW_GROUP // 2), ((s, e) for _, _, s, e in spans)):
                    out.add(kept)
            n = out.close()
            yield _report([(number, out.name if n else None, n)])

    return rewrite


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, staged: str, final: str) -> None:
    source, files = _path(spark, staged)
    target, _ = _path(spark, final)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{staged} could not be moved to {final}")


def keyed(df: DataFrame, key: Column, tag: Column) -> DataFrame:
    """``df`` as key, tag and row, a struct of all columns: so no name can clash."""
    return df.select(key.alias("key"), tag.alias("tag"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _sorted(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """part, pos, tag and row in the global order."""
    order = [F.col("key").asc(), *[F.col("row").getField(c).asc_nulls_first() for c in rows.schema["row"].dataType.names]]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return scratch.written(placed.select(F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "tag", "row"), f"sorted-{name}")


def lay_out(scratch: Scratch, table: DataFrame, name: str, folder: str, files: int = FILES) -> Layout:
    """Write the rows of ``table`` (see ``keyed``) as ``files + 1`` Parquet files at most, of 1 + n div ``files``
    consecutive rows each (the last: what is left), in the order of the key and then of all columns from left to
    right, nulls first. Equal rows may stand in either order. An empty table has no files. ``tag`` is what rows are
    erased by. All columns have to be of types that can be sorted."""
    spark = table.sparkSession
    rows = _sorted(scratch, table, name)
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row per partition
    per_file = 1 + sum(n for _, n in sizes) // files
    before = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    ranked = rows.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("pos"))
    if not sizes:
        return Layout(name, folder, per_file, {}, ranked.select("part", "rank", "tag"))
    n_files = -(-sum(n for _, n in sizes) // per_file)
    numbered = ranked.select(F.expr(f"rank div {per_file}").alias("file_no"), "rank", "row")
    dealt = numbered.repartitionById(n_files, F.col("file_no").cast("int")).sortWithinPartitions("file_no", "rank")
    staging = f"{folder}/_staging-{name}"
    done = scratch.written(dealt.mapInArrow(_files_of(staging), _REPORT), f"files-{name}").collect()  # one row per file
    paths = {r["file_no"]: f"{folder}/{name}/{r['file_no']:05d}.parquet" for r in done}
    for r in done:
        _move(spark, r["staged"], paths[r["file_no"]])
    unlink(spark, staging)
    return Layout(name, folder, per_file, paths, ranked.select("part", "rank", "tag"))


def erased_intervals(layout: Layout, victims: DataFrame) -> DataFrame:
    """file_no, start and end (exclusive) of the victims' rows in each file. ``victims``: distinct non-null tags.

    Ranks are first collapsed per partition and tag. A tag whose ranks have no gap is one interval there, of
    the others (few: they share the sort key with another owner, or aren't what the table is sorted by) the
    single ranks are fetched. Islands of touching intervals are merged, then split at the files' borders."""
    runs = layout.ranks.where(F.col("tag").isNotNull()).groupBy("part", "tag").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.lit(1)).alias("n"))
    runs = runs.join(victims.select("tag"), "tag", "left_semi").withColumn("whole", F.col("n") == F.col("hi") - F.col("lo") + 1)
    scattered = layout.ranks.join(runs.where(~F.col("whole")).select("part", "tag"), ["part", "tag"], "left_semi")
    found = runs.where("whole").select("part", "lo", "hi").unionByName(scattered.select("part", F.col("rank").alias("lo"), F.col("rank").alias("hi")))
    order = Window.partitionBy("part").orderBy("lo")
    opens = F.coalesce(F.col("lo") > F.lag("hi").over(order) + 1, F.lit(True)).cast("long")
    islands = found.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order)).groupBy("part", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    s = layout.rows_per_file
    cut = islands.select("lo", "hi", F.explode(F.sequence(F.expr(f"lo div {s}"), F.expr(f"hi div {s}"))).alias("file_no"))
    base = F.col("file_no") * s
    return cut.select("file_no", (F.greatest("lo", base) - base).alias("start"), (F.least(F.col("hi"), base + s - 1) - base + 1).alias("end"))


def erase(scratch: Scratch, layout: Layout, victims: DataFrame) -> dict[int, int]:
    """Erase the victims' rows: rewrite the files that hold some, remove those that hold nothing else, leave
    the others untouched. Returns the erased rows of each touched file; ``layout.paths`` names what is left."""
    spark = victims.sparkSession
    intervals = scratch.written(erased_intervals(layout, victims), f"intervals-{layout.name}")
    erased = {r["file_no"]: r["n"] for r in intervals.groupBy("file_no").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    if not erased:
        return {}
    paths = spark.createDataFrame(list(layout.paths.items()), "file_no long, path string")
    dealt = intervals.join(F.broadcast(paths), "file_no").repartitionById(max(erased) + 1, F.col("file_no").cast("int")).sortWithinPartitions("file_no", "start")
    staging = f"{layout.folder}/_staging-{layout.name}"
    done = scratch.written(dealt.mapInArrow(_rewrite(staging), _REPORT), f"rewritten-{layout.name}").collect()
    for r in done:
        unlink(spark, layout.paths[r["file_no"]])
        if r["staged"] is None:
            del layout.paths[r["file_no"]]
        else:
            _move(spark, r["staged"], layout.paths[r["file_no"]])
    unlink(spark, staging)
    return erased


_PRINT = "table_name string, file_no long, n_rows long, cents long, ids_sha256 string, columns string, path string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: what each listed file holds, streamed."""
    import hashlib

    import numpy as np
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    for listed in batches:
        for name, number, path, amount in zip(*(listed.column(c).to_pylist() for c in ("table_name", "file_no", "path", "amount")), strict=True):
            files, inner = fs.FileSystem.from_uri(path)
            digest, n, cents = hashlib.sha256(), 0, 0
            with files.open_input_file(inner) as source:
                parquet = pq.ParquetFile(source)
                columns = parquet.schema_arrow.names
                for rows in parquet.iter_batches(ROW_GROUP // 2, columns=list(dict.fromkeys([columns[0], amount]))):
                    ids = pc.fill_null(rows.column(columns[0]).cast(pa.string()), "").to_pylist()
                    digest.update((("," if n else "") + ",".join(ids)).encode())
                    n += rows.num_rows
                    value = rows.column(amount).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    value = np.floor(100 * value + 0.5)
                    cents += int(value[np.isfinite(value)].astype(np.int64).sum())
            yield pa.RecordBatch.from_pydict({"table_name": [name], "file_no": [number], "n_rows": [n], "cents": [cents], "ids_sha256": [digest.hexdigest()], "columns": [",".join(columns)], "path": [path]})


def files_as_read(spark: SparkSession, layouts: list[tuple[Layout, str, dict[int, int]]]) -> DataFrame:
    """One row per file as it lies in the folder now, read back: ``layouts`` gives each layout with its amount column and
    the erased rows of its files. An amount that is null or no finite number counts as 0."""
    listed = [(x.name, number, path, amount, erased.get(number, 0), number in erased) for x, amount, erased in layouts for number, path in x.paths.items()]
    names = spark.createDataFrame(listed, "table_name string, file_no long, path string, amount string, n_erased long, rewritten boolean")
    tasks = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    read = names.select("table_name", "file_no", "path", "amount").repartition(tasks).mapInArrow(_read_back, _PRINT)
    return read.join(F.broadcast(names.select("table_name", "file_no", "n_erased", "rewritten")), ["table_name", "file_no"])


#: Keys with more rows than this part of a table are few (their number is its inverse at most).
HOT = 1000


def owner_of_lines(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """``lines`` in the column row, and the client of each one's sale (null: none), as owner. Of a sale that
    stands twice the smallest client counts. Lines of the sales that have more than a thousandth of all lines meet
    those sales by a broadcast of at most 1,000 rows, the others by a shuffle; lines without a sale are not moved."""
    row = F.struct(*[F.col(f"`{c}`") for c in lines.columns]).alias("row")
    rows = lines.select("sale_id", row)
    clients = sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("owner"))
    counts = lines.where("sale_id is not null").groupBy("sale_id").agg(F.count(F.lit(1)).alias("n"))
    n = lines.count()
    hot = counts.where(F.col("n") > max(n // HOT, 1)).select("sale_id")
    hot_ids = [r["sale_id"] for r in hot.collect()]  # fewer than HOT
    if not hot_ids:
        return rows.join(clients, "sale_id", "left").select("row", "owner")
    is_hot = F.col("sale_id").isin(hot_ids)
    nothing = rows.where("sale_id is null").select("row", F.lit(None).cast("long").alias("owner"))
    usual = rows.where("sale_id is not null").where(~is_hot).join(clients, "sale_id", "left").select("row", "owner")
    frequent = rows.where(is_hot).join(F.broadcast(clients.where(is_hot)), "sale_id", "left").select("row", "owner")
    return usual.unionByName(frequent).unionByName(nothing)


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 100) -> DataFrame:
    """tag: the masters whose CRC-32 is divisible by ``every``, and the one whose clients together have the most
    clicks (ties, even at none: the smallest)."""
    pairs = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    counts = clicks.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = pairs.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    top = busiest.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    drawn = pairs.where(client_key(F.col("master_id")) % every == 0).select("master_id")
    return drawn.union(top).distinct().withColumnRenamed("master_id", "tag")


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, folder: str, every: int = 100, files: int = FILES) -> DataFrame:
    """Lay the four tables out in ``folder`` (new), erase the victim masters' clients, their clicks and
    sales and the lines of these sales, and return one row per file that is left, as read back.

    Null ids own nothing and are never victims. Repeated rows stay or go together. Empty tables have no
    files. Columns may have any name beside the ids and amounts that the cascade follows."""
    spark = clients.sparkSession
    with Scratch(spark) as scratch:
        masters = scratch.written(victim_masters(clients, clicks, every), "masters")
        owners = clients.join(masters.withColumnRenamed("tag", "master_id"), "master_id", "left_semi")
        owners = scratch.written(owners.where("client_id is not null").select(F.col("client_id").alias("tag")).distinct(), "owners")
        with_owner = scratch.written(owner_of_lines(lines, sales), "line-owners")
        own = F.col("client_id")
        tables = [
            ("clients", keyed(clients, client_key(own), F.col("master_id")), "balance", masters),
            ("clicks", keyed(clicks, client_key(own), own), "value", owners),
            ("sales", keyed(sales, client_key(own), own), "total", owners),
            ("sale_lines", with_owner.select(client_key(F.col("owner")).alias("key"), F.col("owner").alias("tag"), "row"), "amount", owners),
        ]
        done = []
        for name, rows, amount, victims in tables:
            layout = lay_out(scratch, rows, name, folder, files)
            done.append((layout, amount, erase(scratch, layout, victims)))
    return files_as_read(spark, done)
