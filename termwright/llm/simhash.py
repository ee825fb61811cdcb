"""SimHash near-deduplication by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, located, unlink, without, worker_cache, written

#: The constants of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)

CHUNK = 1 << 18  # bytes of text that are hashed together
SHINGLES = 1 << 16  # shingles whose bits are counted together


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each pair."""
    padded = data + bytes(32)
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    halves = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    single = np.frombuffer(padded, dtype=np.uint8)
    at = starts.astype(np.int64)
    size = ends - starts
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed64 + P5, dtype=np.uint64)
        far = np.flatnonzero(size >= 32)
        if len(far):  # four lanes of eight bytes
            pos, stripes = at[far].copy(), size[far] // 32
            lanes = [np.full(len(far), s, dtype=np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            for r in range(int(stripes.max())):
                on = np.flatnonzero(stripes > r)
                p = pos[on]
                for k in range(4):
                    lanes[k][on] = _round(lanes[k][on], words[p + 8 * k])
                pos[on] += 32
            acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for k in range(4):
                acc = (acc ^ _round(np.zeros_like(acc), lanes[k])) * P1 + P4
            h[far] = acc
            at[far] = pos
        h += size.astype(np.uint64)
        left = ends - at
        while True:
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            all_on = len(on) == len(at)
            p = at if all_on else at[on]
            mixed = _rotl((h if all_on else h[on]) ^ _round(np.uint64(0), words[p]), 27) * P1 + P4
            if all_on:
                h, at, left = mixed, at + 8, left - 8
            else:
                h[on] = mixed
                at[on] += 8
                left[on] -= 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            h[on] = _rotl(h[on] ^ (halves[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ (single[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def _majorities(texts: list[bytes], width: int, seed: int) -> list[int]:
    """Fingerprints of some texts that are hashed together."""
    starts, ends, owners, counts = [], [], [], []
    base, parts = 0, []
    for text in texts:
        flat = b" ".join(text.lower().split())
        if flat:
            gaps = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
            first = np.concatenate(([0], gaps + 1))
            last = np.concatenate((gaps, [len(flat)]))
            n = max(1, len(first) - width + 1)
            starts.append(first[:n] + base)
            ends.append((last[width - 1 :] if len(last) >= width else last[-1:]) + base)
            owners.append(n)
        else:
            owners.append(0)
        parts.append(flat)
        base += len(flat)
    if not starts:
        return [0] * len(texts)
    hashes = xxh64_slices(b"".join(parts), np.concatenate(starts), np.concatenate(ends), seed)
    at = 0
    for n in owners:
        total = np.zeros(64, dtype=np.int64)
        for i in range(at, at + n, SHINGLES):
            bits = np.unpackbits(hashes[i : min(i + SHINGLES, at + n)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total += bits.sum(axis=0, dtype=np.int32)
        at += n
        counts.append(int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big") if n else 0)
    return counts


def fingerprints_of(texts: Iterator[str | None], width: int = 3, seed: int = 42) -> list[int]:
    """SimHash fingerprints (unsigned) of some texts, hashed in chunks of bounded size."""
    out: list[int] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            out += _majorities(held, width, seed)
            held, size = [], 0
    return out + _majorities(held, width, seed)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None) -> DataFrame:
    """doc_id, locator (null unless given) and fp, the 64-bit SimHash of the text's shingles of ``width`` words (A-Z in
    lower case; words stand between ASCII white space; repeats count). A text with fewer
    words is one shingle; one without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash", dict)  # keeps nothing itself
        for batch in batches:
            found = fingerprints_of((x.as_py() for x in batch.column(1)), width, seed)
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed, pa.int64())], ["doc_id", "locator", "fp"])

    where = F.lit(None).cast("string") if locator is None else locator
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), where.alias("locator"))
    return rows.mapInArrow(run, "doc_id long, locator string, fp long")


#: Segments as (mask, shift) of the fingerprint, from the high bits.
SEGMENTS = ((32, 32), (32, 0))


def _segment(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _index(points: DataFrame) -> DataFrame:
    """seg, key, fp: each fingerprint under each of its segments."""
    fp = F.col("fp")
    return points.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(fp, shift, width).alias("key")) for s, (width, shift) in enumerate(SEGMENTS)])).alias("k")).select("k.seg", "k.key", "fp")


def _probes(index: DataFrame) -> DataFrame:
    """seg, key, fp: each segment's own value and those with one of its set bits cleared.

    Of two segments that differ in one bit one has that bit set, so each pair at distance
    one is found from that side; the ball's other half would find it twice.
    """
    width = max(w for w, _ in SEGMENTS)
    key = F.col("key")
    ball = F.transform(F.array(*[F.lit(1 << b) for b in range(width)]), lambda m: F.when(key.bitwiseAND(m) != 0, key.bitwiseXOR(m)))
    return index.select("seg", "fp", F.explode(F.concat(F.array(key), F.filter(ball, lambda k: k.isNotNull()))).alias("key"))


def _stars(points: DataFrame, most: int = 3) -> DataFrame:
    """Edges that connect all pairs at distance ``most`` or less without listing the pairs.

    Each pair shares a point z that the one is near to and the other reaches by clearing set bits:

    * most 3: near is 1 flip or none; the other clears two (of three differing bits one side has two set);
    * most 2: both are 1 flip or none away; * most 1: z is the one itself, the other clears one bit.

    Points near z are within 2 flips (1 or 2 for smaller radii) of each other, and the others
    within ``most`` of those, so all of them hang on the least near point: at most
    65 + C(set bits, 2) rows a point, some 560 on average, however dense the group is.
    """
    fp = F.col("fp")
    bits = [1 << b for b in range(63)] + [-(1 << 63)]
    flips = F.transform(F.array(F.lit(0), *[F.lit(b) for b in bits] * (most >= 2)), lambda m: fp.bitwiseXOR(m))
    at = points.select("fp", F.explode(flips).alias("z"), F.lit(True).alias("near"))
    cleared = F.filter(F.array(*[F.lit(b) for b in bits]), lambda m: fp.bitwiseAND(m) != 0)
    if most == 1:
        at = at.unionByName(points.select("fp", F.explode(F.transform(cleared, lambda m: fp.bitwiseXOR(m))).alias("z"), F.lit(False).alias("near")))
    if most == 3:
        pairs = F.flatten(F.transform(cleared, lambda m, i: F.transform(F.slice(cleared, i + 2, F.size(cleared)), lambda k: fp.bitwiseXOR(m).bitwiseXOR(k))))
        at = at.unionByName(points.select("fp", F.explode(pairs).alias("z"), F.lit(False).alias("near")))
    hubs = at.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1 and hub is not null")
    return at.join(hubs, "z").where(F.col("fp") != F.col("hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(points: DataFrame, most: int = 3, light: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, whose components are those of all pairs
    that differ in ``most`` bits or fewer (3 at most: then one of the two segments differs
    in one bit or none).

    ``points``: fp, without repeats. A table row with ``light`` fingerprints or fewer is
    compared with all its probes. Where a table row holds more, its fingerprints and the
    probes that meet it go to ``_stars`` instead, which lists no pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius one serve distances up to 3")
    index = written(_index(points), "simhash-index")
    sizes = index.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    heavy = written(sizes.where(F.col("n") > light).select("seg", "key"), "simhash-heavy")
    dense = not heavy.isEmpty()
    probes = _probes(index)
    table = index.join(heavy, ["seg", "key"], "left_anti") if dense else index
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    pairs = (
        probes.join(table.withColumnRenamed("fp", "other"), ["seg", "key"])
        .where((F.col("fp") != F.col("other")) & (distance <= most))
        .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
        .distinct()
    )
    if dense and most:
        some = probes.join(heavy, ["seg", "key"], "left_semi").select("fp").distinct()
        pairs = pairs.unionByName(_stars(some, most)).distinct()
    return pairs


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes with an edge.

    Alternates the large-star and small-star steps (each node's greater neighbours, then its
    lesser ones, are hung on its least) until nothing changes; each round is a written table.
    """
    spark = edges.sparkSession
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def mark(df: DataFrame):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    last = mark(now)
    for _ in range(rounds):
        if not last[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = written(small, "cc")
        this = mark(new)
        unlink(spark, now.inputFiles()[0].rsplit("/", 1)[0]) if now.inputFiles() else None
        now = new
        if this == last:
            break
        last = this
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _labelled(docs: DataFrame, width: int, most: int, light: int, id_col: str, text_col: str, locator: Column | None = None) -> DataFrame:
    """doc_id, locator, fp and best: the first row (null ids last, then id, then locator) of the
    row's component."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
    prints = written(fingerprints(docs, width, id_col=id_col, text_col=text_col, locator=locator), "simhash")
    with Scratch(docs.sparkSession) as scratch:
        points = scratch.written(prints.groupBy("fp").agg(F.min(order).alias("least")), "simhash-points")
        roots = scratch.written(components(links(points.select("fp"), most, light)), "simhash-roots")
        linked = points.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
        best = linked.groupBy("root").agg(F.min("least").alias("best"))
        labels = linked.join(best, "root").select("fp", F.col("best").alias("reached"))
        alone = points.join(labels, "fp", "left").select("fp", F.coalesce("reached", "least").alias("best"))
        # A table of its own: a fingerprint of very many copies can then be split in the join.
        alone = written(alone, "simhash-labels")
    return prints.join(alone, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, light: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64-bit, signed) and component_id, the smallest id that can be reached over
    links between fingerprints that differ in ``most`` bits or fewer.

    One row per input row. Documents with the same fingerprint are one point, so copies are
    never paired. Texts without words have fingerprint zero, which links like any other.
    Null ids don't count for the smallest id; a component that has only null ids has a null
    component_id. Rows that repeat are returned as often as they come. Other columns may have any
    name. An empty table gives no rows.
    """
    return _labelled(docs, width, most, light, id_col, text_col).select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, light: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: the one with the smallest id (null
    ids last), of rows that share it the first in the files. Rows are told apart by their
    place, so ids may repeat or be null. Returns the columns of ``docs``."""
    rows, where = located(docs)
    found = _labelled(rows, width, most, light, id_col, text_col, where)
    gone = written(found.where(F.col("locator") != F.col("best.locator")).select("locator"), "near-gone")
    return without(rows, gone)
