"""Best-fit packing of documents into sequences of bounded length, by bin completion.

What has to be searched is only how many pieces there are of each length: 2,048 numbers at most, however
many documents there are. On these counts branch and bound completes one sequence after the other around
the longest piece that is left and applies each filling as often as the counts allow, so the plan, too, is
at most a few fillings per length. Pieces then find their places by joins: tasks number the pieces of each
length as they cut them, the numbers of earlier partitions are added, and a number lies in one of the
plan's intervals of its length. No piece is collected, and nothing is sorted or gathered by length.
"""

from __future__ import annotations

import itertools
import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import worker_cache, written

CAPACITY = 2048
#: Bounds of the search: fillings that are tried at one node, and nodes. When they are used up the best solution found stands.
WIDTH, NODES = 8, 2500

#: So many sequences are filled like this: (length, pieces of it per sequence), longest first.
Filling = tuple[int, tuple[tuple[int, int], ...]]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: of the total, and of pieces longer than a half beside those that can't join them."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for small in {0, *(k for k in counts if k <= capacity // 2)}:
        # Pieces over capacity - small stand alone (as to these), those over a half one each; what is from small on must fit beside them.
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        half = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - small]
        rest = sum(k * n for k, n in counts.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Longest first, each piece into the fullest sequence that has room. Sequences that are filled alike are handled together."""
    open_: dict[int, list[list]] = {}  # room left -> [filling, how many]
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            each = (capacity if room is None else room) // length
            if room is None:
                group, there = (), -(-n // each)
            else:
                group, there = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            some = min(there, n // each) if n >= each else 0
            if some:
                open_.setdefault((capacity if room is None else room) - each * length, []).append([(*group, (length, each)), some])
                n -= some * each
            elif n:
                open_.setdefault((capacity if room is None else room) - n * length, []).append([(*group, (length, n)), 1])
                some, n = 1, 0
            if room is not None and there > some:
                open_.setdefault(room, []).append([group, there - some])
    return [(n, filling) for groups in open_.values() for filling, n in groups]


def n_sequences(plan: list[Filling]) -> int:
    return sum(n for n, _ in plan)


class _Reach:
    """Which sums up to a limit the pieces of each length and below can make, as bits."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.counts = counts
        self.lengths = sorted(k for k, n in counts.items() if n and k <= limit)
        mask, sums = (1 << (limit + 1)) - 1, 1
        self.sums = [1]
        for k in self.lengths:
            left, step = min(counts[k], limit // k), 1
            while left > 0:  # 1, 2, 4, ... pieces at a time, then what is left
                take = min(step, left)
                sums |= (sums << (take * k)) & mask
                left, step = left - take, step * 2
            self.sums.append(sums)

    def exactly(self, target: int) -> Iterator[list[tuple[int, int]]]:
        """The sets that add up to ``target``, those with longer pieces first. No branch is a dead end."""
        stack = [(target, len(self.lengths), [])]
        while stack:
            target, top, chosen = stack.pop()
            if target == 0:
                yield chosen
                continue
            branches = []
            for i in range(bisect_right(self.lengths, target, 0, top) - 1, -1, -1):
                if not self.sums[i + 1] >> target & 1:
                    break
                k = self.lengths[i]
                for n in range(min(self.counts[k], target // k), 0, -1):
                    if self.sums[i] >> (target - n * k) & 1:
                        branches.append((target - n * k, i, [*chosen, (k, n)]))
                if len(branches) > 2 * WIDTH:
                    break
            stack.extend(reversed(branches))


def _dominated(filling: list[tuple[int, int]], waste: int, counts: dict[int, int]) -> bool:
    """Whether some unused piece could stand for two of the filling, or for a shorter one, without overflowing: the
    filling with that piece leaves shorter pieces to others, so this one need not be tried."""
    used = dict(filling)
    for i, (a, n) in enumerate(filling):
        for k in range(a + 1, a + waste + 1):
            if counts.get(k, 0) > used.get(k, 0):
                return True
        for b in [x for x, _ in filling[i + 1 :]] + ([a] if n > 1 else []):
            for k in range(a + b, a + b + waste + 1):
                if counts.get(k, 0) > used.get(k, 0):
                    return True
    return False


def fillings(counts: dict[int, int], capacity: int, slack: int, width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Waste and pieces of up to ``width`` undominated ways to fill ``capacity`` that waste ``slack`` at most, least waste
    first, longer pieces first."""
    reach, found, first = _Reach(counts, capacity), [], None
    sets = ((waste, pieces) for waste in range(min(slack, capacity) + 1) if reach.sums[-1] >> (capacity - waste) & 1 for pieces in reach.exactly(capacity - waste))
    for waste, pieces in itertools.islice(sets, 4 * width):
        first = first or (waste, pieces)
        if not _dominated(pieces, waste, counts):
            found.append((waste, pieces))
        if len(found) >= width:
            break
    return found or ([first] if first else [])


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> list[Filling]:
    """A packing of ``counts[length]`` pieces into few sequences of ``capacity``.

    Each node takes the longest piece that is left and enumerates the undominated fillings around it; each is
    applied as often as the counts allow. A branch ends when what it has wasted exceeds what a packing
    better than the incumbent may waste. The first incumbent is the best-fit solution; a branch that
    runs out of nodes is completed by best fit. The search ends at the lower bound."""
    counts = {k: n for k, n in counts.items() if n}
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError(f"pieces are 1 to {capacity} long")
    total, least = sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bound = n_sequences(best)
    if bound <= least:
        return best

    def children(left: dict[int, int], done: list[Filling], waste: int) -> Iterator[tuple]:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        slack = (bound - 1) * capacity - total - waste
        if slack < 0:
            return
        for wasted, pieces in fillings(rest, capacity - longest, slack, width):
            filled = Counter(dict(pieces))
            filled[longest] += 1
            times = min(left[k] // n for k, n in filled.items())
            if wasted:
                times = min(times, slack // wasted)
            after = {k: n - times * filled.get(k, 0) for k, n in left.items() if n > times * filled.get(k, 0)}
            yield after, [*done, (times, tuple(sorted(filled.items(), reverse=True)))], waste + times * wasted

    stack = [children(counts, [], 0)]
    deepest: tuple | None = None
    while stack and nodes > 0 and bound > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        left, done, waste = step
        if deepest is None or sum(left.values()) < sum(deepest[0].values()):
            deepest = step
        if not left:
            if n_sequences(done) < bound:
                best, bound = done, n_sequences(done)
        elif waste <= (bound - 1) * capacity - total:
            stack.append(children(*step))
    if deepest is not None and deepest[0]:
        done = deepest[1] + best_fit(deepest[0], capacity)
        if n_sequences(done) < bound:
            best = done
    return best


@dataclass(frozen=True)
class Places:
    """Where the pieces of one length with numbers from ``first`` to ``last`` go: ``each`` per sequence, from sequence ``sequence``
    on, the first of them at ``offset``."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    offset: int


def places(plan: list[Filling]) -> list[Places]:
    taken, sequence, out = Counter(), 0, []
    for times, filling in plan:
        offset = 0
        for length, each in filling:
            out.append(Places(length, taken[length], taken[length] + each * times - 1, each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    return out


def encoder(path: str):
    """The ids of a text by a byte-level BPE vocabulary file (JSON): those of the tokenizers library, special
    tokens' names in a text being ordinary text.

    Ids follow the order of the merges in such files (checked here), so the merge of lowest rank is the
    merge to the lowest id, and the quicker library of rank files gives the same ids (tests hold one
    against the other)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    listed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    unlisted = [b for b in range(256) if b not in set(listed)]
    byte_of = {chr(b): b for b in listed} | {chr(256 + i): b for i, b in enumerate(unlisted)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError(f"the ids of {path} don't follow its merges")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    import public_tokenizers

    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_PIECE = StructType().add("part", "integer").add("length", "integer").add("number", "long").add("piece", "integer").add("start", "long").add("ids_crc32", "long")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, label: str = "pieces") -> DataFrame:
    """The pieces of all documents as a written table: ``row`` (a struct of all columns but text) and part, length,
    number, piece, start and ids_crc32. A document is its ids and ``end_id``; a longer one than ``capacity`` is cut into
    pieces of ``capacity``, the first being what is over. ``number`` counts the pieces of a length in their partition."""
    rest = [c for c in docs.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        from pyspark import TaskContext

        encode = worker_cache(f"pieces {path}", lambda: encoder(path))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            of, out = [], {c: [] for c in ("length", "number", "piece", "start", "ids_crc32")}
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                borders = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    of.append(i)
                    for name, value in zip(out, (b - a, seen[b - a], k, a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        out[name].append(value)
                    seen[b - a] += 1
            if of:
                numbers = [pa.array([part] * len(of), pa.int32()), pa.array(out["length"], pa.int32()), pa.array(out["number"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["ids_crc32"], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of)), *numbers], names=["row", "part", *out])

    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    given = docs.select(F.col("text").cast("string").alias("text"), row)
    schema = StructType([*given.select("row").schema.fields, *_PIECE.fields])
    return written(given.mapInArrow(cut, schema), label)


def numbered(cut: DataFrame) -> DataFrame:
    """The pieces with the number of each among all of its length (``among``)."""
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return cut.join(sizes, ["part", "length"]).withColumn("among", F.col("before") + F.col("number")).drop("before")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """Per piece of each document: row (its other columns), piece, start, length, ids_crc32, sequence_id and offset.

    Null texts are empty: their piece is the end id alone. Repeated rows are packed each, ids may be null, other
    columns may have any name. An empty table gives no rows."""
    cut = pieces(docs, path, capacity, end_id)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    found = places(bin_completion(counts, capacity, width, nodes))
    spark = docs.sparkSession
    plan = spark.createDataFrame([(p.length, p.first, p.last, p.each, p.sequence, p.offset) for p in found], "length int, first long, last long, each long, sequence long, at long")
    placed = numbered(cut).alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & F.col("p.among").between(F.col("q.first"), F.col("q.last")))
    index = F.col("among") - F.col("first")
    return placed.select(
        "row", "piece", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.expr("(among - first) div each")).alias("sequence_id"),
        (F.col("at") + F.pmod(index, F.col("each")) * F.col("p.length")).alias("offset"),
    )
