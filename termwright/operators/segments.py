"""Words of texts without blanks: the cheapest path through a lexicon.

A lexicon of a checked size goes to the texts, which are cut where they stand: nothing of them is moved or written.
Of a larger one no task holds more than a part: only the distinct runs of word characters are cut, and their lattice
is made by joins. Each place of a run meets the lengths of the entries that begin with its character, and what it
spells meets the entries. What the lexicon doesn't cover is cut by script.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..sources.store import Batches, shared_folder
from .joins import join_uneven
from .mining import bit_map, in_map

RUN = r"[\p{L}\p{M}\p{N}_]+"
#: Places of a run that are handled in one row: what a row repeats of a long run is bounded.
WINDOW = 256
#: Entries of a lexicon, of 16 characters each on average, that every Python worker may hold: see ``Held``.
MOST_HELD = 6_000_000
#: Bytes of texts whose runs are cut together, characters of runs of one length that are, and the length from which runs are cut by themselves.
AT_ONCE, TOGETHER, LONG = 8_000_000, 100_000, 64



def entries(lexicon: DataFrame) -> DataFrame:
    """surface, cost and latin: the cheapest entry of each surface (ties: the first latin). Surfaces of other than word
    characters stand in no run."""
    kept = lexicon.where(F.col("surface").rlike(f"^{RUN}$") & F.col("cost").isNotNull())
    best = F.min(F.struct(F.col("cost").cast("double").alias("cost"), F.coalesce("latin", F.lit("")).alias("latin")))
    return kept.groupBy("surface").agg(best.alias("e")).select("surface", "e.cost", "e.latin")


def lattice(runs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """key, start, end, cost and latin of each entry (see ``entries``) at each place of each of ``runs`` (key, run)."""
    longest = lexicon.agg(F.coalesce(F.max(F.length("surface")), F.lit(1))).first()[0]
    heads = lexicon.groupBy(F.substring("surface", 1, 1).alias("head")).agg(F.collect_set(F.length("surface")).alias("lengths"))  # a row per character that begins a word
    windows = runs.select("key", "run", F.explode(F.sequence(F.lit(0), F.length("run") - 1, F.lit(WINDOW))).alias("base"))
    windows = windows.select("key", "base", F.substring(F.col("run"), F.col("base") + 1, F.lit(WINDOW + longest - 1)).alias("part"))
    places = windows.select("key", "base", "part", F.explode(F.sequence(F.lit(1), F.least(F.length("part"), F.lit(WINDOW)))).alias("i"))
    tried = places.withColumn("head", F.substring(F.col("part"), F.col("i"), F.lit(1))).join(F.broadcast(heads), "head")
    spelled = tried.select("key", (F.col("base") + F.col("i") - 1).alias("start"), "part", "i", F.explode("lengths").alias("size"))
    spelled = spelled.where(F.col("i") + F.col("size") - 1 <= F.length("part"))
    spelled = spelled.select("key", "start", (F.col("start") + F.col("size")).alias("end"), F.substring(F.col("part"), F.col("i"), F.col("size")).alias("surface"))
    # What is surely no entry goes before rows are shuffled, by a map of bounded size.
    likely = in_map(spelled, bit_map(lexicon.select(F.xxhash64("surface").alias("h"))), F.xxhash64("surface"))
    return likely.join(lexicon, "surface").select("key", "start", "end", "cost", "latin")


_PATH = "array<struct<start:int,end:int,latin:string>>"


def _path(n: int, sizes, begin, dearest: float) -> list[tuple[int, int, str]]:
    """start, end and latin of the words of a run of n characters: the path of least cost, then of fewest words, then with
    the longest last word. Beside the entries (``begin``: end, cost and latin of those at a place) there are the rest of a
    stretch of one script (``sizes``), at ``dearest``, and single characters, at twice that."""
    best, back = [(0.0, 0)] + [(float("inf"), 0)] * n, [(0, "")] * (n + 1)
    at = 0
    for size in sizes:
        stop = at + size
        while at < stop:
            cost, words = best[at]
            for end, more, latin in (*begin(at), (stop, dearest, ""), (at + 1, 2 * dearest, "")):
                new = (cost + more, words + 1)
                if new < best[end]:  # earlier starts come first, so equal paths keep the longest last word
                    best[end], back[end] = new, (at, latin)
            at += 1
    out, end = [], n
    while end:
        start, latin = back[end]
        out.append((start, end, latin))
        end = start
    return out[::-1]


def _cheapest(dearest: float) -> Column:
    """The cheapest path (see ``_path``) of runs whose lattice is given."""
    import pandas as pd

    def path(sizes, edges) -> list[dict]:
        begin = {}
        for e in edges if edges is not None else ():
            begin.setdefault(e["start"], []).append((e["end"], e["cost"], e["latin"]))
        found = _path(sum(sizes), sizes, lambda at: begin.get(at, ()), dearest)
        return [{"start": start, "end": end, "latin": latin} for start, end, latin in found]

    def paths(batches):
        for sizes, edges in batches:
            yield pd.Series([path(s, e) for s, e in zip(sizes, edges, strict=True)])

    paths.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(paths, _PATH)


_WORDS = "array<struct<surface:string,latin:string>>"


#: Multipliers of the hashes: of one character more, and of what picks a bucket.
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Held:
    """A lexicon in a few arrays, some 12 bytes an entry and two (four beyond the first 65,536 characters) a character: entries by
    buckets of a hash of their characters, and the characters of each length's entries, which are compared. Bytes that
    tell which finer buckets are empty rule most of a text's other places out."""

    def __init__(self, surfaces, costs: list[float], latins: list[str]):
        import numpy as np

        codes, ends = _code_points(surfaces)
        lengths = np.diff(ends)
        pairs: dict[tuple[float, str], int] = {}
        pair = np.array([pairs.setdefault(p, len(pairs)) for p in zip(costs, latins, strict=True)], np.int32)
        self.costs = np.array([cost for cost, _ in pairs] + [np.inf])  # the last one, at -1: no entry
        self.latins = [latin for _, latin in pairs] + [""]
        self.dearest = max((cost for cost, _ in pairs), default=0.0) + 1.0
        self.bits = max(4, (2 * len(pair)).bit_length())
        self.lengths = [int(k) for k in np.unique(lengths)]
        narrow = np.uint16 if not len(codes) or codes.max() < 1 << 16 else np.uint32
        self.of, self.seen = {}, np.zeros(1 << (self.bits + 2), bool)
        for k in self.lengths:
            rows = np.flatnonzero(lengths == k)
            letters = codes[ends[rows][:, None] + np.arange(k)]
            key = np.zeros(len(rows), np.uint64)
            for n in range(k):
                key = key * np.uint64(_STEP) + letters[:, n]
            order = np.argsort(key)
            self.of[k] = (key[order], letters[order].astype(narrow), pair[rows[order]])
            self.seen[(key * np.uint64(_SPREAD)) >> np.uint64(62 - self.bits)] = True

    def found(self, letters, key, k: int):
        """Of places (rows) and runs (columns) the number of the entry of ``k`` characters that begins there, or -1. ``letters``
        and ``key``: the characters, and the hashes of ``k`` of them."""
        import numpy as np

        out = np.full(key.shape, -1, np.int32)
        at = np.flatnonzero(self.seen[(key * np.uint64(_SPREAD)) >> np.uint64(62 - self.bits)])
        keys, entries, pair = self.of[k]
        wanted = key.ravel()[at]
        row, column = np.divmod(at, key.shape[1])
        first = np.searchsorted(keys, wanted)
        left = np.flatnonzero(first < len(keys))
        while len(left):  # once, unless two entries share a hash
            left = left[keys[first[left]] == wanted[left]]
            equal = np.ones(len(left), bool)
            for n in range(k):
                equal &= entries[first[left], n] == letters[row[left] + n, column[left]]
            out.ravel()[at[left[equal]]] = pair[first[left[equal]]]
            left = left[~equal]
            first[left] += 1
            left = left[first[left] < len(keys)]
        return out


def _code_points(texts):
    """The code points of all of a column of strings, and where each string ends (with a 0 before)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None and len(texts) else b""
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), ends


def _paths(held: Held, letters, stops):
    """For runs of equal length (columns of ``letters``, a row per place) whose stretches end at ``stops`` (True in the row of a
    stretch's last place): where the words of the cheapest path end (a row per place), and the numbers of their entries. See ``_path``."""
    import numpy as np

    n, runs = letters.shape
    key, found = np.zeros((n, runs), np.uint64), {}
    for k in range(1, min(n, max(held.lengths, default=0)) + 1):
        key = key[: n - k + 1] * np.uint64(_STEP) + letters[k - 1 :]
        if k in held.of:
            found[k] = held.found(letters, key, k)
    ends, entry = np.zeros((n, runs), bool), np.full((n, runs), -1, np.int32)
    if n > LONG:
        for r in range(runs):
            begin: dict[int, list] = {}
            for k, numbers in found.items():
                for at in np.flatnonzero(numbers[:, r] >= 0).tolist():
                    begin.setdefault(at, []).append((at + k, held.costs[numbers[at, r]], numbers[at, r]))
            sizes = np.diff(np.concatenate([[-1], np.flatnonzero(stops[:, r])])).tolist()
            for _, end, number in _path(n, sizes, lambda at: begin.get(at, ()), held.dearest):
                ends[end - 1, r], entry[end - 1, r] = True, -1 if isinstance(number, str) else number
        return ends, entry
    # Sums and comparisons are those of ``_path``, for all runs at once: least cost, fewest words, earliest start.
    cost, words = np.zeros((n + 1, runs)), np.zeros((n + 1, runs), np.int32)
    back = np.zeros((n + 1, runs), np.int32)
    rest, rest_words, rest_start = np.full(runs, np.inf), np.zeros(runs, np.int32), np.zeros(runs, np.int32)  # the best start of a stretch's rest
    for e in range(1, n + 1):
        over, more = cost[e - 1] + held.dearest, words[e - 1] + 1
        opened = stops[e - 2] if e > 1 else True
        new = opened | (over < rest) | ((over == rest) & (more < rest_words))
        rest, rest_words, rest_start = np.where(new, over, rest), np.where(new, more, rest_words), np.where(new, np.int32(e - 1), rest_start)
        best, fewest, start, number = np.full(runs, np.inf), np.zeros(runs, np.int32), np.zeros(runs, np.int32), np.full(runs, -1, np.int32)
        for k in sorted(found, reverse=True):
            if k > e:
                continue
            numbers = found[k][e - k]
            at = np.flatnonzero(numbers >= 0)
            if not len(at):
                continue
            c, w = cost[e - k, at] + held.costs[numbers[at]], words[e - k, at] + 1
            at_best = best[at]
            better = (c < at_best) | ((c == at_best) & (w < fewest[at]))
            at = at[better]
            best[at], fewest[at], start[at], number[at] = c[better], w[better], e - k, numbers[at]
        for here, c, w, s in ((stops[e - 1], rest, rest_words, rest_start), (True, cost[e - 1] + 2 * held.dearest, more, np.int32(e - 1))):
            better = here & ((c < best) | ((c == best) & ((w < fewest) | ((w == fewest) & (s < start)))))
            best, fewest, start, number = np.where(better, c, best), np.where(better, w, fewest), np.where(better, s, start), np.where(better, np.int32(-1), number)
        cost[e], words[e], back[e], entry[e - 1] = best, fewest, start, number
    place, column = np.full(runs, n, np.int64), np.arange(runs)
    while len(column):
        ends[place - 1, column] = True
        place = back[place, column].astype(np.int64)
        column, place = column[place > 0], place[place > 0]
    return ends, entry


def _cut(held: Held, pieces, sizes, kind):
    """The words of texts, given as lists of pieces and of the sizes of their stretches (null for what isn't a run). A piece is
    cut once, however often it stands; runs of one length are cut together."""
    import numpy as np
    import pyarrow as pa

    rows, coded = pieces.offsets.to_numpy().astype(np.int64), pieces.flatten().dictionary_encode()
    rows -= rows[0]
    distinct, codes = coded.dictionary, coded.indices.to_numpy()
    highest = np.maximum.accumulate(codes) if len(codes) else codes
    first = np.flatnonzero(np.diff(highest, prepend=-1) > 0)  # a new piece has the next number
    parts = sizes.flatten().take(pa.array(first))
    letters, ends = _code_points(distinct)
    length, is_run = np.diff(ends), parts.is_valid().to_numpy(zero_copy_only=False)
    stop, word_end, entry = np.zeros(len(letters), bool), np.zeros(len(letters), bool), np.full(len(letters), -1, np.int32)
    word_end[ends[1:][~is_run] - 1] = True
    steps, counts = parts.flatten().to_numpy(zero_copy_only=False), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    runs_before = np.cumsum(np.where(is_run, length, 0)) - np.where(is_run, length, 0)
    stop[np.cumsum(steps, dtype=np.int64) - 1 + np.repeat(ends[:-1] - runs_before, counts)] = True
    of_length = np.argsort(np.where(is_run, length, 0), kind="stable")
    bounds = np.flatnonzero(np.diff(length[of_length] * is_run[of_length], prepend=-1, append=-1))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(length[of_length[low]]) if is_run[of_length[low]] else 0
        if n == 0:
            continue
        for some in range(low, high, max(1, TOGETHER // n)):
            chosen = of_length[some : min(some + max(1, TOGETHER // n), high)]
            place = ends[chosen][None, :] + np.arange(n)[:, None]
            word_end[place], entry[place] = _paths(held, letters[place], stop[place])
    width = np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000), dtype=np.int64)
    at = np.flatnonzero(word_end)
    start = distinct.buffers()[2]
    surfaces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], width[at]]).astype(np.int32)), start if start is not None else pa.py_buffer(b""))
    latins = pa.array(held.latins, pa.string()).take(pa.array(entry[at] % len(held.latins)))
    offsets = np.concatenate([[0], np.cumsum(word_end)])[ends].astype(np.int32)
    of_pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([surfaces, latins], fields=list(kind))).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(of_pieces.offsets.to_numpy()[rows].astype(np.int32)), of_pieces.values)


def _cut_in_place(known: DataFrame) -> Column:
    """A function that cuts texts, given as pieces and the sizes of their stretches (null for what isn't a run), by ``known``
    entries, which are sent to the workers once."""
    import pyarrow as pa

    table = known.toArrow().combine_chunks()
    surfaces = pa.concat_arrays([c.cast(pa.string()) for c in table.column("surface").chunks] or [pa.array([], pa.string())])
    shared = known.sparkSession.sparkContext.broadcast(Held(surfaces, table.column("cost").to_pylist(), table.column("latin").to_pylist()))
    kind = pa.struct([("surface", pa.string()), ("latin", pa.string())])

    def words(batches):
        held = shared.value
        for batch in batches:
            out, pieces, sizes = [pa.array([], pa.list_(kind))], batch.field("pieces"), batch.field("sizes")
            rows = max(1, AT_ONCE * len(batch) // max(1, pieces.flatten().nbytes))
            for first in range(0, len(batch), rows):
                out.append(_cut(held, pieces.slice(first, rows), sizes.slice(first, rows), kind))
            yield pa.concat_arrays(out)

    words.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(words, _WORDS)


def cut_runs(runs: DataFrame, known: DataFrame, stretches: str) -> DataFrame:
    """key and words (array of surface and latin) of distinct runs (key, run), by joins with ``known`` (see ``entries``).
    ``stretches``: the pattern that cuts a run by script."""
    dearest = known.agg(F.coalesce(F.max("cost"), F.lit(0.0))).first()[0] + 1.0
    edges = lattice(runs, known).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "cost", "latin"))).alias("edges"))
    sizes = F.transform(F.regexp_extract_all(F.col("run"), F.lit(stretches), F.lit(0)), lambda p: F.length(p))
    found = runs.join(edges, "key", "left").select("key", "run", _cheapest(dearest)(sizes, F.col("edges")).alias("path"))
    # A word is the head of what is left; long runs are cut from an array, where a place is found at once.
    letters = F.regexp_extract_all(F.col("run"), F.lit("(?s)."), F.lit(0))
    spelled = found.select("key", letters.alias("letters"), "path")
    word = lambda p: F.struct(F.array_join(F.slice(F.col("letters"), p["start"] + 1, p["end"] - p["start"]), "").alias("surface"), p["latin"].alias("latin"))
    return spelled.select("key", F.transform("path", word).alias("words"))


def segmented(texts: DataFrame, lexicon: DataFrame, id_column: str, text_column: str, stretches: str) -> DataFrame:
    """``texts`` with the array column ``words`` (surface, latin): all of each text in its order, what stands between
    runs being one word each. ``id_column`` tells the rows apart; the others may be anything.

    A null or empty text has no words. A lexicon of more than MOST_HELD entries is joined: then runs are cut once,
    however often they stand."""
    piece = F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(f"{RUN}|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+"), F.lit(0))
    batches = Batches(texts.sparkSession, shared_folder(texts.sparkSession))
    known = batches.write("lexicon", "rows", entries(lexicon))  # read several times
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("surface") + F.length("latin")), F.lit(0)).alias("characters")).first()
    if size["n"] <= MOST_HELD and size["characters"] <= 16 * MOST_HELD:
        sizes = lambda p: F.when(p.rlike(f"^{RUN}"), F.transform(F.regexp_extract_all(p, F.lit(stretches), F.lit(0)), lambda t: F.length(t)))
        given = let(piece, lambda ps: F.struct(ps.alias("pieces"), F.transform(ps, sizes).alias("sizes")))
        cut = _cut_in_place(known)(given)
        batches.drop("lexicon")
        return texts.select(*[F.col(f"`{c}`") for c in texts.columns], cut.alias("words"))
    pieces = texts.select(F.col(id_column).alias("id"), F.posexplode(piece).alias("at", "piece"))
    runs = pieces.where(F.col("piece").rlike(f"^{RUN}$")).select(F.md5(F.col("piece").cast("binary")).alias("key"), F.col("piece").alias("run"))
    cut = cut_runs(runs.groupBy("key").agg(F.first("run").alias("run")), known, stretches)
    keyed = pieces.select("id", "at", F.when(F.col("piece").rlike(f"^{RUN}$"), F.md5(F.col("piece").cast("binary"))).alias("key"), F.when(~F.col("piece").rlike(f"^{RUN}$"), F.col("piece")).alias("gap"))
    between = F.array(F.struct(F.col("gap").alias("surface"), F.lit("").alias("latin")))
    gaps = keyed.where(F.col("key").isNull()).select("id", "at", between.alias("words"))
    met = join_uneven(keyed.where(F.col("key").isNotNull()).select("id", "at", "key"), cut, "key", "inner").select("id", "at", "words")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])
    whole = met.unionByName(gaps).groupBy("id").agg(F.flatten(listed).alias("words"))
    none = F.array().cast(_WORDS)
    joined = texts.withColumn("id", F.col(id_column)).join(whole, "id", "left")
    return joined.select(*[F.col(f"`{c}`") for c in texts.columns], F.coalesce("words", none).alias("words"))
