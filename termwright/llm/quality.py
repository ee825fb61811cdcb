"""Quality by weak supervision: overlapping heuristics vote, expectation-maximisation weighs
the votes, and a hashed linear scorer learns from the posterior labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_cache, written

#: Frequent words of languages in Latin script, for the share of function words.
FUNCTION_WORDS = frozenset(
    "the and of to in is that it for was on are as with his they at be this from have or by one had not but what "
    "le la les de des un une et est en que qui dans pour pas sur avec au aux du par ce il elle "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem "
    "el los las del y que se por con para una su al lo como más pero sus "
    "il di che non per sono della nel gli ma o os da em não uma com mais no na "
    "het een van niet op te dat zijn er i och att det som på är av med til og ikke w z na się nie do jest".split()
)

#: First and last characters of scripts that put no blanks between words.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")

SIZE = 1 << 10  # places of the hashed vector
REMEMBERED = 150_000  # words whose traits a worker remembers

#: The heuristics, each with the statistic that it reads, and the bounds up to which it votes
#: for one class and from which it votes for the other; between them it abstains.
#: (name, statistic, bad at or above, good at or below) or with "below" reversed.
RULES = (
    ("symbols", "symbol_share", 0.05, 0.01),
    ("pipes", "pipe_share", 0.05, 0.005),
    ("shouting", "upper_share", 0.30, 0.10),
    ("exclaiming", "exclaim_share", 0.10, 0.02),
    ("stutter", "stutter_share", 0.10, 0.03),
    ("repetition", "repeat_share", 0.85, 0.60),
    ("long sentences", "sentence_words", 60.0, 30.0),
    ("no function words", "content_share", 0.97, 0.90),
    ("odd words", "odd_share", 0.30, 0.10),
)

_SYMBOLS = frozenset("#$%&*^~@=<>\\{}[]_+|")


def _shape(word: str) -> int:
    """Place of the word's shape: runs of capitals, other letters, digits, and each mark once."""
    shape, last = [], ""
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            shape.append(k)
            last = k
    return zlib.crc32("".join(shape[:12]).encode("utf-8", "surrogatepass")) % (SIZE // 2)


def _short(word: str, known: dict[str, int] = {}) -> int:  # noqa: B006
    """The same for the few shapes of most words; the worker remembers them."""
    found = known.get(word)
    if found is None:
        found = _shape(word)
        if len(known) < 4096:
            known[word] = found
    return found


TRAITS = 8  # of a word, before the place of its shape


def _traits(word: str) -> tuple[int, ...]:
    """symbol, pipe, upper, exclaim, sentence end, function word, odd length, Latin letters, hashed shape."""
    core = word.rstrip(".,")
    if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # most words: Latin letters, with a point or comma
        low = core.lower()
        case = "x" if core == low else "Xx" if core[1:] == low[1:] and len(core) > 1 else "X" if core.isupper() else ""
        if case:
            return (False, False, case == "X" and len(core) > 1, False, word[-1] == ".", low in FUNCTION_WORDS, len(core) > 20, True, _short(case + word[len(core) :]))
    bare = word.strip(".,;:!?\"'()")
    letters = [c for c in word if c.isalpha()]
    upper = len(letters) > 1 and all(c.isupper() for c in letters)
    return (
        sum(c in _SYMBOLS for c in word) >= 2 or (len(word) == 1 and word in _SYMBOLS),
        word == "|",
        upper,
        word.rstrip(".,").endswith("!"),
        word[-1] in ".!?…。！？؟।",
        bare.lower() in FUNCTION_WORDS,
        not 1 <= len(bare) <= 20 and not UNSPACED.search(word),
        not letters or all(c < "\u0250" for c in letters),
        _shape(word),
    )


class _Words:
    """Traits of the words met so far, by their numbers."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((4096, TRAITS + 1), dtype=np.int32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The words' numbers, which hold until the next call."""
        if len(self.numbers) > REMEMBERED:
            self.__init__()
        fresh = list(set(words).difference(self.numbers))
        if fresh:
            low = len(self.numbers)
            while low + len(fresh) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[low : low + len(fresh)] = list(map(_traits, fresh))
            self.numbers.update(zip(fresh, range(low, low + len(fresh))))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


def _worker_words() -> _Words:
    return worker_cache("quality", _Words)


CHUNK, TEXTS = 1 << 15, 128  # words, and texts, that are looked up together


def _pieces(texts: Iterator[str | None]) -> Iterator[tuple[list[str], list[tuple[int, int]], bool]]:
    """Words of several short texts, or of a part of a long one, with the number and size of each
    text, and whether the (last) text goes on in the next piece."""
    words: list[str] = []
    sizes: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        own = (text or "").split()
        if sizes and (len(words) + len(own) > CHUNK or len(sizes) >= TEXTS):
            yield words, sizes, False
            words, sizes = [], []
        for at in range(0, len(own) - CHUNK, CHUNK):
            yield own[at : at + CHUNK], [(k, CHUNK)], True
        rest = own[(len(own) - 1) // CHUNK * CHUNK :] if own else own
        words += rest
        sizes.append((k, len(rest)))
        if len(own) > CHUNK:
            yield words, sizes, False
            words, sizes = [], []
    if sizes:
        yield words, sizes, False


def statistics(texts: Iterator[str | None], words_of: _Words) -> Iterator[tuple[dict[str, float], np.ndarray, np.ndarray]]:
    """Of each whole text: the statistics that the heuristics read (none of an empty one), and the
    places and values of its hashed vector that aren't zero.

    Shares that the length of a text makes coarse are smoothed by a few words of the usual kind,
    so that a short text moves a heuristic little; no length switches one off.
    """
    half = SIZE // 2
    held = None  # of a text that goes on: counts, sums, stutters, distinct words, size, last word
    for words, sizes, more in _pieces(texts):
        codes = words_of.look_up(words)
        traits = words_of.table[codes]
        n = np.array([size for _, size in sizes])
        owner = np.repeat(np.arange(len(n)), n)
        shapes = traits[:, TRAITS].astype(np.int64)
        counts = np.zeros((len(n), SIZE))
        counts[:, :half] = np.bincount(owner * half + shapes, minlength=len(n) * half).reshape(-1, half)
        inside = owner[1:] == owner[:-1]
        same = (codes[1:] == codes[:-1]) & inside
        pairs = (shapes[:-1] * 31 + shapes[1:] + 17 * same) % (half - TRAITS) + owner[1:] * (half - TRAITS)
        counts[:, half : SIZE - TRAITS] = np.bincount(pairs[inside], minlength=len(n) * (half - TRAITS)).reshape(-1, half - TRAITS)
        sums = np.stack([np.bincount(owner, traits[:, k], len(n)) for k in range(TRAITS)], axis=1)
        stutters = np.bincount(owner[1:][same], minlength=len(n))
        latin = traits[:, 7] == 1
        functions = np.bincount(owner[latin], traits[latin, 5], len(n))
        distinct = np.bincount(np.unique(owner << 32 | codes) >> 32, minlength=len(n))
        if held is not None or more:
            kinds = set(words)
            if held is not None:
                counts[0] += held[0]
                sums[0] += held[1]
                stutters[0] += held[2] + (held[5] == words[0])
                kinds |= held[3]
                n[0] += held[4]
                functions[0] += held[6]
                distinct[0] = len(kinds)
            held = (counts[0], sums[0], stutters[0], kinds, n[0], words[-1], functions[0]) if more else None
            if more:
                continue
        # Square roots of shares: a trait of a few words still counts in a long text.
        counts[:, SIZE - TRAITS] = stutters
        counts[:, SIZE - 7 :] = sums[:, :7]
        vectors = np.sqrt(counts / np.maximum(n, 1)[:, None]).astype(np.float32)
        for k, m in enumerate(n.tolist()):
            places = np.flatnonzero(vectors[k])
            found = {
                "symbol_share": sums[k, 0] / m,
                "pipe_share": sums[k, 1] / m,
                "upper_share": sums[k, 2] / m,
                "exclaim_share": sums[k, 3] / m,
                "stutter_share": stutters[k] / m,
                "repeat_share": max(0.0, 1 - (distinct[k] + 5) / (m + 5)),
                "sentence_words": m / max(1.0, sums[k, 4]),
                "content_share": 1 - (functions[k] + 0.7) / (sums[k, 7] + 10),
                "odd_share": sums[k, 6] / m,
            } if m else {}
            yield found, places.astype(np.int32), vectors[k, places]


def votes(found: dict[str, float]) -> list[int]:
    """1 (good), 0 (bad) or -1 (abstains) of each heuristic; an empty text gets no votes but bad ones."""
    if not found:
        return [0] * len(RULES)
    return [0 if found[s] >= bad else 1 if found[s] <= good else -1 for _, s, bad, good in RULES]


def pattern_code(v: list[int]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def pattern_votes(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, r = divmod(code, 3)
        out.append(r - 1)
    return out[::-1]


def fit_labellers(patterns: dict[int, int], rounds: int = 200, prior: float = 0.85) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation-maximisation over the counts of vote patterns.

    Each heuristic has, per class, a chance of each vote (good, bad, abstains), independent of
    the others given the class; nothing is known but the votes. Starts from the assumption
    that heuristics are mostly right and that one bad vote is telling. Returns each pattern's posterior chance of being good,
    the estimated accuracies (of votes that are not abstentions) and the share of good rows.
    """
    if not patterns:
        return {}, np.full(len(RULES), np.nan), prior
    codes = list(patterns)
    v = np.array([pattern_votes(c) for c in codes]) + 1  # 0 abstains, 1 bad, 2 good
    n = np.array([patterns[c] for c in codes], dtype=np.float64)
    onehot = (v[:, :, None] == np.arange(3)).astype(np.float64)
    bad_votes, good_votes = (v == 1).sum(1), (v == 2).sum(1)
    q = np.where(bad_votes >= 1, np.where(bad_votes >= 2, 0.02, 0.3), np.where(good_votes >= 1, 0.97, prior))
    share = prior
    for _ in range(rounds):
        good = np.einsum("p,pkv->kv", n * q, onehot) + 0.5
        bad = np.einsum("p,pkv->kv", n * (1 - q), onehot) + 0.5
        good /= good.sum(axis=1, keepdims=True)
        bad /= bad.sum(axis=1, keepdims=True)
        share = float(np.clip((n * q).sum() / n.sum(), 1e-3, 1 - 1e-3))
        odds = np.log(share / (1 - share)) + np.einsum("pkv,kv->p", onehot, np.log(good) - np.log(bad))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    right = (share * good[:, 2] + (1 - share) * bad[:, 1]) / np.maximum(1e-9, share * (good[:, 1] + good[:, 2]) + (1 - share) * (bad[:, 1] + bad[:, 2]))
    return dict(zip(codes, q.tolist(), strict=True)), right, share


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by Adam; classes weigh the same. The last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1), dtype=np.float32)), axis=1)
    w = np.zeros(x.shape[1], dtype=np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    good = max(float(y.mean()), 1e-3)
    weight = (y / good + (1 - y) / max(1 - good, 1e-3)).astype(np.float32) / 2
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) / len(y) + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


FEATURES = "pattern int, h long, places array<int>, values array<float>"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One pass over the texts: doc_id (or, if ``whole``, the row itself as ``doc``), pattern (of
    the votes), h (hash of the text), and the places and values of the scorer's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words()
        for batch in batches:
            texts = batch.column(0).field(at) if whole else batch.column(2)
            codes, places, values = [], [], []
            for found, p, v in statistics((t.as_py() for t in texts), words):
                codes.append(pattern_code(votes(found)))
                places.append(p)
                values.append(v)
            columns = [pa.array(codes, pa.int32()), batch.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc" if whole else "doc_id", "pattern", "h", "places", "values"])

    text = F.col(f"`{text_col}`").cast("string")
    h = F.xxhash64(F.lit(3), F.coalesce(text, F.lit(""))).alias("h")
    if not whole:
        return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), h, text.alias("text")).mapInArrow(run, f"doc_id long, {FEATURES}")
    at = docs.columns.index(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(row, h)
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {FEATURES}")


def fit(table: DataFrame, sample: int = 8000) -> dict:
    """Weights of the scorer and what was learnt of the heuristics, from written ``features``.

    All documents vote, and the label model is fitted on all their patterns (3 ** 9 at most).
    The scorer is fitted on the posterior labels of a bounded sample: the ``sample`` distinct
    texts whose hashes are lowest, so that copies neither fill nor empty it.
    """
    patterns, kinds = {}, 0
    for r in table.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect():
        patterns[r["pattern"]] = r["n"]
    kinds = table.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"]
    posterior, accuracy, good = fit_labellers(patterns)
    # About twice the sample is kept as candidates, then the lowest hashes are taken.
    share = min(1.0, 2.0 * sample / max(kinds, 1))
    lowest = table.where(F.col("h") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    lowest = lowest.groupBy("h").agg(F.min(F.struct("pattern", "places", "values")).alias("f")).orderBy("h").limit(sample)
    chosen = lowest.select("f.*").collect()
    weights = np.zeros(SIZE + 1, dtype=np.float32)
    if chosen:
        x = np.zeros((len(chosen), SIZE), dtype=np.float32)
        for k, r in enumerate(chosen):
            x[k, r["places"]] = r["values"]
        weights = fit_scorer(x, np.array([posterior[r["pattern"]] for r in chosen], dtype=np.float32))
    return {"weights": weights, "posterior": posterior, "accuracy": {name: float(a) for (name, *_), a in zip(RULES, accuracy, strict=True)}, "good_share": good}


def _score(model: dict) -> Column:
    """The scorer as an expression over places and values; a text without words scores 0."""
    weights = F.expr("array(" + ",".join(f"{float(w)!r}D" for w in model["weights"][:-1]) + ")")
    z = F.aggregate(F.zip_with("places", "values", lambda p, v: F.get(weights, p) * v), F.lit(float(model["weights"][-1])), lambda a, x: a + x)
    return F.when(F.size("places") > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).otherwise(0.0)


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (chance of being good), posterior (of the label model), pattern and keep (score
    at or above ``threshold``), a row per input row.

    Texts are read once; the scorer reads the written features. Null and empty texts score 0.
    Null ids and repeated rows are kept, equal texts get equal scores; other columns may have
    any name; an empty table gives no rows."""
    table = written(features(docs, id_col, text_col), "quality")
    model = fit(table, sample)
    chances = F.expr("map(" + ",".join(f"{k},{v!r}D" for k, v in model["posterior"].items()) + ")") if model["posterior"] else F.lit(None).cast("map<int,double>")
    return table.select("doc_id", _score(model).alias("score"), F.coalesce(F.try_element_at(chances, F.col("pattern")), F.lit(0.5)).alias("posterior"), "pattern").withColumn("keep", F.col("score") >= threshold)


def drop_rejected(docs: DataFrame, threshold: float = 0.5, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with its columns.

    The rows are written once with their features and filtered on reading: one pass over the
    texts, no shuffle, no join by an id that may repeat or be null. Null and empty texts go;
    copies go or stay together; an empty table gives no rows."""
    table = written(features(docs, id_col, text_col, whole=True), "quality-rows")
    return table.where(_score(fit(table, sample)) >= threshold).select("doc.*")
