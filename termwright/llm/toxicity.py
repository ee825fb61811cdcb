"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

WINDOW, STRIDE = 32, 24  # words of a window, and from one window's start to the next
WORDS, GRAMS = 1 << 12, 1 << 14  # rows of the hashed word and character tables
WIDTH, HIDDEN, ATTENTION = 12, 8, 8
REMEMBERED = 150_000  # words whose gate inputs a worker remembers
AT_ONCE = 2048  # windows that run through the network together
_EDGES = "#$%&*|!?.,;:()[]{}<>\"'`~^_-+=/\\…«»¿¡"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


#: Bytes of the character sequences that are looked up anywhere in a word, and at its start.
ANYWHERE, AT_START = (3, 4, 5, 6), (2, 7, 8, 10)


def traits(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash; its hashed character sequences (those of all words in one row);
    their number. Words have a mark at either end, and punctuation at the ends is left off."""
    if not words:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    marked = [b"<%b>" % w.strip(_EDGES).encode("utf-8", "surrogatepass") for w in words]
    ids = np.fromiter((zlib.crc32(m) % WORDS for m in marked), np.int64, len(marked))
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(marked) + bytes(max(AT_START)), dtype=np.uint8).astype(np.uint64)
    n = len(data) - max(AT_START)
    room = np.repeat(starts + sizes, sizes) - np.arange(n)  # bytes from here to the word's end
    columns, masks = [], []
    rolled = np.zeros(n, dtype=np.uint64)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    for k in range(1, max(AT_START) + 1):
        rolled = rolled * np.uint64(1099511628211) + data[k - 1 : k - 1 + n] + np.uint64(1)
        for chosen, salt in ((k in ANYWHERE, 0), (k in AT_START, 0x9E3779B97F4A7C15)):
            if chosen:
                mixed = (rolled ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
                columns.append((mixed >> np.uint64(40)).astype(np.int64) % GRAMS)
                masks.append((room >= k) & first if salt else room >= k)
    mask = np.stack(masks, axis=1)
    flat = np.stack(columns, axis=1)[mask]
    return ids, flat, np.add.reduceat(mask.sum(axis=1), starts)


class Model:
    """Parameters. Row 0 of a vocabulary stands for padding and has no features."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.word = normal(WORDS, WIDTH, scale=0.1)
        self.gram = normal(GRAMS, WIDTH, scale=0.1)
        self.dense = {
            "Wx": normal(2, 2 * WIDTH, 3 * HIDDEN, scale=0.3),
            "bx": np.zeros((2, 3 * HIDDEN), dtype=np.float32),
            "U": normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "A": normal(2 * HIDDEN, ATTENTION, scale=0.3),
            "v": normal(ATTENTION, scale=0.3),
            "w": normal(2 * HIDDEN, scale=0.3),
            "b": np.zeros(1, dtype=np.float32),
        }
        self.document = np.array([1.0, 0.0, 0.0, 0.0, 0.0])  # of summary() and one
        self.key = uuid.UUID(int=0).hex

    def state(self) -> dict:
        """The parameters as plain arrays."""
        return dict(self.__dict__)

    @classmethod
    def restored(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def features(self, ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word vector and mean-scaled sum of character vectors, side by side."""
        chars = np.add.reduceat(self.gram[flat], offsets, axis=0) / np.sqrt(sizes)[:, None] if len(ids) else np.zeros((0, WIDTH))
        return np.concatenate((self.word[ids], chars.astype(np.float32)), axis=1)

    def gates(self, features: np.ndarray) -> np.ndarray:
        """Inputs of the gates, (rows, 2 directions, 3 HIDDEN)."""
        d = self.dense
        return np.stack([features @ d["Wx"][k] + d["bx"][k] for k in (0, 1)], axis=1)

    def run(self, table: np.ndarray, windows: np.ndarray, filled: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ``table``); ``filled``: places that hold words."""
        d, h = self.dense, HIDDEN
        n, length = windows.shape
        x = np.empty((length, 2, n, 3 * h), dtype=np.float32)
        for t in range(length):
            x[t, 0] = table[windows[:, t], 0]
            x[t, 1] = table[windows[:, length - 1 - t], 1]
        state = np.zeros((2, n, h), dtype=np.float32)
        states = np.empty((length, 2, n, h), dtype=np.float32)
        saved = []
        for t in range(length):
            g = np.matmul(state, d["U"])
            zr = x[t, :, :, : 2 * h] + g[:, :, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :h], zr[:, :, h:]
            gn = g[:, :, 2 * h :]
            new = np.tanh(x[t, :, :, 2 * h :] + r * gn)
            if keep:
                saved.append((state, zr, gn, new))
            state = new + z * (state - new)
            states[t] = state
        seen = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)  # (length, n, 2h)
        u = np.tanh(seen @ d["A"])
        s = np.where(filled.T, u @ d["v"], np.float32(-1e9))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, seen)
        logits = pooled @ d["w"] + d["b"]
        return logits, (x, states, saved, seen, u, a, pooled) if keep else None

    def backward(self, held, windows: np.ndarray, slope: np.ndarray):
        """Gradients of the dense parameters and of the gate inputs, (length, 2, n, 3 HIDDEN)."""
        d, h = self.dense, HIDDEN
        x, states, saved, seen, u, a, pooled = held
        length = len(x)
        grads = {"w": pooled.T @ slope, "b": slope.sum(keepdims=True)}
        dpooled = slope[:, None] * d["w"]
        dseen = a[:, :, None] * dpooled
        da = np.einsum("nh,tnh->tn", dpooled, seen)
        ds = a * (da - (a * da).sum(axis=0))
        grads["v"] = np.einsum("tn,tnk->k", ds, u)
        du = ds[:, :, None] * d["v"] * (1 - u * u)
        grads["A"] = np.einsum("tnh,tnk->hk", seen, du)
        dseen += du @ d["A"].T
        dstates = np.stack((dseen[:, :, :h], dseen[::-1, :, h:]), axis=1)
        dx = np.empty_like(x)
        gU = np.zeros_like(d["U"])
        back = np.zeros_like(states[0])
        turned = d["U"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            before, zr, gn, new = saved[t]
            z, r = zr[:, :, :h], zr[:, :, h:]
            total = dstates[t] + back
            dn = total * (1 - z) * (1 - new * new)
            dz = total * (before - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[t, :, :, :h], dx[t, :, :, h : 2 * h], dx[t, :, :, 2 * h :] = dz, dr, dn
            dg = np.concatenate((dz, dr, dn * r), axis=2)
            gU += np.matmul(before.transpose(0, 2, 1), dg)
            back = total * z + np.matmul(dg, turned)
        grads["U"] = gU
        return grads, dx


class Lexicon:
    """The words of some texts, numbered from 1."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        for word in sorted(set(words).difference(self.numbers)):
            self.numbers[word] = len(self.numbers) + 1
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


def windows_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of a text and which of their places hold words. A text without
    words is one window of padding."""
    n = len(codes)
    count = 1 + max(0, -(-(n - WINDOW) // STRIDE))
    padded = np.zeros(WINDOW + STRIDE * (count - 1), dtype=np.int64)
    padded[:n] = codes
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    filled = views > 0
    if not n:
        filled = np.zeros_like(filled)
        filled[0, 0] = True
    return views, filled


def summary(logits: np.ndarray) -> np.ndarray:
    """A document's windows: the worst, the means of the worst three and eight (missing ones
    count as clean), and the logarithm of their number."""
    top = np.full(8, -8.0)
    worst = np.sort(np.clip(logits, -8, 8))[::-1][:8]
    top[: len(worst)] = worst
    return np.array([top[0], top[:3].mean(), top.mean(), np.log(len(logits))])


def calibrate(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Logistic regression of the labels on document summaries: Newton's method, with steps
    halved until the penalised loss falls."""
    x = np.concatenate((rows, np.ones((len(rows), 1))), axis=1)
    pull = ridge * np.array([1, 1, 1, 1, 0.01])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ w)).sum() + (pull * w * w).sum() / 2)

    w, now = np.zeros(5), loss(np.zeros(5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull), x.T @ (p - labels) + pull * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if now - loss(w) < 1e-9:
            break
        now = loss(w)
    return w


class Corpus:
    """The windows of some whole texts with a label each."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        lexicon = Lexicon()
        parts = [windows_of(lexicon.codes(tokens(t))) for t in texts]
        self.labels = labels
        self.windows = np.concatenate([p[0] for p in parts])
        self.filled = np.concatenate([p[1] for p in parts])
        self.owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        self.first = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        self.positive = labels[self.owner] == 1
        self.ids, self.flat, self.sizes = (np.concatenate((x, y)) for x, y in zip(([0], [0], [1]), traits(list(lexicon.numbers)), strict=True))
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def subset(self, words: np.ndarray):
        n = self.sizes[words]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.offsets[words], n)
        return self.ids[words], self.flat[places], ends - n, n

    def logits(self, model: Model, texts: np.ndarray) -> np.ndarray:
        """Of the windows of the chosen texts; the others get none (0)."""
        out = np.zeros(len(self.windows), dtype=np.float32)
        chosen = np.flatnonzero(texts[self.owner])
        for at in range(0, len(chosen), AT_ONCE):
            own = chosen[at : at + AT_ONCE]
            part = self.windows[own]
            words, inverse = np.unique(part, return_inverse=True)
            table = model.gates(_padded(model.features(*self.subset(words)), words))
            out[own] = model.run(table, inverse.reshape(part.shape), self.filled[own])[0]
        return out

    def summaries(self, logits: np.ndarray) -> np.ndarray:
        return np.array([summary(logits[a:b]) for a, b in zip(self.first, self.first[1:])])

    def weigh(self, logits: np.ndarray) -> np.ndarray:
        """How often a window teaches: of a positive text the highest so far, of a negative one any, hard
        ones more often."""
        weight = np.empty(len(self.windows))
        for k, label in enumerate(self.labels):
            own = slice(self.first[k], self.first[k + 1])
            e = np.exp(3 * (logits[own] - logits[own].max()))
            weight[own] = e / e.sum() if label == 1 else 0.5 / len(e) + 0.5 * e / e.sum()
        return weight


def train(texts: list[str], labels: np.ndarray, steps: int = 600, batch: int = 192, seed: int = 6) -> Model:
    """Fit on whole texts with a label each.

    A text is as toxic as its worst window, so a positive text teaches through the windows
    that score highest so far (all alike at first), a negative one through any of its windows,
    hard ones more often. The document's score is fitted, whatever the number of texts, to
    what the windows of each half of them get from a network that learnt from the other half only.
    """
    if not texts or labels.min() == labels.max():
        model = Model(seed)
        model.document = np.array([0.0, 0.0, 0.0, 0.0, -3.0])
        return model
    corpus = Corpus(texts, labels)
    half = np.zeros(len(labels), dtype=np.int64)
    for side in (0, 1):
        own = np.flatnonzero(labels == side)
        half[own] = np.arange(len(own)) % 2
    found = np.zeros((len(labels), 4))
    for h in (0, 1):
        if (labels[half != h] == 1).any():
            other = _taught(corpus, half != h, steps // 3, batch, seed)
            found[half == h] = corpus.summaries(corpus.logits(other, half == h))[half == h]
    model = _taught(corpus, np.ones(len(labels), dtype=bool), steps, batch, seed)
    model.document = calibrate(found, labels)
    model.key = f"{zlib.crc32(model.gram.tobytes()):08x}{zlib.crc32(model.dense['Wx'].tobytes()):08x}"
    return model


def _taught(corpus: Corpus, texts: np.ndarray, steps: int, batch: int, seed: int) -> Model:
    """A network that learnt from the windows of the chosen texts."""
    model = Model(seed)
    rng = np.random.default_rng(seed)
    windows, filled, positive, subset = corpus.windows, corpus.filled, corpus.positive, corpus.subset
    taught = texts[corpus.owner]
    moments = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in model.dense.items()}
    second = {"word": np.full(WORDS, 1e-4, dtype=np.float32), "gram": np.full(GRAMS, 1e-4, dtype=np.float32)}

    def spread(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chance = [np.where(taught & (positive == side), weight, 0.0) for side in (True, False)]
        return tuple(np.cumsum(c / c.sum()) for c in chance)

    sums = spread(1.0 / np.diff(corpus.first)[corpus.owner])
    for step in range(1, steps + 1):
        if step in (steps // 3, 2 * steps // 3):
            sums = spread(corpus.weigh(corpus.logits(model, texts)))
        pick = np.concatenate([np.minimum(np.searchsorted(s, rng.random(batch // 2)), len(windows) - 1) for s in sums])
        target = positive[pick].astype(np.float32)
        part = windows[pick]
        words, inverse = np.unique(part, return_inverse=True)
        inverse = inverse.reshape(part.shape)
        wid, grams, starts, n = subset(words)
        features = _padded(model.features(wid, grams, starts, n), words)
        table = model.gates(features)
        logits, held = model.run(table, inverse, filled[pick], keep=True)
        slope = ((1 / (1 + np.exp(-logits)) - target) / len(pick)).astype(np.float32)
        grads, dx = model.backward(held, inverse, slope)
        dtable = np.zeros_like(table)
        order = np.argsort(inverse, axis=None, kind="stable")
        groups = np.flatnonzero(np.diff(inverse.ravel()[order], prepend=-1))
        for k, moved in ((0, dx[:, 0]), (1, dx[::-1, 1])):
            dtable[:, k] = np.add.reduceat(moved.transpose(1, 0, 2).reshape(-1, 3 * HIDDEN)[order], groups, axis=0)
        grads["Wx"] = np.stack([features.T @ dtable[:, k] for k in (0, 1)])
        grads["bx"] = dtable.sum(axis=0)
        dfeatures = _padded(sum(dtable[:, k] @ model.dense["Wx"][k].T for k in (0, 1)), words)
        for name, g in grads.items():
            m, s = moments[name]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            model.dense[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        spreadings = (("word", wid, dfeatures[:, :WIDTH]), ("gram", grams, np.repeat(dfeatures[:, WIDTH:] / np.sqrt(n)[:, None], n, axis=0)))
        for name, rows, g in spreadings:
            order = np.argsort(rows, kind="stable")
            groups = np.flatnonzero(np.diff(rows[order], prepend=-1))
            g, rows = np.add.reduceat(g[order], groups, axis=0), rows[order][groups]
            second[name][rows] += (g * g).mean(axis=1)
            getattr(model, name)[rows] -= (0.02 * g / np.sqrt(second[name][rows])[:, None]).astype(np.float32)
    return model


def _padded(features: np.ndarray, words: np.ndarray) -> np.ndarray:
    features[words == 0] = 0.0
    return features.astype(np.float32)


class Scorer:
    """Scores texts, remembering the gate inputs of words."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED // 8, 2, 3 * HIDDEN), dtype=np.float32)
        self.table[0] = self.model.gates(np.zeros((1, 2 * WIDTH), dtype=np.float32))[0]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            own = words[at : at + 4096]
            ids, flat, sizes = traits(own)
            rows = self.model.gates(self.model.features(ids, flat, np.cumsum(sizes) - sizes, sizes))
            low = len(self.numbers) + 1
            while low + len(own) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[low : low + len(own)] = rows
            self.numbers.update(zip(own, range(low, low + len(own)), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Each text's chance of being toxic, from all its windows."""
        out, held, size = [], [], 0

        def flush():
            windows = np.concatenate([w for w, _ in held])
            filled = np.concatenate([f for _, f in held])
            logits = np.concatenate([self.model.run(self.table, windows[at : at + AT_ONCE], filled[at : at + AT_ONCE])[0] for at in range(0, len(windows), AT_ONCE)])
            ends = np.cumsum([len(w) for w, _ in held])
            found = np.array([summary(logits[e - len(w) : e]) for e, (w, _) in zip(ends, held, strict=True)])
            z = np.clip(found @ self.model.document[:-1] + self.model.document[-1], -30, 30)
            out.extend((1 / (1 + np.exp(-z))).tolist())
            held.clear()

        for text in texts:
            words = tokens(text)
            fresh = set(words).difference(self.numbers)
            if fresh:
                if len(self.numbers) + len(fresh) > REMEMBERED and self.numbers:
                    if held:
                        flush()
                        size = 0
                    self.clear()
                    fresh = set(words)
                self._learn(sorted(fresh))
            held.append(windows_of(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))))
            size += len(held[-1][0])
            if size >= AT_ONCE:
                flush()
                size = 0
        if held:
            flush()
        return out


def worker_scorer(state: dict) -> Scorer:
    """The scorer of this worker process, which serves all its tasks."""
    return worker_cache(f"toxicity-{state['key']}", lambda: Scorer(Model.restored(state)))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, each: int = 1500, longest: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``each`` whole labelled texts of either class that aren't held out: those
    whose hashed ids are lowest. Rows without a label or id teach nothing, nor do texts of more
    than ``longest`` code points, so that at most 2 x each x longest come to the driver; an id
    that has several labels counts as toxic, one that has several texts teaches by the least."""
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).alias("label")).where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.where(~held_out("doc_id")).withColumn("h", F.xxhash64(F.lit(6), "doc_id"))
    chosen = marked.where("label = 1").orderBy("h", "doc_id").limit(each).unionByName(marked.where("label = 0").orderBy("h", "doc_id").limit(each))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")  # 2 x each rows at most
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("h").alias("h"), F.first("label").alias("label"))
    found = sorted(one.collect(), key=lambda r: (r["h"], r["doc_id"]))
    return train([r["text"] for r in found], np.array([r["label"] for r in found], dtype=np.int64))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (from the worst of all overlapping windows of the whole text) and predicted.

    Null and empty texts are scored as one window of padding. Null ids and repeated rows are
    kept; other columns may have any name and are not read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # fixed size: the tables above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = scorer.scores(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
