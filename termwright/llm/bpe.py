"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is one token that its encoding ends with; it is the one
token that is a suffix of the prefix and may follow the last token of what stands before it
(two tokens may be neighbours if merging their joined bytes gives just these two). A prefix's
last token depends on earlier bytes only, so bytes can be appended without touching what is
stored, and after an edit the stored tokens are good again once a whole window of them agrees.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Bound of the broadcast vocabulary file; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose encodings a worker remembers; as many older ones are looked up before they go.
REMEMBERED = 200_000
LONGEST_KEY = 64  # characters of a piece that is remembered
#: Characters that are split into pieces at once.
LONG_TEXT = 1 << 22


class Vocabulary:
    """Token ranks and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        #: For a token that is merged from two: those two.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        #: Known answers, by left << 32 | right.
        self._neighbours: dict[int, bool] = {}
        #: All tokens that end at a place, longest first; bytes stand as characters.
        self.suffixes = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self.suffixes.make_automaton()
        for token, i in ranks.items():
            if len(token) > 1:
                parts = self.merged(token, i)
                if len(parts) == 2:
                    self.halves[i] = (parts[0], parts[1])
                    self.joined[parts[0], parts[1]] = i

    @classmethod
    def from_file(cls, data: bytes) -> Vocabulary:
        """A file of lines: the token in base64, a blank, its rank."""
        pairs = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merged(self, piece: bytes, below: int = sys.maxsize) -> list[int]:
        """Merge neighbours of the lowest rank, if under ``below``, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, best = min((ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank >= below or rank == sys.maxsize:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or token in self.halves

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives these two tokens.

        Undo merges from the last one back: it must not be that, just before a token was
        made, a part of it and what stands at the seam would have merged first.
        """
        key = left << 32 | right
        found = self._neighbours.get(key)
        if found is not None:
            return found
        if len(self._neighbours) >= 4 * REMEMBERED:
            self._neighbours.clear()
        a, b, below, found = left, right, sys.maxsize, True
        while True:
            if self.joined.get((a, b), sys.maxsize) < below:
                found = False
                break
            # The later of the two merges is undone; on a tie the left one was made first.
            if a > b and a in self.halves:
                below, a = a, self.halves[a][1]
            elif b in self.halves:
                below, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                below, a = a, self.halves[a][1]
            else:
                break
        self._neighbours[key] = found
        return found


class Prefixes:
    """The last token of each byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def _last_token(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        get = v.ranks.get
        for start in range(max(0, end - v.longest), end):
            token = get(data[start:end])
            if token is not None and (v.neighbours(last[start], token) if start else v.whole(token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, data: bytes) -> None:
        """Add bytes at the end; nothing stored before them changes."""
        v, last, old = self.vocabulary, self.last, len(self.data)
        self.data += data
        last += [-1] * len(data)
        base = max(0, old - v.longest + 1)  # tokens that end behind ``old`` start here or later
        fits = v._neighbours.get
        for at, (token, size) in v.suffixes.iter(self.data[base:].decode("latin-1")):
            end = base + at + 1
            if end > old and last[end] < 0:
                start = end - size
                if not start:
                    if v.whole(token):
                        last[end] = token
                elif (ok := fits(last[start] << 32 | token)) or (ok is None and v.neighbours(last[start], token)):
                    last[end] = token
        if -1 in last[old + 1 :]:
            raise ValueError("the vocabulary lacks a single byte")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to stop; returns how many prefixes were redone."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        agree = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_token(end)
            self.last.append(token)
            agree = agree + 1 if end > start + len(data) and old[end - shift] == token else 0
            if agree >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        """Walk back from the end: each last token tells where the one before it ends."""
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:  # a piece that is itself a token is never split
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Text:
    """An encoded text that takes appends and edits; only the pieces near them are redone."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.pieces: list[str] = []
        self.prefixes: list[Prefixes] = []
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def append(self, more: str) -> int:
        n = sum(map(len, self.pieces))
        return self.replace(n, n, more)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of characters start to stop; returns how many pieces were redone."""
        at, first = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) < start:
            at += len(self.pieces[first])
            first += 1
        for _ in range(2):  # a piece may end where it does because of what follows it
            if first:
                first -= 1
                at -= len(self.pieces[first])
        head, text = self.pieces[:first], self.text
        text = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        old, place = {}, at
        for i in range(first, len(self.pieces)):
            old[place] = i
            place += len(self.pieces[i])
        kept = self.prefixes[:first]
        redone = 0
        for match in self.pattern.finditer(text, at):
            i = old.get(match.start() - shift) if match.start() > start + len(new) else None
            if i is not None and self.pieces[i] == match[0]:
                head += self.pieces[i:]
                kept += self.prefixes[i:]
                break
            was = old.get(match.start()) if match.start() <= start else None
            if was is not None and match[0].startswith(self.pieces[was]):
                grown = self.prefixes[was]
                grown.append(match[0][len(self.pieces[was]) :].encode())
            else:
                grown = Prefixes(self.vocabulary, match[0].encode())
            head.append(match[0])
            kept.append(grown)
            redone += 1
        self.pieces, self.prefixes = head, kept
        return redone

    def tokens(self) -> list[int]:
        return [t for p in self.prefixes for t in p.tokens()]


class _Memo(dict):
    """Results of ``make`` for the keys met lately: two generations of REMEMBERED short keys at most.
    Long keys seldom come again and are not kept, so that memory is bounded too."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> str:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


#: Where cutting a text at its blanks might not cut between pieces: a blank beside other white
#: space, or at either end.
_UNSAFE = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]|\A | \Z")


class Encoder:
    """Encodes and decodes whole texts, piece by piece.

    With a pattern whose pieces take one leading blank at most and never hold a blank
    elsewhere but in runs of white space (``blank_starts``), a text whose blanks all stand
    alone is cut at them first: each cut is between two pieces.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, blank_starts: bool | None = None):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.blank_starts = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern if blank_starts is None else blank_starts
        self.pieces = _Memo(self._piece)
        self.words = _Memo(self._word)
        self.bytes_of = {str(i): b for i, b in vocabulary.bytes_of.items()}

    def _piece(self, piece: str) -> str:
        return ",".join(map(str, Prefixes(self.vocabulary, piece.encode("utf-8", "surrogatepass")).tokens()))

    def _word(self, word: str) -> str:
        """Ids of a blank and what stands up to the next one: letters are one piece with the blank,
        and a mark after them is another; anything else is left to the pattern."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return f"{self.words[word[:-1]]},{self.pieces[word[-1]]}"
        return self._by_pattern(" " + word)

    def _by_pattern(self, text: str) -> str:
        get = self.pieces.__getitem__
        if len(text) <= LONG_TEXT:
            return ",".join(map(get, self.pattern.findall(text)))
        out, held = [], []
        for match in self.pattern.finditer(text):
            held.append(get(match[0]))
            if len(held) >= LONG_TEXT:
                out.append(",".join(held))
                held = []
        return ",".join(out + held)

    def ids(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        if not self.blank_starts or _UNSAFE.search(text):
            return self._by_pattern(text)
        first, *rest = text.split(" ")
        return ",".join([self._by_pattern(first), *map(self.words.__getitem__, rest)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def worker_encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of this worker process, which serves all its tasks."""
    return worker_cache(f"bpe-{hashlib.sha256(data).hexdigest()}-{pattern}", lambda: Encoder(Vocabulary.from_file(data), pattern))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encode every whole text, then decode the ids.

    ``pattern`` splits a text into pieces, each encoded for itself; there are no special
    tokens. ``vocabulary_path`` is a local file on the driver, broadcast to the executors; its
    size is checked. Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded bytes), round_trip (whether those are the text's)
    and, if wanted, ids. Null texts count as empty: no tokens, and the digests of the empty
    string. Null ids and repeated rows are kept; ``carry`` names whole-number columns that come
    along; others may have any name; an empty table gives no rows. Texts of any length are
    read whole.
    """
    with open(vocabulary_path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * with_ids + list(carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # the ids of few texts at once
                batch = whole.slice(at, 512)
                counts, ids_hash, text_hash, same, lists = [], [], [], [], []
                for value in batch.column(1):
                    text = value.as_py() or ""
                    ids = encoder.ids(text)
                    back = encoder.decode(ids)
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode("utf-8", "surrogatepass"))
                    if with_ids:
                        lists.append(list(map(int, ids.split(","))) if ids else [])
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                columns += batch.columns[2:]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids + "".join(f", `{c}` long" for c in carry or [])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").cast("long").alias(c) for c in carry or []])
    return rows.mapInArrow(run, schema)
