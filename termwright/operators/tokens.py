"""Tokens: the contract, two tokenizers, chunks and spans.

Everything downstream takes ``tokens``, an array of structs with pos, surface, latin (romaji, or
empty), kind, start and end. Only whether one token's end is the next one's start is ever
used, so offsets may count characters or pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kana, tables
from ..functions.base import let
from . import segments

TOKEN = "struct<pos:int,surface:string,latin:string,kind:string,start:int,end:int>"
TOKENS = f"array<{TOKEN}>"

_OTHER = rf"[[\p{{L}}\p{{M}}\p{{N}}_]&&[^{tables.HIRAGANA}{tables.KATAKANA}{tables.KANJI}]]+"
_WORD_CHARACTER = rf"[[\p{{L}}\p{{M}}\p{{N}}_]&&[^{tables.HIRAGANA}{tables.KATAKANA}{tables.KANJI}]]"
#: Whole runs that are ASCII words and hold a capital: what ``script_runs`` and the casing rule leave of a text.
CAPITAL_WORDS = rf"(?<!{_WORD_CHARACTER})(?=[a-z0-9_]*+[A-Z])[A-Za-z][A-Za-z0-9_]*+(?!{_WORD_CHARACTER})"
PIECES = rf"[{tables.KATAKANA}]+|[{tables.HIRAGANA}]+|[{tables.KANJI}]+|{_OTHER}|[^\p{{L}}\p{{M}}\p{{N}}_{tables.KATAKANA}]+"


def script_runs(text: Column) -> Column:
    """Tokens without a lexicon: runs of one script. All characters belong to some piece, so
    pieces are neighbours in the text if they are in the array; offsets count pieces."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    return F.transform(
        pieces,
        lambda p, i: F.struct(i.alias("pos"), p.alias("surface"), F.lit("").alias("latin"), kana.classify(p).alias("kind"), i.alias("start"), (i + 1).alias("end")),
    ).cast(TOKENS)


def with_script_runs(utterances: DataFrame, text_col: str = "text") -> DataFrame:
    return utterances.withColumn("tokens", script_runs(F.col(text_col)))


def with_lexicon(utterances: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens by the cheapest path through a lexicon of surface, latin and cost, of any size (see ``segments``); ``utt``
    tells the utterances apart.

    Runs of one script are the fallback, at a cost above any entry's. Offsets count words."""
    cut = segments.segmented(utterances, lexicon, "utt", text_col, PIECES)
    listed = F.transform(
        "words",
        lambda w, i: F.struct(i.alias("pos"), w["surface"].alias("surface"), w["latin"].alias("latin"), kana.classify(w["surface"]).alias("kind"), i.alias("start"), (i + 1).alias("end")),
    )
    return cut.withColumn("tokens", F.filter(listed, lambda t: ~t["surface"].rlike(r"(?U)^\s*$")).cast(TOKENS)).drop("words")


def class_of(token: Column) -> Column:
    """ja, ascii, or null for what ends a chunk."""
    return F.when(token["kind"].isin("kanji", "katakana"), "ja").when(token["kind"] == "ascii", "ascii")


def chunks(tokens: Column) -> Column:
    """Maximal runs of neighbouring content tokens of one class, in one pass over the array."""

    def cut(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | ~class_of(F.get(t, i)).eqNullSafe(class_of(F.get(t, i - 1))) | (F.get(t, i - 1)["end"] != F.get(t, i)["start"]),
        )
        return let(
            starts,
            lambda s: F.filter(
                F.transform(s, lambda b, j: F.slice(t, b + 1, F.coalesce(F.get(s, j + 1), F.size(t)) - b)),
                lambda c: class_of(F.get(c, F.lit(0))).isNotNull(),
            ),
        )

    return let(tokens, lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(F.array().cast(f"array<{TOKENS}>")))


def spans(chunk: Column, most: int) -> Column:
    """All runs of 1 to ``most`` tokens of a chunk, and the chunk itself if it is longer."""
    none = F.array().cast(f"array<{TOKENS}>")
    if most < 1:
        return F.when(F.size(chunk) > 0, F.array(chunk)).otherwise(none)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(most), F.size(chunk))),
            lambda k: F.transform(F.sequence(F.lit(1), F.size(chunk) - k + 1), lambda i: F.slice(chunk, i, k)),
        )
    )
    return F.when(F.size(chunk) > 0, F.concat(runs, F.when(F.size(chunk) > most, F.array(chunk)).otherwise(none))).otherwise(none)


def surface_of(span: Column) -> Column:
    return F.array_join(F.transform(span, lambda t: t["surface"]), "")


def exploded_chunks(utterances: DataFrame) -> DataFrame:
    """utt, project, chunk_no and chunk of utterances with tokens."""
    return utterances.select("utt", "project", F.posexplode(chunks(F.col("tokens"))).alias("chunk_no", "chunk"))
