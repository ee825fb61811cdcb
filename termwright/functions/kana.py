"""Character classes, kana conversion and readings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables
from .base import let, literal_map
from .unicode import nfkc


def is_katakana(s: Column) -> Column:
    return s.rlike(f"^[{tables.KATAKANA}]+$")


def is_hiragana(s: Column) -> Column:
    return s.rlike(f"^[{tables.HIRAGANA}ー]+$")


def is_kana(s: Column) -> Column:
    return s.rlike(f"^[{tables.HIRAGANA}{tables.KATAKANA}ー]+$")


def has_kanji(s: Column) -> Column:
    return s.rlike(f"[{tables.KANJI}]")


def is_kanji(s: Column) -> Column:
    return s.rlike(f"^[{tables.KANJI}]+$")


def has_japanese(s: Column) -> Column:
    return s.rlike(f"[{tables.HIRAGANA}{tables.KATAKANA}{tables.KANJI}]")


def is_ascii_word(s: Column) -> Column:
    return s.rlike(f"^{tables.ASCII_WORD}$")


def classify(surface: Column) -> Column:
    """katakana, hiragana, kanji (contains one), ascii or other; the first that holds."""
    return (
        F.when(is_katakana(surface), "katakana")
        .when(is_hiragana(surface), "hiragana")
        .when(has_kanji(surface), "kanji")
        .when(is_ascii_word(surface), "ascii")
        .otherwise("other")
    )


_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def katakana_to_hiragana(s: Column) -> Column:
    return F.translate(s, _KATAKANA, _HIRAGANA)


def hiragana_to_katakana(s: Column) -> Column:
    return F.translate(s, _HIRAGANA, _KATAKANA)


def normalise_reading(s: Column) -> Column:
    """Compatibility normal form (half-width kana in full, with their marks), no white space at the ends, hiragana."""
    return katakana_to_hiragana(F.regexp_replace(nfkc(s), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def _segments() -> str:
    keys = sorted(tables.romaji_table(), key=lambda k: (-len(k), k))
    # An apostrophe; n before no vowel or y; a doubled consonant; t before ch; the longest syllable.
    return r"'|n(?![aeiouy])|([^aeioun])(?=\1)|t(?=ch)|" + "|".join(keys)


def romaji_to_hiragana(romaji: Column) -> Column:
    """Hiragana of a romaji spelling, or null where some of it has none.

    One regular expression cuts the spelling into syllables; it has a reading if the pieces
    add up to it.
    """
    spelling = F.replace(F.replace(F.lower(F.translate(romaji, _WIDE + "　", _NARROW + " ")), F.lit("’"), F.lit("'")), F.lit("-"), F.lit(""))
    table = literal_map(tables.romaji_table() | {"'": ""})

    def read(s: Column) -> Column:
        return let(
            F.regexp_extract_all(s, F.lit(_segments()), F.lit(0)),
            lambda pieces: F.when(
                (F.array_join(pieces, "") == s),
                F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), F.lit("っ"))), ""),
            ),
        )

    return F.when(F.coalesce(romaji, F.lit("")) != "", let(spelling, read))


def acronym_reading(word: Column) -> Column:
    """The letters of an all-capital word of 2 to 6, one by one, or null."""
    table = literal_map(tables.LETTERS)
    spelled = F.array_join(F.transform(F.split(F.lower(word), "(?!^)(?!$)"), lambda c: F.try_element_at(table, c)), "")
    return F.when(word.rlike("^(?=.*[A-Z])[A-Z0-9]{2,6}$"), spelled)


def token_reading(surface: Column, latin: Column, kind: Column) -> Column:
    """A token's hiragana: its own kana, or those of its romaji; null if there are none."""
    return (
        F.when(kind == "katakana", katakana_to_hiragana(surface))
        .when(kind == "hiragana", surface)
        .when(kind == "kanji", romaji_to_hiragana(latin))
    )
