"""Stop words, known spellings, ids and scores."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .base import literal_map

#: Up to so many words are compared as constants; a longer list is joined (see ``drop_stop_words``).
MOST_CONSTANTS = 5000


@dataclass(frozen=True)
class StopWords:
    """Words that no dictionary needs: ``exact`` ones, and ``lower`` ones whatever their case."""

    exact: frozenset[str] = field(default_factory=lambda: tables.COMMON_JAPANESE | tables.AFFIXES)
    lower: frozenset[str] = field(default_factory=lambda: tables.COMMON_ENGLISH)
    listed: DataFrame | None = field(default=None, compare=False)

    @classmethod
    def of(cls, japanese: Iterable[str] = (), english: Iterable[str] = ()) -> StopWords:
        """The default lists and more words."""
        return cls(tables.COMMON_JAPANESE | tables.AFFIXES | frozenset(japanese), tables.COMMON_ENGLISH | frozenset(w.lower() for w in english))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> StopWords:
        """The default lists and the words of a text file, separated by white space. A file of more
        than MOST_CONSTANTS words stays a table, which words are joined with."""
        words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).where("w != ''").distinct()
        some = words.limit(MOST_CONSTANTS + 1).collect()
        if len(some) > MOST_CONSTANTS:
            return cls(listed=words)
        return cls.of(japanese=[r["w"] for r in some])

    def matches(self, word: Column) -> Column:
        return word.isin(*sorted(self.exact)) | F.lower(word).isin(*sorted(self.lower))


def drop_stop_words(df: DataFrame, stop: StopWords, column: str = "word") -> DataFrame:
    """Without the stop words: constants are compared, a table of them is joined."""
    kept = df.where(~stop.matches(F.col(column)))
    if stop.listed is None:
        return kept
    return kept.join(stop.listed.select(F.col("w").alias("__stop")), F.col(column) == F.col("__stop"), "left_anti")


def canonical_spelling(word: Column) -> Column:
    """The known spelling of a word in any case, or null."""
    return F.try_element_at(literal_map(tables.CANONICAL), F.lower(word))


def stable_id(word: Column, reading: Column) -> Column:
    """An id in the form of a version-5 UUID, from the SHA-1 of reading, tab and word."""
    h = F.sha1(F.concat_ws("\t", reading, word))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.upper(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def score(word: Column, count: Column, projects: Column) -> Column:
    """Frequent, long and widely used words first."""
    length = F.greatest(F.lit(0), F.length(word) - 2)
    return count * (1.0 + 0.25 * length) * (1.0 + 0.15 * (projects - 1)) * F.log1p(count.cast("double"))


def has_inner_capital(word: Column) -> Column:
    return word.rlike("^.+[A-Z]")
