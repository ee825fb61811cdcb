"""From tokens to ranked candidates, operator by operator.

Counting is done per project first and then over projects, so no task ever holds a set of
all projects of a term, and a very frequent term is pre-aggregated before each shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kana, tables, words
from ..functions.base import let
from .tokens import CAPITAL_WORDS, exploded_chunks, spans, surface_of

CANDIDATE = ["word", "reading", "kind", "count", "projects", "standalone", "parts", "confidence", "score", "reading_ord", "first_seq"]


@dataclass(frozen=True)
class ExtractConfig:
    """What counts as a term."""

    min_count: int = 3
    min_projects: int = 1
    min_length: int = 3
    max_length: int = 24
    max_span_tokens: int = 3
    ascii_terms: bool = True
    japanese_terms: bool = True
    min_standalone_ratio: float = 0.2
    ascii_reading: str = "both"
    stop: words.StopWords = field(default_factory=words.StopWords)

    def __post_init__(self):
        if self.ascii_reading not in ("lower", "letters", "both"):
            raise ValueError("ascii_reading is lower, letters or both")


def accept_ascii(word: Column, cfg: ExtractConfig) -> Column:
    """Length in range, no number, no stop word, and not all in lower case."""
    return F.length(word).between(cfg.min_length, cfg.max_length) & ~word.rlike("^[0-9._-]+$") & ~cfg.stop.matches(word) & (word != F.lower(word))


def accept_japanese(word: Column, reading: Column, single: Column, cfg: ExtractConfig) -> Column:
    """Length in range, no stop word, a reading of two or more, no inflected single token, not all kana."""
    return (
        F.length(word).between(cfg.min_length, cfg.max_length)
        & ~cfg.stop.matches(word)
        & (F.length(reading) >= 2)
        & ~(single & word.rlike(f"[{tables.HIRAGANA}]$"))
        & ~kana.is_hiragana(word)
    )


def ascii_forms(chunk_rows: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """lower, form, project, n, first_seq of the accepted ASCII chunks."""
    word = surface_of(F.col("chunk"))
    rows = chunk_rows.where(F.get("chunk", F.lit(0))["kind"] == "ascii").select(word.alias("form"), "project", F.struct("utt", "chunk_no").alias("seq"))
    return _counted_forms(rows, cfg)


def _counted_forms(rows: DataFrame, cfg: ExtractConfig) -> DataFrame:
    kept = words.drop_stop_words(rows.where(accept_ascii(F.col("form"), cfg)), cfg.stop, "form")
    return kept.groupBy(F.lower("form").alias("lower"), "form", "project").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def ascii_forms_of(utterances: DataFrame, cfg: ExtractConfig, text_col: str = "text") -> DataFrame:
    """The same straight from texts, for script runs where no Japanese terms are wanted: one regular
    expression finds the ASCII words that hold a capital, and no token is built."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CAPITAL_WORDS), F.lit(0))
    rows = utterances.select("utt", "project", F.posexplode(found).alias("chunk_no", "form"))
    return _counted_forms(rows.select("form", "project", F.struct("utt", "chunk_no").alias("seq")), cfg)


def canonical_forms(forms: DataFrame) -> DataFrame:
    """lower, word, count, projects, first_seq: the known spelling, or the form with the most
    weight (count, half as much again with a capital inside), then count, then the first seen."""
    # Both branches need all columns of the counts below them, so that their shuffle is made
    # once and read twice.
    by_form = forms.groupBy("lower", "form").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    by_project = forms.groupBy("lower", "project").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    totals = by_project.groupBy("lower").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("projects"), F.min("first_seq").alias("first_seq"))
    return _usual(by_form).join(totals, "lower").select("lower", _spelling(), "count", "projects", "first_seq")


def _usual(by_form: DataFrame) -> DataFrame:
    weight = F.col("n") * F.when(words.has_inner_capital(F.col("form")), 1.5).otherwise(1.0)
    return by_form.groupBy("lower").agg(F.min_by("form", F.struct(-weight, -F.col("n"), "first_seq")).alias("usual"))


def _spelling() -> Column:
    return F.coalesce(words.canonical_spelling(F.col("lower")), F.col("usual")).alias("word")


def spelled(by_form: DataFrame) -> DataFrame:
    """lower, word, count and first_seq of counted forms (lower, form, n, first_seq), each once."""
    totals = by_form.groupBy("lower").agg(F.sum("n").alias("count"), F.min("first_seq").alias("first_seq"))
    return _usual(by_form).join(totals, "lower").select("lower", _spelling(), "count", "first_seq")


def ascii_readings(canonical: DataFrame, mode: str = "both") -> DataFrame:
    """A row per reading: the lower-case spelling, the letters of an acronym, or both."""
    letters = kana.acronym_reading(F.col("word"))
    plain, none = F.col("lower"), F.lit(None).cast("string")
    readings = {
        "lower": lambda a: F.array(plain),
        "letters": lambda a: F.array(F.coalesce(a, plain)),
        "both": lambda a: F.array(plain, F.coalesce(a, none)),
    }[mode]
    listed = let(letters, lambda a: F.array_distinct(F.filter(readings(a), lambda x: x.isNotNull())))
    return canonical.select("*", F.posexplode(listed).alias("reading_ord", "reading"))


def span_rows(chunk_rows: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """The accepted spans of Japanese chunks: word, reading, project, whole, parts, seq."""
    read = F.transform(
        "chunk",
        lambda t: F.struct(t["surface"].alias("surface"), kana.token_reading(t["surface"], t["latin"], t["kind"]).alias("reading")),
    )
    rows = (
        chunk_rows.where(F.get("chunk", F.lit(0))["kind"] != "ascii")
        .select("utt", "project", "chunk_no", read.alias("read"), "chunk")
        .select("utt", "project", "chunk_no", F.size("chunk").alias("tokens"), "read", F.posexplode(spans(F.transform("chunk", lambda t, i: F.struct(i.alias("pos"), t["surface"].alias("surface"), t["latin"].alias("latin"), t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"))), cfg.max_span_tokens)).alias("span_no", "span"))
    )
    readings = F.transform("span", lambda t: F.coalesce(F.get(F.col("read"), t["pos"])["reading"], F.lit("")))
    return (
        rows.select(
            surface_of(F.col("span")).alias("word"),
            let(readings, lambda r: F.when(~F.exists(r, lambda x: x == ""), F.array_join(r, ""))).alias("reading"),
            "project",
            (F.size("span") == F.col("tokens")).alias("whole"),
            F.transform("span", lambda t: t["surface"]).alias("parts"),
            F.struct("utt", "chunk_no", "span_no").alias("seq"),
        )
        .where(F.col("reading").isNotNull())
        .where(accept_japanese(F.col("word"), F.col("reading"), F.size("parts") == 1, cfg))
        .transform(words.drop_stop_words, cfg.stop)
    )


def japanese_candidates(rows: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Counts per (word, reading); words that hardly stand alone are dropped."""
    per_project = rows.groupBy("word", "reading", "project").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("whole").cast("long")).alias("alone"), F.min(F.struct("seq", "parts")).alias("first")
    )
    return (
        per_project.groupBy("word", "reading")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("projects"), F.sum("alone").alias("standalone"), F.min("first").alias("first"))
        .where(F.col("standalone") >= F.greatest(F.lit(1.0), F.lit(float(cfg.min_standalone_ratio)) * F.col("count")))
        .select(
            "word",
            "reading",
            F.when(kana.is_katakana(F.col("word")), "katakana").otherwise("kanji").alias("kind"),
            "count",
            "projects",
            "standalone",
            F.col("first.parts").alias("parts"),
            F.struct("first.seq.utt", "first.seq.chunk_no").alias("first_seq"),
        )
    )


def ambiguous_surfaces(utterances: DataFrame) -> DataFrame:
    """surface of kanji tokens that are read in more than one way anywhere."""
    return (
        utterances.select(F.explode("tokens").alias("t"))
        .where((F.col("t.kind") == "kanji") & (F.coalesce("t.latin", F.lit("")) != ""))
        .groupBy(F.col("t.surface").alias("surface"), F.lower("t.latin").alias("latin"))
        .agg(F.lit(1).alias("x"))
        .groupBy("surface")
        .agg(F.count(F.lit(1)).alias("readings"))
        .where("readings > 1")
        .select("surface")
    )


def with_confidence(candidates: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """low where a part is read in several ways, else ok."""
    names = candidates.columns
    parts = candidates.select("word", "reading", F.struct(*names).alias("c"), F.explode_outer("parts").alias("surface"))
    marked = parts.join(ambiguous.withColumn("low", F.lit(True)), "surface", "left")
    found = marked.groupBy("word", "reading").agg(F.any_value("c").alias("c"), F.coalesce(F.max("low"), F.lit(False)).alias("low"))
    return found.select("c.*", F.when(F.col("low"), "low").otherwise("ok").alias("confidence"))


def drop_subsumed(candidates: DataFrame) -> DataFrame:
    """Without words that stand inside a longer one at least as frequent.

    Each word is listed with its proper substrings (a few hundred at most): itself with its row,
    those with its count. Grouped by that text, a row meets the greatest count of a word that
    holds it. No pairs are compared, and the candidates are computed once.
    """
    size, names = F.length("word"), candidates.columns
    row = F.struct(*names)
    nothing = F.when(F.lit(False), row)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
            lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(F.col("word"), i, k)),
        )
    )
    inner = F.when(size > 1, F.array_distinct(inner)).otherwise(F.array().cast("array<string>"))
    own = F.struct(F.col("word").alias("text"), F.lit(None).cast("long").alias("n"), row.alias("row"))
    held = F.transform(inner, lambda t: F.struct(t.alias("text"), F.col("count").cast("long").alias("n"), nothing.alias("row")))
    listed = candidates.select(F.explode(F.concat(F.array(own), held)).alias("x")).select("x.*")
    met = listed.groupBy("text").agg(F.max("n").alias("longer"), F.collect_list("row").alias("rows"))
    kept = met.where(F.size("rows") > 0).select("longer", F.explode("rows").alias("row"))
    return kept.where(F.col("longer").isNull() | (F.col("longer") < F.col("row.count"))).select("row.*")


def drop_subsumed_by_grams(candidates: DataFrame, size: int = 3) -> DataFrame:
    """The same for words of any length: by an inverted index of ``size``-grams, not by listing substrings.

    A word is looked up by the rarest of its grams, so that only words that hold that one are compared; words shorter
    than a gram are met by grouping, without pairs. A word of n characters is in the index size * n times at most."""
    held = candidates.groupBy("word").agg(F.max(F.col("count").cast("long")).alias("n"))
    length = F.length("word")

    def parts(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(length - k + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, F.lit(k)))
        return F.when(length >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    shorter = F.filter(F.concat(*[parts(k) for k in range(1, size)]) if size > 1 else F.array().cast("array<string>"), lambda t: F.length(t) < length)
    short = held.select(F.explode(shorter).alias("word"), "n").groupBy("word").agg(F.max("n").alias("longer"))
    grams = held.select("word", "n", length.alias("length"), F.explode(parts(size)).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    rarest = grams.join(rarity, "gram").groupBy("word").agg(F.min_by("gram", F.struct("words", "gram")).alias("gram"))
    holders = grams.select("gram", F.col("word").alias("holder"), "n", F.col("length").alias("holder_length"))
    met = rarest.join(holders, "gram").where((F.col("holder_length") > length) & F.contains("holder", "word"))
    longer = met.groupBy("word").agg(F.max("n").alias("longer")).unionByName(short.where(length < size))
    kept = candidates.join(longer.withColumnRenamed("longer", "__longer"), "word", "left").where(F.col("__longer").isNull() | (F.col("__longer") < F.col("count")))
    return kept.select(*[F.col(f"`{c}`") for c in candidates.columns])


def drop_subsumed_by_pairs(candidates: DataFrame) -> DataFrame:
    """The same by comparing pairs: for small sets, and to check the other form."""
    a, b = candidates.alias("a"), candidates.select("word", "count").alias("b")
    inside = (F.length("b.word") > F.length("a.word")) & (F.col("b.count") >= F.col("a.count")) & F.contains("b.word", "a.word")
    return a.join(b, inside, "left_anti")


def ranked(candidates: DataFrame) -> DataFrame:
    """By score, then word, then reading and first place."""
    return candidates.orderBy(F.desc("score"), "word", "reading_ord", "first_seq")


def top(candidates: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must be 0 or more")
    return ranked(candidates).limit(limit)


def exclude_registered(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Without the (reading, word) pairs that some dictionary has already."""
    return candidates.join(registered.select("reading", "word").distinct(), ["reading", "word"], "left_anti")


def ascii_candidates(forms: DataFrame, cfg: ExtractConfig) -> DataFrame:
    read = ascii_readings(canonical_forms(forms), cfg.ascii_reading)
    return read.select(
        "word",
        "reading",
        F.lit("ascii").alias("kind"),
        "count",
        "projects",
        F.lit(0).cast("long").alias("standalone"),
        F.array().cast("array<string>").alias("parts"),
        F.lit("ok").alias("confidence"),
        "reading_ord",
        "first_seq",
    )


def candidates(utterances: DataFrame, cfg: ExtractConfig | None = None) -> DataFrame:
    """All candidates of utterances with tokens, before subsumption: counted, with their
    confidence and score, and above the thresholds. Without tokens only ASCII terms are found."""
    cfg = cfg or ExtractConfig()
    if "tokens" in utterances.columns:
        rows = exploded_chunks(utterances)
    elif cfg.japanese_terms:
        raise ValueError("Japanese terms need tokens")
    parts = []
    if cfg.japanese_terms:
        japanese = with_confidence(japanese_candidates(span_rows(rows, cfg), cfg), ambiguous_surfaces(utterances))
        parts.append(japanese.withColumn("reading_ord", F.lit(0)))
    if cfg.ascii_terms:
        forms = ascii_forms(rows, cfg) if "tokens" in utterances.columns else ascii_forms_of(utterances, cfg)
        parts.append(ascii_candidates(forms, cfg))
    if not parts:
        raise ValueError("neither Japanese nor ASCII terms are wanted")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.where((F.col("count") >= cfg.min_count) & (F.col("projects") >= cfg.min_projects))
    return found.withColumn("score", words.score(F.col("word"), F.col("count"), F.col("projects"))).select(*CANDIDATE)


def extract(utterances: DataFrame, cfg: ExtractConfig | None = None) -> DataFrame:
    """Ranked terms of utterances with tokens."""
    return ranked(drop_subsumed(candidates(utterances, cfg)))


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A dictionary's items in their order, then the new ones that it lacks, each pair once.

    ``existing``: word, reading, id, hint, ord; ``new``: word, reading, hint, ord. Returns
    word, reading, id, hint, src (0 existing, 1 added) and ord.
    """
    first = Window.partitionBy("reading", "word").orderBy("ord")
    once = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    known = existing.select(F.coalesce("reading", F.lit("")).alias("reading"), F.coalesce("word", F.lit("")).alias("word")).distinct()
    added = once.join(known, ["reading", "word"], "left_anti")
    old = existing.select("word", "reading", "id", "hint", F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"))
    return old.unionByName(added.select("word", "reading", words.stable_id(F.col("word"), F.col("reading")).alias("id"), F.expr("nullif(hint, '')").alias("hint"), F.lit(1).alias("src"), F.col("ord").cast("long").alias("ord")))


def merge_counts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """added, skipped and total of a merge."""
    merged = merge(existing, new).agg(F.coalesce(F.sum("src"), F.lit(0)).cast("long").alias("added"), F.count(F.lit(1)).alias("total"))
    offered = new.agg(F.count(F.lit(1)).alias("offered"))
    both = merged.withColumn("k", F.lit(1)).join(offered.withColumn("k", F.lit(1)), "k")
    return both.select("added", (F.col("offered") - F.col("added")).alias("skipped"), "total")
