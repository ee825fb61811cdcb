"""Compatibility normalisation (NFKC) as a column expression.

The tables come from the character database that Python brings, so one rule holds on all
workers. Most texts hold no character that can change: they are found by their characters' hashes
and stay as they are. The rest is decomposed by tables, marks are put in the order of
their classes where two of them meet, and pairs are composed from left to right.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

# Hangul syllables are composed by rule (first lead, vowel and tail, and how many there are).
LEAD, VOWEL, TAIL, SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00
LEADS, VOWELS, TAILS = 19, 21, 28


def _every() -> range:
    return range(0x80, 0x30000)


@cache
def _decompositions() -> dict[str, str]:
    """Characters and their full compatibility decomposition; Hangul syllables stay whole."""
    return {c: d for c in map(chr, _every()) if not SYLLABLE <= ord(c) < SYLLABLE + LEADS * VOWELS * TAILS and (d := unicodedata.normalize("NFKD", c)) != c}


@cache
def _classes() -> dict[str, int]:
    """Combining class of each mark that has one."""
    return {c: k for c in map(chr, _every()) if (k := unicodedata.combining(c))}


@cache
def _compositions() -> dict[str, str]:
    """Pairs that compose to one character."""
    out = {}
    for c in map(chr, _every()):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == c:
                out[pair] = c
    return out


def _class_body(chars) -> str:
    """A regular-expression class body of characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@cache
def _changing() -> str:
    """Characters beside which a text may differ from its normal form."""
    own = {c for c in map(chr, _every()) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFKC", c) != c}
    jamo = set(map(chr, [*range(VOWEL, VOWEL + VOWELS), *range(TAIL + 1, TAIL + TAILS)]))
    return "".join(sorted(own | set(_classes()) | {p[1] for p in _compositions()} | jamo))


#: First of the private characters that stand for numbers in ``_number``.
PRIVATE = 0xF0000


def _number(c: Column, of: dict[str, int]) -> Column:
    """The number of a character, or null for a text that holds none of ``of``. Unlike a constant map, which is searched in
    order, ``translate`` looks characters up by their hash."""
    found = F.translate(c, "".join(of), "".join(chr(PRIVATE + k) for k in of.values()))
    return let(found, lambda t: F.when(t != c, F.ascii(t) - PRIVATE))


def _holds(s: Column, chars) -> Column:
    """Whether a text holds one of many characters (a class of a regular expression is tried range by range)."""
    return s.rlike(r"[^\x00-\x7f]") & (F.translate(s, "".join(chars), "") != s)


def _table(entries: dict[str, str]) -> Column:
    """A constant map, folded from one literal. No entry holds a control character."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in entries.items())), F.lit("\u0001"), F.lit("\u0002"))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))  # code points: an empty pattern would cut between surrogates


def _decomposed(s: Column) -> Column:
    one = {k: v for k, v in _decompositions().items() if len(v) == 1}
    more = {k: v for k, v in _decompositions().items() if len(v) > 1}
    single = F.translate(s, "".join(one), "".join(one.values()))
    whole = F.split(F.lit("\u0001".join(more.values())), "\u0001")
    number = {c: k for k, c in enumerate(more)}
    longer = lambda t: F.array_join(F.transform(_chars(t), lambda c: F.coalesce(F.get(whole, _number(c, number)), c)), "")
    return let(single, lambda t: F.when(_holds(t, more), longer(t)).otherwise(t))


def _class_of(c: Column) -> Column:
    return F.coalesce(_number(c, _classes()), F.lit(0))


def _ordered(s: Column) -> Column:
    """Runs of marks in the order of their classes, those of one class as they stood."""
    marks = _class_body(_classes())

    def run(p: Column) -> Column:
        keyed = F.transform(_chars(p), lambda c, i: F.struct(_class_of(c).alias("k"), i.alias("i"), c.alias("c")))
        return F.when(p.rlike(f"^[{marks}]{{2}}"), F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")).otherwise(p)

    runs = F.regexp_extract_all(s, F.lit(f"[{marks}]+|[^{marks}]+"), F.lit(0))
    neighbours = F.contains(F.translate(s, "".join(_classes()), "\u0301" * len(_classes())), F.lit("\u0301\u0301"))
    return F.when(neighbours, F.array_join(F.transform(runs, run), "")).otherwise(s)


def _hangul(one: Column, other: Column) -> Column:
    """The syllable of lead and vowel, or of such a syllable and a tail, or null."""
    a, b = F.ascii(one), F.ascii(other)
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("long")), 4, "0")), "UTF-16BE")
    lead = a.between(LEAD, LEAD + LEADS - 1) & b.between(VOWEL, VOWEL + VOWELS - 1)
    open_ = a.between(SYLLABLE, SYLLABLE + LEADS * VOWELS * TAILS - 1) & ((a - SYLLABLE) % TAILS == 0) & b.between(TAIL + 1, TAIL + TAILS - 1)
    return F.when(lead, char(F.lit(SYLLABLE) + ((a - LEAD) * VOWELS + b - VOWEL) * TAILS)).when(open_, char(a + b - TAIL))


def _composed(s: Column) -> Column:
    """Each mark (or second half of a pair) joined to the last starter where nothing of its class
    or a higher one stands between them."""
    table, second = _table(_compositions()), f"[{_class_body({p[1] for p in _compositions()})}]"
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(-1).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        def put(k: Column) -> Column:
            known = F.when(c.rlike(second), F.try_element_at(table, F.concat(acc["starter"], c)))
            pair = F.when((acc["starter"] != "") & (acc["last"] < k), F.coalesce(known, _hangul(acc["starter"], c)))
            next_ = lambda made: (
                F.when(made.isNotNull(), F.struct(acc["done"].alias("done"), made.alias("starter"), acc["marks"].alias("marks"), acc["last"].alias("last")))
                .when(k == 0, F.struct(F.concat(acc["done"], acc["starter"], acc["marks"]).alias("done"), c.alias("starter"), F.lit("").alias("marks"), F.lit(-1).alias("last")))
                .otherwise(F.struct(acc["done"].alias("done"), acc["starter"].alias("starter"), F.concat(acc["marks"], c).alias("marks"), k.alias("last")))
            )
            return let(pair, next_)

        return let(_class_of(c), put)

    return F.aggregate(_chars(s), begin, step, lambda acc: F.concat(acc["done"], acc["starter"], acc["marks"]))


def nfkc(s: Column) -> Column:
    """``s`` in compatibility normal form (NFKC). Null stays null, the empty text empty. Characters
    from U+30000 on have no decomposition and stay as they are."""
    return F.when(_holds(s, _changing()), let(let(_decomposed(s), _ordered), lambda d: F.when(d == "", d).otherwise(_composed(d)))).otherwise(s)
