"""Single-file outputs of a ranked, limited list of terms.

Rows come to the driver one by one, in their order; the list is as long as its limit.
"""

from __future__ import annotations

import csv
import json
import plistlib
import shutil
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..operators import candidates as ops
from . import dictionaries

# The columns of the review table.
REVIEW = ["reading", "word", "count", "projects", "kind", "confidence"]


def dictionary_items(terms: DataFrame, hint: str = "") -> DataFrame:
    """word, reading, id and hint (null if there is none) of terms."""
    return terms.withColumns({"id": words.stable_id(F.col("word"), F.col("reading")), "hint": F.lit(hint or None).cast("string")})


def _rows(terms: DataFrame) -> Iterator:
    return terms.toLocalIterator()


def _file(path: str) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    return out


def write_review(terms: DataFrame, path: str) -> int:
    n = 0
    with _file(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerow(REVIEW)
        for n, r in enumerate(_rows(terms.select(*REVIEW)), 1):
            out.writerow(list(r))
    return n


def write_plist(terms: DataFrame, path: str) -> int:
    items = [{"shortcut": r["reading"], "phrase": r["word"]} for r in _rows(terms.select("reading", "word"))]
    with _file(path).open("wb") as f:
        plistlib.dump(items, f, fmt=plistlib.FMT_XML, sort_keys=False)
    return len(items)


def _objects(terms: DataFrame, hint: str) -> list[dict]:
    rows = _rows(dictionary_items(terms, hint).select("word", "reading", "id", "hint"))
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]


def write_items(terms: DataFrame, path: str, hint: str = "") -> int:
    items = _objects(terms, hint)
    _file(path).write_text(json.dumps({"items": items}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return len(items)


def write_items_csv(terms: DataFrame, path: str, hint: str = "") -> int:
    n = 0
    with _file(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        for n, r in enumerate(_rows(terms.select("word", "reading")), 1):
            out.writerow([r["word"], r["reading"], hint])
    return n


def write_all(terms: DataFrame, folder: str, hint: str = "") -> int:
    """All four files; the terms are computed once."""
    kept = terms.cache()
    try:
        n = write_review(kept, f"{folder}/terms.tsv")
        write_plist(kept, f"{folder}/user-dictionary.plist")
        write_items(kept, f"{folder}/user-dictionary.json", hint)
        write_items_csv(kept, f"{folder}/user-dictionary.csv", hint)
    finally:
        kept.unpersist()
    return n


@dataclass(frozen=True)
class MergeResult:
    added: int
    skipped: int
    total: int
    backup: str | None


def merge_into_prefs(spark: SparkSession, terms: DataFrame, path: str, key: str, hint: str = "", backup: bool = True, dry_run: bool = False) -> MergeResult:
    """Append the terms that a preference file's items lack; other keys and the items that are
    there stay as they are. ``terms``: word, reading and ord (their order)."""
    prefs = dictionaries.load_prefs(path)
    existing = dictionaries.items_of(prefs, key)
    old = dictionaries.items_frame(spark, existing)
    new = terms.select("word", "reading", F.lit(hint).alias("hint"), "ord")
    offered = new.count()
    added = [
        {k: v for k, v in r.asDict().items() if v is not None}
        for r in ops.merge(old, new).where("src = 1").orderBy("ord").select("word", "reading", "id", "hint").toLocalIterator()
    ]
    saved = None
    if not dry_run:
        target = _file(path)
        if backup and target.is_file():
            saved = str(target.with_suffix(f"{target.suffix}.bak-{int(time.time())}"))
            shutil.copy2(target, saved)
        prefs[key] = json.dumps({"items": existing + added}, ensure_ascii=False)
        with target.open("wb") as f:
            plistlib.dump(prefs, f, fmt=plistlib.FMT_BINARY)
    return MergeResult(len(added), offered - len(added), len(existing) + len(added), saved)
