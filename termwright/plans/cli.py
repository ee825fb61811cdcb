"""Command line: scan transcripts, rebuild from a reviewed table, merge into a dictionary."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.words import StopWords
from ..operators import candidates as ops
from ..operators import tokens
from ..sources import dictionaries, onepass, transcripts, writers

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termwright", description="Input-method dictionaries from chat transcripts.")
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)

    scan = sub.add_parser("scan", help="mine transcripts and write dictionary files")
    scan.add_argument("--root", required=True, help="folder with projects/*/*.jsonl and history.jsonl")
    for flag in ("--include-assistant", "--include-sidechain", "--no-history", "--keep-ascii-lines", "--no-ascii", "--no-japanese", "--exclude-existing"):
        scan.add_argument(flag, action="store_true")
    for flag, default in (("--min-count", 3), ("--min-projects", 1), ("--min-length", 3), ("--max-length", 24), ("--max-span", 3), ("--limit", 500)):
        scan.add_argument(flag, type=int, default=default)
    scan.add_argument("--ascii-reading", choices=["lower", "letters", "both"], default="both")
    scan.add_argument("--progress", action="store_true", help="tell how many tasks of the reading pass are done")
    scan.add_argument("--report-unreadable", action="store_true", help="name transcripts that can't be read, for one more pass over the lines")
    scan.add_argument("--stop-words", help="text file of more stop words")
    scan.add_argument("--lexicon", help="Parquet table of surface, latin and cost")
    scan.add_argument("--replacements", help="text-replacement database, for --exclude-existing")
    scan.add_argument("--replacements-export", help="exported defaults, used if the database can't be read")
    scan.add_argument("--prefs", help="preference file, for --exclude-existing")
    scan.add_argument("--prefs-key")

    build = sub.add_parser("build", help="write dictionary files from a reviewed table")
    build.add_argument("tsv")
    for cmd in (scan, build):
        cmd.add_argument("-o", "--out-dir", default="dict-out")
        cmd.add_argument("--hint", default="")

    merge = sub.add_parser("merge", help="append terms to the items of a preference file")
    given = merge.add_mutually_exclusive_group(required=True)
    given.add_argument("--json")
    given.add_argument("--tsv")
    merge.add_argument("--prefs", required=True)
    merge.add_argument("--prefs-key", required=True)
    merge.add_argument("--hint", default="")
    merge.add_argument("--only-here", action="store_true", help="confirm that the dictionary isn't fed from the system's own")
    merge.add_argument("--no-backup", action="store_true")
    merge.add_argument("--dry-run", action="store_true")
    return p


def scan(spark: SparkSession, args) -> int:
    said = transcripts.read_utterances(spark, args.root, args.include_assistant, args.include_sidechain, not args.no_history, not args.keep_ascii_lines)
    kept = onepass.stored(spark, said, _tell if args.progress else None)
    try:
        return _mine(spark, args, kept.utterances, kept.metrics)
    finally:
        kept.drop()


def _tell(done: int, tasks: int) -> None:
    print(f"reading: {done:,} of {tasks:,} tasks", file=sys.stderr)


def _mine(spark: SparkSession, args, said, m: dict[str, int]) -> int:
    print(f"read: {m['utterances']:,} utterances, {m['characters']:,} characters, {m['projects']:,} projects", file=sys.stderr)
    if args.report_unreadable:
        for f in transcripts.file_report(spark, f"{args.root}/projects/*/*.jsonl").where("reason IS NOT NULL").toLocalIterator():
            print(f"warning: {f['path']}: {f['reason']}", file=sys.stderr)
    if not m["utterances"]:
        print(f"warning: no transcripts below {args.root}", file=sys.stderr)
    cfg = ops.ExtractConfig(
        args.min_count, args.min_projects, args.min_length, args.max_length, args.max_span, not args.no_ascii, not args.no_japanese,
        ascii_reading=args.ascii_reading, stop=StopWords.read(spark, args.stop_words) if args.stop_words else StopWords(),
    )
    if args.lexicon:
        cut = tokens.with_lexicon(said, spark.read.parquet(args.lexicon))
    else:
        cut = said if args.no_japanese else tokens.with_script_runs(said)
    found = ops.drop_subsumed(ops.candidates(cut, cfg))
    if args.exclude_existing and not (args.prefs or args.replacements):
        print("error: --exclude-existing needs --prefs or --replacements: without them nothing would be excluded", file=sys.stderr)
        return 1
    if args.exclude_existing:
        known = spark.createDataFrame([], dictionaries.PAIR)
        if args.prefs:
            known = known.union(dictionaries.registered_in_prefs(spark, args.prefs, args.prefs_key))
        if args.replacements:
            known = known.union(dictionaries.registered_on_system(spark, args.replacements, args.replacements_export))
        found = ops.exclude_registered(found, known.distinct())
    n = writers.write_all(ops.top(found, args.limit), args.out_dir, args.hint)
    print(f"{n:,} terms in {args.out_dir}")
    return 0


def build(spark: SparkSession, args) -> int:
    rows = _reviewed(spark, args.tsv)
    if rows.isEmpty():
        print(f"error: no valid row in {args.tsv}", file=sys.stderr)
        return 1
    n = writers.write_all(rows.withColumns({"projects": F.lit(0), "confidence": F.lit("ok")}).orderBy("ord"), args.out_dir, args.hint)
    print(f"{n:,} terms in {args.out_dir}")
    return 0


def _reviewed(spark: SparkSession, path: str):
    return dictionaries.read_review(spark, path).withColumn("ord", F.monotonically_increasing_id())


def merge(spark: SparkSession, args) -> int:
    terms = _reviewed(spark, args.tsv) if args.tsv else dictionaries.read_items(spark, args.json)
    if terms.isEmpty():
        print("error: no terms", file=sys.stderr)
        return 1
    if not args.only_here:
        print("The dictionary may follow the system's own; terms would then be there twice. Confirm with --only-here.", file=sys.stderr)
        return 1
    done = writers.merge_into_prefs(spark, terms, args.prefs, args.prefs_key, args.hint, not args.no_backup, args.dry_run)
    print(("[dry run] " if args.dry_run else "") + f"added {done.added}, skipped {done.skipped}, total {done.total}")
    if done.backup:
        print(f"backup: {Path(done.backup)}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("termwright").getOrCreate()
    try:
        return {"scan": scan, "build": build, "merge": merge}[args.command](spark, args)
    except KeyboardInterrupt:
        return 130
