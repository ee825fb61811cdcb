"""Keeping what a person wrote: rules that blank out pasted and generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

# Tags whose content was not written by the user; the last has no stray form.
TAGS = ["system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr", "ide_selection", "user-prompt-submit-hook"]
_S = r"\s\x1c-\x1f"  # white space as Unicode has it, with the four separators that (?U)\s leaves out

# The patterns of the rules, in their order.
TAGGED = rf"(?Uis)<({'|'.join(TAGS)})\b[^>]*>.*?</\1>"
STRAY_TAG = rf"(?Uis)</?({'|'.join(TAGS[:-1])})\b[^>]*>"
FENCE = r"(?s)```.*?```"
OPEN_FENCE = r"(?s)```.*"
PLACEHOLDER = r"(?Ui)\[(?:Pasted text|Image|Screenshot|Attached)[^\]]*\]"
URL = rf"(?U)https?://[^{_S}]+|www\.[^{_S}]+"
PATH = rf"(?U)(?:[~.]?/[^{_S}/、。「」『』()（）\[\]\"'`]+){{2,}}/?"
NOISE = (
    rf"(?U)^[{_S}]*(?:Caveat: The messages below|\[Request interrupted|This session is being continued|<local-command"
    r"|\[(?:INFO|WARN|WARNING|ERROR|DEBUG|STEP|TRACE|OK|NG|FAIL)\]|Traceback \(most recent call last\)|File \")"
)
SLASH_COMMAND = rf"(?U)^/[a-zA-Z][\w:-]*[{_S}]*"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def blank_tags(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, TAGGED, " "), STRAY_TAG, " ")


def blank_fences(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, FENCE, " "), OPEN_FENCE, " ")


def blank_placeholders(s: Column) -> Column:
    return F.regexp_replace(s, PLACEHOLDER, " ")


def blank_urls(s: Column) -> Column:
    return F.regexp_replace(s, URL, " ")


def blank_paths(s: Column) -> Column:
    return F.regexp_replace(s, PATH, " ")


def keep_lines(s: Column, japanese_only: bool = True) -> Column:
    """Without log lines and, if wanted, without lines that hold no Japanese; the rest is
    joined by line feeds."""
    lines = F.split(s, LINE_BREAK, -1)
    if japanese_only:  # the shorter test first
        return F.array_join(F.filter(lines, lambda x: x.rlike(f"[{tables.LINE_JAPANESE}]") & ~x.rlike(NOISE)), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(NOISE))
    # A break at the very end opens no further line.
    ended = F.when(F.element_at(lines, -1) == "", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    return F.array_join(ended, "\n")


def clean_text(s: Column, japanese_only: bool = True) -> Column:
    """All rules in order; null gives the empty text."""
    out = F.coalesce(s, F.lit(""))
    for rule in (blank_tags, blank_fences, blank_placeholders, blank_urls, blank_paths):
        out = rule(out)
    return keep_lines(out, japanese_only)


def strip_slash_command(s: Column) -> Column:
    return F.regexp_replace(s, SLASH_COMMAND, "")


def not_blank(s: Column) -> Column:
    return s.rlike(rf"(?U)[^{_S}]")
