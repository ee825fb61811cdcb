"""Registered queries: each operator over the driver's tables or over stated example rows, with
the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, kana, tables, unicode, words
from ..functions.base import let, literal_map, quoted
from ..operators import candidates as ops
from ..operators import mining, segments, state, tokens
from ..operators.joins import spread
from ..sources import dictionaries, onepass, store, transcripts, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts take long: over all cores, however few row groups its files have."""
    return spread(table(spark, sf_dir, name))


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values(data: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in data) + f") AS t({names})"


# ---- utterances of the driver's tables -------------------------------------------------


def utterances(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    """conversations (project: the conversation) and documents (project: the source)."""
    talk = table(spark, sf_dir, "conversations").where(F.col("role").isin(*([role] if role else ["user", "assistant"])))
    talk = talk.select(F.struct(F.lit(0).alias("source"), F.col("conv_id").alias("a"), F.col("turn").alias("b")).alias("utt"), F.col("conv_id").cast("string").alias("project"), "role", "text")
    docs = table(spark, sf_dir, "documents").select(F.struct(F.lit(1).alias("source"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("utt"), F.col("source").alias("project"), F.lit("user").alias("role"), "text")
    return talk.unionByName(docs)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = text_table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return said.select(F.struct(F.col("conv_id").alias("a"), F.col("turn").alias("b")).alias("utt"), F.col("conv_id").cast("string").alias("project"), "role", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("utt"), F.col("source").alias("project"), F.lit("user").alias("role"), "text")


# ---- table texts in other scripts ----------------------------------------------------------------
# The driver's texts hold no Japanese. Their letters are replaced one by one, by the same expression in Spark and SQL, so that
# the Japanese operators run over whole tables.

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_GLYPHS = "ア幕協動エ編画ハイ次奏資料ンオ曲字リスのを集見確設定"


def japanese(text) -> Column:
    return F.translate(F.lower(text), _LETTERS, _GLYPHS)


def japanese_sql(text: str) -> str:
    return f"translate(lower({text}), '{_LETTERS}', '{_GLYPHS}')"


def words_of(df: DataFrame) -> DataFrame:
    """w: the word runs of ``text``, as often as they stand."""
    return df.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w"))


def counted_words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """w and n of a table's texts."""
    return words_of(text_table(spark, sf_dir, name)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def counted_words_sql(name: str) -> str:
    return f"(SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS w FROM {name}) GROUP BY w)"


STOP_EXACT = ", ".join(quoted(w) for w in sorted(tables.COMMON_JAPANESE | tables.AFFIXES))
STOP_LOWER = ", ".join(quoted(w) for w in sorted(tables.COMMON_ENGLISH))
IS_STOP = f"(w IN ({STOP_EXACT}) OR lower(w) IN ({STOP_LOWER}))"
RUN = r"[\p{L}\p{M}\p{N}_]+"
ASCII = r"[A-Za-z][A-Za-z0-9_+#.\-]*"
CANONICAL = values(list(tables.CANONICAL.items()), "lower, known").replace("AS t(", "AS canonical(")

#: Word runs of a table's texts with their order; ASCII chunks are such runs here, since the driver's texts
#: hold no Japanese.
_TOKENS = r"""
    SELECT project, a, b, u.p AS pos, u.w AS w
    FROM (SELECT project, a, b, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') AS ws FROM said),
         LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) AS u
"""
_SAID = {
    "conversations": "SELECT CAST(conv_id AS VARCHAR) AS project, conv_id AS a, turn AS b, text FROM conversations WHERE role IN ('user', 'assistant')",
    "documents": "SELECT source AS project, doc_id AS a, 0 AS b, text FROM documents",
}


def _forms_sql(source: str) -> str:
    return rf"""
    WITH said AS ({_SAID[source]}), toks AS ({_TOKENS}),
    forms AS (
        SELECT lower(w) AS lower, w AS form, project, count(*) AS n, min({{'a': a, 'b': b, 'p': pos}}) AS first_seq
        FROM toks
        WHERE regexp_full_match(w, '{ASCII}') AND length(w) BETWEEN 3 AND 24 AND w <> lower(w) AND NOT {IS_STOP}
        GROUP BY ALL
    ), by_form AS (
        SELECT lower, form, sum(n) AS n, min(first_seq) AS first_seq FROM forms GROUP BY ALL
    ), usual AS (
        SELECT lower, form, row_number() OVER (PARTITION BY lower ORDER BY n * CASE WHEN regexp_matches(form, '^.+[A-Z]') THEN 1.5 ELSE 1.0 END DESC, n DESC, first_seq) AS k,
               sum(n) OVER (PARTITION BY lower) AS cnt, min(first_seq) OVER (PARTITION BY lower) AS first_seq
        FROM by_form
    ), chosen AS (
        SELECT u.lower, coalesce(canonical.known, form) AS word, CAST(cnt AS BIGINT) AS cnt, p.projects, u.first_seq
        FROM usual u JOIN (SELECT lower, count(DISTINCT project) AS projects FROM forms GROUP BY 1) p ON p.lower = u.lower
        LEFT JOIN {CANONICAL} ON canonical.lower = u.lower WHERE k = 1
    )"""


_LETTER_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in tables.LETTERS.items()) + "}"
_ACRONYM = rf"""CASE WHEN regexp_full_match(word, '[A-Z0-9]{{2,6}}') AND regexp_matches(word, '[A-Z]')
    THEN array_to_string(list_transform(string_split(lower(word), ''), lambda c: {_LETTER_MAP}[c]), '') END"""


def _candidates_sql(source: str) -> str:
    return (
        _forms_sql(source)
        + rf""", acro AS (SELECT *, {_ACRONYM} AS letters FROM chosen), read AS (
        SELECT word, lower AS reading, 0 AS reading_ord, cnt, projects, first_seq FROM acro
        UNION ALL SELECT word, letters, 1, cnt, projects, first_seq FROM acro WHERE letters IS NOT NULL AND letters <> lower
    ), cands AS (
        SELECT *, cnt * (1.0::DOUBLE + 0.25::DOUBLE * greatest(0, length(word) - 2)) * (1.0::DOUBLE + 0.15::DOUBLE * (projects - 1)) * ln(1.0::DOUBLE + cnt) AS score
        FROM read WHERE cnt >= 3 AND projects >= 1
    )"""
    )


_KEPT = ", kept AS (SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM cands l WHERE length(l.word) > length(c.word) AND l.cnt >= c.cnt AND contains(l.word, c.word)))"

LOWER_ONLY = ops.ExtractConfig(japanese_terms=False)


def _ascii(spark: SparkSession, sf_dir: str, source: Callable = conversations) -> DataFrame:
    return ops.candidates(source(spark, sf_dir), LOWER_ONLY)


# ---- scans ------------------------------------------------------------------------------


@query(
    "utterance_union",
    """SELECT 0 AS source, conv_id AS a, turn AS b, CAST(conv_id AS VARCHAR) AS project, role, text FROM conversations WHERE role IN ('user', 'assistant')
    UNION ALL SELECT 1, doc_id, 0, source, 'user', text FROM documents""",
)
def utterance_union(spark, sf_dir):
    return utterances(spark, sf_dir).select("utt.source", "utt.a", "utt.b", "project", "role", "text")


@query(
    "scan_metrics",
    """SELECT count(*) AS utterances, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT project) AS projects FROM (
        SELECT CAST(conv_id AS VARCHAR) AS project, text FROM conversations WHERE role IN ('user', 'assistant')
        UNION ALL SELECT source, text FROM documents)""",
)
def scan_metrics(spark, sf_dir):
    return transcripts.metrics(utterances(spark, sf_dir))


@query(
    "scan_once",
    """WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS project, text FROM conversations WHERE role IN ('user', 'assistant')
        UNION ALL SELECT source, text FROM documents),
    t AS (SELECT count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS c, count(DISTINCT project) AS p FROM u)
    SELECT project, count(*) AS utterances, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters,
        any_value(t.n) AS all_utterances, any_value(t.c) AS all_characters, any_value(t.p) AS all_projects FROM u, t GROUP BY project""",
)
def scan_once(spark, sf_dir):
    """The projects of the stored utterances, beside the counts that were observed while these were stored."""
    kept = onepass.stored(spark, utterances(spark, sf_dir))
    by_project = kept.utterances.groupBy("project").agg(F.count(F.lit(1)).alias("utterances"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters"))
    return by_project.withColumns({f"all_{k}": F.lit(v).cast("long") for k, v in kept.metrics.items()})


LINES = [
    (1, '{"type":"user","cwd":"/w/a","message":{"role":"user","content":"ホルン協奏曲を聴く"}}'),
    (2, '{"type":"user","message":{"content":[{"type":"tool_result","content":"x"},{"type":"text","text":"字幕ファイル"},{"type":"text","text":null},7]}}'),
    (3, '{"type":"assistant","cwd":"/w/a","message":{"content":"はい"}}'),
    (4, '{"type":"user","isSidechain":true,"message":{"content":"side"}}'),
    (5, '{"type":"user","isMeta":"false","message":{"content":"meta"}}'),
    (6, '{"type":"user","isMeta":0,"isSidechain":"","cwd":"","message":{"content":"kept"}}'),
    (7, '{"type":"user","isMeta":[],"message":{"content":"also kept"}}'),
    (8, '{"type":"user","isMeta":{"a":1},"message":{"content":"meta"}}'),
    (9, '{"type":"user","message":"no object"}'),
    (10, '[{"type":"user"}]'),
    (11, "not json type"),
    (12, '{"type":"user","isMeta":null,"message":{"content":5}}'),
    (13, '{"type":"summary","message":{"content":"no"}}'),
]


_BLOCKS_SQL = f"""WITH r AS (SELECT n, CAST(v AS JSON) AS j FROM {values(LINES, 'n, v')} WHERE json_valid(v) AND contains(v, '"type"')),
    k AS (SELECT n, j, j->'$.message.content' AS c FROM r WHERE json_type(j) = 'OBJECT' AND j->>'$.type' = 'user' AND json_type(j->'$.message') = 'OBJECT'
        AND coalesce(j->>'$.isMeta', '') IN ('', '0', 'false', '[]', '{{}}') AND NOT coalesce(json_type(j->'$.isMeta') = 'VARCHAR' AND j->>'$.isMeta' <> '', false)
        AND coalesce(j->>'$.isSidechain', '') IN ('', '0', 'false', '[]', '{{}}')),
    b AS (SELECT n, j, unnest(CAST(c AS JSON[])) AS x FROM k WHERE json_type(c) = 'ARRAY')
    SELECT n, coalesce(nullif(j->>'$.cwd', ''), 'slug') AS project, 'user' AS role, c->>'$' AS text FROM k WHERE json_type(c) = 'VARCHAR'
    UNION ALL SELECT n, coalesce(nullif(j->>'$.cwd', ''), 'slug'), 'user', coalesce(x->>'$.text', '') FROM b WHERE json_type(x) = 'OBJECT' AND x->>'$.type' = 'text'"""


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n and value: each turn as a record, with its text as a string where it is one line and as blocks of its lines otherwise, and as a
    side chain where the conversation's first turn isn't from a user."""
    said = table(spark, sf_dir, "conversations")
    lines = F.split("text", "\n")
    common = [F.col("role").alias("type"), F.concat(F.lit("/w/"), F.col("conv_id").cast("string")).alias("cwd"), (F.col("turn") < 0).alias("isMeta"), F.when(F.col("role") == "user", "").otherwise("x").alias("isSidechain")]
    block = F.transform(lines, lambda t: F.struct(F.lit("text").alias("type"), t.alias("text")))
    tool = F.array(F.struct(F.lit("tool_result").alias("type"), F.lit("left out").alias("text")))
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("n")
    one = said.where(F.size(lines) == 1).select(key, F.to_json(F.struct(*common, F.struct(F.col("text").alias("content")).alias("message"))).alias("value"))
    more = said.where(F.size(lines) > 1).select(key, F.to_json(F.struct(*common, F.struct(F.concat(tool, block).alias("content")).alias("message"))).alias("value"))
    return one.unionByName(more)


@query(
    "json_blocks",
    f"""SELECT CAST(n AS BIGINT) AS n, project, role, text FROM ({_BLOCKS_SQL})
    UNION ALL SELECT conv_id * 1000 + turn, '/w/' || conv_id, 'user', unnest(string_split(text, chr(10))) FROM conversations WHERE role = 'user'""",
)
def json_blocks(spark, sf_dir):
    given = rows(spark, LINES, "n long, value string").unionByName(transcript_lines(spark, sf_dir))
    lines = given.select("value", F.lit("slug").alias("slug"), F.struct("n").alias("utt"))
    return transcripts.parse_transcript(lines).select("utt.n", "project", "role", "text")


HISTORY = [(1, '{"display":"/luatex 演奏会プログラムを作成","project":"/w/b"}'), (2, '{"display":"と/or"}'), (3, '{"project":"x"}'), (4, "broken"), (5, '{"display":"/cmd:sub-x","project":""}')]


@query(
    "history_scan",
    rf"""SELECT n, project, role, regexp_replace(display, '^/[a-zA-Z][\p{{L}}\p{{M}}\p{{N}}_:-]*[\s\p{{Z}}]*', '') AS text FROM (
        SELECT CAST(n AS BIGINT) AS n, coalesce(nullif(CAST(v AS JSON)->>'$.project', ''), '?') AS project, 'user' AS role, coalesce(CAST(v AS JSON)->>'$.display', '') AS display FROM (SELECT * FROM {values(HISTORY, 'n, v')} WHERE json_valid(v))
        UNION ALL SELECT conv_id * 1000 + turn, CASE WHEN turn = 0 THEN '?' ELSE '/w/' || conv_id END, 'user', '/' || role || ':run ' || text FROM conversations)""",
)
def history_scan(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    project = F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit("/w/"), F.col("conv_id").cast("string")))
    display = F.concat(F.lit("/"), "role", F.lit(":run "), "text")
    told = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.to_json(F.struct(display.alias("display"), project.alias("project"))).alias("value"))
    lines = rows(spark, HISTORY, "n long, value string").unionByName(told).select("value", F.struct("n").alias("utt"))
    return transcripts.parse_history(lines).select("utt.n", "project", "role", "text")


# ---- cleaning -----------------------------------------------------------------------------

TEXTS = [
    (1, "<system-reminder>無視\nされる</system-reminder>この機能を実装してください。"),
    (2, "前<COMMAND-NAME x='1'>a</command-name>後<command-args>残り</ide_selection>"),
    (3, "始め```python\nx=1 # 日本語\n```終わり```閉じない\n行"),
    (4, "[Pasted text #1 +92 lines]エラーを直して。[image 3] [Attached: a.png]"),
    (5, "https://example.com/日本 続き www.x.jp/a　日本語"),
    (6, "/Users/me/Documents/作業資料/for_Download/a.mp4 を見て。 and/or/xor 2024/01/02 を ~/a/b/ ./c/d"),
    (7, "[INFO] 起動完了\nTraceback (most recent call last)\n  File \"/x\", 行\n日本語の行\nascii line\r\n別の行\x0b最後"),
    (8, "Caveat: The messages below 日本\n[Request interrupted by 日本\nThis session is being continued 日\n<local-command 日\n[FAIL] 日"),
    (9, ""),
    (10, "ascii only\nsecond\n"),
]
#: Each document as a prompt might hold it: tags, a fence, a placeholder, a link, a path, a log line, and Japanese prose.
_PROMPT = ["<system-reminder>", "{text}", "</system-reminder>", "{ja}", "```", "{text}", "``` [Image 1] https://example.com/", "{lang}", " ~/", "{lang}", "/", "{lang}", "\n[INFO] ", "{ja}", "\n", "{text}", "\n", "{ja}", "</ide_selection>\r\n", "{ja}"]
_JA_TEXT = japanese_sql("coalesce(text, '')")
_PROMPT_SQL = " || ".join({"{text}": "coalesce(text, '')", "{ja}": _JA_TEXT, "{lang}": "coalesce(lang, '')"}.get(p) or "'" + p.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'" for p in _PROMPT)
_TEXTS = f"(SELECT CAST(n AS BIGINT) AS n, s FROM {values(TEXTS, 'n, s')} UNION ALL SELECT 1000 + doc_id, {_PROMPT_SQL} FROM documents) AS texts"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))

    def prompt(ja: Column) -> Column:  # the Japanese text stands there thrice, and is made once
        part = {"{text}": text, "{ja}": ja, "{lang}": F.coalesce("lang", F.lit(""))}
        return F.concat(*[part[p] if p in part else F.lit(p) for p in _PROMPT])

    docs = text_table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("n"), let(japanese(text), prompt).alias("s"))
    return rows(spark, TEXTS, "n long, s string").unionByName(docs)


def _nested(expression: str, steps: list[tuple[str, str]], by: str = " ") -> str:
    for pattern, flags in steps:
        expression = f"regexp_replace({expression}, {quoted(pattern)}, '{by}', '{flags}')"
    return expression


_TAG_STEPS = [(rf"<{t}\b[^>]*>.*?</{t}>", "gis") for t in cleaning.TAGS] + [(rf"</?({'|'.join(cleaning.TAGS[:-1])})\b[^>]*>", "gis")]
_FENCE_STEPS = [("```.*?```", "gs"), ("```.*", "gs")]
_PLACEHOLDER_STEPS = [(r"\[(?:Pasted text|Image|Screenshot|Attached)[^\]]*\]", "gi")]
_URL_STEPS = [(r"https?://[^\s\p{Z}\x0b]+|www\.[^\s\p{Z}\x0b]+", "g")]
_PATH_STEPS = [(r"""(?:[~.]?/[^\s\p{Z}\x0b/、。「」『』()（）\[\]"'`]+){2,}/?""", "g")]
_NOISE_SQL = r"""^\s*(?:Caveat: The messages below|\[Request interrupted|This session is being continued|<local-command|\[(?:INFO|WARN|WARNING|ERROR|DEBUG|STEP|TRACE|OK|NG|FAIL)\]|Traceback \(most recent call last\)|File ")"""


def _lines_sql(expression: str) -> str:
    return f"""array_to_string(list_filter(regexp_split_to_array({expression}, '\\r\\n|[\\n\\r\\x0b\\x0c]'),
        lambda x: NOT regexp_matches(x, {quoted(_NOISE_SQL)}) AND regexp_matches(x, '[{tables.LINE_JAPANESE}]')), chr(10))"""


for _name, _rule, _steps in (
    ("clean_tags", cleaning.blank_tags, _TAG_STEPS),
    ("clean_fences", cleaning.blank_fences, _FENCE_STEPS),
    ("clean_placeholders", cleaning.blank_placeholders, _PLACEHOLDER_STEPS),
    ("clean_urls", cleaning.blank_urls, _URL_STEPS),
):
    query(_name, f"SELECT n, {_nested('s', _steps)} AS text FROM {_TEXTS}")(lambda spark, sf_dir, rule=_rule: _texts(spark, sf_dir).select("n", rule(F.col("s")).alias("text")))


@query("clean_paths", f"SELECT n, {_nested('s', _PATH_STEPS)} AS text FROM (SELECT CAST(n AS BIGINT) AS n, s FROM {values(TEXTS, 'n, s')} UNION ALL SELECT page_id + 100, html FROM pages)")
def clean_paths(spark, sf_dir):
    both = rows(spark, TEXTS, "n long, s string").unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("n"), F.col("html").alias("s")))
    return both.select("n", cleaning.blank_paths(F.col("s")).alias("text"))


@query("clean_lines", f"SELECT n, {_lines_sql('s')} AS text FROM {_TEXTS}")
def clean_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("n", cleaning.keep_lines(F.col("s")).alias("text"))


@query("clean_text", f"SELECT n, {_lines_sql(_nested('s', _TAG_STEPS + _FENCE_STEPS + _PLACEHOLDER_STEPS + _URL_STEPS + _PATH_STEPS))} AS text FROM {_TEXTS}")
def clean_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("n", cleaning.clean_text(F.col("s")).alias("text"))


COMMANDS = [(1, "/luatex 演奏会プログラムを作成"), (2, "/cmd演奏会"), (3, "/a:b-c  x"), (4, "no /x command"), (5, "/1x")]


@query(
    "slash_strip",
    rf"""SELECT CAST(n AS BIGINT) AS n, regexp_replace(s, '^/[a-zA-Z][\p{{L}}\p{{M}}\p{{N}}_:-]*[\s\p{{Z}}]*', '') AS text FROM (
        SELECT n, s FROM {values(COMMANDS, 'n, s')} UNION ALL SELECT 1000 + conv_id * 1000 + turn, '/' || role || chr(9) || text FROM conversations)""",
)
def slash_strip(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.concat(F.lit("/"), "role", F.lit("\t"), "text").alias("s"))
    return rows(spark, COMMANDS, "n long, s string").unionByName(said).select("n", cleaning.strip_slash_command(F.col("s")).alias("text"))


@query("nonblank_texts", f"SELECT 'said' AS kind, conv_id * 1000 + turn AS n FROM conversations WHERE trim(text, E' \t\n\r') <> '' UNION ALL SELECT 'gaps', doc_id FROM documents WHERE regexp_matches(text, '[^\\p{{L}} ] *[^\\p{{L}} ] ')")
def nonblank_texts(spark, sf_dir):
    """Turns that aren't blank, and documents that hold something else than letters and blanks between two of these."""
    said = table(spark, sf_dir, "conversations").where(cleaning.not_blank(F.col("text"))).select(F.lit("said").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    gaps = table(spark, sf_dir, "documents").where(cleaning.not_blank(F.regexp_extract("text", r"[^\p{L} ] *[^\p{L} ] ", 0))).select(F.lit("gaps"), "doc_id")
    return said.union(gaps)


# ---- characters and readings ----------------------------------------------------------------

WORDS = ["チャプター", "チャプタ名", "字幕ファイル", "PySide6", "6PySide", "ひらがな", "ーー", "々", "ｶﾅ", "・", "C++", "node.js", "Ouréaux", "𠮷野", "行なっ", "URL", "MP3", "A", "LuaTeX", "PDF", "設定", "The", "的"]
_WORD_VALUES = values([(w,) for w in WORDS], "w")
_KIND = f"""CASE WHEN regexp_full_match(w, '[{tables.KATAKANA}]+') THEN 'katakana' WHEN regexp_full_match(w, '[{tables.HIRAGANA}ー]+') THEN 'hiragana'
    WHEN regexp_matches(w, '[{tables.KANJI}]') THEN 'kanji' WHEN regexp_full_match(w, '{ASCII}') THEN 'ascii' ELSE 'other' END"""


def _all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those above, the words of the documents, and these in Japanese glyphs."""
    listed = rows(spark, [(w,) for w in WORDS], "w string")
    docs = text_table(spark, sf_dir, "documents")
    runs = words_of(docs).distinct()
    return listed.unionByName(runs).unionByName(words_of(docs.select(japanese("text").alias("text"))).distinct()).distinct()


_ALL_WORDS = rf"(SELECT w FROM {_WORD_VALUES} UNION SELECT unnest(regexp_extract_all(text, '{RUN}')) FROM documents UNION SELECT unnest(regexp_extract_all({japanese_sql('text')}, '{RUN}')) FROM documents)"


@query(
    "char_classes",
    f"""SELECT w AS word, {_KIND} AS kind, regexp_matches(w, '[{tables.HIRAGANA}{tables.KATAKANA}{tables.KANJI}]') AS japanese,
    regexp_full_match(w, '[{tables.HIRAGANA}{tables.KATAKANA}ー]+') AS kana, regexp_full_match(w, '[{tables.KANJI}]+') AS kanji_only FROM {_ALL_WORDS}""",
)
def char_classes(spark, sf_dir):
    w = F.col("w")
    return _all_words(spark, sf_dir).select(w.alias("word"), kana.classify(w).alias("kind"), kana.has_japanese(w).alias("japanese"), kana.is_kana(w).alias("kana"), kana.is_kanji(w).alias("kanji_only"))


@query("kana_convert", f"SELECT w AS word, translate(w, {quoted(kana._KATAKANA)}, {quoted(kana._HIRAGANA)}) AS hiragana, translate(w, {quoted(kana._HIRAGANA)}, {quoted(kana._KATAKANA)}) AS katakana FROM {_ALL_WORDS}")
def kana_convert(spark, sf_dir):
    w = F.col("w")
    return _all_words(spark, sf_dir).select(w.alias("word"), kana.katakana_to_hiragana(w).alias("hiragana"), kana.hiragana_to_katakana(w).alias("katakana"))


#: Letters of the words of the documents, each as a spelling that isn't in compatibility normal form, and that form.
COMPATIBLE = {
    "a": ("ｶﾞ", "ガ"), "b": ("ﾊﾟ", "パ"), "c": ("㍻", "平成"), "d": ("①", "1"), "e": ("e\u0301", "é"), "f": ("ﬁ", "fi"), "g": ("\u1100\u1161", "가"),
    "h": ("ａ", "a"), "i": ("Ⅳ", "IV"), "j": ("㌔", "キロ"), "k": ("ｦ", "ヲ"), "l": ("q\u0307\u0323", "q\u0323\u0307"), "m": ("\u1112\u1161\u11ab", "한"),
    "n": ("か\u3099", "が"), "o": ("\u212b", "\u00c5"), "p": ("\uf900", "\u8c48"), "q": ("½", "1\u20442"), "r": ("ſ", "s"), "s": ("㈱", "(株)"),
    "t": ("\u1e9b\u0323", "\u1e69"), "u": ("ｰ", "ー"), "v": ("²", "2"), "w": ("％", "%"), "x": ("㎏", "kg"), "y": ("…", "..."), "z": ("\U0002f800", "\u4e3d"),
}
_COMPATIBLE_SQL = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, (_, v) in COMPATIBLE.items()) + "}"


@query(
    "nfkc_words",
    f"""SELECT w AS word, f AS folded, translate(f, {quoted(kana._KATAKANA)}, {quoted(kana._HIRAGANA)}) AS reading
    FROM (SELECT w, array_to_string(list_transform(string_split(lower(w), ''), lambda c: coalesce({_COMPATIBLE_SQL}[c], c)), '') AS f
    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{RUN}')) AS w FROM documents))""",
)
def nfkc_words(spark, sf_dir):
    table_of = literal_map({k: v for k, (v, _) in COMPATIBLE.items()})
    spelled = F.array_join(F.transform(F.regexp_extract_all(F.lower("w"), F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table_of, c), c)), "")
    found = words_of(text_table(spark, sf_dir, "documents")).distinct().withColumn("s", spelled)
    return found.select(F.col("w").alias("word"), unicode.nfkc(F.col("s")).alias("folded"), kana.normalise_reading(F.col("s")).alias("reading"))


ROMAJI = ["kyousou", "gakushuu", "keitarou", "shiryou", "gasshuku", "kinyuu", "hon", "sesshon", "okona~tsu", "hidzuke", "2rén", "", "matcha", "n'o", "kon'ya", "hi-ro", "ＴＯＫＹＯ", "x", "tti", "nn", "nna", "dji", "vaiorin", "wha", "l"]
_SYLLABLES = values(list((tables.romaji_table() | {"'": ""}).items()), "k, v").replace("AS t(", "AS syllables(")


@query(
    "romaji_hiragana",
    rf"""WITH RECURSIVE inputs AS (
        SELECT s, replace(replace(lower(translate(s, {quoted(kana._WIDE)}, {quoted(kana._NARROW)})), '’', ''''), '-', '') AS t FROM (
            SELECT s FROM {values([(s,) for s in ROMAJI], 's')} UNION SELECT lower(w) FROM {counted_words_sql('conversations')})
    ), step(s, t, done, out) AS (
        SELECT s, t, 0, '' FROM inputs
        UNION ALL
        SELECT s, t, done + least_size, out || piece FROM (
            SELECT s, t, done, out, CASE
                WHEN substr(t, done + 1, 1) = '''' THEN {{'n': 1, 'p': ''}}
                WHEN substr(t, done + 1, 1) = 'n' AND NOT regexp_matches(substr(t, done + 2, 1), '^[aeiouy]$') THEN {{'n': 1, 'p': 'ん'}}
                WHEN regexp_matches(substr(t, done + 1, 1), '^[^aeioun]$') AND substr(t, done + 2, 1) = substr(t, done + 1, 1) THEN {{'n': 1, 'p': 'っ'}}
                WHEN substr(t, done + 1, 3) = 'tch' THEN {{'n': 1, 'p': 'っ'}}
                ELSE (SELECT {{'n': length(k), 'p': v}} FROM {_SYLLABLES} WHERE substr(t, done + 1, length(k)) = k AND k <> '''' ORDER BY length(k) DESC LIMIT 1) END AS x
            FROM step WHERE done < length(t)), LATERAL (SELECT x.n AS least_size, x.p AS piece) WHERE x IS NOT NULL
    )
    SELECT inputs.s AS romaji, max(CASE WHEN inputs.s <> '' AND done = length(inputs.t) THEN out END) AS hiragana FROM inputs LEFT JOIN step ON step.s = inputs.s GROUP BY inputs.s""",
)
def romaji_hiragana(spark, sf_dir):
    said = counted_words(spark, sf_dir, "conversations").select(F.lower("w").alias("s"))
    return rows(spark, [(s,) for s in ROMAJI], "s string").unionByName(said).distinct().select(F.col("s").alias("romaji"), kana.romaji_to_hiragana(F.col("s")).alias("hiragana"))


@query("acronym_reading", f"SELECT word, {_ACRONYM} AS reading FROM (SELECT w AS word FROM {_ALL_WORDS})")
def acronym_reading(spark, sf_dir):
    return _all_words(spark, sf_dir).select(F.col("w").alias("word"), kana.acronym_reading(F.col("w")).alias("reading"))


@query("stopword_filter", f"SELECT w AS word FROM {_ALL_WORDS} WHERE NOT {IS_STOP}")
def stopword_filter(spark, sf_dir):
    return words.drop_stop_words(_all_words(spark, sf_dir).withColumnRenamed("w", "word"), words.StopWords())


# ---- ASCII terms ------------------------------------------------------------------------------


@query("ascii_forms", _forms_sql("documents") + " SELECT lower, form, project, n FROM forms")
def ascii_forms(spark, sf_dir):
    return ops.ascii_forms_of(documents(spark, sf_dir), LOWER_ONLY).select("lower", "form", "project", "n")


@query("ascii_forms_of_tokens", _forms_sql("conversations") + " SELECT lower, form, project, n FROM forms")
def ascii_forms_of_tokens(spark, sf_dir):
    chunk_rows = tokens.exploded_chunks(tokens.with_script_runs(conversations(spark, sf_dir)))
    return ops.ascii_forms(chunk_rows, LOWER_ONLY).select("lower", "form", "project", "n")


for _source in ("documents", "conversations"):

    @query(f"ascii_canonical_{_source}", _forms_sql(_source) + " SELECT lower, word, cnt AS n, projects FROM chosen")
    def ascii_canonical(spark, sf_dir, source=_source):
        said = {"documents": documents, "conversations": conversations}[source](spark, sf_dir)
        forms = ops.ascii_forms_of(said, LOWER_ONLY)
        return ops.canonical_forms(forms).select("lower", "word", F.col("count").alias("n"), "projects")


@query("ascii_readings", _candidates_sql("conversations") + " SELECT word, reading, reading_ord, cnt AS n, projects FROM read")
def ascii_readings(spark, sf_dir):
    forms = ops.ascii_forms_of(conversations(spark, sf_dir), LOWER_ONLY)
    return ops.ascii_readings(ops.canonical_forms(forms)).select("word", "reading", "reading_ord", F.col("count").alias("n"), "projects")


for _mode, _reading in (("lower", "lower"), ("letters", "coalesce(letters, lower)")):

    @query(f"ascii_readings_{_mode}", _forms_sql("documents") + f" SELECT word, {_reading} AS reading, cnt AS n FROM (SELECT *, {_ACRONYM} AS letters FROM chosen)")
    def ascii_readings_in(spark, sf_dir, mode=_mode):
        forms = ops.ascii_forms_of(documents(spark, sf_dir), LOWER_ONLY)
        return ops.ascii_readings(ops.canonical_forms(forms), mode).select("word", "reading", F.col("count").alias("n"))


CASED = [("p1", "Fooapp", 5), ("p1", "FooApp", 4), ("p2", "Barapp", 6), ("p2", "BarApp", 4), ("p1", "Luatex", 6), ("p3", "LuaTeX", 4), ("p1", "Github", 9), ("p1", "SRT", 8)]


@query(
    "casing_choice",
    f"""WITH f AS (SELECT p, f, CAST(n AS BIGINT) AS n FROM {values(CASED, 'p, f, n')} UNION ALL SELECT role, w, count(*) FROM (SELECT role, unnest(regexp_extract_all(text, '{RUN}')) AS w FROM conversations) GROUP BY ALL),
    g AS (SELECT lower(f) AS lower, f, sum(n) AS n FROM f GROUP BY ALL),
    u AS (SELECT lower, f, row_number() OVER (PARTITION BY lower ORDER BY n * CASE WHEN regexp_matches(f, '^.+[A-Z]') THEN 1.5 ELSE 1.0 END DESC, n DESC, f) AS k FROM g)
    SELECT u.lower, coalesce(known, u.f) AS word, CAST((SELECT sum(n) FROM g WHERE g.lower = u.lower) AS BIGINT) AS n, (SELECT count(DISTINCT p) FROM f WHERE lower(f.f) = u.lower) AS projects
    FROM u LEFT JOIN {CANONICAL} ON canonical.lower = u.lower WHERE k = 1""",
)
def casing_choice(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("role").alias("project"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("form"))
    counted = rows(spark, CASED, "project string, form string, n long").unionByName(said.groupBy("project", "form").agg(F.count(F.lit(1)).alias("n")))
    forms = counted.select(F.lower("form").alias("lower"), "form", "project", "n", F.struct("form").alias("first_seq"))
    return ops.canonical_forms(forms).select("lower", "word", F.col("count").alias("n"), "projects")


@query("subsumption", _candidates_sql("conversations") + _KEPT + " SELECT word, reading, cnt AS n FROM kept")
def subsumption(spark, sf_dir):
    return ops.drop_subsumed(_ascii(spark, sf_dir)).select("word", "reading", F.col("count").alias("n"))


@query("score_topk", _candidates_sql("conversations") + _KEPT + " SELECT word, reading, cnt AS n, projects, round(score, 9) AS score FROM kept ORDER BY kept.score DESC, word, reading_ord, first_seq LIMIT 500")
def score_topk(spark, sf_dir):
    found = ops.top(ops.drop_subsumed(_ascii(spark, sf_dir)), 500)
    return found.select("word", "reading", F.col("count").alias("n"), "projects", F.round("score", 9).alias("score"))


@query("score_topk_documents", _candidates_sql("documents") + _KEPT + " SELECT word, reading, cnt AS n, projects, round(score, 6) AS score FROM kept ORDER BY kept.score DESC, word, reading_ord, first_seq LIMIT 500")
def score_topk_documents(spark, sf_dir):
    found = ops.top(ops.drop_subsumed(_ascii(spark, sf_dir, documents)), 500)
    return found.select("word", "reading", F.col("count").alias("n"), "projects", F.round("score", 6).alias("score"))


REGISTERED = [("the", "The"), ("and", "And"), ("ndonea", "Ndonea"), ("x", "Y"), ("the", "The")]


@query(
    "exclude_existing",
    _candidates_sql("documents") + f", known AS (SELECT DISTINCT lower(u) AS r, u AS w FROM (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS u FROM conversations) UNION SELECT r, w FROM {values(REGISTERED, 'r, w')}) SELECT word, reading, cnt AS n FROM cands WHERE NOT EXISTS (SELECT 1 FROM known WHERE r = reading AND w = word)",
)
def exclude_existing(spark, sf_dir):
    """Terms of the documents that no conversation holds."""
    said = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("word"))
    known = rows(spark, REGISTERED, dictionaries.PAIR).union(said.distinct().select(F.lower("word").alias("reading"), "word"))
    return ops.exclude_registered(_ascii(spark, sf_dir, documents), known).select("word", "reading", F.col("count").alias("n"))


_ID = """upper(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)))"""


@query("stable_ids", _candidates_sql("conversations") + f" SELECT word, reading, {_ID} AS id FROM (SELECT word, reading, sha1(reading || chr(9) || word) AS h FROM cands)")
def stable_ids(spark, sf_dir):
    return _ascii(spark, sf_dir).select("word", "reading", words.stable_id(F.col("word"), F.col("reading")).alias("id"))


@query("dictionary_items", _candidates_sql("conversations") + f" SELECT word, reading, {_ID} AS id, 'mined' AS hint FROM (SELECT word, reading, sha1(reading || chr(9) || word) AS h FROM cands)")
def dictionary_items(spark, sf_dir):
    return writers.dictionary_items(_ascii(spark, sf_dir), "mined").select("word", "reading", "id", "hint")


# ---- segments ---------------------------------------------------------------------------------

#: Neighbouring words run together, cut again by a lexicon of the table's own words: surface, and a whole-number
#: cost that falls with the logarithm of the frequency.
_RUN_TOGETHER = r"([\p{L}]+) ([\p{L}]+)"
_LEXICON = rf"""words AS (SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS w FROM documents) GROUP BY 1),
    lex AS (SELECT w AS surface, greatest(2, 24 - length(bin(n)))::DOUBLE AS cost FROM words WHERE n >= 3 AND length(w) <= 12)"""


def lexicon_of(texts: DataFrame) -> DataFrame:
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    cost = F.greatest(F.lit(2), 24 - F.length(F.bin("n"))).cast("double")
    return found.where((F.col("n") >= 3) & (F.length("surface") <= 12)).select("surface", F.lit("").alias("latin"), cost.alias("cost"))


_STRETCH_SQL = rf"[{tables.KATAKANA}]+|[{tables.HIRAGANA}]+|[{tables.KANJI}]+|[^{tables.KATAKANA}{tables.HIRAGANA}{tables.KANJI}]+"


@query(
    "lexicon_segments",
    rf"""WITH RECURSIVE {_LEXICON},
    said AS (SELECT doc_id, regexp_replace(lower(text), '{_RUN_TOGETHER}', '\1\2', 'g') AS text FROM documents),
    pieces AS (SELECT doc_id, u.p AS p, u.w AS w FROM (SELECT doc_id, regexp_extract_all(text, '{RUN}') AS ws FROM said), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) AS u),
    runs AS (SELECT DISTINCT w FROM pieces),
    places AS (SELECT w, unnest(range(length(w))) AS s FROM runs),
    sizes AS (SELECT substr(surface, 1, 1) AS head, length(surface) AS k FROM lex GROUP BY ALL),
    spelled AS MATERIALIZED (SELECT w, s, k, substr(w, s + 1, k) AS t FROM (SELECT *, substr(w, s + 1, 1) AS head FROM places) p JOIN sizes ON sizes.head = p.head WHERE s + k <= length(w)),
    dear AS (SELECT coalesce(max(cost), 0) + 1 AS d FROM lex),
    stretches AS (SELECT w, regexp_extract_all(w, '{_STRETCH_SQL}') AS ps FROM runs),
    borders AS (SELECT w, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT) AS bs FROM stretches),
    edges AS (
        SELECT w, s, s + k AS e, cost FROM spelled JOIN lex ON surface = t
        UNION ALL SELECT p.w, s, s + 1, 2 * d FROM places p, dear
        UNION ALL SELECT p.w, s, list_min(list_filter(bs, lambda b: b > s)), d FROM places p JOIN borders ON borders.w = p.w, dear
    ),
    ending AS (SELECT w, e, list({{'c': cost, 'n': 1::BIGINT, 's': s::BIGINT}}) AS es FROM edges GROUP BY w, e),
    lattice AS (SELECT w, list(es ORDER BY e) AS ends FROM ending GROUP BY w),
    best AS (  -- of each place: the least cost of a path to it, its words, and where the last one begins
        SELECT w, len(ends) AS n, list_reduce(list_prepend([{{'c': 0::DOUBLE, 'n': 0::BIGINT, 's': 0::BIGINT}}], ends),
            lambda b, es: list_append(b, list_min(list_transform(es, lambda x: {{'c': b[x.s + 1].c + x.c, 'n': b[x.s + 1].n + 1, 's': x.s}})))) AS b FROM lattice
    ),
    back AS (
        SELECT w, n::BIGINT AS e, b, [] :: VARCHAR[] AS words FROM best
        UNION ALL
        SELECT w, b[e + 1].s, b, list_prepend(substr(w, b[e + 1].s + 1, e - b[e + 1].s), words) FROM back WHERE e > 0
    ),
    cut AS (SELECT w, words FROM back WHERE e = 0)
    SELECT d.doc_id, coalesce(sum(len(words)), 0)::BIGINT AS n_words, md5(coalesce(string_agg(array_to_string(words, '|'), '|' ORDER BY p), '')) AS words_md5
    FROM documents d LEFT JOIN pieces ON pieces.doc_id = d.doc_id LEFT JOIN cut ON cut.w = pieces.w GROUP BY d.doc_id""",
)
def lexicon_segments(spark, sf_dir):
    """The words of all documents, pairs of which were run together."""
    docs = text_table(spark, sf_dir, "documents")
    joined = docs.select("doc_id", F.regexp_replace(F.lower("text"), _RUN_TOGETHER, "$1$2").alias("text"))
    cut = segments.segmented(joined, lexicon_of(docs), "doc_id", "text", tokens.PIECES)
    words_only = F.filter("words.surface", lambda w: w.rlike(RUN))
    found = let(words_only, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, "|").cast("binary")).alias("words_md5")))
    return cut.select("doc_id", found.alias("found")).select("doc_id", "found.*")


# ---- stored state and spans -----------------------------------------------------------------------


@query("term_counts_merged", _forms_sql("documents") + " SELECT lower, word, cnt AS n, projects FROM chosen")
def term_counts_merged(spark, sf_dir):
    """Short documents first, then the others, then the short ones once more, which changes nothing: the same as
    all at once."""
    docs = text_table(spark, sf_dir, "documents")
    kept = state.TermCounts(spark, store.shared_folder(spark))
    short = F.coalesce(F.col("n_chars") < 700, F.lit(False))
    for key, some in (("short", docs.where(short)), ("long", docs.where(~short)), ("short", docs.where(short))):
        said = some.select(F.struct(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("utt"), F.col("source").alias("project"), "text")
        kept.add(ops.ascii_forms_of(said, LOWER_ONLY), key)
    return kept.canonical().select("lower", "word", F.col("count").alias("n"), "projects")


_HALVES = {half: f"SELECT source AS project, doc_id AS a, 0 AS b, text FROM documents WHERE (md5(source) < '8') IS {truth}" for half, truth in (("first", "TRUE"), ("second", "NOT TRUE"))}
_SAID |= _HALVES


def _terms_sql(half: str) -> str:
    return f"(SELECT word, reading, cnt FROM ({_candidates_sql(half)} SELECT * FROM cands))"


@query(
    "dictionary_merged",
    rf"""WITH old AS (SELECT word, reading, row_number() OVER (ORDER BY cnt DESC, reading, word) - 1 AS ord FROM {_terms_sql('first')}),
    new AS (SELECT word, reading, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY cnt DESC, reading, word) - 1 AS ord FROM {_terms_sql('second')} n
            WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.word = n.word AND old.reading = n.reading))
    SELECT word, reading, {_ID} AS id, ord, src FROM (SELECT *, sha1(reading || chr(9) || word) AS h FROM (SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new))""",
)
def dictionary_merged(spark, sf_dir):
    """The terms of some sources as the dictionary, those of the others as what is offered, twice."""
    docs = text_table(spark, sf_dir, "documents")
    first = F.coalesce(F.md5(F.col("source").cast("binary")) < "8", F.lit(False))
    kept = state.Dictionary(spark, store.shared_folder(spark))
    for key, some in (("old", docs.where(first)), ("new", docs.where(~first)), ("new", docs.where(~first)), ("again", docs.where(~first))):
        said = some.select(F.struct(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("utt"), F.col("source").alias("project"), "text")
        terms = ops.candidates(said, LOWER_ONLY).select("word", "reading", F.lit("").alias("hint"), (-F.col("count")).alias("ord"))
        kept.merge(terms, key)
    return kept.items().select("word", "reading", "id", "ord", F.when(F.col("batch").endswith("-old"), 0).otherwise(1).alias("src"))


_CHUNK = r"[\p{L}\p{M}\p{N}_ ]+"


def _chunks_of(docs: DataFrame) -> DataFrame:
    """The words between two marks, in their order."""
    lines = docs.select(F.col("source").alias("project"), F.explode(F.regexp_extract_all("text", F.lit(_CHUNK), F.lit(0))).alias("c"))
    return lines.select("project", F.filter(F.split("c", " "), lambda w: w != "").alias("chunk"))


@query(
    "frequent_spans",
    rf"""WITH c AS (SELECT source AS project, list_filter(string_split(unnest(regexp_extract_all(text, '{_CHUNK}')), ' '), lambda w: w <> '') AS chunk FROM documents),
    s AS (SELECT project, chunk, unnest([1, 2, 3]) AS size FROM c), t AS (SELECT project, chunk, size, unnest(range(1, greatest(len(chunk) - size + 2, 1))) AS i FROM s WHERE len(chunk) >= size)
    SELECT array_to_string(chunk[i:i + size - 1], ' ') AS span, size, count(*) AS n, count(DISTINCT project) AS projects FROM t GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT project) >= 2""",
)
def frequent_spans(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents")
    projects = table(spark, sf_dir, "documents").select(F.col("source").alias("project"))
    found = mining.frequent_spans(_chunks_of(docs), 3, min_count=5, min_projects=2, projects=projects)
    return found.select("span", "size", F.col("count").alias("n"), "projects")


# ---- Japanese terms from written-out tokens ------------------------------------------------------

# The turns of all conversations in Japanese glyphs. A kanji token is read as one syllable per glyph, another one in what an assistant
# says, so that whatever both say is ambiguous.


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = conversations(spark, sf_dir).withColumn("text", japanese("text"))
    syllable = F.when(F.col("role") == "user", "ka").otherwise("shi")
    latin = lambda t: F.when(t["kind"] == "kanji", F.array_join(F.array_repeat(syllable, F.length(t["surface"])), "")).otherwise(t["latin"])
    return tokens.with_script_runs(said).withColumn("tokens", F.transform("tokens", lambda t: t.withField("latin", latin(t))))


_CHUNKS = f"""WITH said AS (SELECT conv_id, turn, role, {japanese_sql('text')} AS text FROM conversations WHERE role IN ('user', 'assistant')),
    l AS (SELECT *, regexp_extract_all(text, '[{tables.KANJI}{tables.KATAKANA}]+') AS cs FROM said),
    c AS (SELECT conv_id AS utt, turn, role, CAST(conv_id AS VARCHAR) AS project, island, regexp_extract_all(chunk, '[{tables.KATAKANA}]+|[{tables.KANJI}]+') AS surfaces
          FROM l, LATERAL (SELECT unnest(cs) AS chunk, generate_subscripts(cs, 1) AS island) AS u)"""
_READING_OF = f"CASE WHEN regexp_matches(surfaces[j], '[{tables.KANJI}]') THEN repeat(CASE role WHEN 'user' THEN 'か' ELSE 'し' END, length(surfaces[j])) ELSE translate(surfaces[j], {quoted(kana._KATAKANA)}, {quoted(kana._HIRAGANA)}) END"
_SPANS = f"""{_CHUNKS}, n AS (SELECT *, len(surfaces) AS size FROM c),
    i AS (SELECT *, unnest(range(1, size + 1)) AS i FROM n), sp AS (SELECT * FROM (SELECT *, unnest(range(1, size - i + 2)) AS k FROM i) WHERE k <= 3 OR k = size),
    r AS (SELECT utt, turn, role, project, island, i, k, size, array_to_string(surfaces[i:i + k - 1], '') AS word, surfaces[i:i + k - 1] AS parts,
        list_transform(range(i, i + k), lambda j: {_READING_OF}) AS readings FROM sp)"""
_JA = f"""{_SPANS}, ok AS (SELECT *, array_to_string(readings, '') AS reading FROM r),
    acc AS (SELECT *, word AS w FROM ok WHERE length(word) BETWEEN 3 AND 24 AND length(reading) >= 2),
    g AS (SELECT word, reading, count(*) AS n, count(DISTINCT project) AS projects, sum(CASE WHEN k = size THEN 1 ELSE 0 END) AS alone, any_value(parts) AS parts FROM acc WHERE NOT {IS_STOP} GROUP BY word, reading)"""


@query("chunks", f"{_CHUNKS} SELECT utt, turn, project, array_to_string(surfaces, '|') AS chunk FROM c")
def chunks(spark, sf_dir):
    found = tokens.exploded_chunks(_sentences(spark, sf_dir)).where(tokens.class_of(F.get("chunk", F.lit(0))) == "ja")
    return found.select(F.col("utt.a").alias("utt"), F.col("utt.b").alias("turn"), "project", F.array_join(F.transform("chunk", lambda t: t["surface"]), "|").alias("chunk"))


@query("spans", f"{_SPANS} SELECT utt, turn, project, array_to_string(parts, '|') AS span FROM r")
def spans(spark, sf_dir):
    found = tokens.exploded_chunks(_sentences(spark, sf_dir)).select("utt", "project", F.explode(tokens.spans(F.col("chunk"), 3)).alias("s"))
    return found.select(F.col("utt.a").alias("utt"), F.col("utt.b").alias("turn"), "project", F.array_join(F.transform("s", lambda t: t["surface"]), "|").alias("span"))


_LONE = "alone >= greatest(1.0, 0.2::DOUBLE * n)"


@query(
    "ja_candidates",
    f"{_JA} SELECT word, reading, CASE WHEN regexp_full_match(word, '[{tables.KATAKANA}]+') THEN 'katakana' ELSE 'kanji' END AS kind, n, projects, CAST(alone AS BIGINT) AS standalone, array_to_string(parts, '|') AS parts FROM g WHERE {_LONE}",
)
def ja_candidates(spark, sf_dir):
    cfg = ops.ExtractConfig()
    found = ops.japanese_candidates(ops.span_rows(tokens.exploded_chunks(_sentences(spark, sf_dir)), cfg), cfg)
    return found.select("word", "reading", "kind", F.col("count").alias("n"), "projects", "standalone", F.array_join("parts", "|").alias("parts"))


_AMBIGUOUS = f"SELECT s AS surface FROM (SELECT unnest(surfaces) AS s, role FROM c) WHERE regexp_matches(s, '[{tables.KANJI}]') GROUP BY 1 HAVING count(DISTINCT role) > 1"


@query("ambiguous_surfaces", f"{_CHUNKS} {_AMBIGUOUS}")
def ambiguous_surfaces(spark, sf_dir):
    return ops.ambiguous_surfaces(_sentences(spark, sf_dir))


@query("confidence_low", f"{_JA}, amb AS ({_AMBIGUOUS}) SELECT word, reading, CASE WHEN len(list_intersect(parts, (SELECT list(surface) FROM amb))) > 0 THEN 'low' ELSE 'ok' END AS confidence FROM g WHERE {_LONE}")
def confidence_low(spark, sf_dir):
    cfg = ops.ExtractConfig()
    said = _sentences(spark, sf_dir)
    found = ops.japanese_candidates(ops.span_rows(tokens.exploded_chunks(said), cfg), cfg)
    return ops.with_confidence(found, ops.ambiguous_surfaces(said)).select("word", "reading", "confidence")


@query(
    "ja_terms",
    f"""{_JA}, amb AS ({_AMBIGUOUS}), k AS (SELECT *, CASE WHEN len(list_intersect(parts, (SELECT list(surface) FROM amb))) > 0 THEN 'low' ELSE 'ok' END AS confidence FROM g WHERE {_LONE} AND n >= 3)
    SELECT word, reading, n, confidence FROM k WHERE NOT EXISTS (SELECT 1 FROM k l WHERE length(l.word) > length(k.word) AND l.n >= k.n AND contains(l.word, k.word))""",
)
def ja_terms(spark, sf_dir):
    """The Japanese path from tokens to terms, whole."""
    found = ops.drop_subsumed(ops.candidates(_sentences(spark, sf_dir), ops.ExtractConfig(ascii_terms=False)))
    return found.select("word", "reading", F.col("count").alias("n"), "confidence")


VECTORS = [("協奏", 5), ("協奏曲", 5), ("ホルン協奏曲", 3), ("TeX", 4), ("LuaTeX", 4), ("Lua", 9), ("a", 1)]


_VECTORS_SQL = f"(SELECT w, CAST(max(n) AS BIGINT) AS n FROM (SELECT w, n FROM {values(VECTORS, 'w, n')} UNION ALL SELECT w, n FROM {counted_words_sql('conversations')} WHERE n >= 3) GROUP BY w)"


@query("subsumption_vectors", f"WITH t AS {_VECTORS_SQL} SELECT w AS word, n FROM t WHERE NOT EXISTS (SELECT 1 FROM t l WHERE length(l.w) > length(t.w) AND l.n >= t.n AND contains(l.w, t.w))")
def subsumption_vectors(spark, sf_dir):
    said = counted_words(spark, sf_dir, "conversations").where("n >= 3")
    listed = rows(spark, VECTORS, "w string, n long").unionByName(said).groupBy(F.col("w").alias("word")).agg(F.max("n").alias("count"))
    return ops.drop_subsumed(listed).select("word", F.col("count").alias("n"))


@query(
    "subsumption_by_grams",
    f"WITH t AS (SELECT lower(w) AS w, CAST(sum(n) AS BIGINT) AS n FROM {counted_words_sql('documents')} GROUP BY 1 HAVING sum(n) >= 3) SELECT w AS word, n FROM t WHERE NOT EXISTS (SELECT 1 FROM t l WHERE length(l.w) > length(t.w) AND l.n >= t.n AND contains(l.w, t.w))",
)
def subsumption_by_grams(spark, sf_dir):
    """Of the documents' words in any case, of any length, those that stand in no longer one as frequent."""
    said = counted_words(spark, sf_dir, "documents").groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("count")).where("count >= 3")
    return ops.drop_subsumed_by_grams(said).select("word", F.col("count").alias("n"))


# ---- dictionaries ---------------------------------------------------------------------------------

REVIEWED = [
    (1, "reading", "word", "count", None, None, None), (2, "# note", "x", None, None, None, None), (3, "", None, None, None, None, None), (4, "ほるん", "ホルン", "9", None, None, None),
    (5, " じまくふぁいる ", "字幕ファイル ", "12", "1", "kanji", "ok"), (6, "luatex", "LuaTeX", "x8", "2", "ascii", "low"), (7, "only", None, None, None, None, None), (8, "blank", "  ", "3", None, None, None),
]


_REVIEWED_SQL = f"""(SELECT c0, c1, c2, c4 FROM {values(REVIEWED, 'k, c0, c1, c2, c3, c4, c5')}
    UNION ALL SELECT CASE WHEN starts_with(w, 'T') THEN '#' || w WHEN starts_with(w, 'Q') THEN ' ' ELSE ' ' || lower(w) || ' ' END, w || ' ', CASE WHEN length(w) > 9 THEN 'x' ELSE '' END || n, CASE WHEN n > 3 THEN ' kanji' END FROM {counted_words_sql('documents')})"""


@query(
    "review_tsv_parse",
    f"""SELECT trim(c0) AS reading, trim(c1) AS word, CASE WHEN regexp_full_match(c2, '[0-9]+') THEN CAST(c2 AS BIGINT) ELSE 1 END AS n, coalesce(trim(c4), 'manual') AS kind
    FROM {_REVIEWED_SQL} WHERE trim(coalesce(c0, '')) <> '' AND NOT starts_with(c0, '#') AND NOT (c0 = 'reading' AND coalesce(c1, '') = 'word') AND trim(coalesce(c1, '')) <> ''""",
)
def review_tsv_parse(spark, sf_dir):
    w = F.col("w")
    c0 = F.when(w.startswith("T"), F.concat(F.lit("#"), w)).when(w.startswith("Q"), " ").otherwise(F.concat(F.lit(" "), F.lower(w), F.lit(" ")))
    c2 = F.concat(F.when(F.length(w) > 9, "x").otherwise(""), F.col("n").cast("string"))
    none = F.lit(None).cast("string")
    found = counted_words(spark, sf_dir, "documents").select(F.lit(0).alias("k"), c0.alias("c0"), F.concat(w, F.lit(" ")).alias("c1"), c2.alias("c2"), none.alias("c3"), F.when(F.col("n") > 3, " kanji").alias("c4"), none.alias("c5"))
    lines = rows(spark, REVIEWED, "k int, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string").unionByName(found)
    return dictionaries.parse_review(lines).withColumnRenamed("count", "n")


EXISTING = [("既存語", "きそんご", "EXISTING", None, 0), ("字幕", "じまく", "OLD", "h", 1)]
OFFERED = [("字幕ファイル", "じまくふぁいる", "", 0), ("LuaTeX", "luatex", "", 1), ("既存語", "きそんご", "", 2), ("LuaTeX", "luatex", "", 3)]
_MERGE = f"""WITH old AS (SELECT word, reading, id, hint, CAST(ord AS BIGINT) AS ord FROM {values(EXISTING, 'word, reading, id, hint, ord')} UNION ALL SELECT w, lower(w), md5(w), NULL, n FROM {counted_words_sql('conversations')}),
    offered AS (SELECT word, reading, hint, CAST(ord AS BIGINT) AS ord FROM {values(OFFERED, 'word, reading, hint, ord')} UNION ALL SELECT w, lower(w), 'seen', n FROM {counted_words_sql('documents')}),
    new AS (SELECT *, row_number() OVER (PARTITION BY reading, word ORDER BY ord) AS k FROM offered),
    added AS (SELECT word, reading, ord, sha1(reading || chr(9) || word) AS h, nullif(hint, '') AS hint FROM new WHERE k = 1 AND (reading, word) NOT IN (SELECT reading, word FROM old)),
    merged AS (SELECT word, reading, id, hint, 0 AS src, ord FROM old UNION ALL SELECT word, reading, {_ID}, hint, 1, ord FROM added)"""


def _merge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The words of the conversations are there, those of the documents are offered."""
    w, n = F.col("w"), F.col("n")
    there = counted_words(spark, sf_dir, "conversations").select(w.alias("word"), F.lower(w).alias("reading"), F.md5(w.cast("binary")).alias("id"), F.lit(None).cast("string").alias("hint"), n.alias("ord"))
    more = counted_words(spark, sf_dir, "documents").select(w.alias("word"), F.lower(w).alias("reading"), F.lit("seen").alias("hint"), n.alias("ord"))
    old = rows(spark, EXISTING, dictionaries.ITEM)
    return old.unionByName(there.select(*[F.col(f.name).cast(f.dataType) for f in old.schema])), rows(spark, OFFERED, "word string, reading string, hint string, ord long").unionByName(more)


@query("merge_dictionary", f"{_MERGE} SELECT word, reading, id, hint, src, CAST(ord AS BIGINT) AS ord FROM merged")
def merge_dictionary(spark, sf_dir):
    return ops.merge(*_merge_inputs(spark, sf_dir)).orderBy("src", "ord")


@query("merge_counts", f"{_MERGE} SELECT (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM new) - (SELECT count(*) FROM added) AS skipped, (SELECT count(*) FROM merged) AS total")
def merge_counts(spark, sf_dir):
    return ops.merge_counts(*_merge_inputs(spark, sf_dir))


PREFS = [("よろ", "よろしくお願いします。"), ("omw", "On my way!"), ("", "x"), ("omw", "On my way!")]


@query(
    "registered_union",
    f"""SELECT DISTINCT r AS reading, w AS word FROM (SELECT * FROM {values(PREFS, 'r, w')} UNION ALL SELECT * FROM {values(REGISTERED, 'r, w')}
    UNION ALL SELECT lower(w), w FROM {counted_words_sql('conversations')} UNION ALL SELECT lower(w), w FROM {counted_words_sql('documents')})""",
)
def registered_union(spark, sf_dir):
    known = rows(spark, PREFS, dictionaries.PAIR).union(rows(spark, REGISTERED, dictionaries.PAIR))
    for name in ("conversations", "documents"):
        known = known.union(counted_words(spark, sf_dir, name).select(F.lower("w").alias("reading"), F.col("w").alias("word")))
    return known.distinct()
