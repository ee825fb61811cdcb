"""Behaviour of the vocabulary engine on small, written-out cases."""

import hashlib
import json
import plistlib
import random
import sqlite3
import unicodedata
import uuid
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termwright import functions
from termwright.functions import cleaning, kana, tables, unicode, words
from termwright.operators import candidates as ops
from termwright.operators import tokens
from termwright.plans import cli
from termwright.sources import dictionaries, transcripts, writers

# Sentences as tokens: surface, romaji and kind.
A = [("字幕", "jimaku", "kanji"), ("ファイル", "", "katakana"), ("を", "", "hiragana"), ("作成", "sakusei", "kanji"), ("。", "", "other")]
B = [("一", "ichi", "kanji"), ("次", "ji", "kanji"), ("資料", "shiryou", "kanji"), ("に", "", "hiragana")]
C = [("次", "ji", "kanji"), ("セッション", "", "katakana"), ("に", "", "hiragana"), ("引き継ぐ", "hikitsugu", "kanji"), ("。", "", "other")]
D = [("次", "tsugi", "kanji"), ("の", "", "hiragana"), ("資料", "shiryou", "kanji"), ("を", "", "hiragana"), ("見る", "miru", "kanji")]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", make(F.col("s")).alias("x")).orderBy("i").collect()]


def scan_romaji(s):
    """A scanner written from the rules, to hold the expression against."""
    table, out, i = tables.romaji_table(), [], 0
    s = s.lower().replace("-", "")
    while i < len(s):
        rest = s[i:]
        if rest[0] == "'":
            i += 1
        elif rest[0] == "n" and rest[1:2] not in tuple("aeiouy"):
            out.append("ん")
            i += 1
        elif rest[0] not in "aeioun" and rest[1:2] == rest[0] or rest[:3] == "tch":
            out.append("っ")
            i += 1
        else:
            key = next((rest[:n] for n in (4, 3, 2, 1) if rest[:n] in table), None)
            if key is None:
                return None
            out.append(table[key])
            i += len(key)
    return "".join(out)


def test_romaji(spark):
    given = ["kyousou", "gakushuu", "keitarou", "shiryou", "gasshuku", "kinyuu", "hon", "sesshon", "okona~tsu", "hidzuke", "2rén", "", None]
    want = ["きょうそう", "がくしゅう", "けいたろう", "しりょう", "がっしゅく", "きにゅう", "ほん", "せっしょん", "おこなっ", "ひづけ", None, None, None]
    assert column(spark, given, kana.romaji_to_hiragana) == want
    rng = random.Random(1)
    keys = [*tables.romaji_table(), "n", "'", "kk", "x", "l", "tch"]
    made = ["".join(rng.choice(keys) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    assert column(spark, made, kana.romaji_to_hiragana) == [scan_romaji(s) for s in made]
    assert len(tables.romaji_table()) == 199


def test_kana_and_acronyms(spark):
    assert column(spark, ["チャプター", "ヴ"], kana.katakana_to_hiragana) == ["ちゃぷたー", "ゔ"]
    assert column(spark, ["ほるん"], kana.hiragana_to_katakana) == ["ホルン"]
    assert column(spark, ["URL", "PDF", "MP3", "LuaTeX", "A", "C++", "123"], kana.acronym_reading) == ["ゆーあーるえる", "ぴーでぃーえふ", "えむぴーさん", None, None, None, None]
    assert column(spark, ["チャプター", "ーー", "引き継ぐ", "PySide6", "6PySide", "・"], kana.classify) == ["katakana", "katakana", "kanji", "ascii", "other", "other"]
    assert column(spark, [" ＡＢカナ "], kana.normalise_reading) == ["ABかな"]


def test_normal_form_of_all_code_points(spark):
    """Equal to Python's own, for characters and for mixed strings of marks, kana and jamo."""
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x80, 0x30000) if unicodedata.combining(chr(c))]
    pool = marks + [chr(c) for c in range(0x1100, 0x1200)] + list("aeiouAOカキハかは가각ｶﾊﾞﾟ①ﬁ…") + [chr(c) for c in range(0xA0, 0x250)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x31000 or c % 997 == 0)]
    texts = every + ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(5000)]
    df = spark.createDataFrame(pa.table({"s": pa.array([*texts, None])})).repartition(8)
    wrong = [r["s"] for r in df.select("s", unicode.nfkc(F.col("s")).alias("n")).toArrow().to_pylist() if r["n"] != (r["s"] and unicodedata.normalize("NFKC", r["s"]))]
    assert not wrong, [w.encode("unicode_escape") for w in wrong[:5]]


def test_half_width_readings(spark):
    assert column(spark, [" ｶﾞｸｼｭｳ　", "ﾊﾟｰﾃｨ", "か\u3099く", None, ""], kana.normalise_reading) == ["がくしゅう", "ぱーてぃ", "がく", None, ""]
    assert column(spark, ["ｋｙｏｕ", "ﬁ", "①"], kana.romaji_to_hiragana) == ["きょう", None, None]


def test_stable_ids(spark):
    pairs = [(f"w{i}", f"r{i * 7}") for i in range(300)]
    want = [str(uuid.UUID(bytes=hashlib.sha1(f"{r}\t{w}".encode()).digest()[:16], version=5)).upper() for w, r in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, w string, r string")
    assert [x["id"] for x in df.orderBy("i").select(words.stable_id(F.col("w"), F.col("r")).alias("id")).collect()] == want


def test_cleaning(spark):
    text = "<system-reminder>無視される</system-reminder>この機能を実装してください。\n```python\n日本語 = 1\n```\nhttps://example.com/日本\n[Pasted text #1 +92 lines]エラーを直して。\n[INFO] 起動完了"
    (out,) = column(spark, [text], cleaning.clean_text)
    assert "この機能を実装してください。" in out and "エラーを直して。" in out
    assert not any(x in out for x in ("無視される", "日本語 =", "example.com", "起動完了"))
    log = 'Traceback を貼ります。\n  File "/tmp/a.py", line 3\nValueError: bad'
    assert column(spark, [log], cleaning.clean_text) == ["Traceback を貼ります。"]
    assert column(spark, [log], lambda s: cleaning.clean_text(s, False)) == ["Traceback を貼ります。\nValueError: bad"]
    assert column(spark, ["/Users/me/Documents/作業資料/for_Download/a.mp4 を見て。"], cleaning.clean_text) == ["  を見て。"]
    assert column(spark, ["日\x85本 語 字\n", None, "a\n\nb\n"], lambda s: cleaning.clean_text(s, False)) == ["日\n本\n語\n字", "", "a\n\nb"]
    assert column(spark, ["https://x.co/a　日本語"], cleaning.clean_text) == [" 　日本語"]
    assert column(spark, ["/luatex 演奏会", "/cmd演奏会"], cleaning.strip_slash_command) == ["演奏会", ""]


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "projects" / "-w-a"
    folder.mkdir(parents=True)
    lines = [
        {"type": "user", "cwd": "/w/a", "message": {"content": "ホルン協奏曲を聴く"}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "結果"}, {"type": "text", "text": "字幕ファイルを作る"}]}},
        {"type": "assistant", "message": {"content": "承知しました"}},
        {"type": "user", "isSidechain": True, "message": {"content": "脇道"}},
        {"type": "user", "isMeta": True, "message": {"content": "注入された文"}},
    ]
    (folder / "s.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + '\nbroken "type"\n', encoding="utf-8")
    (tmp_path / "history.jsonl").write_text('{"display": "/luatex 演奏会プログラムを作成", "project": "/w/b"}\n', encoding="utf-8")
    return str(tmp_path)


def test_transcripts(spark, root, tmp_path):
    found = {(r["project"], r["role"], r["text"]) for r in transcripts.read_utterances(spark, root).collect()}
    assert found == {("/w/a", "user", "ホルン協奏曲を聴く"), ("-w-a", "user", "字幕ファイルを作る"), ("/w/b", "user", "演奏会プログラムを作成")}
    more = {r["text"] for r in transcripts.read_utterances(spark, root, include_assistant=True, include_sidechain=True, use_history=False).collect()}
    assert {"承知しました", "脇道"} < more and "注入された文" not in more
    assert transcripts.read_utterances(spark, str(tmp_path / "none")).isEmpty()


@pytest.fixture
def big_root(tmp_path):
    for k in range(3):
        folder = tmp_path / "projects" / f"-w %41+é{k}"
        folder.mkdir(parents=True)
        end = "\r\n" if k == 1 else "\n"
        body = end.join(json.dumps({"type": "user", "message": {"content": f"字幕 {k} {i} " + "字" * (i % 40)}}, ensure_ascii=False) for i in range(2000))
        (folder / "s.jsonl").write_bytes((body + (end if k == 2 else "")).encode())
    (tmp_path / "projects" / "-empty").mkdir()
    (tmp_path / "projects" / "-empty" / "e.jsonl").write_text("")
    return str(tmp_path)


def test_line_numbers_at_any_split_size(spark, big_root):
    def keys(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = transcripts.read_utterances(spark, big_root, line_numbers=True).select("utt.*", "text").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        return {(r["path"], r["block"], r["line"], r["part"]): r["text"] for r in found}

    whole = keys("128m")
    assert len(whole) == 6000 and all(text.startswith(f"字幕 {path[-9]} {line} ") for (path, _, line, _), text in whole.items())
    assert keys("20k") == whole == keys("7001")


def test_unreadable_files_are_named_and_left_out(spark, big_root):
    """A checksum that doesn't fit makes a file unreadable from the start."""
    folder = Path(big_root) / "projects" / "-bad"
    folder.mkdir()
    (folder / "b.jsonl").write_text('{"type": "user", "message": {"content": "字幕"}}\n' * 50, encoding="utf-8")
    (folder / ".b.jsonl.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1" * 40)
    said = transcripts.read_utterances(spark, big_root)
    assert said.count() == 6000
    report = {r["path"].rsplit("/", 2)[1]: r for r in transcripts.file_report(spark, f"{big_root}/projects/*/*.jsonl").collect()}
    assert len(report) == 4 and {k: r["reason"] for k, r in report.items() if r["reason"]} == {"-bad": "unreadable"}
    assert sum(r["lines"] for r in report.values()) == 6000


def sentences(spark, *groups):
    out = []
    for project, sentence, times in groups:
        for _ in range(times):
            at, made = 0, []
            for pos, (s, latin, kind) in enumerate(sentence):
                made.append((pos, s, latin, kind, at, at + len(s)))
                at += len(s)
            out.append(((len(out),), project, made))
    return spark.createDataFrame(out, f"utt struct<a:long>, project string, tokens {tokens.TOKENS}")


def test_japanese_terms(spark):
    cfg = ops.ExtractConfig()
    found = {r["word"]: r for r in ops.extract(sentences(spark, ("p1", A, 5), ("p1", B, 10), ("p1", C, 6), ("p1", D, 6)), cfg).collect()}
    assert found["字幕ファイル"]["reading"] == "じまくふぁいる" and found["字幕ファイル"]["count"] == 5
    assert found["一次資料"]["reading"] == "いちじしりょう" and "次資料" not in found
    assert found["次セッション"]["confidence"] == "low"
    assert ops.extract(sentences(spark, ("p", A, 2)), cfg).isEmpty()
    assert ops.extract(sentences(spark, ("p", A, 9)), ops.ExtractConfig(min_projects=2)).isEmpty()


def said(spark, *groups):
    out = [((i, n), p, t) for i, (p, t, times) in enumerate(groups) for n in range(times)]
    return tokens.with_script_runs(spark.createDataFrame(out, "utt struct<a:long,b:long>, project string, text string"))


def test_ascii_terms(spark):
    df = said(spark, ("p", "Luatex で組版する。", 5), ("p", "LuaTeX で組版する。", 4), ("p", "ffmpeg で変換する。", 8), ("p", "SRT を書き出して。", 8), ("p", "Fooapp と", 5), ("q", "FooApp と", 4), ("p", "Barapp と", 6), ("p", "BarApp と", 4))
    found = [(r["word"], r["reading"]) for r in ops.extract(df, ops.ExtractConfig(japanese_terms=False)).collect()]
    assert ("LuaTeX", "luatex") in found and not any(w in ("Luatex", "ffmpeg", "FFmpeg") for w, _ in found)
    assert {r for w, r in found if w == "SRT"} == {"srt", "えすあーるてぃー"}
    assert ("FooApp", "fooapp") in found and ("Barapp", "barapp") in found
    letters = [r["reading"] for r in ops.extract(df, ops.ExtractConfig(japanese_terms=False, ascii_reading="letters")).where("word = 'SRT'").collect()]
    assert letters == ["えすあーるてぃー"]


def test_katakana_needs_no_lexicon_and_lexicon_cuts_kanji(spark):
    df = said(spark, ("p", "スペクトログラムを表示する。", 10))
    assert [r["word"] for r in ops.extract(df).collect()] == ["スペクトログラム"]
    lexicon = spark.createDataFrame([("字幕", "jimaku", 1.0), ("作成", "sakusei", 1.0), ("する", "", 1.0)], "surface string, latin string, cost double")
    plain = spark.createDataFrame([((i,), "p", "字幕ファイルを作成する") for i in range(4)], "utt struct<a:long>, project string, text string")
    cut = tokens.with_lexicon(plain, lexicon)
    assert [t["surface"] for t in cut.first()["tokens"]] == ["字幕", "ファイル", "を", "作成", "する"]
    assert {(r["word"], r["reading"]) for r in ops.extract(cut).collect()} == {("字幕ファイル", "じまくふぁいる")}


def test_spans_and_chunks(spark):
    df = sentences(spark, ("p", [("一", "", "kanji"), ("二", "", "kanji"), ("三", "", "kanji"), ("四", "", "kanji")], 1))
    chunk = tokens.exploded_chunks(df)
    for most, want in ((3, 10), (0, 1), (9, 10)):
        assert chunk.select(F.size(tokens.spans(F.col("chunk"), most)).alias("n")).first()["n"] == want
    empty = spark.createDataFrame([((1,), "p", [])], df.schema)
    assert tokens.exploded_chunks(empty).isEmpty()


def test_subsumption_forms_agree(spark):
    rng = random.Random(3)
    made = {"".join(rng.choice("ab字") for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(250)}
    df = spark.createDataFrame(list(made.items()), "word string, count long")
    want = {w for w, n in made.items() if not any(len(v) > len(w) and m >= n and w in v for v, m in made.items())}
    assert {r["word"] for r in ops.drop_subsumed(df).collect()} == want
    assert {r["word"] for r in ops.drop_subsumed_by_pairs(df).collect()} == want
    for size in (1, 2, 3, 9):
        assert {r["word"] for r in ops.drop_subsumed_by_grams(df, size).collect()} == want
    long = spark.createDataFrame([("x" * 5000 + "y", 3), ("x" * 4000, 3), ("x" * 4000 + "z", 2), ("y", 4), ("xy", 1), ("x", 3)], "word string, count long")
    assert {len(r["word"]) for r in ops.drop_subsumed_by_grams(long).collect()} == {5001, 4001, 1} and ops.drop_subsumed_by_grams(long).count() == 3
    assert ops.drop_subsumed_by_grams(df.where("count > 99")).collect() == []


def test_limit_is_checked(spark):
    with pytest.raises(ValueError):
        ops.top(spark.range(1), -1)


def terms(spark, *pairs):
    return spark.createDataFrame([(w, r, "kanji", 3, 1, "ok", i) for i, (w, r) in enumerate(pairs)], "word string, reading string, kind string, count long, projects long, confidence string, ord long").coalesce(1)


def test_files(spark, tmp_path):
    df = terms(spark, ("字幕ファイル", "じまくふぁいる"), ("LuaTeX", "luatex"))
    assert writers.write_all(df, str(tmp_path), "note") == 2
    assert plistlib.loads((tmp_path / "user-dictionary.plist").read_bytes())[0] == {"shortcut": "じまくふぁいる", "phrase": "字幕ファイル"}
    items = json.loads((tmp_path / "user-dictionary.json").read_text())["items"]
    assert [i["word"] for i in items] == ["字幕ファイル", "LuaTeX"] and items[0]["hint"] == "note"
    assert (tmp_path / "user-dictionary.csv").read_bytes().splitlines()[1] == b"LuaTeX,luatex,note"
    back = dictionaries.read_review(spark, str(tmp_path / "terms.tsv")).collect()
    assert [(r["reading"], r["word"], r["count"]) for r in back] == [("じまくふぁいる", "字幕ファイル", 3), ("luatex", "LuaTeX", 3)]
    assert [r["word"] for r in dictionaries.read_items(spark, str(tmp_path / "user-dictionary.json")).orderBy("ord").collect()] == ["字幕ファイル", "LuaTeX"]


def test_merge(spark, tmp_path):
    prefs = tmp_path / "p.plist"
    prefs.write_bytes(plistlib.dumps({"other": True, "k": json.dumps({"items": [{"word": "既存", "reading": "きそん", "id": "EXISTING"}]})}))
    df = terms(spark, ("字幕", "じまく"), ("既存", "きそん"), ("LuaTeX", "luatex"))
    before = prefs.read_bytes()
    dry = writers.merge_into_prefs(spark, df, str(prefs), "k", dry_run=True)
    assert (dry.added, dry.skipped, dry.total) == (2, 1, 3) and prefs.read_bytes() == before
    done = writers.merge_into_prefs(spark, df, str(prefs), "k")
    saved = plistlib.loads(prefs.read_bytes())
    assert (done.added, done.skipped, done.total) == (2, 1, 3) and saved["other"] is True and done.backup
    assert json.loads(saved["k"])["items"][0]["id"] == "EXISTING"
    assert writers.merge_into_prefs(spark, df, str(prefs), "k", backup=False).added == 0
    assert {r["word"] for r in dictionaries.registered_in_prefs(spark, str(prefs), "k").collect()} == {"既存", "字幕", "LuaTeX"}


def test_replacement_database(spark, tmp_path):
    db = tmp_path / "t.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE ZTEXTREPLACEMENTENTRY (ZSHORTCUT TEXT, ZPHRASE TEXT)")
    con.executemany("INSERT INTO ZTEXTREPLACEMENTENTRY VALUES (?, ?)", [("よろ", "よろしく"), (None, "x"), ("a", None)])
    con.commit()
    con.close()
    before = db.read_bytes()
    assert {tuple(r) for r in dictionaries.registered_on_system(spark, str(db)).collect()} == {("よろ", "よろしく"), ("", "x")}
    assert db.read_bytes() == before
    assert dictionaries.registered_in_database(spark, str(tmp_path / "none")) is None
    bad, export = tmp_path / "bad.db", tmp_path / "e.plist"
    bad.write_bytes(b"no database" * 100)
    export.write_bytes(plistlib.dumps({"NSUserDictionaryReplacementItems": [{"replace": "omw", "with": "On my way!"}, {"replace": "x"}]}))
    assert {tuple(r) for r in dictionaries.registered_on_system(spark, str(bad), str(export)).collect()} == {("omw", "On my way!")}


def test_command_line(spark, root, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["scan", "--root", root, "--min-count", "1", "-o", out]) == 0
    assert cli.main(["build", f"{out}/terms.tsv", "-o", f"{out}/2"]) in (0, 1)
    (tmp_path / "r.tsv").write_text("reading\tword\tcount\n# x\n\nほるん\tホルン\t9\n", encoding="utf-8")
    assert cli.main(["build", str(tmp_path / "r.tsv"), "-o", f"{out}/3"]) == 0
    assert "ホルン" in (tmp_path / "out/3/terms.tsv").read_text()
    args = ["merge", "--tsv", str(tmp_path / "r.tsv"), "--prefs", str(tmp_path / "n.plist"), "--prefs-key", "k"]
    assert cli.main(args) == 1
    assert cli.main([*args, "--only-here"]) == 0
    assert "added 1" in capsys.readouterr().out


def test_sql_functions(spark):
    functions.register(spark)
    row = spark.sql("SELECT acronym_reading('URL') a, katakana_to_hiragana('カナ') k, canonical_spelling('GITHUB') c, stable_id('w', 'r') i, clean_text('日本 www.x.jp') t").first()
    assert (row["a"], row["k"], row["c"], row["t"]) == ("ゆーあーるえる", "かな", "GitHub", "日本  ")
    assert row["i"] == str(uuid.UUID(bytes=hashlib.sha1(b"r\tw").digest()[:16], version=5)).upper()


def test_stream(spark, root, tmp_path):
    from termwright.streaming import terms as streaming

    more = tmp_path / "projects" / "-w-a" / "t.jsonl"
    more.write_text('{"type":"user","message":{"content":"PySide を使う"}}\n' * 3, encoding="utf-8")
    counts = streaming.running_forms(streaming.stream_utterances(spark, root))
    q = counts.writeStream.format("memory").queryName("forms").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("forms").collect()] == [("pyside", "PySide", "-w-a", 3)]
