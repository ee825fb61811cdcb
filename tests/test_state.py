"""The lexicon lattice, uneven joins, stored state, numbering and spans against plain versions."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termwright import functions
from termwright.functions import kana
from termwright.operators import joins, mining, segments, state, tokens
from termwright.sources.store import Batches, numbered


def plain_words(text, lexicon, stretches):
    """The cheapest path by its definition, place by place."""
    import regex

    out = []
    for piece in regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+", text or ""):
        if not regex.match(r"[\p{L}\p{M}\p{N}_]", piece):
            out.append((piece, ""))
            continue
        dearest = max((c for c, _ in lexicon.values()), default=0.0) + 1
        stops = list(itertools.accumulate(len(m) for m in regex.findall(stretches, piece)))
        best = {0: (0.0, 0, None, "")}
        for end in range(1, len(piece) + 1):
            found = []
            for start in range(end):
                cost, n, *_ = best[start]
                if piece[start:end] in lexicon:
                    more, latin = lexicon[piece[start:end]]
                    found.append((cost + more, n + 1, start, latin))
                if end == next(s for s in stops if s > start):
                    found.append((cost + dearest, n + 1, start, ""))
                if end == start + 1:
                    found.append((cost + 2 * dearest, n + 1, start, ""))
            best[end] = min(found, key=lambda f: f[:3])
        words, end = [], len(piece)
        while end:
            _, _, start, latin = best[end]
            words.append((piece[start:end], latin))
            end = start
        out += words[::-1]
    return out


STRETCHES = "[ァ-ヺーヽヾ]+|[ぁ-ゟ]+|[々一-鿿\U00020000-\U0002ffff]+|[^ァ-ヺーヽヾぁ-ゟ々一-鿿\U00020000-\U0002ffff]+"


def test_lexicon_words_equal_the_cheapest_path(spark):
    rng = random.Random(7)
    letters = "ab字幕カを𠮷"
    lexicon = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): (float(rng.randint(1, 4)), rng.choice(["", "x"])) for _ in range(60)}
    texts = [None, "", " ", "字幕", "。。", "ab ab  字幕を", "a" * 700 + "字幕" * 200] + ["".join(rng.choice(letters + " .") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    texts += texts[:5]
    lex = spark.createDataFrame([(s, latin, c) for s, (c, latin) in lexicon.items()] + [("字 幕", "", 0.1), ("", "", 0.1), (None, "", 0.1), (next(iter(lexicon)), "zz", 99.0), ("b", None, None)], "surface string, latin string, cost double")
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("words_", F.lit("kept"))
    found = segments.segmented(df, lex, "n", "text", tokens.PIECES).collect()
    assert len(found) == len(texts)
    for r in found:
        assert [(w["surface"], w["latin"]) for w in r["words"]] == plain_words(r["text"], lexicon, STRETCHES), r["text"]
        assert "".join(w["surface"] for w in r["words"]) == (r["text"] or "")
        assert r["words_"] == "kept"


def test_segments_without_entries_or_texts(spark):
    none = spark.createDataFrame([], "surface string, latin string, cost double")
    df = spark.createDataFrame([(1, "字幕ファイルabc")], "n int, text string")
    assert [w["surface"] for w in segments.segmented(df, none, "n", "text", tokens.PIECES).first()["words"]] == ["字幕", "ファイル", "abc"]
    assert segments.segmented(df.where("n > 1"), none, "n", "text", tokens.PIECES).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_uneven_join(spark, how):
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(3000)] + [(10 + i, i) for i in range(20)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (15, "c"), (99, "d")], "k int, w string")
    usual = sorted(map(repr, left.join(right, "k", how).collect()))
    assert sorted(map(repr, joins.join_uneven(left, right, "k", how, least=5).collect())) == usual
    assert sorted(map(repr, joins.join_uneven(left, right, "k", how).collect())) == usual


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_have_no_gap(spark, tmp_path, n):
    rows = [(random.Random(i).randrange(50), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    found = numbered(Batches(spark, f"file://{tmp_path}/{n}"), "x", df, "a", "b", start=5).collect()
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["ord"])] == sorted(rows)
    assert sorted(r["ord"] for r in found) == list(range(5, 5 + n))


def offered(spark, rows):
    return spark.createDataFrame(rows, "word string, reading string, hint string, ord long")


def test_dictionary_grows_once(spark, tmp_path):
    kept = state.Dictionary(spark, f"file://{tmp_path}/dictionary")
    assert kept.items().collect() == []
    kept.start(spark.createDataFrame([("字幕", "じまく", "ID1", "h"), ("字幕", "じまく", "ID2", None), (None, None, "ID3", None)], "word string, reading string, id string, hint string"), "id")
    with pytest.raises(ValueError):
        kept.start(offered(spark, []), "word")
    batch = offered(spark, [("b", "b", "", 2), ("a", "a", "x", 1), ("b", "b", "late", 3), ("字幕", "じまく", "new", 0), (None, None, "", 9), ("", "x", "", 4)])
    for _ in range(2):
        assert tuple(kept.merge(batch, "one").first()) == (3, 3, 6)
    assert tuple(kept.merge(batch, "two").first()) == (0, 6, 6)
    items = sorted(kept.items().collect(), key=lambda r: r["ord"])
    assert [(r["word"], r["reading"], r["hint"], r["ord"]) for r in items] == [("字幕", "じまく", "h", 0), ("字幕", "じまく", None, 1), (None, None, None, 2), ("a", "a", "x", 3), ("b", "b", None, 4), ("", "x", None, 5)]
    # A batch whose writer failed isn't there, and its next attempt takes its place.
    name = kept.batches.next_name("three")
    kept.batches.write(name, "items", kept.items().drop("batch"))
    assert kept.items().count() == 6
    assert tuple(kept.merge(offered(spark, [("c", "c", "", 1)]), "three").first()) == (1, 0, 7)


def test_dictionary_from_a_stream(spark, tmp_path):
    from termwright.streaming import terms as streaming

    kept = state.Dictionary(spark, f"file://{tmp_path}/dictionary")
    source = tmp_path / "in"
    for n, words in enumerate((["a", "b"], ["b", "c"])):
        offered(spark, [(w, w, "", i) for i, w in enumerate(words)]).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("word string, reading string, hint string, ord long").json(str(source))
        streaming.merge_into(stream, kept, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        kept.merge_batch(offered(spark, [("zz", "zz", "", 1)]), n)  # the batch's number again, as after a failure
    assert [r["word"] for r in kept.items().orderBy("ord").collect()] == ["a", "b", "c"]


def test_term_counts_in_any_order_and_repeated(spark, tmp_path):
    rng = random.Random(2)
    forms = [(f"{f.lower()}", f, rng.choice([None, *(f"p{i}" for i in range(150))]), rng.randint(1, 9), (i,)) for i in range(1200) for f in [rng.choice(["GitHub", "Github", "FooApp", "Fooapp", "Bar"])]]
    df = spark.createDataFrame(forms, "lower string, form string, project string, n long, first_seq struct<a:long>")
    from termwright.operators import candidates as ops

    want = sorted(map(repr, ops.canonical_forms(df).collect()))
    for name, cuts in (("one", [range(1200)]), ("more", [range(900, 1200), range(0, 5), range(5, 900)])):
        kept = state.TermCounts(spark, f"file://{tmp_path}/{name}")
        for cut in cuts:
            for _ in range(2):
                kept.add(df.where(F.col("first_seq.a").between(cut[0], cut[-1])), f"b{cut[0]}")
        assert sorted(map(repr, kept.canonical().collect())) == want


@pytest.mark.parametrize("least", [(1, 1), (3, 1), (3, 2), (50, 1)])
def test_frequent_spans(spark, least):
    rng = random.Random(4)
    chunks = [(rng.choice("pqr"), [rng.choice("abcdé") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 7))]) for _ in range(120)] + [("p", None), ("p", []), (None, ["a", "b"])]
    df = spark.createDataFrame(chunks, "project string, chunk array<string>")
    counts, projects = Counter(), {}
    for p, c in chunks:
        for size in range(1, 5):
            for i in range(len(c or []) - size + 1):
                span = " ".join(c[i : i + size])
                counts[span, size] += 1
                projects.setdefault((span, size), set()).add(p)
    want = {(s, k, n, len(projects[s, k])) for (s, k), n in counts.items() if n >= least[0] and len(projects[s, k]) >= least[1]}
    found = [tuple(r) for r in mining.frequent_spans(df, 4, *least).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_rare_spans_are_no_candidates(spark):
    chunks = spark.createDataFrame([("p", ["a", "b", f"rare{i}", f"once{i}", "c"]) for i in range(100)], "project string, chunk array<string>")
    single = mining.frequent_spans(chunks, 1, 3)
    assert {r["span"] for r in mining.candidate_spans(chunks, 2, single).collect()} == {"a b"}
    assert mining.spans_of(chunks, 2).count() == 400


def test_romaji_as_a_sql_function(spark):
    functions.register(spark)
    words = ["kyousou", "kon'ya", "hi-ro", "ＴＯＫＹＯ", "x", "", None, "nna", "matcha"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for r in df.select("s", F.expr("romaji_to_hiragana(s)").alias("sql"), kana.romaji_to_hiragana(F.col("s")).alias("column")).collect():
        assert r["sql"] == r["column"], r


@pytest.mark.parametrize("most", [1000, 3])
def test_texts_meet_a_small_lexicon_where_they_stand(spark, monkeypatch, most):
    """No shuffle but the lexicon's own; one that is too large to be held is joined, with the same words."""
    monkeypatch.setattr(segments, "MOST_HELD", most)
    rng = random.Random(11)
    lexicon = {"".join(rng.choice("abcd字") for _ in range(rng.randint(1, 4))): (float(rng.randint(1, 4)), "") for _ in range(50)}
    texts = ["".join(rng.choice("abcd字 .") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    lex = spark.createDataFrame([(s, "", c) for s, (c, _) in lexicon.items()], "surface string, latin string, cost double")
    cut = segments.segmented(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), lex, "n", "text", tokens.PIECES)
    assert [(w["surface"], w["latin"]) for r in sorted(cut.collect()) for w in r["words"]] == [w for t in texts for w in plain_words(t, lexicon, STRETCHES)]
    assert ("Exchange" in cut._jdf.queryExecution().executedPlan().toString()) == (most == 3)


def test_rows_of_one_part_are_dealt_over_the_cores(spark):
    one, four, few = spark.range(0, 3000, 1, 1), spark.range(0, 3000, 1, 4), spark.range(0, 30, 1, 1)
    dealt = joins.spread(one)
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 3000 and len(parts) > 4 and max(r["count"] for r in parts) < 1000
    assert dealt.distinct().count() == 3000
    assert joins.spread(four) is four and joins.spread(few) is few and joins.spread(one.where("id < 0")).count() == 0


def test_normal_form_is_looked_up_by_hash(spark):
    """No table of all marks or decompositions is searched in order: only pairs of a starter and a mark that joins one are."""
    from termwright.functions import unicode

    df = spark.createDataFrame([("が㍻ﬁé",)], "s string")
    found = df.select(unicode.nfkc(F.col("s")).alias("n"))
    assert found.first()["n"] == "が平成fié"
    assert found._jdf.queryExecution().logical().toString().count("str_to_map") <= 1


def _spans_by_loop(chunks, most, least, projects_least=1):
    counts, projects = Counter(), {}
    for p, c in chunks:
        for size in range(1, most + 1):
            for i in range(len(c) - size + 1):
                span = " ".join(c[i : i + size])
                counts[span, size] += 1
                projects.setdefault((span, size), set()).add(p)
    return {(s, k, n, len(projects[s, k])) for (s, k), n in counts.items() if n >= least and len(projects[s, k]) >= projects_least}


@pytest.mark.parametrize("many", [3, 64, 65, 200])
def test_spans_of_few_and_many_projects(spark, many):
    """A bit a project, up to 64 of them (the last is the sign), or one more grouping: the same counts."""
    rng = random.Random(9)
    chunks = [(f"p{n % many}", [rng.choice("abcdef") for _ in range(rng.randint(1, 6))]) for n in range(400)]
    df = spark.createDataFrame(chunks, "project string, chunk array<string>")
    assert {tuple(r) for r in mining.frequent_spans(df, 3, 3, 2).collect()} == _spans_by_loop(chunks, 3, 3, 2)
    wider = spark.createDataFrame([(p,) for p, _ in chunks] + [("elsewhere",)], "project string")
    assert {tuple(r) for r in mining.frequent_spans(df, 3, 3, 2, projects=wider).collect()} == _spans_by_loop(chunks, 3, 3, 2)


def test_span_passes_shuffle_counts_once(spark, monkeypatch):
    """With few projects a level is grouped by one shuffle, and what it makes isn't made again for the next level."""
    made = []
    write = Batches.write
    monkeypatch.setattr(Batches, "write", lambda self, name, table, df: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(self, name, table, df))
    chunks = spark.createDataFrame([("p", ["a", "b", "c"])] * 9, "project string, chunk array<string>")
    found = mining.frequent_spans(chunks, 3, 3)
    assert [n for n, _ in made] == ["tokens", "level-1", "level-2", "level-3"] and made[0][1].count("Exchange hashpartitioning") == 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(s, s.count(" ") + 1, 9, 1) for s in ("a", "b", "c", "a b", "b c", "a b c")}


def test_spans_where_keys_collide(spark, monkeypatch):
    """A seed under which two tokens have one key is not used."""
    narrow = mining.token_key
    monkeypatch.setattr(mining, "token_key", lambda t, seed: F.pmod(narrow(t, seed), F.lit(2)) if seed < 2 else narrow(t, seed))
    chunks = [("p", ["a", "b", "c", "a"])] * 5 + [("q", ["d", "c", "b"])] * 4
    df = spark.createDataFrame(chunks, "project string, chunk array<string>")
    assert mining.injective_seed(df.select(F.explode("chunk").alias("span")).distinct()) == 2
    assert {tuple(r) for r in mining.frequent_spans(df, 3, 3).collect()} == _spans_by_loop(chunks, 3, 3)


def test_long_chunks_are_not_copied_for_each_start(spark):
    """A chunk of 60,000 tokens: a row for each start that held it would make some 20 GB."""
    words = [f"w{n % 7}" for n in range(60_000)]
    found = mining.frequent_spans(spark.createDataFrame([("p", words)], "project string, chunk array<string>"), 2, 3)
    assert {tuple(r) for r in found.collect()} == _spans_by_loop([("p", words)], 2, 3)


@pytest.mark.parametrize("changed", [{}, {"_STEP": 1}, {"AT_ONCE": 50, "TOGETHER": 7}, {"LONG": 3}, {"LONG": 10_000}])
def test_runs_cut_together_equal_the_cheapest_path(monkeypatch, changed):
    """Whatever is cut together, and if entries share their hashes (their characters' sum)."""
    import pyarrow as pa
    import regex

    for name, value in changed.items():
        monkeypatch.setattr(segments, name, value)
    rng, kind = random.Random(5), pa.struct([("surface", pa.string()), ("latin", pa.string())])
    letters = "abc字幕カを𠮷é"
    lexicon = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): (rng.choice([1.0, 2.0, 0.1, 0.7, -0.5]), rng.choice(["", "x", "y"])) for _ in range(250)} | {"abcabcabcab": (0.2, "long")}
    texts = ["", " ", "abcab" * 40 + "を字"] + ["".join(rng.choice(letters + " .。") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    found = [regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+", t) for t in texts]
    sizes = [[[len(m) for m in regex.findall(STRETCHES, p)] if regex.match(r"[\p{L}\p{M}\p{N}_]", p) else None for p in ps] for ps in found]
    held = segments.Held(pa.array(list(lexicon)), [c for c, _ in lexicon.values()], [x for _, x in lexicon.values()])
    cut = segments._cut(held, pa.array([["z"], *found], pa.list_(pa.string()))[1:], pa.array([[None], *sizes], pa.list_(pa.list_(pa.int32())))[1:], kind)
    for text, words in zip(texts, cut.to_pylist(), strict=True):
        assert [(w["surface"], w["latin"]) for w in words] == plain_words(text, lexicon, STRETCHES), text


def test_a_lexicon_of_over_a_million_entries_is_held(spark):
    """It was joined before, which wrote a hundred times the input."""
    name = lambda n: F.translate(F.lpad(n.cast("string"), 8, "0"), "0123456789", "abcdefghij")
    lexicon = spark.range(1_100_000).select(name(F.col("id")).alias("surface"), F.lit("").alias("latin"), F.lit(0.5).alias("cost"))
    texts = spark.createDataFrame([(1, "aaaaaaabaaaaaaac x"), (2, "aajjjjjjaajjjjji")], "n int, text string")
    cut = segments.segmented(texts, lexicon, "n", "text", tokens.PIECES)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    assert [[w["surface"] for w in r["words"]] for r in sorted(cut.collect())] == [["aaaaaaab", "aaaaaaac", " ", "x"], ["aajjjjjj", "aajjjjji"]]
