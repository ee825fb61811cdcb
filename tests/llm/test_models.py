"""The quality classifier and the toxicity scorer: estimates, gradients and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwright.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    n, k = 40_000, len(quality.RULES)
    good = rng.random(n) < 0.8
    right, active = np.linspace(0.72, 0.97, k), 0.7
    v = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None]).astype(int)
    v[rng.random((n, k)) > active] = -1
    counts = {}
    for row in v:
        c = quality.pattern_code(row.tolist())
        counts[c] = counts.get(c, 0) + 1
        assert len(counts) > 3 or quality.pattern_votes(c) == row.tolist()
    posterior, accuracy, share = quality.fit_labellers(counts)
    assert np.abs(accuracy - right).max() < 0.03 and abs(share - 0.8) < 0.03
    q = np.array([posterior[quality.pattern_code(r.tolist())] for r in v[:5000]])
    assert ((q > 0.5) == good[:5000]).mean() > 0.95


def dense(places, values):
    out = np.zeros(quality.SIZE)
    out[places] = values
    return out


def brute_statistics(text):
    """Word by word, from the definitions."""
    words = text.split()
    n, half = len(words), quality.SIZE // 2
    if not n:
        return {}, np.zeros(quality.SIZE)
    traits = [quality._traits(w) for w in words]
    vector = np.zeros(quality.SIZE)
    for t in traits:
        vector[t[8]] += 1
        vector[-7:] += t[:7]
    stutter = 0
    for (a, b), (x, y) in zip(zip(traits, traits[1:]), zip(words, words[1:])):
        vector[half + (a[8] * 31 + b[8] + 17 * (x == y)) % (half - 8)] += 1
        stutter += x == y
    vector[-8] = stutter
    share = [sum(t[k] for t in traits) / n for k in range(7)]
    latin = [t for t in traits if t[7]]
    found = dict(zip(("symbol_share", "pipe_share", "upper_share", "exclaim_share"), share))
    found |= {"stutter_share": stutter / n, "repeat_share": max(0, 1 - (len(set(words)) + 5) / (n + 5)), "sentence_words": n / max(1, share[4] * n)}
    return found | {"content_share": 1 - (sum(t[5] for t in latin) + 0.7) / (len(latin) + 10), "odd_share": share[6]}, np.sqrt(vector / n)


def test_statistics_by_definition():
    rng = np.random.default_rng(5)
    parts = ["The", "day", "day.", "|", "GOOD!!", "ab###", "été,", "привет", "日本語の文", "x" * 30, "Ok?", "12,5", "naïveté", "—"]
    texts = ["", None, "x", "day day day", *[" ".join(rng.choice(parts, rng.integers(1, 90))) for _ in range(300)], " \n\t "]
    for (found, places, values), text in zip(quality.statistics(texts, quality._Words()), texts, strict=True):
        want, vector = brute_statistics(text or "")
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
        assert np.allclose(dense(places, values), vector, atol=1e-6)
    assert quality.votes({}) == [0] * len(quality.RULES)


def test_long_texts_in_parts(monkeypatch):
    texts = ["short text", " ".join(f"w{i % 50}" for i in range(5000)), "a a b", "x " * 700]
    whole = list(quality.statistics(texts, quality._Words()))
    monkeypatch.setattr(quality, "CHUNK", 700)
    for (a, p, v), (b, q, u) in zip(whole, quality.statistics(texts, quality._Words()), strict=True):
        assert a == b and np.abs(dense(p, v) ** 2 - dense(q, u) ** 2).max() < 0.002  # pairs over a cut are left out


def test_other_scripts_get_no_bad_votes():
    texts = [
        "Вчера вечером мы долго гуляли по старому городу и говорили о том, что будет дальше. Потом пошёл дождь, и мы вернулись домой.",
        "昨日の夜、私たちは古い町を長い間歩いて、これからのことを話しました。その後雨が降り始めたので家に帰りました。",
        "Ieri sera abbiamo camminato a lungo per la città vecchia e abbiamo parlato di che cosa sarebbe successo dopo.",
        "어제 저녁 우리는 오래된 도시를 오랫동안 걸었다. 그리고 비가 와서 집으로 돌아왔다.",
    ]
    for found, _, _ in quality.statistics(texts, quality._Words()):
        assert 0 not in quality.votes(found)


def test_copies_neither_fill_nor_empty_the_sample(spark, make_docs):
    """Many copies of two texts beside others: the scorer still tells good from bad."""
    good = [f"The {a} of the house is on the hill, and it was {a}." for a in ("door", "roof", "wall", "yard", "gate", "path")]
    bad = ["BUY NOW!! $$$ ### BUY NOW!! | | | FREE FREE FREE ###" for _ in range(1)]
    rows = [(i, good[0], "s") for i in range(300)] + [(300 + i, bad[0], "s") for i in range(100)] + [(400 + i, t, "s") for i, t in enumerate(good[1:])]
    model = quality.fit(quality.written(quality.features(make_docs(rows)), "t"), sample=7)
    assert np.abs(model["weights"]).max() > 0
    found = quality.classify(make_docs(rows), sample=7).collect()
    assert len(found) == len(rows) and all(r["keep"] == (not 300 <= r["doc_id"] < 400) for r in found)


def test_em_by_hand():
    """Two rounds of expectation and maximisation over three patterns, written out in loops."""
    counts = {quality.pattern_code([1] * 9): 60, quality.pattern_code([0] * 9): 25, quality.pattern_code([1, 0, -1] * 3): 15}
    posterior, accuracy, share = quality.fit_labellers(counts, rounds=2)
    q = {c: {18: 0.97, 0: 0.02}.get(sum(v + 1 for v in quality.pattern_votes(c)) if -1 not in quality.pattern_votes(c) else -5, 0.02) for c in counts}
    for _ in range(2):
        table = {}
        for side in (0, 1):
            for k in range(9):
                sums = {-1: 0.5, 0: 0.5, 1: 0.5}
                for c, n in counts.items():
                    sums[quality.pattern_votes(c)[k]] += n * (q[c] if side else 1 - q[c])
                table[side, k] = {v: x / sum(sums.values()) for v, x in sums.items()}
        prior = sum(n * q[c] for c, n in counts.items()) / 100
        for c in counts:
            both = [prior if side else 1 - prior for side in (0, 1)]
            for side in (0, 1):
                for k, v in enumerate(quality.pattern_votes(c)):
                    both[side] *= table[side, k][v]
            q[c] = both[1] / sum(both)
    assert all(abs(posterior[c] - q[c]) < 1e-9 for c in counts) and abs(share - prior) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_quality_on_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = quality.classify(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in found) / len(found) > 0.97
    kept = quality.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs).where("keep").count()


def test_quality_odd_and_no_rows(odd_docs, no_docs):
    found = quality.classify(odd_docs).collect()
    assert len(found) == odd_docs.count() and not any(r["keep"] for r in found if r["doc_id"] in (1, 2, 11))
    assert quality.classify(no_docs).isEmpty() and quality.drop_rejected(no_docs).isEmpty()


def test_gradients(monkeypatch):
    model = toxicity.Model(1)
    for k in model.dense:
        model.dense[k] = model.dense[k].astype(np.float64)
    rng = np.random.default_rng(2)
    table = rng.standard_normal((9, 2, 3 * toxicity.HIDDEN))
    windows = rng.integers(0, 9, (4, 6))
    filled = np.arange(6) < np.array([[6], [3], [1], [5]])
    target = np.array([1.0, 0, 1, 0])

    def loss():
        logits = model.run(table, windows, filled)[0].astype(np.float64)
        return float(np.logaddexp(0, np.where(target == 1, -logits, logits)).sum())

    logits, held = model.run(table, windows, filled, keep=True)
    grads, dx = model.backward(held, windows, 1 / (1 + np.exp(-logits)) - target)
    for name, g in grads.items():
        place = tuple(rng.integers(0, s) for s in model.dense[name].shape)
        old, e = model.dense[name][place], 1e-2
        model.dense[name][place] = old + e
        up = loss()
        model.dense[name][place] = old - e
        down = loss()
        model.dense[name][place] = old
        assert abs((up - down) / (2 * e) - g[place]) < 2e-2 * max(1, abs(g[place])), name
    want = np.zeros_like(table)
    for t in range(6):
        np.add.at(want[:, 0], windows[:, t], dx[t, 0])
        np.add.at(want[:, 1], windows[:, 5 - t], dx[t, 1])
    place = (int(windows[0, 0]), 1, 3)
    table[place] += 1e-2
    up = loss()
    table[place] -= 2e-2
    down = loss()
    assert abs((up - down) / 2e-2 - want[place]) < 2e-2


def test_windows_cover_the_text():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        windows, filled = toxicity.windows_of(np.arange(1, n + 1))
        assert set(windows[windows > 0].tolist()) == set(range(1, n + 1)) and filled.any(axis=1).all()
        assert all(set(a[-toxicity.WINDOW + toxicity.STRIDE :]) == set(b[: toxicity.WINDOW - toxicity.STRIDE]) for a, b in zip(windows, windows[1:], strict=False))


def made_corpus(n=900):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "st", "rel", "lo")]
    texts, labels = [], []
    for i in range(n):
        own = rng.choice(words, rng.integers(5, 200)).tolist()
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.integers(2, 5)):
                own.insert(rng.integers(0, len(own) + 1), str(rng.choice(["vileword!", "zorqen", "Zorqist"])))
        texts.append(" ".join(own))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_learns_and_holds_out(spark, make_docs, odd_docs, no_docs):
    texts, y = made_corpus()
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs, model).select("*", toxicity.held_out().alias("out")).collect()
    out = [r for r in found if r["out"]]
    assert {r["doc_id"] for r in out} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == y[r["doc_id"]] for r in out) / len(out) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned).key == model.key
    odd = toxicity.score_documents(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_documents(no_docs, model).isEmpty()
    nothing = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.score_documents(odd_docs, nothing).count() == odd_docs.count()


def test_scores_do_not_depend_on_company():
    texts, y = made_corpus(200)
    model = toxicity.train(texts, y, steps=60)
    together = toxicity.Scorer(model).scores(texts)
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts[:20]]
    assert np.allclose(together[:20], alone, atol=1e-5)
