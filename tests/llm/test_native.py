"""Sharding, mixing and exact deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from termwright.llm import exact, mixing, sharding


def corpus(n=3000):
    rng = random.Random(2)
    return [(i, f"text {rng.randint(0, 10**6)}", "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}") for i in range(n)]


def test_shards_match_the_mixture(spark, make_docs):
    rows = corpus()
    found = sharding.stratified_shards(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
    per = defaultdict(list)
    for r in found:
        per[r["shard"]].append(r)
        text = rows[r["doc_id"]][1]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
    assert set(per) == set(range(40)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    total = Counter(s for _, _, s in rows)
    for own in per.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        mixed = Counter(r["source"] for r in own)
        for s, n in total.items():
            assert abs(mixed[s] - n / 40) <= 2
    # The order is that of the fractional rank in a seeded shuffle.
    place = defaultdict(list)
    for r in sorted(found, key=lambda r: r["position"]):
        place[r["source"]].append(r["position"])
    for s, at in place.items():
        assert all(abs(p / len(rows) - (k + 0.5) / len(at)) < 0.5 / len(at) + 10 / len(rows) for k, p in enumerate(at))
    again = sharding.stratified_shards(make_docs(rows).repartition(7)).collect()
    assert {(r["doc_id"], r["position"]) for r in again} == {(r["doc_id"], r["position"]) for r in found}
    assert {(r["doc_id"], r["position"]) for r in sharding.stratified_shards(make_docs(rows), seed=21).collect()} != {(r["doc_id"], r["position"]) for r in found}


def test_shards_of_odd_and_no_rows(odd_docs, no_docs):
    found = sharding.stratified_shards(odd_docs, n_shards=5).collect()
    assert len(found) == odd_docs.count() and sorted(r["position"] for r in found) == list(range(len(found)))
    assert {r["size"] for r in found if r["doc_id"] in (1, 2)} == {16}
    assert sharding.stratified_shards(no_docs).isEmpty()
    with pytest.raises(ValueError):
        sharding.stratified_shards(odd_docs, n_shards=0)


def simulate(weights, blocks):
    """Earliest deadline first, slot by slot, in exact fractions; also the even flow at every slot."""
    names = sorted(blocks)
    w = {s: Fraction(weights[s]) for s in names}
    flow, starts, ends, flows, t = dict.fromkeys(names, Fraction(0)), defaultdict(list), defaultdict(list), [], Fraction(0)
    for s in names:
        starts[s].append(t)
    total = sum(blocks.values())
    while t < total:
        alive = [s for s in names if flow[s] < blocks[s]]
        rate = {s: w[s] / sum(w[x] for x in alive) for s in alive}
        step = min([(int(flow[s]) + 1 - flow[s]) / rate[s] for s in alive] + [int(t) + 1 - t])
        t += step
        for s in alive:
            flow[s] += step * rate[s]
            if flow[s].denominator == 1:
                ends[s].append(t)
                if flow[s] < blocks[s]:
                    starts[s].append(t)
        if t.denominator == 1:
            flows.append(dict(flow))
    given, out = Counter(), []
    for slot in range(total):
        ready = [s for s in names if given[s] < blocks[s] and int(starts[s][given[s]]) <= slot]
        s = min(ready, key=lambda s: (-(-ends[s][given[s]] // 1), names.index(s)))
        out.append((s, given[s]))
        given[s] += 1
        assert all(abs(given[x] - flows[slot][x]) < 1 for x in names)
    return out, flows


@pytest.mark.parametrize("block_rows", [1, 4])
def test_mixing_follows_the_schedule(spark, make_docs, block_rows):
    rows = corpus(700)
    weights = {"hot": 1.0, **{f"s{i}": 1.0 + i for i in range(7)}}
    found = mixing.pfair_mix(make_docs(rows), spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=block_rows).select("doc_id", "source", "__mix.*").collect()
    count = Counter(s for _, _, s in rows)
    # Whole units of 2^-40 stand for the weights.
    units = {s: round(weights[s] / sum(weights[x] for x in count) * mixing.WHOLE) for s in count}
    want, _ = simulate(units, {s: -(-n // block_rows) for s, n in count.items()})
    slots = {(r["source"], r["block"]): r["slot"] for r in found}
    assert slots == {b: i for i, b in enumerate(want)}
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in found)
    assert sorted(r["position"] for r in found) == list(range(len(rows)))
    ordered = sorted(found, key=lambda r: r["position"])
    assert [(r["slot"], r["offset"]) for r in ordered] == sorted((r["slot"], r["offset"]) for r in found)


@pytest.mark.parametrize("lane", [32, 100])
def test_lanes_stay_with_the_targets(spark, make_docs, lane):
    """Weights that no short period has: no source drifts from its target, lane after lane."""
    rng = random.Random(3)
    weights = {f"s{i}": w for i, w in enumerate([1 / 3, 2 / 3, 1e-3, 0.17, 0.4142135])}
    rows = [(i, f"t{i}", f"s{rng.choice([0, 1, 1, 2, 3, 4])}") for i in range(900)]
    found = mixing.pfair_mix(make_docs(rows), spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=1, lane=lane).select("source", "__mix.*").collect()
    units = {s: round(w / sum(weights.values()) * mixing.WHOLE) for s, w in weights.items()}
    count = Counter(s for _, _, s in rows)
    _, flows = simulate(units, dict(count))
    given = Counter()
    for slot, r in enumerate(sorted(found, key=lambda r: r["slot"])):
        assert (r["slot"], r["block"]) == (slot, given[r["source"]])
        given[r["source"]] += 1
        assert all(abs(given[s] - flows[slot][s]) < 1.25 for s in count)


def test_mixing_many_sources_and_rows_without_id(spark, make_docs):
    rows = [(None, f"t{i}", f"s{i % 400}") for i in range(1200)]
    found = mixing.pfair_mix(make_docs(rows), block_rows=1).select("source", "__mix.*").collect()
    assert sorted(r["position"] for r in found) == list(range(1200))
    for at in range(0, 1200, 400):  # equal weights: a block of each in every 400 slots
        assert len({r["source"] for r in found if at <= r["slot"] < at + 400}) == 400
    hashes = make_docs(rows).select(mixing.shuffled_hash(7, F.col("doc_id"), F.col("text"), F.col("text")).alias("h")).distinct()
    assert hashes.count() == 1200


def test_mixing_odd_and_no_rows(odd_docs, no_docs):
    found = mixing.pfair_mix(odd_docs)
    assert found.columns == [*odd_docs.columns, "__mix"] and found.count() == odd_docs.count()
    assert sorted(r["p"] for r in found.select(F.col("__mix.position").alias("p")).collect()) == list(range(odd_docs.count()))
    assert mixing.pfair_mix(no_docs).isEmpty()
    with pytest.raises(ValueError):
        mixing.pfair_mix(odd_docs, block_rows=0)


def brute_groups(rows):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return {tuple(sorted(k for *_, k in g)): min(g) for g in groups.values()}, groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(make_docs, weak):
    rng = random.Random(5)
    base = ["a b", "ab", " a\tb\n", "abc", "", None, "日 本", "日本"]
    rows = [(i, rng.choice(base), "s") for i in range(60)]
    digest = (lambda c: (F.crc32(c) % 3).cast("string")) if weak else exact.sha256_hex
    found = exact.exact_duplicates(make_docs(rows), digest=digest).collect()
    assert len(found) == len(rows)
    _, groups = brute_groups(rows)
    for r in found:
        text = re.sub(r"[\x20\x09-\x0D]", "", rows[r["doc_id"]][1] or "")
        best = min(groups[text])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[2], len(groups[text]), best[2] == r["doc_id"])
        if not weak:
            assert r["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_odd_and_no_rows(odd_docs, no_docs):
    found = exact.exact_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    for keeper in (8, 11):  # the longest of the texts about the cat, and of the blank ones
        own = [r for r in found if r["keep_id"] == keeper]
        assert [r["group_size"] for r in own] == [4] * 4 and [r["doc_id"] for r in own if r["kept"]] == [keeper]
    kept = exact.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in found) == 8
    assert exact.exact_duplicates(no_docs).isEmpty() and exact.drop_exact_duplicates(no_docs).isEmpty()


def test_rows_that_repeat_stay_once(make_docs):
    kept = exact.drop_exact_duplicates(make_docs([(1, "same", "a"), (1, "same", "a"), (2, "other", "a")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_rows_of_one_id_and_of_none(make_docs):
    kept = exact.drop_exact_duplicates(make_docs([(1, "a", "x"), (5, "a", "x"), (5, "b", "x"), (None, "c", "x"), (None, "b ", "x"), (None, "c", "x")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "b "), (0, "c"), (1, "a")]


@pytest.mark.parametrize("weak", [False, True])
def test_a_second_batch_meets_the_first(make_docs, tmp_path, weak):
    digest = (lambda c: (F.crc32(c) % 3).cast("string")) if weak else exact.sha256_hex
    first = [(10, "one text", "s"), (11, "another", "s"), (12, "only here", "s"), (13, "", "s")]
    later = [(1, "onetext", "s"), (2, "another  longer by blanks", "s"), (3, "anot her", "s"), (4, "new", "s"), (5, "new", "s"), (6, None, "s")]
    state = f"file://{tmp_path}/state"
    exact.exact_duplicates(make_docs(first), digest=digest, state_path=state).collect()
    found = exact.exact_duplicates(make_docs(later), digest=digest, state_path=state).collect()
    _, groups = brute_groups(first + later)
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5, 6]
    texts = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in first + later}
    for r in found:
        own = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own)[2], len(own), min(own)[2] == r["doc_id"])


def test_an_empty_state_is_an_error(spark, make_docs, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    real = DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: real(self, *a, **k).limit(0))
    with pytest.raises(RuntimeError):
        exact.exact_duplicates(make_docs([(1, "a", "s")]))
