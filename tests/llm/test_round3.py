"""Erasure, whitening and packing against plain versions."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termwright.llm import erasure, packing, queries, whitening

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")

# ---- erasure ------------------------------------------------------------------------------------


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def first_nulls(row):
    return [(0, 0) if v is None else (1, v) for v in row]


def plain_erasure(tables):
    """Per table and file: erased rows, kept rows."""
    clients, clicks, sales, lines = (tables[n] for n in ("clients", "clicks", "sales", "sale_lines"))
    of = defaultdict(set)
    for r in clients:
        if r["master_id"] is not None:
            of[r["master_id"]].add(r["client_id"])
    seen = Counter(r["client_id"] for r in clicks if r["client_id"] is not None)
    masters = {m for m in of if crc(m) % 100 == 0}
    if of:
        masters.add(min(of, key=lambda m: (-sum(seen[c] for c in of[m]), m)))
    owners = {r["client_id"] for r in clients if r["master_id"] in masters} - {None}
    sale_owner = {}
    for r in sales:
        if r["sale_id"] is not None:
            known = [c for c in (sale_owner.get(r["sale_id"]), r["client_id"]) if c is not None]
            sale_owner[r["sale_id"]] = min(known, default=None)
    rules = {
        "clients": (lambda r: r["client_id"], lambda r: r["master_id"] in masters, "balance"),
        "clicks": (lambda r: r["client_id"], lambda r: r["client_id"] in owners, "value"),
        "sales": (lambda r: r["client_id"], lambda r: r["client_id"] in owners, "total"),
        "sale_lines": (lambda r: sale_owner.get(r["sale_id"]), lambda r: sale_owner.get(r["sale_id"]) in owners, "amount"),
    }
    out = {}
    for name, (owner, victim, amount) in rules.items():
        rows = sorted(tables[name], key=lambda r: (crc(owner(r)), first_nulls(r.values())))
        per_file = 1 + len(rows) // 150
        for number in range(-(-len(rows) // per_file)):
            part = rows[number * per_file : (number + 1) * per_file]
            kept = [r for r in part if not victim(r)]
            if kept:
                first = list(kept[0])[0]
                ids = ",".join("" if r[first] is None else str(r[first]) for r in kept)
                cents = sum(math.floor(100 * r[amount] + 0.5) for r in kept if r[amount] is not None)
                out[name, number] = (len(kept), len(part) - len(kept), cents, len(kept) != len(part), hashlib.sha256(ids.encode()).hexdigest(), ",".join(part[0]))
    return out


def held(found):
    return {(r["table_name"], r["file_no"]): (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"], r["ids_sha256"], r["columns"]) for r in found}


@tables
def test_erasure_equals_a_plain_version(spark):
    found = queries.op11_rank_erasure(spark, SF).collect()
    given_tables = {n: pq.read_table(f"{SF}/{n}.parquet").to_pylist() for n in ("clients", "clicks", "sales", "sale_lines")}
    assert held(found) == plain_erasure(given_tables)
    # The folder holds these files alone; footers speak of what is left.
    root = found[0]["path"].removeprefix("file://").rsplit("/", 2)[0]
    there = {f"{d}/{f}" for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}
    assert there == {r["path"].removeprefix("file://") for r in found}
    for r in found:
        path = r["path"].removeprefix("file://")
        whole, meta = pq.read_table(path), pq.ParquetFile(path).metadata
        assert meta.num_rows == len(whole) == r["n_rows"]
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            if meta.num_row_groups == 1 and stats is not None and stats.has_min_max:
                assert stats.min == min(x for x in whole.column(0).to_pylist() if x is not None)
    rows = {n: Counter(map(repr, t)) for n, t in given_tables.items()}
    for n in rows:  # survivors are rows of the table, unchanged
        left = Counter(repr(x) for r in found if r["table_name"] == n for x in pq.read_table(r["path"].removeprefix("file://")).to_pylist())
        assert not left - rows[n]


SHOP = {
    "clients": "client_id long, master_id long, key string, balance double, tag int",
    "clicks": "click_id long, client_id long, value double, row string, rank int",
    "sales": "sale_id long, client_id long, total double, part int, pos int",
    "sale_lines": "sale_id long, line_no int, amount double, owner string, n int",
}


def shop(spark, rows):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SHOP.items()}


@pytest.mark.parametrize("case", ["odd", "hot", "empty"])
def test_erasure_of_odd_tables(spark, tmp_path, case):
    rng = random.Random(5)
    rows = {}
    if case != "empty":
        hot = 0.6 if case == "hot" else 0.02
        client = lambda: None if rng.random() < 0.05 else 3 if rng.random() < hot else rng.randrange(60)
        rows["clients"] = [(c, None if c % 7 == 0 else c // 3, "k", None if c % 5 == 0 else c * 1.005, c) for c in range(60)] + [(None, 1, None, -2.345, 0), (None, None, None, None, None)]
        rows["clicks"] = [(None if i % 50 == 0 else i % 400, client(), None if i % 9 == 0 else i / 7, "r", i) for i in range(700)]
        rows["clicks"] += rows["clicks"][:40]
        rows["sales"] = [(None if i % 60 == 0 else i, client(), i * 0.015, 1, 2) for i in range(300)]
        rows["sale_lines"] = [(None if rng.random() < 0.05 else 8 if rng.random() < hot else rng.randrange(330), i % 4, rng.choice([None, 0.005, 1.115, -3.335]), "o", i % 3) for i in range(900)]
    frames = shop(spark, rows)
    found = erasure.erase_clients(*[frames[n] for n in SHOP], f"file://{tmp_path}/out").collect()
    plain = {n: [dict(zip((c.split()[0] for c in SHOP[n].split(", ")), r, strict=True)) for r in rows.get(n, [])] for n in SHOP}
    assert held(found) == plain_erasure(plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=6), st.sets(st.integers(0, 35)))
def test_survivors_are_the_rows_outside_of_the_spans(sizes, gone):
    n = sum(sizes)
    gone = sorted(g for g in gone if g < n)
    spans, start = [], 0
    for _, run in itertools.groupby(enumerate(gone), key=lambda x: x[1] - x[0]):
        run = [g for _, g in run]
        spans.append((run[0], run[-1] + 1))
    batches = []
    for size in sizes:
        batches.append(pa.RecordBatch.from_pydict({"x": list(range(start, start + size))}, schema=pa.schema([("x", pa.int64())])))
        start += size
    kept = [v for b in erasure.survivors(iter(batches), iter(spans)) for v in b.column(0).to_pylist()]
    assert kept == [v for v in range(n) if v not in set(gone)]


# ---- whitening ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_symmetric_qr(size):
    rng = np.random.default_rng(size)
    for matrix in (rng.normal(size=(size, size)), np.zeros((size, size)), np.eye(size), np.outer(np.arange(size), np.arange(size)) * 1.0, np.diag(np.arange(size) * 1e9)):
        matrix = matrix + matrix.T
        values, rows = whitening.symmetric_qr(matrix)
        scale = max(np.abs(matrix).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13 * size * scale)
        assert np.allclose(rows @ rows.T, np.eye(size), atol=1e-13 * size)
        assert np.allclose(rows.T * values @ rows, matrix, atol=1e-13 * size * scale)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), max_size=5), min_size=1, max_size=5))
def test_merged_moments_are_those_of_all(parts):
    vectors = [[np.array([1e6 + v, 7.0 * v * v]) for v in p] for p in parts]
    whole = None
    for p in vectors:
        m = whitening.Moments.of(iter(p))
        whole = m if whole is None else whole if m is None else whole.merged(m)
    every = np.array([v for p in vectors for v in p])
    if not len(every):
        assert whole is None
        return
    assert whole.n == len(every)
    assert np.allclose(whole.pilot + whole.mean, every.mean(axis=0))
    centred = every - every.mean(axis=0)
    assert np.allclose(whole.covariance, centred.T @ centred / len(every), atol=1e-8)


def plain_whitening(vectors, most=32):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return deviations, centred @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@tables
def test_whitening_of_embeddings(spark):
    found = queries.op12_welford_whitening(spark, SF).collect()
    given_rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    deviations, z, explained = plain_whitening([r["embedding"] for r in given_rows])
    assert len(found) == z.size
    assert {r["n"] for r in found} == {len(given_rows)}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    place = {r["vec_id"]: i for i, r in enumerate(given_rows)}
    ours = np.zeros_like(z)
    for r in found:
        i, k = place[r["vec_id"]], r["component"] - 1
        ours[i, k] = r["whitened"]
        assert r["deviation"] == deviations[i]
        assert abs(r["explained"] / explained[k] - 1) < 1e-9
    signs = np.sign((ours * z).sum(axis=0))
    assert np.abs(ours * signs - z).max() < 1e-6


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)] + [1.0], "x", i) for i in range(50)]
    good = [r[1] for r in rows] + [rows[0][1]]
    rows += [(0, rows[0][1], "x", 1), (60, None, "x", 1), (61, [1.0, None, 2.0, 1.0], None, 1), (62, [float("nan"), 1.0, 1.0, 1.0], None, 1), (63, [float("inf"), 1.0, 1.0, 1.0], None, 1), (64, [], None, 1), (65, [1.0], None, 1), (66, [1e30, 0.0, 0.0, 1.0], None, 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n int")
    found = whitening.whiten_embeddings(docs).collect()
    assert {r["component"] for r in found} == {1, 2, 3}  # the fourth dimension doesn't vary
    assert Counter(r["vec_id"] for r in found) == Counter({i: 6 if i == 0 else 3 for i in range(50)})
    _, _, explained = plain_whitening(good, 3)
    assert {(r["component"], round(r["explained"], 9)) for r in found} == {(k + 1, round(e, 9)) for k, e in enumerate(explained)}
    assert found[0]["identity_error"] < 1e-9
    empty = spark.createDataFrame([], docs.schema)
    assert whitening.whiten_embeddings(empty).collect() == []
    assert whitening.whiten_embeddings(docs.where("vec_id = 0")).collect() == []  # two equal vectors: nothing varies
    assert whitening.whiten_embeddings(empty).columns == whitening.whiten_embeddings(docs).columns


def test_moments_from_many_partitions(spark):
    rows = [(float(i % 17), float(i * i % 23) + 1e6) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(40).selectExpr("array(a, b) AS v")
    m = whitening.moments(df, "v")
    assert m.n == 2000
    assert np.allclose(m.covariance, np.cov(np.array(rows).T, bias=True), rtol=1e-12)


# ---- packing ----------------------------------------------------------------------------------------


def fewest(lengths, capacity):
    """The least number of sequences, by exhaustion."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def sound(plan, counts, capacity):
    used = Counter()
    for times, filling in plan:
        assert times > 0 and sum(k * n for k, n in filling) <= capacity
        for k, n in filling:
            used[k] += n * times
    assert used == +Counter(counts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=11))
def test_bin_completion_finds_the_least(lengths):
    counts = Counter(lengths)
    plan = packing.bin_completion(counts, 20)
    sound(plan, counts, 20)
    assert packing.lower_bound(counts, 20) <= packing.n_sequences(plan) == fewest(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 10_000), max_size=30))
def test_plans_of_large_counts(counts):
    fit, plan = packing.best_fit(counts, 100), packing.bin_completion(counts, 100, nodes=200)
    sound(fit, counts, 100)
    sound(plan, counts, 100)
    assert packing.lower_bound(counts, 100) <= packing.n_sequences(plan) <= packing.n_sequences(fit)
    assert len(plan) <= 5 * len(counts) + 5


def test_fillings_are_undominated_and_by_waste():
    counts = {8: 1, 5: 2, 4: 1, 3: 3, 2: 1}
    found = packing.fillings(counts, 8, 2)
    assert found[0] == (0, [(8, 1)])  # what 5 + 3 and others could fill is dominated by it
    assert [w for w, _ in found] == sorted(w for w, _ in found)
    assert all(sum(k * n for k, n in f) == 8 - w for w, f in found)
    assert (0, [(5, 1), (3, 1)]) not in found


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def plain_pieces(docs, path, capacity):
    out, encode = [], library(path).encode
    for key, text in docs:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // capacity)
        start, end = 0, len(ids) - capacity * (n - 1)
        for k in range(n):
            out.append((key, k, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())))
            start, end = end, end + capacity
    return sorted(out, key=repr)


def in_place(rows, capacity):
    """Sequences without gaps or overlap; how many."""
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for held_ in filled.values():
        at = 0
        for offset, length in sorted(held_):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@tables
def test_packing_of_documents(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = queries.op13_bin_completion(spark, SF).collect()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = plain_pieces([(d["doc_id"], d["text"]) for d in docs], path, 2048)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == expected
    counts = Counter(r["length"] for r in found)
    assert in_place(found, 2048) <= packing.lower_bound(counts) + 1


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(odd_docs.repartition(3), path, 64).select("row.doc_id", "row.shard", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    expected = plain_pieces([(r["doc_id"], r["text"]) for r in odd_docs.collect()], path, 64)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == expected
    assert in_place(found, 64) <= packing.lower_bound(Counter(r["length"] for r in found), 64) + 1
    assert {r["shard"] for r in found} == {1}
    assert packing.pack(no_docs, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_library(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_ids_are_those_of_the_library, "both"):
        test_ids_are_those_of_the_library.both = packing.encoder(path), library(path)
    ours, theirs = test_ids_are_those_of_the_library.both
    for t in (text, text + "<|endoftext|>" + text):
        assert ours(t) == theirs.encode(t, add_special_tokens=False).ids
