"""BPE, unit dedup, SimHash, media and WARC against brute force and round trips."""

import base64
import hashlib
import itertools
import random
import re
import time
import uuid
import wave
import zlib
from collections import defaultdict
from io import BytesIO

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termwright.llm import bpe, media, simhash, substring, warc

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


BITS = ["a", "b", "the", "  ", "\n", "1", "!!", "é", "日本", "🙂", "'s", "ing", " A", "\t", "\x00", "\x1f", " ", "\x85", "straße"]


def test_bpe_equals_the_library(vocabulary, library):
    encoder = bpe.Encoder(vocabulary, tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(2500):
        text = "".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        ids = encoder.ids(text)
        assert ids == ",".join(map(str, library.encode_ordinary(text))) and encoder.decode(ids) == text.encode()
    for text in ("a" * 5000, " " * 300 + "x", "ab" * 900, "!" * 999, "x\n" * 400):
        assert encoder.ids(text) == ",".join(map(str, library.encode_ordinary(text)))


def test_bpe_last_tokens_and_merging_agree(vocabulary):
    rng = random.Random(5)
    for _ in range(400):
        data = "".join(rng.choice(["th", "er", "a", "é", "Z", "9", "ing"]) for _ in range(rng.randint(1, 9))).encode()
        p = bpe.Prefixes(vocabulary, data)
        for end in range(1, len(data) + 1):
            assert p.last[end] == vocabulary.merged(data[:end])[-1]


def test_bpe_edits(vocabulary, library):
    rng = random.Random(6)
    text = bpe.Text(vocabulary, tokenizers.PATTERN, "hello world " * 40)
    now = text.text
    for _ in range(300):
        a = rng.randint(0, len(now))
        b = rng.randint(a, min(len(now), a + 5))
        new = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.2:
            text.append(new)
            now += new
        else:
            text.replace(a, b, new)
            now = now[:a] + new + now[b:]
        assert text.text == now and text.tokens() == library.encode_ordinary(now)
    word = bpe.Prefixes(vocabulary, b"antidisestablishmentarianism" * 40)
    redone = word.replace(500, 502, b"xyz")
    assert redone < 200 and word.last == bpe.Prefixes(vocabulary, word.data).last


def test_bpe_frame(odd_docs, no_docs, library):
    rows = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.encode_documents(odd_docs, PATH, tokenizers.PATTERN).collect()}
    for d in odd_docs.collect():
        ids = library.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert bpe.encode_documents(no_docs, PATH, tokenizers.PATTERN).isEmpty()


def test_xxh64():
    rng = random.Random(7)
    data = bytes(rng.randrange(256) for _ in range(4000))
    spans = [(a, a + rng.randint(0, 90)) for a in (rng.randrange(3900) for _ in range(800))]
    found = simhash.xxh64_slices(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert found.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in spans]


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points):
    """least id reachable, per (id, fingerprint)."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(points)), 2):
        if (points[i][1] ^ points[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 70)
    for i, (d, _) in enumerate(points):
        least[find(i)] = min(least[find(i)], d)
    return {d: least[find(i)] for i, (d, _) in enumerate(points)}


def near_rows(n=220):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 300))] for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = f"W{rng.randint(0, 400)}"
        rows.append((i, "\t".join(words), "s"))
    return rows


def test_simhash_components(make_docs):
    rows = near_rows()
    found = simhash.near_duplicates(make_docs(rows)).collect()
    want = brute_components([(i, brute_print(t)) for i, t, _ in rows])
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["fp"] % 2**64 for r in found} == {i: brute_print(t) for i, t, _ in rows}
    assert len(set(want.values())) < len(rows) - 20
    kept = simhash.drop_near_duplicates(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("light", [0, 2, 64])
def test_links_of_dense_points(spark, light):
    rng = random.Random(9)
    points = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(45):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    points |= {0, 1, 7, 1 << 63, (1 << 63) | 6}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    roots = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), light=light)).collect()
    found = {p: p for p in signed} | {r["node"]: r["root"] for r in roots}
    want = brute_components([(p, p % 2**64) for p in signed])
    assert found == want


def test_simhash_odd_and_no_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 11)} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (7, 8)} == {7}
    assert simhash.near_duplicates(no_docs).isEmpty() and simhash.drop_near_duplicates(no_docs).isEmpty()


def brute_units(text):
    """Normal form, whether a line, start, end, first and last sentence, and words before and after."""
    out, number, words = [], 0, 0
    for line in re.finditer("[^\r\n\x0b\x0c\x85\u2028\u2029]+", text):
        own, start = [], line.start()
        ends = [m.end(1) + line.start() for m in re.finditer(r"([.!?…]+)(?=\s)", line[0])] + [line.end()]
        for end in ends:
            part = text[start:end]
            found = re.findall(r"\w+", part.lower())
            if found:
                a = start + len(part) - len(part.lstrip())
                own.append((" ".join(found), a, start + len(part.rstrip()), len(found)))
            start = end
        for k, (unit, x, y, n) in enumerate(own):
            if len(own) > 1:
                before = words + sum(o[3] for o in own[:k])
                out.append((unit, False, x, y, number + k, number + k, before, before + n))
        if own:
            total = sum(o[3] for o in own)
            out.append((" ".join(o[0] for o in own), True, own[0][1], own[-1][2], number, number + len(own) - 1, words, words + total))
            number += len(own)
            words += total
    return out


def brute_spans(rows, passage):
    """Of each row: the spans that go, and how many repeated units stay."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        again = []
        own = set()
        for u in brute_units(rows[k][1] or ""):
            if u[0] in seen or u[0] in own:
                again.append(u)
            own.add(u[0])
        seen |= own
        again = [u for u in again if not any(v[4] <= u[4] and u[5] <= v[5] and v != u and (v[1] or not u[1]) for v in again if v[1])]
        runs = []
        for u in sorted(again, key=lambda u: u[4]):
            if runs and u[4] <= runs[-1][-1][5] + 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        gone = [u for r in runs if r[-1][7] - r[0][6] >= passage for u in r]
        out[k] = (sorted((u[2], u[3]) for u in gone), sum(u[1] for u in gone), len(again) - len(gone))
    return out


@pytest.mark.parametrize("passage", [1, 12])
def test_repeated_units(make_docs, passage):
    rng = random.Random(10)
    lines = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 2, 4, 7, 12]))).capitalize() + rng.choice([".", "!", "", "..."]) for _ in range(60)]
    rows = [(rng.choice([i, i // 2, None]), "".join(rng.choice(lines) + rng.choice([" ", "\n", "  \n"]) for _ in range(rng.randint(0, 9))), "s") for i in range(120)]
    docs = make_docs(rows).coalesce(1)
    want = brute_spans(rows, passage)
    found = substring.repeated_units(docs, passage).collect()
    shown = lambda i, spans, lines, left: (str(i), sorted(spans), lines, left)
    assert sorted(shown(r["doc_id"], [tuple(s) for s in r["spans"]], r["n_lines"], r["n_left"]) for r in found) == sorted(shown(rows[k][0], *w) for k, w in want.items())
    assert any(w[0] for w in want.values()) and (passage == 1) != any(w[2] for w in want.values())
    cut = []
    for k, (i, text, _) in enumerate(rows):
        keep, at = [], 0
        for a, b in want[k][0]:
            keep.append(text[at:a])
            at = b
        cut.append((str(i), "".join(keep) + text[at:]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in substring.drop_repeats(docs, passage=passage).collect()) == sorted(cut)


def test_units_keep_their_places():
    text = "Short. One two three four five six!  Seven eight nine ten eleven.\r\n\n  One, two three FOUR five six  \n--\nx"
    found = [(line, text[a:b], first, last, before, after) for _, line, a, b, first, last, before, after in substring.units(text)]
    assert found == [
        (False, "Short.", 0, 0, 0, 1),
        (False, "One two three four five six!", 1, 1, 1, 7),
        (False, "Seven eight nine ten eleven.", 2, 2, 7, 12),
        (True, "Short. One two three four five six!  Seven eight nine ten eleven.", 0, 2, 0, 12),
        (True, "One, two three FOUR five six", 3, 3, 12, 18),
        (True, "x", 4, 4, 18, 19),
    ]
    digests = [u[0] for u in substring.units(text)]
    assert digests[1] == digests[4]


def test_short_lines_of_a_long_passage_go(make_docs):
    poem = "\n".join(f"line {k} x" for k in range(20))  # three words a line
    rows = [(1, "Begin here.\n" + poem + "\nend one", "s"), (2, "another start\n" + poem + "\nline 3 x", "s"), (3, "line 3 x", "s")]
    found = {r["doc_id"]: r for r in substring.repeated_units(make_docs(rows)).collect()}
    assert (len(found[2]["spans"]), found[2]["n_lines"]) == (21, 21) and not found[1]["spans"]
    assert not found[3]["spans"] and found[3]["n_left"] == 1


def test_repeats_of_odd_and_no_rows(odd_docs, no_docs):
    found = substring.repeated_units(odd_docs, passage=7).collect()
    assert len(found) == odd_docs.count()
    gone = sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in found if r["spans"])
    assert gone == [("7", [(0, 28)]), ("None", [(0, 28)])]  # document 8 breaks the line elsewhere
    cut = substring.drop_repeats(odd_docs, passage=7)
    assert cut.columns == [*odd_docs.columns, "removed_spans"] and cut.count() == odd_docs.count()
    assert sorted(r["text"] for r in cut.where("doc_id = 7 or doc_id is null").collect() if r["text"] is not None) == ["", "", "the cat sat on the mat today"]
    assert substring.repeated_units(no_docs).isEmpty() and substring.drop_repeats(no_docs).isEmpty()


def test_wav_round_trip(odd_docs, no_docs):
    found = media.media_columns(odd_docs).collect()
    assert len(found) == odd_docs.count()
    texts = defaultdict(list)
    for d in odd_docs.collect():
        texts[d["doc_id"]].append(d["text"] or "")
    values = {}
    for r in found:
        with wave.open(BytesIO(r["media"])) as w:
            back = w.readframes(w.getnframes())
        data = back[: r["n_bytes"]]
        assert data.decode() in texts[r["doc_id"]] and not any(back[r["n_bytes"] :])
        assert len(back) == r["payload_bytes"] and len(back) % 64 == 0 and len(back) > 0 and len(back) - r["n_bytes"] < 65
        assert r["payload_sha256"] == hashlib.sha256(back).hexdigest() and r["tail_crc32"] == zlib.crc32(back[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert values.setdefault(data, r["codes"]) == r["codes"]
    assert media.media_columns(no_docs).isEmpty()


def brute_codes(samples):
    """Peaks and pairs from the definitions, frame by frame and pair by pair."""
    x = np.concatenate((np.zeros(media.HOP), [b - 128.0 if b else 0.0 for b in samples], np.zeros(media.HOP)))
    frames = [x[i : i + media.FRAME] for i in range(0, len(x) - media.FRAME + 1, media.HOP)]
    assert (len(frames) - 1) * media.HOP + media.FRAME == len(x)  # the last sample is in the last frame
    s = np.array([np.abs(np.fft.rfft((f - f.mean()) * np.hanning(media.FRAME))) for f in frames])
    found = []
    for t in range(len(s)):
        for first, last in media.BANDS:
            b = first + s[t, first:last].argmax()
            if s[t, b] > 1e-3 and (t == 0 or s[t, b] > s[t - 1, b]) and (t == len(s) - 1 or s[t, b] >= s[t + 1, b]):
                found.append((t, int(b)))
    found.sort()
    codes = [t << 24 | b << 16 | c << 8 | (u - t) for k, (t, b) in enumerate(found) for u, c in found[k + 1 : k + 1 + media.FAN_OUT] if u - t <= media.FAR]
    return found, sorted(codes)


def test_peaks_and_codes_by_definition(monkeypatch):
    rng = np.random.default_rng(1)
    tone = (128 + 90 * np.sin(np.arange(6016) * 0.7) * (np.arange(6016) // 900 % 2) + rng.integers(-20, 20, 6016)).clip(0, 255).astype(np.uint8).tobytes()
    for samples in (tone, tone[:64], tone[:128], bytes([200, 100] * 32)):
        times, bins = media.peaks(samples)
        found, codes = brute_codes(samples)
        assert list(zip(times.tolist(), bins.tolist(), strict=True)) == found
        assert media.pair_codes(times, bins).tolist() == codes
    times, bins = media.peaks(tone)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    chunked = media.peaks(tone)
    assert (chunked[0] == times).all() and (chunked[1] == bins).all()


def test_short_texts_and_tails_differ(make_docs):
    long = "the same words again and again " * 40
    texts = ["hello", "short", "Two words.", "42 is it?", "Short text.", long + "x" * 30 + "an end like this one", long + "x" * 30 + "quite another ending"]
    found = media.media_columns(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len({(r["n_peaks"], r["n_codes"], r["codes_sha256"]) for r in found}) == len(texts)
    assert sum(r["n_codes"] > 0 for r in found) >= 5


PAGE = '<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x <a href="no"> --><script>var t="</p>"</script><p>One <b>two</b><br>three &lt;ok&gt;</p><a href="/x?a=1&amp;b=2">L</a><img src=\'i.png\'></body></html>'


def test_warc_records(spark):
    df = spark.createDataFrame([("<urn:uuid:1>", "http://e.org/d/p", "2024-01-01T00:00:00Z", bytearray(warc.http_response(PAGE)), "x")], "record_id string, target_uri string, warc_date string, block binary, warc_type string")
    meta, conv = sorted(warc.build_derivatives(df).collect(), key=lambda r: r["warc_type"])[::-1]
    assert (meta["warc_type"], conv["warc_type"]) == ("metadata", "conversion")
    assert conv["block"] == "One two\nthree <ok>\nL"
    assert meta["refers_to"] == conv["refers_to"] == "<urn:uuid:1>" and meta["concurrent_to"] == conv["record_id"] and conv["concurrent_to"] == meta["record_id"]
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in (meta, conv):
        data = r["block"].encode()
        assert r["block_digest"] == sha(data) and r["content_length"] == len(data)
        assert r["source_payload_digest"] == sha(PAGE.encode()) and r["source_block_digest"] == sha(warc.http_response(PAGE))
        assert [h["name"] for h in r["source_headers"]] == [":status", "Content-Type", "Content-Length"]
        uuid.UUID(r["record_id"][10:-1])
        raw = warc.serialised(r.asDict())
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert rest == data + b"\r\n\r\n" and fields["WARC-Refers-To"] == "<urn:uuid:1>" and int(fields["Content-Length"]) == len(data)
        assert fields["WARC-Source-Payload-Digest"] == sha(PAGE.encode()) and b"WARC-Source-Header: Content-Type: text/html; charset=utf-8\r\n" in head
        assert r["record_digest"] == sha(raw)
    lines = meta["block"].split("\r\n")
    assert "title: A & B" in lines and "language: de" in lines and f"source-payload-digest: {sha(PAGE.encode())}" in lines
    assert "outlink: http://e.org/x?a=1&b=2 A/@href" in lines and "outlink: http://e.org/d/i.png IMG/@src" in lines and not any("no" in x for x in lines if x.startswith("outlink"))


def test_pages_with_left_out_tags():
    text = lambda page: warc.plain_text(page)
    assert text("<html><head><title>x</title><body><p>Hello world</p>") == "Hello world"
    assert text("<title>x</title>Hello<p>one<p>two<ul><li>a<li>b</ul>") == "Hello\none\ntwo\na\nb"
    assert text('<a title="a>b" href=x>L</a> 1 < 2 &amp; 3 <3') == "L 1 < 2 & 3 <3"
    assert text("a<!-- x > y -->b<!>c<!doctype html>d<?php e ?>f<![CDATA[<g>]]>h") == "abcdf<g>h"
    assert text("<style>p{}</style><SCRIPT>'</p>'</SCRIPT >x<noscript>n<b>m</b></noscript><template><p>t</template>y") == "xy"
    assert text("<p>x<noscript>never closed") == "x" + "never closed"
    assert text("<p a b c='1>2'd=\"3\"/>t<br/>u<textarea><b></textarea>") == "t\nu<b>"
    assert text("") == "" and text("x <b") == "x" and text("\u0130<script>1</script>\u0130x") == "\u0130\u0130x"
    page = warc.Page('<html lang=de><base href="/b/"><title> A &lt; B </title><a href="1" HREF="2">x</a><svg><title>no</title></svg><noscript><img src=i></noscript>')
    assert (page.title, page.lang, page.base, page.links) == ("A < B", "de", "/b/", [("a", "href", "1"), ("img", "src", "i")])


@pytest.mark.parametrize("page", ["<a x=" * 30_000, "<!--" * 30_000, "<" * 60_000, "<a b='" * 30_001, "<noscript>" * 30_000 + "</noscript>", "<!x" * 40_000, "<a " + "b" * 60_000, "<title>" * 30_000])
def test_pages_take_linear_time(page):
    began = time.perf_counter()
    warc.Page(page)
    assert time.perf_counter() - began < 5


def test_plain_text_equals_a_parser():
    """Against the standard library's parser, on made pages whose tags are all closed."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title", "noscript", "template")
            self.out.append("\n" * (tag in warc.LINES and not self.hidden))

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title", "noscript", "template")
            self.out.append("\n" * (tag in warc.LINES and not self.hidden))

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    rng = random.Random(12)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word ", "two words", " &amp; ", "&eacute;t&#233;", "  \n x", "<!-- <p> -->", "<br>", "<img src='a>b'>"])
        tag = rng.choice(["p", "div", "b", "a href=\"x>y\"", "li", "span class=it", "script", "style", "template", "noscript", "td"])
        name = tag.split()[0]
        inner = "var a = 1;" if name in ("script", "style") else "".join(made(depth - 1) for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{name}>"

    for _ in range(400):
        page = "".join(made(3) for _ in range(4))
        parser = Text()
        parser.feed(page)
        parser.close()
        want = re.sub(r" ?\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(parser.out))).strip()
        assert warc.plain_text(page) == want, page


@pytest.mark.parametrize(
    ("head", "body", "want"),
    [
        ("text/html; charset=ISO-8859-1", "é–".encode("cp1252"), "é–"),
        ("text/html", "<meta charset=windows-1251>привет".encode("cp1251"), "привет"),
        ("text/html", '<META http-equiv="Content-Type" content="text/html; charset=Shift_JIS">日本'.encode("cp932"), "日本"),
        ("text/html; charset=koi8-r", "<meta charset=utf-8>привет".encode("koi8-r"), "привет"),
        ("text/html; charset=utf-8", "é".encode("utf-16"), "é"),
        ("text/html; charset=nope", "é".encode(), "é"),
        ("text/html; charset=base64", "é".encode(), "é"),
        ("text/html", "<meta charset=utf-16>é".encode(), "é"),
        ("text/html", b"\xef\xbb\xbf\xc3\xa9\xff", "é\ufffd"),
    ],
)
def test_charsets(head, body, want):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {head}\r\n\r\n".encode() + body
    meta, conversion = warc.derivatives("r", "http://e.org/", None, block)
    assert conversion["block"] == want


def test_warc_odd_rows(spark):
    schema = "record_id string, target_uri string, warc_date string, block binary"
    rows = [(None, None, None, None), ("r", "http://[bad", None, bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nope\r\nX: a\r\n b\r\n\r\n\xff<a href=x>")), ("r", "u", "d", bytearray(b"plain <b>" * 20_000))]
    found = warc.build_derivatives(spark.createDataFrame(rows * 2, schema)).collect()
    assert len(found) == 12 and all(r["content_length"] == len(r["block"].encode()) for r in found)
    assert warc.build_derivatives(spark.createDataFrame([], schema)).isEmpty()
    pages = spark.createDataFrame([(1, "http://e.org/", PAGE), (None, None, None)], "page_id long, url string, html string")
    ids = [r["record_id"] for r in warc.responses_of(pages, "2024-01-01T00:00:00Z").collect()]
    assert len({uuid.UUID(i[10:-1]) for i in ids}) == 2
