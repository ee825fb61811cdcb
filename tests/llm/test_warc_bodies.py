"""Response blocks as crawlers store them: heads, encodings, charsets and types."""

import encodings.aliases
import gzip
import time
import zlib

import pytest

from termwright.llm import warc

PAGE = "<html><title>T</title><body><p>café &amp; more</p><p>" + "word " * 3000 + "</p></body></html>"
TEXT = "café & more\n" + ("word " * 3000).strip()


def block(body, *fields, end="\r\n"):
    return (end.join(["HTTP/1.1 200 OK", *fields]) + end * 2).encode("latin-1") + body


def text(body, *fields, end="\r\n"):
    found = warc.derivatives("<id>", "http://a.example/", None, block(body, *fields, end=end))
    return found[1]["block"] if len(found) == 2 else None


def chunked(data, size, extra=b""):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%X%s\r\n%s\r\n" % (len(p), extra, p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def raw_deflate(data):
    z = zlib.compressobj(wbits=-15)
    return z.compress(data) + z.flush()


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_heads(end):
    body = PAGE.encode()
    assert text(body, "Content-Type: text/html", "X-Folded: a", " b", end=end) == TEXT
    fields, payload = warc.split_http(block(body + b"\r\n\r\nrest", "A: 1", end=end))
    assert fields == [(":status", "HTTP/1.1 200 OK"), ("A", "1")] and payload == body + b"\r\n\r\nrest"
    assert warc.split_http(b"HTTP/1.0 204 No Content") == ([(":status", "HTTP/1.0 204 No Content")], b"")


def test_encoded_bodies():
    body = PAGE.encode()
    packed = gzip.compress(body)
    cases = [
        (chunked(body, 100), "Transfer-Encoding: chunked"),
        (chunked(body, 7, b";name=v"), "transfer-encoding: Chunked"),
        (packed, "Content-Encoding: gzip"),
        (packed, "Content-Encoding: X-GZIP"),
        (gzip.compress(body[:50]) + gzip.compress(body[50:]), "Content-Encoding: gzip"),
        (zlib.compress(body), "Content-Encoding: deflate"),
        (raw_deflate(body), "Content-Encoding: deflate"),
        (gzip.compress(zlib.compress(body)), "Content-Encoding: deflate, gzip"),
        (body, "Content-Encoding: gzip"),  # decoded before it was stored
        (body, "Transfer-Encoding: chunked"),
        (body, "Content-Encoding: identity"),
    ]
    for data, field in cases:
        assert text(data, "Content-Type: text/html", field) == TEXT, field
    assert text(chunked(packed, 33), "Transfer-Encoding: chunked", "Content-Encoding: gzip") == TEXT
    assert text(body, "Content-Encoding: br") is None
    assert text(b"", "Content-Encoding: gzip") == ""


def test_damaged_bodies_give_what_there_is():
    body = PAGE.encode()
    cut = text(gzip.compress(body)[:-30], "Content-Encoding: gzip")
    assert cut and TEXT.startswith(cut[:100])
    assert text(chunked(body, 100)[:300], "Transfer-Encoding: chunked").startswith("café & more")
    assert text(gzip.compress(body) + b"\0" * 9, "Content-Encoding: gzip") == TEXT


def test_what_inflates_too_far_has_no_text(monkeypatch):
    monkeypatch.setattr(warc, "LONGEST", 1 << 22)
    assert text(gzip.compress(b"x" * (1 << 23)), "Content-Encoding: gzip") is None


def test_large_bodies_take_time_by_their_length():
    body = b"<p>" + b"word " * 2_000_000
    start = time.time()
    assert len(text(gzip.compress(body, 1), "Content-Encoding: gzip")) == len(body) - 4
    assert len(text(chunked(body, 10), "Transfer-Encoding: chunked")) == len(body) - 4
    assert time.time() - start < 20


def test_types():
    plain = "if a<b then c>d else e &amp; f\r\n\r\n  <meta charset=cp1251>"
    assert text(plain.encode(), "Content-Type: text/plain") == plain.replace("\r\n", "\n")
    assert text(b'{"a": "<b>"}', "Content-Type: application/json; charset=utf-8") == '{"a": "<b>"}'
    assert text(b"<p>x</p>", "Content-Type: application/xhtml+xml") == "x" == text(b"<p>x</p>", "Content-Type: nonsense") == text(b"<p>x</p>")
    for kind in ("image/png", "application/pdf", "application/octet-stream", "image/svg+xml"):
        (only,) = warc.derivatives("<id>", None, None, block(b"\x89PNG\r\n\r\n\0", f"Content-Type: {kind}"))
        assert only["warc_type"] == "metadata" and only["concurrent_to"] is None and "conversion: none: not text" in only["block"]
        assert only["record_digest"] == warc.sha1_digest(warc.serialised(only))


def test_no_charset_label_raises():
    body = "<p>plain</p>".encode()
    labels = {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), "idna", "undefined", "aliases", "utf-16", "utf_16", "x" * 5000, "..", "mbcs", "x-", "unknown-8bit"}
    for label in sorted(labels):
        found = text(body, f"Content-Type: text/html; charset={label}")
        assert found == "plain" or (warc._charset(label) or "").startswith("utf-16"), label
        assert text(f"<meta charset={label}>".encode() + body) == "plain", label


@pytest.mark.parametrize(("label", "codec"), [("ISO-8859-1", "cp1252"), ("windows-1251", "cp1251"), ("x-sjis", "cp932"), ("GB2312", "gb18030"), ("x-gbk", "gb18030"), ("EUC-KR", "cp949"), ("ks_c_5601-1987", "cp949"), ("windows-874", "cp874"), ("big5", "big5hkscs"), ("euc-jp", "euc_jp"), ("koi8-r", "koi8-r"), ("macintosh", "mac-roman"), ("x-mac-cyrillic", "mac-cyrillic"), ("utf-16", "utf-16-le"), ("utf8", "utf-8"), ("cp037", None), ("punycode", None), ("utf-7", None), ("unicode_escape", None), ("rot13", None)])
def test_charset_labels(label, codec):
    assert warc._charset(label) == codec


def test_records_of_such_responses(spark):
    body = PAGE.encode("cp1251", "replace")
    rows = [("<a>", "http://a.example/", None, block(gzip.compress(body), "Content-Type: text/html; charset=windows-1251", "Content-Encoding: gzip")), ("<b>", None, None, block(b"\0\1", "Content-Type: image/gif")), ("<c>", None, None, None), ("<d>", None, None, b"")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary")
    found = warc.build_derivatives(df).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["refers_to"], {})[r["warc_type"]] = r
    assert {k: sorted(v) for k, v in kinds.items()} == {"<a>": ["conversion", "metadata"], "<b>": ["metadata"], "<c>": ["conversion", "metadata"], "<d>": ["conversion", "metadata"]}
    assert kinds["<a>"]["conversion"]["block"].startswith("caf? & more")
    for refers, *_, data in rows:
        assert all(r["source_block_digest"] == warc.sha1_digest(data or b"") for r in kinds[refers].values())
