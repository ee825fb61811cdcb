"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The name space of record ids that are made from other ids (RFC 4122's for URLs).
NAMES = uuid.NAMESPACE_URL

RECORD = "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, source_headers array<struct<name:string,value:string>>, block string, record_digest string"

#: Markup of a page: a comment, a CDATA section, a tag (its slash, name and attributes, whose values may be
#: quoted and hold any mark), or a declaration. Groups are atomic: nothing is tried twice.
_MARKUP = re.compile(
    r"""<(?:!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|!\[CDATA\[((?s:.*?))(?:\]\]>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|[^\s/>][^\s/>=]*+(?>\s*=\s*(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=>)))?)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))"""
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

#: Elements whose content is no markup (its end is the next end tag of that name), elements
#: that a reader doesn't see, elements that start and end a line, and the attributes that link.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
UNSEEN = frozenset("noscript template".split())
LINES = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "frame": "src", "embed": "src", "source": "src"}

_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(10).join(parts))}>"


class Page:
    """What one pass over a page's markup finds: text, title, lang, base and links (tag, attribute, target).

    End tags may be left out wherever HTML allows: nothing waits for ``</head>`` or ``</p>``. Text
    is what a reader sees: no comments, scripts, styles or titles, nothing in templates and
    ``noscript``; block elements stand on lines of their own; entities are resolved; runs of
    white space are joined. A "<" that begins no markup is text; a tag that the page's end cuts off
    is none. Time grows with the page's length only.
    """

    def __init__(self, page: str):
        self.title: str | None = None
        self.lang: str | None = None
        self.base: str | None = None
        self.links: list[tuple[str, str, str]] = []
        parts: list[str] = []
        at, unseen, low = 0, 0, ""
        ends: dict[str, int] = {}  # where the next end tag of a name stands, as last looked up
        while (m := _MARKUP.search(page, at)) is not None:
            if not unseen and m.start() > at:
                parts.append(page[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                if m[1] and not unseen:
                    parts.append(html.escape(m[1], quote=False))
                continue
            name = name.lower()
            if name in LINES and not unseen:
                parts.append("\n")
            if m[2]:
                unseen -= name in UNSEEN and unseen > 0
                continue
            if (attribute := LINKS.get(name)) or name in ("html", "base"):
                self._attributes(name, attribute, m[4])
            if name in RAW or name in UNSEEN:
                low = low or page.lower()
                if len(low) != len(page):  # a few capitals grow when they are lowered
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
                end = ends.get(name, 0)
                if 0 <= end < at:
                    end = ends[name] = low.find(f"</{name}", at)
                if name in UNSEEN:
                    unseen += end >= 0
                    continue
                raw = page[at : end if end >= 0 else len(page)]
                if name == "title" and self.title is None:
                    self.title = " ".join(html.unescape(raw).split())
                elif name == "textarea" and not unseen:
                    parts.append(raw)
                at = end if end >= 0 else len(page)
        if not unseen:
            parts.append(page[at:])
        text = html.unescape("".join(parts))
        self.text = _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()

    def _attributes(self, name: str, attribute: str | None, found: str) -> None:
        values: dict[str, str] = {}
        for key, *value in _ATTRIBUTE.findall(found):
            values.setdefault(key.lower(), html.unescape(next((v for v in value if v), "")).strip())
        if name == "html" and self.lang is None and values.get("lang"):
            self.lang = values["lang"]
        if name == "base" and self.base is None and values.get("href"):
            self.base = values["href"]
        if attribute and values.get(attribute):
            self.links.append((name, attribute, values[attribute]))


def plain_text(page: str) -> str:
    return Page(page).text


#: Where a response's head ends: at the first empty line.
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields (with the status line first, under the name ``:status``) and payload of an
    HTTP response, whose head's lines end with CR LF or LF alone; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    end = _HEAD_END.search(block)
    head, payload = (block, b"") if end is None else (block[: end.start()], block[end.end() :])
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    fields = [(":status", lines[0])]
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.append((name.strip(), value.strip()))
        elif line[:1] in (" ", "\t") and len(fields) > 1:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
    return fields, payload


#: The text encodings of the web by their names in Python, and those that a page means by the name of a narrower one.
ENCODINGS = frozenset(
    "utf-8 utf-16-be utf-16-le cp866 cp874 cp932 cp949 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 iso8859-2 iso8859-3 iso8859-4 iso8859-5 "
    "iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman mac-cyrillic gb18030 big5hkscs euc_jp iso2022_jp".split()
)
WIDER = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "euc_kr": "cp949", "utf-16": "utf-16-le"}
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


#: Types beside text/* that are text; the beginning of a chunk.
TEXTUAL = frozenset("json javascript ecmascript x-javascript".split())
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
LONGEST = 1 << 30  # bytes of a decompressed body: a cell of a table can't hold more than twice that


@lru_cache(1024)
def _charset(label: str) -> str | None:
    """The codec of a label, or None if it names no text encoding of the web."""
    label = label.strip().lower()
    for name in (label, label.removeprefix("x-"), label.replace("windows-", "cp")):
        try:
            found = codecs.lookup(name).name
        except (LookupError, ValueError):
            continue
        found = WIDER.get(found, found)
        return found if found in ENCODINGS else None
    return None


def _values(fields: list[tuple[str, str]], name: str) -> list[str]:
    return [value for key, value in fields if key.lower() == name]


def _unchunked(data: bytes) -> bytes:
    """The chunks' data; what is no sequence of chunks (archives may have undone them, but kept the header) stays as it
    is. Chunks that are cut off give what there is of them."""
    out, at = [], 0
    while (m := _CHUNK.match(data, at)) is not None:
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
        if at >= len(data):
            return b"".join(out)
        at += 2 if data.startswith(b"\r\n", at) else data.startswith(b"\n", at)
    return b"".join(out) if out else data


def _inflated(data: bytes, wbits: int) -> bytes | None:
    """The data of a compressed body, of all its members; what can be had of a damaged one; None if it is none from the start or more
    than LONGEST bytes come out."""
    out, size = [], 0
    while data:
        reader = zlib.decompressobj(wbits)
        try:
            while data and not reader.eof:
                out.append(reader.decompress(data, 1 << 20))
                size += len(out[-1])
                if size > LONGEST:
                    return None
                data = reader.unconsumed_tail
                if not data and not reader.eof and not out[-1]:
                    break
        except zlib.error:
            break
        data = reader.unused_data
    return b"".join(out) if size else None


def body_of(fields: list[tuple[str, str]], payload: bytes) -> bytes | None:
    """The payload without its transfer and content encodings (chunked, gzip, deflate), or None where they can't be
    undone. A body that doesn't begin as its header says counts as decoded before."""
    if any("chunked" in v.lower() for v in _values(fields, "transfer-encoding")):
        payload = _unchunked(payload)
    named = [v.strip().lower() for value in _values(fields, "content-encoding") for v in value.split(",")]
    for name in reversed([n for n in named if n not in ("", "identity")]):
        if not payload:
            break
        if name in ("gzip", "x-gzip"):
            if payload.startswith(b"\x1f\x8b"):
                payload = _inflated(payload, 31)
        elif name == "deflate":
            framed = len(payload) > 1 and payload[0] & 15 == 8 and not (payload[0] << 8 | payload[1]) % 31
            plain = _inflated(payload, 15 if framed else -15)
            payload = payload if plain is None and not framed else plain
        else:
            payload = None
        if payload is None:
            return None
    return payload


def media_kind(fields: list[tuple[str, str]]) -> str:
    """"markup", "text" or "other" by the content type; what has none, or no real one, is markup."""
    kind = next((v.partition(";")[0].strip().lower() for v in _values(fields, "content-type")), "")
    main, slash, sub = kind.partition("/")
    if not slash or sub in ("html", "xml") or sub.endswith("+xml") and main in ("application", "text"):
        return "markup"
    return "text" if main == "text" or sub in TEXTUAL or sub.endswith("+json") else "other"


def charset_of(fields: list[tuple[str, str]], payload: bytes = b"") -> str:
    """By the payload's byte-order mark, the HTTP header, the page's own declaration in its first
    1,024 bytes (markup only), or UTF-8; names of no text encoding are passed over."""
    for mark, name in MARKS:
        if payload.startswith(mark):
            return name
    for name, value in fields:
        if name.lower() == "content-type" and (found := re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value, re.I)) and (known := _charset(found[1])):
            return known
    if media_kind(fields) == "markup" and (found := _META.search(payload, 0, 1024)) and (known := _charset(found[1].decode("latin-1"))):
        return "utf-8" if known.startswith("utf-16") else known
    return "utf-8"


def derivatives(record_id: str, uri: str | None, date: str | None, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response record; the metadata record alone where the body is
    no text (see ``media_kind``) or can't be decoded. Digests are those of the bytes as they stand in the block."""
    fields, payload = split_http(block)
    kind, body = media_kind(fields), body_of(fields, payload)
    readable = kind != "other" and body is not None
    text = body.decode(charset_of(fields, body), "replace") if readable else ""
    page = Page(text if kind == "markup" else "")
    if kind == "text":
        page.text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").strip()
    source_payload, source_block = sha1_digest(payload), sha1_digest(block)
    ids = {kind: derived_id(record_id, kind) for kind in ("metadata", "conversion")}
    lines = [("source-record-id", record_id), ("source-payload-digest", source_payload), ("source-block-digest", source_block)]
    lines.append(("conversion-record-id", ids["conversion"]) if readable else ("conversion", "none: not text" if kind == "other" else "none: encoding"))
    lines += [(f"source-header-{name.lstrip(':').lower()}", value) for name, value in fields]
    if page.title:
        lines.append(("title", page.title))
    if page.lang:
        lines.append(("language", page.lang))
    base = uri if page.base is None else _joined(uri, page.base)
    lines += [("outlink", f"{_joined(base, target)} {tag.upper()}/@{attribute}") for tag, attribute, target in page.links]
    blocks = {"metadata": "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in lines), "conversion": page.text}
    types = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata"))[: 1 + readable]:
        data = blocks[kind].encode("utf-8", "replace")
        record = {
            "warc_type": kind,
            "record_id": ids[kind],
            "refers_to": record_id,
            "concurrent_to": ids[other] if readable else None,
            "target_uri": uri,
            "warc_date": date,
            "content_type": types[kind],
            "content_length": len(data),
            "block_digest": sha1_digest(data),
            "source_payload_digest": source_payload,
            "source_block_digest": source_block,
            "source_headers": [{"name": n, "value": v} for n, v in fields],
            "block": data.decode(),
        }
        record["record_digest"] = sha1_digest(serialised(record))
        out.append(record)
    return out


def _joined(uri: str | None, target: str) -> str:
    try:
        return urljoin(uri or "", target)
    except ValueError:
        return target


def serialised(record: dict) -> bytes:
    """The record as it stands in a WARC/1.1 file; the source's digests and HTTP header fields are
    extension fields."""
    names = [
        ("WARC-Type", record["warc_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Date", record["warc_date"]),
        ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Refers-To-Target-URI", record["target_uri"]),
        ("WARC-Refers-To-Date", record["warc_date"]),
        ("WARC-Concurrent-To", record["concurrent_to"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Block-Digest", record["block_digest"]),
        ("WARC-Source-Payload-Digest", record["source_payload_digest"]),
        ("WARC-Source-Block-Digest", record["source_block_digest"]),
        *[("WARC-Source-Header", f"{h['name']}: {h['value']}") for h in record["source_headers"]],
        ("Content-Type", record["content_type"]),
        ("Content-Length", str(record["content_length"])),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in names if v is not None)
    return head.encode("utf-8", "replace") + b"\r\n" + record["block"].encode() + b"\r\n\r\n"


def http_response(page: str) -> bytes:
    """A page as the block of a response record."""
    data = page.encode("utf-8", "surrogatepass")
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data) + data


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response (one where it has no text): metadata and conversion, which name the response
    (refers_to), each other (concurrent_to), its digests and its HTTP header fields;
    record_digest is that of the record as a WARC file holds it.

    ``responses``: record_id string, target_uri string, warc_date string, block binary (HTTP
    head and payload, or payload alone); other columns, of any name, are left aside. Ids of
    derived records are made from the response's id, so a run can be repeated. Chunked, gzip and deflate
    bodies are decoded; plain text is kept as it is; a body that is no text by its type, or in another
    encoding, has a metadata record only, whose concurrent_to is null. A null id is
    made from the URI and the block's digest; a null block counts as empty; a null URI or
    date stays null. Bytes that don't fit the charset are replaced. Repeated responses are
    each converted. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                out = []
                for row in whole.slice(at, 128).to_pylist():
                    block = row["block"] or b""
                    out += derivatives(row["record_id"] or derived_id(row["target_uri"] or "", sha1_digest(block)), row["target_uri"], row["warc_date"], block)
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return responses.select(F.col("record_id").cast("string").alias("record_id"), F.col("target_uri").cast("string").alias("target_uri"), F.col("warc_date").cast("string").alias("warc_date"), F.col("block").cast("binary").alias("block")).mapInArrow(run, RECORD)


_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")],
        ("content_length", pa.int64()),
        *[(n, pa.string()) for n in ("block_digest", "source_payload_digest", "source_block_digest")],
        ("source_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("block", pa.string()),
        ("record_digest", pa.string()),
    ]
)


def responses_of(pages: DataFrame, warc_date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records; ids are made from the page's id and URL."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    data = text.cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(data).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    h = F.sha1(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    record_id = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    return pages.select(record_id.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(warc_date).alias("warc_date"), F.concat(head, data).alias("block"))
