"""WARC derivatives (operator 4): linked metadata and plain-text conversion records of responses.

Each response gives a metadata record (fields of the page and its links) and a conversion record (its text). Both name
the response in WARC-Refers-To and keep its target, date and digests; the metadata record also keeps the
response's own headers. Record ids are UUIDs made from the page's id, its address and its digest, so reruns agree.

Headers, ids and digests are built-in functions; the text of a page is taken out in Arrow batches. Nothing is shuffled.

Defined cases: what a broken page does not close is text; a null page is an empty page, with an empty conversion; a null address is left out of the headers; rows
repeated in full give equal records; an empty table gives an empty table; other columns may have any name.
Digests are labelled ``sha256`` and hexadecimal.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages carry no time of capture; a caller that knows it says so.
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
#: Bytes that are looked at together, and bytes of blocks that the reader gives out together.
PIECE, BATCH = 1 << 20, 8 << 20

#: Elements whose content is not shown, and those that begin and end lines.
_HIDDEN = ("script", "style", "noscript", "template", "head")
_BREAKS = frozenset(
    "br hr p div li ul ol dl dt dd tr td th table h1 h2 h3 h4 h5 h6 article section aside nav header footer main pre blockquote form figure title".split()
)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>\"'<]*)")
_PLAIN = re.compile(r"/?([a-zA-Z][^\s/>\"'<]*)[^<>\"']*>")
_MARK = re.compile(r"[<>\"']")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_HIDDEN, "title")}
_TITLE = re.compile(r"<title\b[^<>]*>", re.I)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?|\"[^\"]*\"|'[^']*'")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]")  # a single space stays as it is
_LINES = re.compile(r" ?\n[ \n]*")


#: Addresses, and places on a page's own host, that need no resolving: ASCII without dot segments, parameters or empty parts.
_WHOLE = re.compile(r"(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?)?/(?!/)(?:[A-Za-z0-9_~%/-]|(?<!/)\.)*(?:\?[A-Za-z0-9_~%/.=&+-]+)?(?:#[A-Za-z0-9_~%/.=&+-]+)?")
_HOST = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?=[/?#]|$)")


class Page:
    """One forward scan over a page. Whatever does not close (a tag, a quote, a comment, a script) is text from its first character on.

    A scan that fails is remembered by the places it passed, so that a broken page costs no more than its length.
    """

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()
        self.last = {x: page.rfind(x) for x in ("\"", "'", ">")}
        self.last_comment = page.rfind("-->")
        self.unclosed: set[str] = set()

    def _tag_end(self, at: int) -> int:
        """The place behind the tag that begins before ``at``, or -1. A ``<`` outside quotes ends the search."""
        passed: list[int] = []
        while at <= self.last[">"] and (mark := _MARK.search(self.page, at)) and mark[0] != "<":
            if mark[0] == ">":
                return mark.end()
            if mark.start() >= self.last[mark[0]]:
                break
            at = self.page.index(mark[0], mark.end()) + 1
            if at in self.failed:
                break
            passed.append(at)
        self.failed.update(passed)
        return -1

    def _behind(self, name: str, at: int) -> int:
        """The place behind the end tag of ``name`` from ``at`` on, or -1."""
        found = None if name in self.unclosed else _ENDS[name].search(self.page, at)
        if not found:
            self.unclosed.add(name)
        return found.end() if found else -1

    def read(self) -> tuple[str, list[str]]:
        """What is visible, without markup, blocks on lines of their own; and the addresses of the links."""
        page, at, from_, out, links = self.page, 0, 0, [], []
        while (lt := page.find("<", at)) >= 0:
            at = lt + 1
            between, end = " ", -1
            name = _PLAIN.match(page, at)
            if name:
                end = name.end()
            elif page.startswith("!", at):
                if page.startswith("--", lt + 2):
                    end = page.index("-->", lt + 4) + 3 if lt + 4 <= self.last_comment else -1
                elif page[lt + 2 : lt + 9].lower() == "doctype":
                    end = page.index(">", lt) + 1 if lt < self.last[">"] else -1
            elif name := _NAME.match(page, at):
                end = self._tag_end(name.end())
            if end < 0:
                continue
            if name:
                tag = name[1].lower()
                between = "\n" if tag in _BREAKS else ""
                if page[at] != "/":
                    if tag in _HIDDEN and (behind := self._behind(tag, end)) >= 0:
                        between, end = " ", behind
                    elif tag == "a" and (link := self._address(page[name.end(1) : end - 1])):
                        links.append(link)
            out += (page[from_:lt], between)
            at = from_ = end
        out.append(page[from_:])
        return "".join(out), links

    @staticmethod
    def _address(attributes: str) -> str:
        for found in _ATTRIBUTE.finditer(attributes):
            value = next((x for x in found.groups()[1:] if x is not None), None)
            if value is not None and found[1].lower() == "href":
                return html.unescape(value).strip()
        return ""


def read_page(page: str, base: str) -> tuple[str, list[str]]:
    """The text of what is visible (blocks on lines of their own, entities resolved, white space collapsed), and the
    addresses of its links, resolved against the page's own, each once, in order."""
    text, found = Page(page).read()
    links: dict[str, None] = {}
    host = _HOST.match(base)
    for link in found:
        if host and _WHOLE.fullmatch(link):
            links[host[0] + link if link[0] == "/" else link] = None
            continue
        try:
            links[" ".join(urljoin(base, link).split())] = None
        except ValueError:  # not an address
            continue
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip(), list(links)


def page_title(page: str) -> str:
    found = _TITLE.search(page)
    end = found and _ENDS["title"].search(page, found.end())
    if not end:
        return ""
    return " ".join(html.unescape(Page(page[found.end() : end.start()]).read()[0]).split())


def _content(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    pages, bases = pages.fillna(""), bases.fillna("")
    read = [read_page(p, b) for p, b in zip(pages, bases, strict=True)]
    return pd.DataFrame({"title": [page_title(p) for p in pages], "text": [x for x, _ in read], "links": [x for _, x in read]})


def _uuid(name: Column) -> Column:
    """A name-based identifier: 128 bits of the name's SHA-256, with the marks of version 8 and its variant."""
    d = F.sha2(name, 256)
    part = lambda a, n: F.substring(d, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, *, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload and digests."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    out = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", " ").alias("target_uri"), payload.alias("payload")).withColumn("payload_digest", _digest(F.col("payload")))
    out = out.withColumn("http_headers", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")))
    name = F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), "target_uri", "payload_digest")
    return out.withColumns({"record_id": _uuid(name), "date": F.lit(date), "block_digest": _digest(F.concat("http_headers", "payload"))})


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows per response: page_id, record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_block_digest, source_payload_digest, n_links, headers, block.
    """
    content = F.pandas_udf(_content, "title string, text string, links array<string>")
    made = found.withColumn("content", content("payload", "target_uri"))
    outlinks = F.array_join(F.transform("content.links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")
    source = F.array_join(F.transform(F.filter(F.split("http_headers", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")
    fields = F.concat(
        _field("title", F.nullif(F.col("content.title"), F.lit(""))), _field("source-record-id", F.col("record_id")), _field("source-block-digest", F.col("block_digest")),
        source, outlinks,
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("content.text").alias("block")),
    )
    slim = made.select("page_id", "record_id", "target_uri", "date", "payload_digest", "block_digest", F.size("content.links").cast("long").alias("n_links"), kinds.alias("kinds"))
    rows = slim.select("*", F.explode("kinds").alias("k")).select("*", "k.*").drop("k", "kinds")
    rows = rows.withColumns({"refers_to": F.col("record_id"), "own_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    rows = rows.withColumn("record_id", _uuid(F.concat_ws("|", "record_type", "refers_to", "own_digest")))
    headers = F.concat(
        F.lit(f"{VERSION}\r\n"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.col("date")),
        _field("WARC-Refers-To", F.col("refers_to")), _field("WARC-Target-URI", F.col("target_uri")), _field("WARC-Block-Digest", F.col("own_digest")),
        _field("WARC-Source-Payload-Digest", F.col("payload_digest")), _field("Content-Type", F.col("content_type")), _field("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", F.col("own_digest").alias("block_digest"),
        F.col("block_digest").alias("source_block_digest"), F.col("payload_digest").alias("source_payload_digest"), "n_links", headers.alias("headers"), "block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (headers, block) as gzipped WARC files, one per partition."""
    record = F.concat("headers", F.lit("\r\n"), "block")
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces of some hundred kB; gzip members, one or many, are inflated on the way."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + PIECE] for k in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the file ends inside of a gzip member")
            piece = data[at : at + PIECE // 8]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file's pieces, one record in memory at a time.

    Names of headers may have any case and keep theirs; what repeats is joined by a comma. Blank lines between records are skipped. Bytes that begin no record, a record without a
    length, and one that the file ends in are errors.
    """
    pieces, held = iter(pieces), bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            if not more():
                return
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("the file ends inside of a record's headers")
        if held[:5] != b"WARC/":
            raise ValueError("a record does not begin with its version")
        fields: dict[str, str] = {}
        known: dict[str, str] = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                name = known.setdefault(name.strip().lower(), name.strip())
                fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
        if "content-length" not in known:
            raise ValueError("a record has no length")
        stop = end + 4 + int(fields[known["content-length"]])
        while len(held) < stop:
            if not more():
                raise ValueError("the file ends inside of a record's block")
        yield fields, bytes(held[end + 4 : stop])
        del held[:stop]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers (map), block (binary). A file is one task; it is held as it is stored, and inflated a record at a time."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                rows, size = [], 0
                try:
                    for fields, block in parsed(_inflated(bytes(data))):
                        rows.append((fields, block))
                        size += len(block)
                        if size > BATCH:
                            yield pd.DataFrame(rows, columns=["headers", "block"])
                            rows, size = [], 0
                except ValueError as wrong:
                    raise ValueError(f"{name}: {wrong}") from wrong
                yield pd.DataFrame(rows, columns=["headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content")
    return files.mapInPandas(parse, "headers map<string,string>, block binary")
