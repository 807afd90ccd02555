import gzip
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import mixing, packing, warc
from tests.conftest import SF


def reshared():
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 500}
    names = sorted(sizes, key=lambda s: (s is None, s))
    total = sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, target = {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | fixed
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    return sizes, target


def test_curriculum_meets_its_targets(spark):
    sizes, target = reshared()
    rows, i = [], 0
    for s, n in sizes.items():
        k = n // 10
        for _ in range(max(k, 1)):
            rows.append((i, "w " * (n // max(k, 1)), s))
            i += 1
    got = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, seen = Counter(), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        seen[s] = r
        assert r.taken <= 3 * r.size
    for s, r in seen.items():
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert all(0 <= r.position < 1 for r in got if r.taken)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w", "a") for i in range(400)] + [(1000 + i, "w", "b") for i in range(160)]
    got = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=((2.0, 0.0), (1.0, 1.0))).collect()
    early = [r.position for r in got if r.doc_id < 1000 and r.taken]
    even = [r.position for r in got if r.doc_id >= 1000 and r.taken]
    assert abs(np.median(early) - (1 - np.sqrt(0.5))) < 0.02 and abs(np.median(even) - 0.5) < 0.02


def test_training_order(spark, awkward, empty):
    takes = mixing.curriculum(awkward)
    got = mixing.training_order(awkward)
    assert got.columns == awkward.columns
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    want = Counter({r.doc_id: r.n for r in takes.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n})
    assert Counter({r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}) == want
    assert mixing.training_order(empty).count() == 0 and mixing.curriculum(empty).count() == 0


def check_packing(rows, placed, length=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for k, stop in enumerate(range(len(ids) % length or length, len(ids) + 1, length)):
            want[doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    places = defaultdict(list)
    for r in placed:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_packing(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9000, "a  b  c\n\n d \n e\t\tf  "), (9001, " 😀  x<|endoftext|> I'll ' s"), (9002, "no break   x"), (9003, "x " * 3000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    placed = packing.pack(docs).collect()
    used = check_packing([tuple(r) for r in docs.collect()], placed)
    assert used <= -(-sum(r.length for r in placed) // 1024) + 2
    proof = packing.certificates(packing.pack(docs)).collect()
    assert proof and sum(r.bins for r in proof) + sum(r.length == 1024 for r in placed) == used and all(r.bins >= r.bound > 0 for r in proof)
    rows = awkward.select("doc_id", "text").collect()
    check_packing([tuple(r) for r in rows], packing.pack(awkward).collect())
    assert packing.pack(empty).count() == 0
    whole = packing.sequences(odd).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in packing.pack(odd).collect())


def test_bounds_hold_and_gaps_are_repacked(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 1024, 60)
        bins, offsets, used = packing.best_fit_decreasing(lengths)
        assert packing.bin_bound(lengths) <= used and np.bincount(bins, lengths).max() <= 1024
    assert packing.bin_bound(np.array([513, 513, 513])) == 3
    assert packing.bin_bound(np.array([342, 342, 342, 342])) == 2
    rows = [(i, i, 0, int(n)) for i, n in enumerate(rng.integers(200, 700, 400))]
    small = spark.createDataFrame(rows, "doc_id long, row long, piece int, length long")
    placed = packing.place(small, piece_target=40).collect()
    assert len(placed) == 400 and max(Counter(r.sequence_id for r in placed).values()) > 1
    alone = packing.place(small, piece_target=40, rounds=1).select("sequence_id").distinct().count()
    assert len({r.sequence_id for r in placed}) <= alone


@pytest.fixture(scope="module")
def records(spark):
    pages = [
        (1, "http://a.example/x/", '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><script>var t="</p>";</script><p>One<br>two <b>th</b>ree</p><a href="../y?q=1&amp;r=2">l</a><a href=\'#z\'>z</a><a title=">" href=/y?q=1>k</a> a < b &eacute;</body></html>'),
        (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (None, "http://c.example/\r\nX: y", "plain"),
    ]
    return warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS block", "1 AS record_id")))


def test_derivatives(records):
    rows = records.collect()
    assert len(rows) == 10
    meta, text = ({r.record_type: r for r in rows if r.page_id == 1}[k] for k in ("metadata", "conversion"))
    assert text.block == "One\ntwo three\nlzk a < b é"
    assert "title: T & t\r\n" in meta.block and "outlink: http://a.example/y?q=1&r=2\r\n" in meta.block and meta.n_links == 3
    assert meta.refers_to == text.refers_to != meta.record_id and f"source-record-id: {meta.refers_to}\r\n" in meta.block
    assert "source-header: HTTP/1.1 200 OK\r\n" in meta.block and f"WARC-Refers-To: {meta.refers_to}\r\n" in text.headers
    assert all(r.block == "" for r in rows if r.record_type == "conversion" and r.page_id in (2, 3))
    assert all("\r\nX:" not in r.headers for r in rows)


class Reader(HTMLParser):
    """Text and links of a page by the standard library's parser."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.out, self.links, self.title, self.in_title = base, 0, [], {}, "", False

    def handle_starttag(self, tag, attributes):
        self.in_title = self.in_title or tag == "title"
        self.hidden += tag in ("script", "style", "noscript", "template", "head")
        if not self.hidden and tag == "a" and (link := dict(attributes).get("href")):
            self.links[" ".join(urljoin(self.base, link.strip()).split())] = None
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        self.hidden -= tag in ("script", "style", "noscript", "template", "head")
        self.out.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(data)


def test_pages_against_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = {(r.page_id, r.record_type): r for r in warc.derivatives(warc.responses(pages)).collect()}
    squeezed = lambda x: re.sub(r"\s+", "", x)
    for r in pages.collect():
        reader = Reader(r.url or "")
        reader.feed(r.html or "")
        reader.close()
        assert squeezed(made[r.page_id, "conversion"].block) == squeezed("".join(reader.out))
        meta = made[r.page_id, "metadata"].block
        assert [x[9:] for x in meta.split("\r\n") if x.startswith("outlink: ")] == list(reader.links)
        assert (f"title: {' '.join(reader.title.split())}\r\n" in meta) or not reader.title.strip()


def test_links_are_those_of_the_standard_library():
    base = "https://a.example:80/x/y?z#w"
    links = ["/p", "/p/q.html?a=1&b=2#f", "/p/../q", "/./p", "/p/.", "/p/.q", "//b.example/c", "http://c.example/d.e", "http://c.example", "http://c.example/a/../b", "/p?", "/p#", "/p;x", "q", "?q", "#q", "HTTP://c.example/", "/é", "/p//q", "/p?q#", "http://[x", "/p..q"]
    for link in links:
        try:
            want = [urljoin(base, link)]
        except ValueError:
            want = []
        assert warc.read_page(f'<a href="{link}">', base)[1] == want, link


def test_broken_pages_cost_no_more_than_their_length():
    began = time.perf_counter()
    for bad in ("<a ", "<script>", "<!--", '<a "<a" ', "<a '\"' <b \"'\"", "<title ", "<a href= ", '<div "x" ', "<!doctype ", "</a "):
        page = bad * (1_000_000 // len(bad))
        text, links = warc.read_page(page, "http://a.example/")
        assert not links and warc.page_title(page) == ""
    assert time.perf_counter() - began < 60
    assert warc.read_page("a <b c <i>d</i> e <!-- f", "")[0] == "a <b c d e <!-- f"


def test_warc_files_round_trip(spark, records):
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    warc.write_warc(records, path)
    got = warc.read_warc(spark, path).collect()
    want = sorted((r.record_id, r.block.encode()) for r in records.collect())
    assert sorted((r.headers["WARC-Record-ID"], bytes(r.block)) for r in got) == want


def record(block, **fields):
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_files_of_others(spark, tmp_path):
    """Header names in any case, repeated headers, binary and empty blocks, blocks that look like records, a member per record and one for all, plain files."""
    blocks = [bytes(range(256)) * 20, b"", b"WARC/1.0\r\ncontent-length: 3\r\n\r\nabc", b"\r\n\r\n", "é".encode() * 700_000]
    rows = [record(b, **{("Content_Length", "content_length", "CONTENT_LENGTH")[k % 3]: len(b), "warc_type": "resource", "X_Note": k}) for k, b in enumerate(blocks)]
    rows[1] = rows[1].replace(b"X-Note: 1", b"X-Note: 1\r\nx-note: again\r\nno colon")
    whole = b"".join(rows)
    for name, data in (("a.warc", whole), ("b.warc.gz", gzip.compress(whole)), ("c.warc.gz", b"".join(map(gzip.compress, rows))), ("d.warc", b""), ("e.warc", b"\r\n\r\n")):
        (tmp_path / name).write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.block) for r in got) == sorted(blocks * 3)
    notes = Counter(r.headers["X-Note"] for r in got)
    assert notes == {"0": 3, "1, again": 3, "2": 3, "3": 3, "4": 3} and all(r.headers["warc-type"] == "resource" for r in got)


@pytest.mark.parametrize(
    ("data", "why"),
    [
        (record(b"abc", content_length=9)[:-4], "inside of a record's block"), (b"WARC/1.1\r\ncontent-length: 3", "inside of a record's headers"), (record(b"abc", x=1), "no length"),
        (record(b"abc", content_length=1), "does not begin"), (gzip.compress(record(b"a" * 5000, content_length=5000))[:-9], "inside of a gzip member"),
    ],
)
def test_broken_warc_files_are_errors(spark, tmp_path, data, why):
    (tmp_path / "x.warc").write_bytes(data)
    with pytest.raises(Exception, match=why):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages)).count() == 0
