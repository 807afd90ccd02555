import hashlib
import json
import os
import random
import re
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.sources import code


def test_checksums_stream_through_batches(spark):
    rows = [(i, f"text {i}" if i % 11 else None, f"s{i % 3}" if i % 7 else None) for i in range(100)] + [(5, "again", "s2"), (None, "x", "s1"), (None, "y", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = {}
    for i, t, s in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())):
        want.setdefault(s, []) if t is None else want.setdefault(s, []).append(f"{i}\0{hashlib.sha256(t.encode()).hexdigest()}")
    want["only"] = []
    found = code.checksum(df, "doc_id", "text", "source")
    # No group is collected whole.
    assert "collect_list" not in found._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and {r.source: r.sha256 for r in got} == {s: hashlib.sha256("\0".join(x).encode()).hexdigest() for s, x in want.items()}
    assert code.checksum(df.limit(0), "doc_id", "text", "source").count() == 0


def keys_of(text):
    """Keys that the parser itself hands over, object by object."""
    seen = set()
    json.loads(text, object_pairs_hook=lambda pairs: seen.update(k for k, _ in pairs))
    return seen


def test_json_keys_are_those_of_the_parsed_value(spark):
    texts = [
        '{"a": {"b": [1, {"c": null}], "a": "x"}, "d":"e"}', '["x", ":y"]', '{"a\\u00e9": 1, "q\\"t": 2, "s\\\\": [":", "\\":"]}', "{}", "[]", '"only"', '{"": {" ": 1}, "k" : {"m"\n:2}}',
        json.dumps({"long": "v" * 1_000_000, "esc": "\\" * 200_000, "deep": [{"n" * 5000: ["a:"] * 1000}]}),
    ]
    began = time.perf_counter()
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.json_keys(F.col("t")).alias("k")).collect()
    assert time.perf_counter() - began < 30
    for r in got:
        assert sorted(r.k) == sorted(keys_of(texts[r.i]))


def test_method_names_on_plain_and_on_long_lines(spark):
    texts = [
        "public static int count(String s) {", "  private final Map<String, List<X>> of (", "return new Foo(", "class A {\n  protected   void run() {}\n  abstract T[] all(", "x.y(", "public Foo(",
        "static" + " " * 20_000 + "int far(", "static " * 5_000 + "int many(", "public" + "\n" * 5_000 + "static void lines(",
    ]
    # One modifier or blank at a time, as a loop that backtracks: the same names as the engine's own pattern.
    plain = re.compile(r"\b(?:public|protected|private|static|final|synchronized|abstract|native|\s)+[A-Za-z_][A-Za-z0-9_<>\[\], ?]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")
    began = time.perf_counter()
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", code.method_names(F.lit("a.java"), F.col("t")).alias("m")).collect()
    assert time.perf_counter() - began < 60
    for r in got:
        assert r.m == sorted(set(plain.findall(texts[r.i]))) if r.i < 6 else len(r.m) == 1


#: A modifier or a blank at a time, in a loop that backtracks.
PLAIN = re.compile(r"\b(?:public|protected|private|static|final|synchronized|abstract|native|\s)+[A-Za-z_][A-Za-z0-9_<>\[\], ?]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")


def test_method_names_of_random_sources(spark):
    """Pieces of sources in any order, with tabs, line ends, glued modifiers, digits and signs between them."""
    rng = random.Random(12)
    parts = ["public", "static", "privatefoo", "int", "Map<K, V>", "T[]", "?", "run", "a1", "9x", "_z", "(", ")", ";", "{", ",", ".", "é", " ", "  ", "\t", "\n", "\n    ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ["", "(", "a (", " a(", "é a(", "x a(", "x\na(", "publica b(", "x  y\tz ("]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", code.declared_methods(F.col("t")).alias("m")).collect()
    for r in got:
        assert r.m == PLAIN.findall(texts[r.i]), texts[r.i]


def test_long_lines_take_linear_time(spark):
    """Five million characters of words, with and without a parenthesis at their end, of blanks, of modifiers, and of blank lines."""
    words = "lorem ipsum dolor " * 60_000
    texts = [words, words + "last (", "x" + " " * 1_000_000 + "y(", "static " * 150_000 + "int f(", "\n" * 1_000_000 + "class A", "a b(" * 250_000]
    began = time.perf_counter()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    java = {r.i: r.m for r in df.select("i", code.method_names(F.lit("a.java"), F.col("t")).alias("m")).collect()}
    py = df.select("i", code.class_names(F.lit("a.py"), F.col("t")).alias("c"), code.method_names(F.lit("a.py"), F.col("t")).alias("m")).collect()
    assert java == {0: [], 1: ["last"], 2: [], 3: ["f"], 4: [], 5: []}
    assert {r.i: r.c for r in py if r.c} == {4: ["A"]} and not any(r.m for r in py)
    assert time.perf_counter() - began < 60


def test_ranges(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(code.id_ranges(F.col("t")).alias("x")).first().x
    assert one("1, 3-5,3,") == [1, 3, 4, 5, 3] and one("") == []
    with pytest.raises(Exception, match="invalid range"):
        one("5-3")


def test_sources_below_a_root_in_a_folder_of_a_skipped_name(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/test/pro.j"
    files = {"src/a/B.java": "package a.b;\nclass B { public int f() {} }", "test/T.java": "class T {}", "src/c.py": "def g():\n  pass", "src/d.txt": "no", "src/C.min.js": "x"}
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "w").write(content)
    for form in (root, root + "/", "file://" + root, "file:" + root):
        got = {r.file: r for r in code.read_sources(spark, form).collect()}
        assert set(got) == {"src/a/B.java", "src/c.py"}
        b = got["src/a/B.java"]
        assert (b.package, b.class_names, b.method_names, b.sha256) == ("a.b", ["B"], ["f"], hashlib.sha256(files["src/a/B.java"].encode()).hexdigest())
        assert got["src/c.py"].method_names == ["g"]
