import random
import re
import time
from itertools import groupby

from pyspark.sql import functions as F

from tamarack.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def tokens(text):
    out = []
    for raw in re.findall("[A-Za-z0-9]+", text):
        out.append(raw.lower())
        out += [p.lower() for p in re.split("(?<=[a-z0-9])(?=[A-Z])", raw) if p.lower() != raw.lower()]
    return out


def test_tokens(spark):
    for x in ("fooBarXMLHttp2Go a.b$C", "", "plain words Éa", "aB aB"):
        assert one(spark, T.tokenize(F.col("t")), t=x) == tokens(x)


def test_split_camel(spark):
    assert one(spark, T.split_camel(F.col("t")), t="fooBar_bazQux2Go") == ["foo", "Bar", "baz", "Qux2", "Go"]


def test_lines(spark):
    for x in ("a\r\nb\rc", "x\x1cy\x85z", "a\n\n", "", "\n", "a"):
        assert one(spark, T.lines(F.col("t")), t=x) == x.splitlines()


def test_runtime_context(spark):
    trace = "--- a::b\njava.lang.X: no\n  at java.util.List.get(L.java)\n\n\tat org.app.A.b(A.java:1)\nat jdk.internal.X.y(Z)"
    assert one(spark, T.runtime_context(F.col("t")), t=trace) == "--- a::b\njava.lang.X: no\nat org.app.A.b(A.java:1)"


def test_compact_trace(spark):
    trace = "m\n" + "\tat a.B.c(D)\n" * 5 + "z\nz"
    assert one(spark, T.compact_trace(F.col("t")), t=trace) == "m\n" + "\tat a.B.c(D)\n" * 3 + "\t... repeated identical frame omitted 2 time(s)\nz\nz"
    assert one(spark, T.compact_trace(F.col("t"), max_chars=1), t="abc") == "a\n...[stack trace truncated]"


def compacted(rows, most):
    out = []
    for line, run in groupby(enumerate(rows), key=lambda x: (x[1], None if x[1].strip().startswith("at ") else x[0])):
        n = len(list(run))
        out += [line[0]] * min(n, most) + ([f"\t... repeated identical frame omitted {n - most} time(s)"] if n > most else [])
    return "\n".join(out)


def test_compact_traces_against_runs(spark):
    rng = random.Random(7)
    traces = [[rng.choice(["at a.B.c(D)", "  at a.B.c(D)", "at x.y(z)", "why", "", "--- t::u"]) for _ in range(rng.randint(1, 900)) for _ in range(rng.choice([1, 1, 2, 6]))] for _ in range(20)]
    df = spark.createDataFrame([(k, "\n".join(t) + "\n") for k, t in enumerate(traces)], "k int, t string")
    for r in df.select("k", T.compact_trace(F.col("t"), max_chars=10**7).alias("x")).collect():
        assert r.x == compacted(traces[r.k], 3)


def test_long_traces_take_linear_time(spark):
    """Half a million lines: frames that differ, and one frame over and over."""
    texts = ["\n".join(f"at a.B.c(D:{k})" for k in range(500_000)), "at a.B.c(D)\n" * 500_000]
    began = time.perf_counter()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.compact_trace(F.col("t")).alias("x")).collect()
    assert sorted(len(r.x) for r in got) == [len(compacted(['at a.B.c(D)'] * 500_000, 3)), 60_000 + 27]
    assert time.perf_counter() - began < 60


def test_focused_trace(spark):
    trace = "--- a::b\nx\n--- c::d\ny\nz"
    assert one(spark, T.focused_trace(F.col("t"), F.array(F.lit("c::d"))), t=trace) == "--- c::d\ny\nz"
    assert one(spark, T.focused_trace(F.col("t"), F.array(F.lit("none"))), t=trace) == trace


def test_names(spark):
    assert one(spark, T.simple_name(F.col("t")), t="a.b.C$D") == "C"
    assert one(spark, T.strip_test_suffix(F.col("t")), t="FooTestCase") == "Foo"
    assert one(spark, T.strip_test_suffix(F.col("t")), t="Test") is None
    assert one(spark, T.source_hint(F.col("t")), t="TestFoo_Bar") == "Foo"


def test_json_object(spark):
    assert one(spark, T.json_object(F.col("t")), t='say {"a": 1} end') == '{"a": 1}'
    assert one(spark, T.json_object(F.col("t")), t="[1]") is None
    assert one(spark, T.json_object(F.col("t")), t="{bad") is None


def test_truncate_and_window(spark):
    assert one(spark, T.truncate_text(F.col("t"), 20), t="x" * 21) == "xxxxx ...[truncated]"
    code = "a\nb\npublic void run() {\n1\n2\n3"
    assert one(spark, T.method_window(F.col("t"), F.lit("run"), 3), t=code) == "b\npublic void run() {\n1\n2"
    assert one(spark, T.method_window(F.col("t"), F.lit("absent"), 3), t=code) == ""
