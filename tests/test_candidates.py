import pytest
from pyspark.sql import functions as F

from tamarack.operators import candidates, evidence
from tamarack.sources import records


def window(text, start, end, most):
    """The lines whose numbers lie in the range that is asked for, from its first one on; a range behind the file is its last line."""
    if text is None:
        return False, None, None, None
    numbered = list(enumerate(text.splitlines(), 1))
    if not numbered:
        return True, 1, 0, ""
    asked = range(max(1, start), max(max(1, start), end) + 1)[:most]
    inside = [(i, x) for i, x in numbered if i in asked] or numbered[-1:]
    return True, inside[0][0], inside[-1][0], "\n".join(f"{i}: {x}" for i, x in inside)


def test_windows_against_a_loop(spark):
    texts = {"a": "one\ntwo\r\nthree\n\nfive", "b": "", "c": "x\n" * 30}
    asked = [(q, f, s, e) for q, f in enumerate(("a", "b", "c", "none")) for s in (-3, 1, 2, 5, 40) for e in (-1, 1, 4, 90)]
    rows = spark.createDataFrame([(i, f, s, e) for i, (_, f, s, e) in enumerate(asked)], "query_id long, file string, start_line int, end_line int")
    sources = spark.createDataFrame(list(texts.items()), "file string, text string")
    got = {r.query_id: (r.ok, r.start_line, r.end_line, r.content) for r in candidates.windows(rows, sources, most=7).collect()}
    assert got == {i: window(texts.get(f), s, e, 7) for i, (_, f, s, e) in enumerate(asked)}


def test_briefs_leave_out_unknown_files_and_cut_names(spark):
    ranked = spark.createDataFrame([(1, 1, "x", 3.0), (1, 2, "gone", 2.0), (1, 3, "y", 1.0), (1, 4, "z", 0.0)], "query_id long, rank int, file string, score double")
    names = [f"n{i:02d}" for i in range(50)]
    sources = spark.createDataFrame([(f, "p", names, names[: 9 if f == "y" else 50], "") for f in "xyz"], "file string, package string, classes array<string>, methods array<string>, text string")
    shown = candidates.briefs(ranked, sources, top=3, names=candidates.AGENT)
    assert {(r.rank, r.file, len(r.class_names), len(r.method_names)) for r in shown.collect()} == {(1, "x", 8, 20), (3, "y", 8, 9)}
    assert sorted((r.position, r.file) for r in candidates.dry_run(shown).collect()) == [(1, "x"), (2, "y")]


def test_dotted_class_names_are_hints(spark):
    trace = "expected org.app.util.Reader$Inner but org.app.ReaderTest\n org.other.Writer, Org.app.Nothing org.app.Main " + "a." * 20_000
    row = spark.range(1).select(evidence.direct_hints(F.array().cast("array<string>"), F.lit(trace), "org.app").alias("h")).first()
    assert row.h == ["Reader"]


def test_lookup_reports_or_fails(spark):
    rows, wanted = spark.createDataFrame([(1, "a")], "id long, x string"), spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert sorted((r.id, r.x, r.found) for r in records.lookup(rows, wanted, "id").collect()) == [(1, "a", True), (2, None, False)]
    with pytest.raises(Exception, match="2 is not listed"):
        records.lookup(rows, wanted, "id", strict=True).collect()


def test_manifest_without_parts(spark):
    manifest = spark.createDataFrame([("d", None, [("m", ["p", "p"])], ["q"]), ("e", ["p"], None, None)], "dataset string, bugs array<string>, methods array<struct<name:string,paths:array<string>>>, selection array<string>")
    files = spark.createDataFrame([("p",)], "path string")
    got = sorted(tuple(r) for r in records.manifest_rows(manifest, files).collect())
    assert got == [("d", "method:m", "p", True), ("d", "method:m", "p", True), ("d", "selection", "q", False), ("e", "bugs", "p", True)]


def test_csv_rows(spark, tmp_path):
    (tmp_path / "bugs.csv").write_text('bug.id,note\n1,"a,b"\n2,\n')
    assert [tuple(r) for r in records.read_bugs(spark, str(tmp_path / "bugs.csv")).collect()] == [("1", "a,b"), ("2", None)]
