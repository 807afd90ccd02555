"""Rules as data, runs, appended records, streams, mini-benchmarks and supplements, against plain loops."""

import random
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluation, hybrid, rules, study
from tamarack.sources import records
from tamarack.streaming.scoring import score_stream
from tests.test_text import tokens

SIGNALS = "query_id long, project string, terms array<string>, files array<struct<rank:int,name:string,direct:boolean>>, top1 string, score_ratio double, n_direct int, first_direct_rank int, top1_direct boolean, cost_control boolean, reasons array<string>"


def signals(rng, n):
    names = [*rules.GENERIC_TOP_FILES[:2], *rules.CODE_OUTPUT_FILES, *rules.VALIDATOR_FILES[:1], "FunctionRewriter.java", "Other.java"]
    words = ["codeprinter", "code", "printer", "numeric", "keys", "illegalstateexception", "expected", "function", "call"]
    reasons = ["low_score_ratio<=1.02", "top1_without_direct_hint", "many_direct_hints>=7", "pattern:pass_chain", "pattern:type_system", "pattern:type_cycle", "pattern:state_reset",
               "pattern:mockito_generic", "pattern:mockito_injection", "pattern:mockito_constructor_real_method", "pattern:mockito_invocation_varargs", "pattern:closure_code_output"]
    rows = []
    for k in range(n):
        files = [(r, rng.choice(names), rng.random() < 0.5) for r in range(1, rng.choice([1, 8, 40]))]
        rows.append((k, rng.choice(["closure", "closure", "lang", None]), rng.sample(words, rng.randint(0, 9)), files, files[0][1] if files else None, rng.choice([None, 1.0, 1.05, 1.09, 1.2, 1.5]),
                     rng.choice([0, 3, 7, 9]), rng.choice([None, 1, 2, 3, 9]), rng.choice([True, False]), rng.choice([True, False]), rng.sample(reasons, rng.randint(0, 12))))
    return rows


def patterns(row):
    _, project, terms, files, top1, ratio, *_ = row
    if project != "closure":
        return []
    terms, upto = set(terms), lambda low, high: {n for r, n, _ in files if low <= r <= high}
    direct = lambda low, high: {n for r, n, d in files if d and low <= r <= high}
    generic = set(rules.GENERIC_TOP_FILES)
    found = [
        ("pattern:closure_code_output", ("codeprinter" in terms or {"code", "printer"} <= terms) and upto(1, 20) & set(rules.CODE_OUTPUT_FILES) and (ratio is None or ratio >= 1.15)),
        ("pattern:closure_deep_specific_direct_hint", direct(6, 20) - generic and top1 in generic and (ratio is None or ratio <= 1.08)),
        ("pattern:closure_code_generator_output", top1 == "CodePrinter.java" and "CodeGenerator.java" in upto(1, 20) and terms & {"numeric", "key", "keys"} and (ratio is None or ratio <= 1.05)),
        ("pattern:closure_validator_transform_failure", top1 in rules.VALIDATOR_FILES and "FunctionRewriter.java" in direct(6, 35) and {"illegalstateexception", "expected", "function", "call"} <= terms),
    ]
    return [name for name, holds in found if holds]


def controlled(row):
    ratio, n, first, direct, _, reasons = row[5:]
    low = [r for r in reasons if r.startswith("low_score")] if not direct else []
    conditions = {
        "top1_without_direct_hint": not direct and (first is None or first >= 3), "many_direct_hints>=7": n >= 7, "pattern:pass_chain": not direct or n >= 7 or (ratio is not None and ratio >= 1.4),
        "pattern:type_system": not direct or ratio is None or ratio <= 1.1, "pattern:type_cycle": not direct, "pattern:closure_code_output": True,
    }
    return low + [r for r, holds in conditions.items() if r in reasons and holds]


def tight(row):
    ratio, n, _, direct, cost, reasons = row[5:]
    mockito = [r for r in reasons if r.startswith("pattern:mockito_")]
    out = [r for r in reasons if r not in mockito and r != "pattern:type_cycle"] + ([] if direct else mockito)
    more = [("pattern:mockito_generic", n >= 7), ("pattern:mockito_constructor_real_method", n >= 7 and ratio is not None and ratio <= 1.1), ("pattern:mockito_invocation_varargs", n >= 7 and cost),
            ("pattern:mockito_injection", True), ("pattern:type_cycle", not direct or ratio is None or ratio <= 1.02)]
    return list(dict.fromkeys(out + [r for r, holds in more if holds and r in reasons]))


def test_rules_against_a_loop(spark):
    rows = signals(random.Random(2), 4000)
    df = spark.createDataFrame(rows, SIGNALS)
    found = rules.kept_reasons(rules.kept_reasons(rules.pattern_reasons(df).withColumn("tight", F.col("reasons")), rules.COST_CONTROL), rules.TIGHT_PATTERNS, "tight")
    got = {r.query_id: (r.patterns, r.reasons, r.tight) for r in found.collect()}
    want = {r[0]: (patterns(r), controlled(r), tight(r)) for r in rows}
    assert got == want
    assert {p for x, _, _ in want.values() for p in x} >= {r.reason for r in rules.PATTERN_RULES}


def test_semantic_terms_against_a_loop(spark):
    rng = random.Random(5)
    words = ["state", "loading", "button", "cycle", "spy", "usd", "other", "type"]
    pairs = []
    for k in range(120):
        names = [rng.choice(["resetSeed", "copyOf", "isLoading", "resolveType", "mockSettings", "Plain", "formatCurrency"]) for _ in range(rng.randint(0, 3))]
        pairs.append((k, rng.choice(["a/B.java", "org/Mockito/C.java", "web/x.tsx", "web/state.js"]), rng.sample(words, rng.randint(0, 4)), names[:1], names[1:] or None, rng.choice([None, "total price random", "z " * 3000 + "handle"])))
    df = spark.createDataFrame(pairs, "query_id long, file string, query_terms array<string>, methods array<string>, classes array<string>, text string")
    want = {}
    for k, file, query, methods, classes, text in pairs:
        wanted = set()
        for rule in rules.TERM_RULES:
            fits = set(query) & set(rule.asked) and (not rule.context or set(query) & set(rule.context)) and rule.inside in file.lower() and (not rule.ends or file.endswith(rule.ends))
            wanted |= set(rule.terms) if fits else set()
        names = methods + (classes or [])
        found = wanted & set(tokens(" ".join([*names, file, (text or "")[:4000]])))
        for name in names:
            if set(tokens(name)) & wanted:
                found |= {*tokens(name), name.lower()}
        if found:
            want[k] = sorted(found)
    assert {r.query_id: r.terms for r in rules.semantic_terms(df).collect()} == want and want


def test_common_packages_against_the_fold(spark):
    rng = random.Random(1)
    rows = [(g, i, ".".join(rng.choice(["a", "b"][: rng.randint(1, 2)]) for _ in range(rng.randint(0, 6))) or rng.choice(["", None])) for g in range(60) for i in range(rng.randint(1, 6))]
    rows += [(100, i, f"org.app.x{i % 2}.y") for i in range(4)] + [(101, 0, "one"), (102, 0, None)]
    want = {}
    for g in {r[0] for r in rows}:
        every = [p.split(".") for k, _, p in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) if p]
        prefix = every[0] if every else []
        for parts in every[1:]:
            n = next((i for i, (a, b) in enumerate(zip(prefix, parts)) if a != b), min(len(prefix), len(parts)))
            prefix = prefix[:n]
            if n <= 2:
                break
        want[g] = ".".join(prefix)
    df = spark.createDataFrame(rows, "g int, i int, p string").repartition(3)
    assert {r.g: r.package for r in hybrid.common_packages(df, "g", "i", "p").collect()} == want


def test_runs_from_their_files(spark, tmp_path):
    runs = spark.createDataFrame([("a", 90.5), ("b", 1.0)], "run string, seconds double")
    files = spark.createDataFrame([("a", "x", datetime(2024, 5, 1, 12), "1"), ("a", "y", datetime(2024, 5, 1, 13), None)], "run string, path string, modified timestamp, sha256 string")
    got = {r.run: r for r in records.run_rows(runs, files).collect()}
    assert (got["a"].n_files, got["a"].missing, got["b"].n_files, got["b"].missing, got["b"].started) == (2, False, 0, True, None)
    assert (got["a"].finished - got["a"].started).total_seconds() == 90.5
    (tmp_path / "f.txt").write_text("abc")
    assert [(r.size, r.sha256[:8]) for r in records.file_rows(spark, str(tmp_path)).collect()] == [(3, "ba7816bf")]


def test_appended_records_are_written_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    rows = lambda *ids: spark.createDataFrame([(i, f"v{k}") for k, i in enumerate(ids)], "id long, v string")
    assert {r.id for r in records.append_new(rows(1, 2, 2), folder, "id").collect()} == {1, 2}
    assert {r.id for r in records.append_new(rows(2, 3), folder, "id").collect()} == {3}
    assert records.append_new(rows(1, 3), folder, "id").count() == 0
    assert sorted((r.id, r.v) for r in spark.read.parquet(folder).collect()) == [(1, "v0"), (2, "v1"), (3, "v1")]


def test_a_stream_that_stops_and_starts_ranks_each_query_once(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red hen"), ("c", "blue cat")], "file string, text string")
    put = lambda n, *rows: spark.createDataFrame(rows, "query_id long, text string").coalesce(1).write.json(f"{base}/in/{n}")
    read = lambda: spark.readStream.schema("query_id long, text string").option("recursiveFileLookup", "true").json(f"{base}/in")
    put(1, (1, "red"), (2, "cat"))
    score_stream(read(), docs, f"{base}/out", f"{base}/one", k=2).awaitTermination()
    put(2, (3, "hen"), (2, "cat"))
    score_stream(read(), docs, f"{base}/out", f"{base}/one", k=2).awaitTermination()
    first = sorted((r.query_id, r.rank, r.file) for r in spark.read.parquet(f"{base}/out").collect())
    assert first == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "a"), (3, 1, "b"), (3, 2, "a")]
    # A lost checkpoint: all input comes again, and nothing is ranked again.
    score_stream(read(), docs, f"{base}/out", f"{base}/two", k=2).awaitTermination()
    assert sorted((r.query_id, r.rank, r.file) for r in spark.read.parquet(f"{base}/out").collect()) == first


def test_a_case_without_predictions_fails(spark):
    cases = spark.createDataFrame([(1, "s"), (2, "s"), (1, "t")], "query_id long, source string")
    predictions = spark.createDataFrame([("s", 1, 60, "a"), ("s", 1, 70, "b"), ("s", 2, 1, "a"), ("t", 1, 2, "b")], "source string, query_id long, rank int, file string")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "query_id long, file string")
    got = sorted(tuple(r) for r in study.mini_benchmark(cases, predictions, truth).collect())
    assert got == [(1, "s", 60, False), (1, "t", 2, True), (2, "s", None, False)]
    with pytest.raises(Exception, match="9 is not in s"):
        study.mini_benchmark(spark.createDataFrame([(9, "s")], cases.schema), predictions, truth).collect()


def test_a_selected_query_without_a_rerank_record_fails(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "query_id long, rank int, file string")
    other = spark.createDataFrame([(1, 1, "z")], base.schema)
    chosen = base.select("query_id")
    with pytest.raises(Exception, match="no rerank record of 2"):
        evaluation.merge(base, other, chosen).collect()
    assert sorted(tuple(r) for r in evaluation.merge(base, other, chosen, allow_missing=True).collect()) == [(1, 1, "z", "rerank"), (2, 1, "b", "baseline")]


def test_best_documents_are_those_of_all_scores(spark):
    """The floor and light terms change no rank, with ties, repeated query terms, and terms that nearly all documents have."""
    from tamarack.operators import bm25

    rng = random.Random(7)
    common, scarce = ["the", "of", "and"], [f"w{k}" for k in range(60)]
    docs = [(f"d{k:04d}", " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(scarce, k=rng.randint(0, 6)))) for k in range(700)]
    docs += [(f"e{k}", docs[k][1]) for k in range(40)]
    queries = [(q, " ".join(rng.choices(common, k=4) + rng.choices(scarce, k=rng.randint(0, 4)))) for q in range(25)] + [(90, ""), (91, "absent"), (92, "w1 absent")]
    d, q = spark.createDataFrame(docs, "file string, text string"), spark.createDataFrame(queries, "query_id long, text string")
    every = bm25.scores(q, d).collect()
    for k in (1, 5):
        want = {}
        for i, _ in queries:
            found = {r.file: r.score for r in every if r.query_id == i}
            pool = {f: 0.0 for f, _ in sorted(docs)[:k]} | found
            want[i] = sorted(pool.items(), key=lambda x: (-x[1], x[0]))[:k]
        for bounded in (False, True):
            rows = bm25.rank(q, d, k=k, bounded=bounded).collect()
            assert {i: [(r.file, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] for i, _ in queries} == want
    assert bm25.best(bm25.index(q, d), 1).count() < len(every)
