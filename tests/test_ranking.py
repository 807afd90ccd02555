import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack.operators import bm25, contexts, evaluation, hybrid, rerank
from tests.test_text import tokens


def test_bm25_against_a_loop(spark):
    rng = random.Random(3)
    docs = [(f"f{i:02d}", " ".join(rng.choice("abcdeXyZ") + rng.choice("abQ") for _ in range(rng.randint(0, 30)))) for i in range(25)]
    queries = [(1, "ab aa ab"), (2, "zzz"), (3, "cQ yb")]
    got = {(r.query_id, r.rank): (r.file, r.score) for r in bm25.rank(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(docs, "file string, text string"), k=7).collect()}
    own = {f: tokens(t) for f, t in docs}
    mean = sum(map(len, own.values())) / len(own)
    df = Counter(t for x in own.values() for t in set(x))
    for q, text in queries:
        scores = []
        for f, x in own.items():
            tf, s = Counter(x), 0.0
            for t in tokens(text):
                if tf[t]:
                    s += math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / mean))
            scores.append((-round(s, 6), f))
        for k, (s, f) in enumerate(sorted(scores)[:7], 1):
            assert got[q, k][0] == f and abs(got[q, k][1] + s) < 2e-6


def test_retention_is_the_slot_scan(spark):
    rng = random.Random(5)
    for trial in range(6):
        n, k = 12, rng.choice([3, 5])
        rows = [(1, i + 1, f"f{i:02d}", float(n - i), rng.random() < 0.4) for i in range(n)]
        pool, outside = rows[:k], [r for r in rows[k:] if r[4]]
        for new in outside:
            free = [i for i, r in enumerate(pool) if not r[4]]
            if not free:
                break
            pool[free[-1]] = new
        want = [r[2] for r in sorted(pool, key=lambda r: (-r[3], r[2]))]
        df = spark.createDataFrame(rows, "query_id int, rank int, file string, total double, kept boolean")
        got = hybrid.retain(df, k=k, protected="kept").orderBy("rank").collect()
        assert [r.file for r in got] == want, trial


def test_common_package(spark):
    def of(*packages):
        rows = spark.createDataFrame([(0, -1, "")] + [(0, i, p) for i, p in enumerate(packages)], "g int, i int, p string")
        return hybrid.common_packages(rows, "g", "i", "p").first().package

    assert of("a.b.c.d", "a.b.c.e") == "a.b.c"
    assert of("a.b.c", "x.y", "a.b") == ""
    assert of("a.b", "x.y") == ""
    assert of("", "q.r.s") == "q.r.s"
    assert of() == ""
    assert of("a.b.c", "a.b.d", "x.y") == "a.b"


def test_complete_output(spark):
    output = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (1, 3, "b"), (1, 4, "a")], "query_id int, position int, file string")
    pool = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "query_id int, place int, file string")
    got = rerank.complete(output, pool, depth=3).orderBy("rank").collect()
    assert [(r.file, r.source) for r in got] == [("b", "llm"), ("a", "llm"), ("c", "fallback")]
    c = rerank.output_counters(output, pool, depth=3).first()
    assert (c.returned, c.valid, c.invalid, c.duplicates, c.added) == (4, 2, 1, 1, 1)


def test_published_statistics(spark):
    p = lambda b, c: spark.range(1).select(evaluation.mcnemar(F.lit(b), F.lit(c)).alias("p")).first().p
    assert p(0, 0) == 1.0 and abs(p(2, 0) - 0.5) < 1e-12 and abs(p(1, 0) - 1.0) < 1e-12
    assert abs(p(7, 2) - 2 * sum(math.comb(9, i) for i in range(3)) / 2**9) < 1e-12
    for n, want in ((1, 0.3173), (2, 0.1797)):
        deltas = spark.createDataFrame([(0.5 + i,) for i in range(n)] + [(0.0,)], "delta double")
        row = evaluation.wilcoxon_sums(deltas).withColumn("p", evaluation.normal_tail(F.col("z"))).first()
        assert row.n == n and abs(row.p - want) < 1e-4


def test_summary_of_one_and_of_misses(spark):
    per = spark.createDataFrame([("m", 1, None, 0.0)], "method string, query_id int, correct_rank int, rr double")
    row = evaluation.summarize(per, ["method"], depth=10).first()
    assert (row.n, row.misses, row.rr_sd, row.rank_median, row.hits_10) == (1, 1, 0.0, 11.0, 0)


def test_recall_is_null_beyond_the_depth(spark):
    per = spark.createDataFrame([(1, 12), (2, None)], "query_id int, correct_rank int")
    got = {r.k: (r.hits, r.recall) for r in evaluation.recall_curve(per, [10, 20, 100], max_depth=50).collect()}
    assert got == {10: (0, 0.0), 20: (1, 0.5), 100: (None, None)}


def test_boosts_lift_documents_from_any_rank_by_any_of_their_words(spark, tmp_path):
    from tamarack.jobs import catalog

    rng = random.Random(6)
    words = [f"w{k:03d}" for k in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(70)]
    # Short documents that hold one query term often rank above the long one, whose hints come after 200 other words.
    docs += [(100 + i, "alpha " * 5 + f"x{i}") for i in range(60)]
    docs += [(200, " ".join(rng.choice(words) for _ in range(200)) + " " + "alpha bravo charlie delta echo_ foxtrot golfer"), (201, None)]
    items = [(1, "alpha bravo charlie delta echo foxtrot golfer of it"), (2, "unheard"), (3, words[0] + " " + words[1])]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = spark.createDataFrame(items, "query_id long, text string")
    files = spark.createDataFrame([(f"doc/{i:09d}", t) for i, t in docs], "file string, text string")
    score = {(r.query_id, r.file): r.score for r in bm25.scores(asked, files).collect()}
    boosts = {(r.query_id, r.file): r for r in catalog.QUERIES["R10_R11_boosts"](spark, str(tmp_path)).collect()}
    ranked = {(r.query_id, r.rank): (r.file, r.total) for r in catalog.QUERIES["R13_hybrid_rank"](spark, str(tmp_path)).collect()}
    around = contexts.test_contexts(*catalog._tests(spark, str(tmp_path)), context=9, head=5).withColumnRenamed("context", "text")
    context = {(r.query_id, r.file): r.score for r in bm25.scores(around, files).collect()}
    assert len({q for q, _ in context}) == 3
    for q, text in items:
        terms, totals = {t for t in tokens(text) if len(t) >= 4}, []
        for i, t in docs:
            file, both = f"doc/{i:09d}", sorted(terms & set(tokens(t or "")))
            if (q, file) in score:
                r = boosts[q, file]
                assert (r.direct_boost, r.identifier_boost) == (90.0 * len(both), min(32.0, 4.0 * len(both)))
                assert r.reasons == "|".join(f"direct_class_hint:{h}" for h in both)
            totals.append((-round(score.get((q, file), 0.0) + 0.55 * context.get((q, file), 0.0) + 90.0 * len(both) + min(32.0, 4.0 * len(both)), 6), file))
        for k, (total, file) in enumerate(sorted(totals)[:10], 1):
            assert ranked[q, k][0] == file and abs(ranked[q, k][1] + total) < 2e-6
    assert ranked[1, 1][0] == "doc/000000200" and boosts[1, "doc/000000200"].direct_boost == 630.0


def test_mcnemar_against_exact_tails(spark):
    """Exact fractions for all small counts; large ones, near and far from even, against logarithms of binomials."""
    from fractions import Fraction

    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, float(2 * sum(Fraction(math.comb(n, i), 2**n) for i in range(k + 1)))) if n else 1.0

    pairs = [(b, c) for b in range(0, 40, 3) for c in range(0, 60, 7)] + [(500, 500), (500, 430), (1, 900), (700, 1400), (2, 2)]
    df = spark.createDataFrame([*pairs, (10**9, 10**9 + 10**5), (5 * 10**6, 5 * 10**6)], "b long, c long")
    got = {(r.b, r.c): r.p for r in df.select("b", "c", evaluation.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()}
    assert all(got[p] == pytest.approx(exact(*p), rel=1e-9, abs=1e-15) for p in pairs)
    assert got[5 * 10**6, 5 * 10**6] == 1.0
    z = (10**5 - 1) / math.sqrt(2 * 10**9 + 10**5)
    assert got[10**9, 10**9 + 10**5] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def random_texts(seed, n_docs=40, n_queries=6):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["alpha", "betaB", "Gamma", "of", "to", "delta", "zeta", "x1"]) + rng.choice(["", "s", "er"]) for _ in range(n))
    return [(i, text(rng.randint(0, 5))) for i in range(n_queries)], [(i, text(rng.randint(0, 9))) for i in range(n_queries)], [(f"f{i:02d}", text(rng.randint(0, 25)) if i % 7 else None) for i in range(n_docs)]


def test_pairs_are_summed_where_documents_are(spark):
    queries, others, docs = random_texts(4)
    asked, around = (spark.createDataFrame(x, "query_id int, text string") for x in (queries, others))
    files = spark.createDataFrame(docs, "file string, text string")
    rows = bm25.two_scores(asked, around, files, least=4)
    plan = rows._jdf.queryExecution().toString()
    assert "hashpartitioning(file" in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(word" not in plan
    first, second = ({(r.query_id, r.file): r.score for r in bm25.scores(q, files).collect()} for q in (asked, around))
    own = {f: set(tokens(t or "")) for f, t in docs}
    want = {(q, f): (first.get((q, f), 0.0), second.get((q, f), 0.0), sum(len(x) >= 4 for x in own[f] & set(tokens(dict(queries)[q])))) for q, f in {*first, *second}}
    got = {(r.query_id, r.file): (r.score, r.context, r.n_own) for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 2e-6 for k in want for a, b in zip(got[k], want[k]))


def test_totals_end_in_a_five(spark):
    got = spark.createDataFrame([(0.0000005,), (444.107197 * 0.55,), (2137.1373495,)], "x double").select(hybrid.six_places(F.col("x"))).collect()
    assert [r[0] for r in got] == [math.floor(x * 1e6 + 0.5) / 1e6 for x in (0.0000005, 444.107197 * 0.55, 2137.1373495)]
