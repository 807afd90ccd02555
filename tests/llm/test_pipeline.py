from collections import Counter

import corpus_pipeline
from tamarack.llm._common import drop_tables, scratch, shared_dir, stage, staged
from tamarack.llm.quality_rules import keep_good, quality_rules
from tests.conftest import SF
from tests.llm.test_dedup import LOWER, brute_components
from tests.llm.test_filters import base_counts


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, stage(apply(spark, docs, SF), "test")
        seen[name] = (before.collect(), docs.collect(), docs.columns)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(seen[k][2] == columns for k in list(seen)[:-1])
    before, after, _ = seen["quality rules"]
    for r in before:
        n, _, _, _, repeats = base_counts(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            assert r.doc_id not in {x.doc_id for x in after}
    before, after, _ = seen["exact dedup"]
    last = {}
    for r in before:
        key = r.text.translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after, _ = seen["near dedup"]
    assert {r.doc_id for r in after} == {c for _, c in brute_components([(r.doc_id, r.text) for r in before], 5).values()}
    before, after, _ = seen["mixing"]
    words = lambda rows: sum(base_counts(r.text)[0] for r in rows)
    assert abs(words(after) - words(before)) <= len({r.source for r in before})
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    before, after, _ = seen["packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_run_on_awkward_and_empty_tables(spark, awkward, empty, labels, tmp_path):
    """Nulls, ties, repeated rows and columns that clash with helpers' names; no documents at all; labels of documents that are not there."""
    extra = ["__position", "__words", "__page", "__maybe", "epoch", "nth", "own", "takes", "doc_", "text_sha256"]
    long = spark.createDataFrame([(k, " ".join(f"word{k}x{i}" for i in range(80)), "en", f"s{k % 2}", 9) for k in range(100, 130)], empty.schema)
    rows = awkward.select(*empty.columns).unionByName(long).selectExpr("*", *[f"'x' AS `{c}`" for c in extra])
    for name, docs in (("some", rows), ("none", rows.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.unionByName(spark.createDataFrame([(10**6 + k, k % 2, 0) for k in range(50)], labels.schema)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = docs
        for _, apply in corpus_pipeline.STAGES:
            kept = stage(apply(spark, kept, f"{tmp_path}/{name}"), "test")
            if "piece" not in kept.columns:
                assert kept.columns == docs.columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, out.drop("sequence_id", "offset").collect()), key=str) == sorted(map(tuple, kept.drop("sequence_id", "offset").collect()), key=str)
    assert kept.count() == 0


def test_quality_stage_keeps_what_the_rules_keep(spark, awkward, labels):
    """The same sample of labels, also where some belong to no document and few may be learnt from."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    more = known.unionByName(spark.createDataFrame([(10**6 + k, k % 2, 0) for k in range(500)], known.schema))
    verdict = {r.doc_id for r in quality_rules(docs, more, max_rows=60).filter("kept").collect()}
    assert {r.doc_id for r in keep_good(docs, more, max_rows=60).collect()} == verdict


def test_staged_tables_are_deleted(spark):
    folder = shared_dir(spark)
    with scratch(spark):
        path, kept = staged(stage(spark.range(5), "first").selectExpr("id + 1 AS id"), "second")
    assert kept.count() == 5
    left = [x.getPath().toString() for x in spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    assert any("tamarack-second" in x for x in left) and not any("tamarack-first" in x for x in left)
    drop_tables(spark, path)
