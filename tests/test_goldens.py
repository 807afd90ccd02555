"""Metrics, paired tables, costs and variance on published figures: ranks of first correct files, and what was reported of them."""

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluation, study

# Published ranks, None for a miss.
FIRST_19 = [8, 1, 4, 8, 1, 48, 1, 1, 14, 1, 12, 4, 1, 21, 18, 8, 1, 1, 1]
SECOND_19 = [2, 1, 2, 2, 1, 4, 2, 34, 1, 11, 16, 1, 6, 2, 1, 1, None, 34, 50]
MERGED = [8, 1, 2, 8, 1, None, 1, 1, 3, 1, 1, 4, 1, None, 1, 1, 1, 1, 1, 2, 2, 1, 2, 1, 4, 2, None, 1, None, 1, 1, 6, 1, 1, 1, None, None, 1]
#: Eleven selected cases: the baseline and three variants, with mean RR and hits at 1, 3, 5 and 10.
ABLATION = {
    "baseline": ([None, 4, 1, None, None, None, 8, 1, 2, None, 2], 0.3068, (0.1818, 0.3636, 0.4545, 0.5455)),
    "metadata": ([1, 3, 1, 3, 2, 1, 2, 3, 1, 1, 2], 0.6818, (0.4545, 1.0, 1.0, 1.0)),
    "reasons": ([1, 5, 1, 3, 1, 1, 3, 3, 1, 1, 1], 0.7455, (0.6364, 0.9091, 1.0, 1.0)),
    "full": ([1, 2, 1, 5, 3, 1, 1, 3, 2, 1, 1], 0.7152, (0.5455, 0.9091, 1.0, 1.0)),
}
MINI = {
    "baseline": ([47, 17, 49, 39, 8, 48, 21, None, 7, 14], 0.0534, (0.0, 0.0, 0.0, 0.2)),
    "one-shot": ([9, 1, 5, 3, 1, 2, 2, None, 1, 1], 0.5644, (0.4, 0.7, 0.8, 0.9)),
    "agentic": ([None, 1, 8, 7, 1, 2, 2, None, 1, 2], 0.4768, (0.3, 0.6, 0.6, 0.8)),
}
#: dataset, setting, calls, tokens, seconds, hits at 1, 3, 5, 10 and mean RR.
COSTS = [
    ("a", "retrieval", 0, 0, 0.0, 0.39473684210526316, 0.5263157894736842, 0.6052631578947368, 0.7105263157894737, 0.49451754385964913),
    ("a", "full", 38, 1420902, 706.71, 0.7368421052631579, 0.9210526315789473, 0.9736842105263158, 0.9736842105263158, 0.8219298245614035),
    ("a", "selective", 11, 408568, 178.838, 0.5526315789473685, 0.7105263157894737, 0.7631578947368421, 0.8421052631578947, 0.6513157894736842),
    ("b", "retrieval", 0, 0, 0.0, 0.7, 0.95, 0.95, 0.95, 0.8166666666666667),
    ("b", "full", 20, 652313, 395.424, 0.9, 1.0, 1.0, 1.0, 0.95),
    ("b", "selective", 3, 106016, 48.862, 0.8, 1.0, 1.0, 1.0, 0.8916666666666666),
    ("c", "retrieval", 0, 0, 0.0, 0.5666666666666667, 0.8333333333333334, 0.9166666666666666, 0.9333333333333333, 0.6976587301587301),
    ("c", "full", 60, 1867359, 1151.842, 0.8833333333333333, 0.9833333333333333, 1.0, 1.0, 0.9263888888888889),
    ("c", "selective", 16, 519530, 336.034, 0.7, 0.95, 0.9666666666666667, 0.9666666666666667, 0.8116666666666668),
]
#: dataset, the share of the gain that stays for the five metrics, and what is saved of calls, tokens and seconds.
RETENTION = {
    "a": ((0.46153846153846173, 0.46666666666666673, 0.42857142857142866, 0.4999999999999998, 0.47890154052243794), (0.7105263157894737, 0.7124587058080009, 0.7469428761443873)),
    "b": ((0.5, 1.0, 1.0, 1.0, 0.5625), (0.85, 0.8374767957141082, 0.8764313749291899)),
    "c": ((0.4210526315789473, 0.7777777777777777, 0.6, 0.5, 0.4984385843164473), (0.7333333333333334, 0.7217835456385194, 0.7082638070151981)),
}
REPEATS = {
    "top_1": ([0.5526315789473685, 0.5263157894736842, 0.5263157894736842, 0.5789473684210527, 0.5263157894736842], (0.5421052631578948, 0.023537557657892554, 0.5263157894736842, 0.5789473684210527)),
    "top_3": ([0.7105263157894737, 0.6578947368421053, 0.7105263157894737, 0.7105263157894737, 0.6578947368421053], (0.6894736842105263, 0.028827503026587657, 0.6578947368421053, 0.7105263157894737)),
    "top_5": ([0.7631578947368421, 0.7631578947368421, 0.7631578947368421, 0.7631578947368421, 0.7368421052631579], (0.7578947368421053, 0.011768778828946298, 0.7368421052631579, 0.7631578947368421)),
    "top_10": ([0.8421052631578947] * 5, (0.8421052631578947, 0.0, 0.8421052631578947, 0.8421052631578947)),
    "mrr": ([0.6425438596491229, 0.6236842105263157, 0.6337719298245613, 0.6644736842105263, 0.6271929824561403], (0.6383333333333333, 0.016283097789507203, 0.62368421052631, 0.66447368421052)),
}


def judged(spark, ranks, depth=None):
    """The evaluation of rankings whose first correct file stands at these ranks."""
    ranking = spark.createDataFrame([(i, r, "right") for i, r in enumerate(ranks) if r] + [(i, 1 if r != 1 else 2, "wrong") for i, r in enumerate(ranks)], "query_id long, rank int, file string")
    # Places are positions: the files before a correct one are filled in.
    filled = ranking.filter("file = 'right'").select("query_id", F.explode(F.sequence(F.lit(1), F.col("rank"))).alias("place"), "rank")
    rows = filled.select("query_id", F.col("place").alias("rank"), F.when(F.col("place") == F.col("rank"), "right").otherwise(F.concat(F.lit("f"), "place")).alias("file"))
    truth = spark.createDataFrame([(i, "right") for i in range(len(ranks))], "query_id long, file string")
    return evaluation.correct_ranks(rows, truth, truth.select("query_id"), depth=depth)


def hits(per, ks=(1, 3, 5, 10)):
    row = per.agg(F.avg("rr").alias("mrr"), *[F.count_if(F.coalesce(F.col("correct_rank") <= k, F.lit(False))).alias(f"h{k}") for k in ks]).first()
    return row.mrr, [row[f"h{k}"] for k in ks]


def test_ranks_give_the_reported_metrics(spark):
    mrr, found = hits(judged(spark, FIRST_19), (1, 3, 5, 10, 20, 50))
    assert round(mrr, 4) == 0.5344 and [round(x / 19, 4) for x in found] == [0.4737, 0.4737, 0.5789, 0.7368, 0.8947, 1.0]
    both = FIRST_19 + SECOND_19
    assert round(hits(judged(spark, both))[0], 5) == 0.50796
    mrr, found = hits(judged(spark, both, 10))
    assert mrr == pytest.approx(0.49451754385964913) and found == [15, 20, 23, 27]
    mrr, found = hits(judged(spark, MERGED, 10))
    assert mrr == pytest.approx(0.6513157894736842) and found == [21, 27, 29, 32]
    moved = study.transitions(judged(spark, both, 10), judged(spark, MERGED, 10)).first()
    steps = [(a if a and a <= 10 else 99, b or 99) for a, b in zip(both, MERGED, strict=True)]
    assert (moved.improved, moved.degraded) == (sum(b < a for a, b in steps), sum(b > a for a, b in steps))


@pytest.mark.parametrize(("table", "depth"), [(ABLATION, 10), (MINI, None)], ids=["ablation at 10", "mini-benchmark at full depth"])
def test_variants_give_the_reported_rows(spark, table, depth):
    every = None
    for name, (ranks, _, _) in table.items():
        per = judged(spark, ranks, depth).withColumn("variant", F.lit(name))
        every = per if every is None else every.unionByName(per)
    none = spark.createDataFrame([], "query_id long")
    for r in study.scoped(every, "variant", none).collect():
        ranks, mrr, share = table[r.variant]
        assert r.scope == "all" and r.n == len(ranks) and round(r.mrr, 4) == mrr
        assert tuple(round(r[f"hits_{k}"] / r.n, 4) for k in (1, 3, 5, 10)) == share
    summary = {r.variant: r for r in evaluation.summarize(every, ["variant"], depth=10).collect()}
    assert {k: round(r.mrr, 4) for k, r in summary.items()} == {k: v[1] for k, v in table.items()}


def test_costs_give_the_reported_savings(spark):
    names = "dataset string, setting string, calls long, tokens long, seconds double, top_1 double, top_3 double, top_5 double, top_10 double, mrr double"
    runs = spark.createDataFrame(COSTS, names)
    for i, metric in enumerate(("top_1", "top_3", "top_5", "top_10", "mrr")):
        one = runs.select("dataset", "setting", "calls", "tokens", "seconds", F.col(metric).alias("mrr"))
        for r in study.cost_table(one).collect():
            kept, saved = RETENTION[r.dataset]
            assert r.retention == pytest.approx(kept[i], abs=1e-8)
            assert (r.call_saving, r.token_saving, r.time_saving) == pytest.approx(saved, abs=1e-8)


def test_repeats_give_the_reported_variance(spark):
    rows = [("s", *x) for x in zip(*(v for v, _ in REPEATS.values()), strict=True)]
    row = study.variance(spark.createDataFrame(rows, "setting string, " + ", ".join(f"{m} double" for m in REPEATS)), "setting", list(REPEATS)).first()
    for metric, (_, (mean, sd, least, most)) in REPEATS.items():
        assert (row[f"{metric}_mean"], row[f"{metric}_sd"], row[f"{metric}_min"], row[f"{metric}_max"]) == pytest.approx((mean, sd, least, most), abs=1e-8)
