"""Ranking metrics, paired tests, subsets and curves (V01-V12) as joins and aggregates over long rankings.

A ranking is rows (query_id, rank, file, ...), a truth rows (query_id, file). Truth is joined here and nowhere before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators.tables import kept

KS = (1, 3, 5, 10)


def merge(baseline: DataFrame, reranked: DataFrame, selected: DataFrame, *, depth: int = 10, allow_missing: bool = False) -> DataFrame:
    """V01. Rankings of selected queries come from the reranker, all others from the baseline; cut to depth.

    A selected query that the reranker has no record of fails the job, unless missing ones are allowed: those come from the baseline.
    """
    chosen = selected.select("query_id").distinct()
    wanted = reranked.join(chosen, "query_id", "left_semi")
    covered = wanted.select("query_id").distinct().withColumn("covered", F.lit(True))
    rows = baseline.join(chosen.withColumn("chosen", F.lit(True)), "query_id", "left").join(covered, "query_id", "left").filter("covered IS NULL")
    origin = F.lit("baseline")
    if not allow_missing:
        # The check is part of a column, so that it can't be pruned while the result is read.
        missing = F.raise_error(F.concat(F.lit("no rerank record of "), F.col("query_id").cast("string"))).cast("string")
        origin = F.when(F.col("chosen"), missing).otherwise(origin)
    out = wanted.withColumn("origin", F.lit("rerank")).unionByName(rows.withColumn("origin", origin).drop("chosen", "covered"), allowMissingColumns=True)
    return out.filter(F.col("rank") <= depth)


def correct_ranks(ranking: DataFrame, truth: DataFrame, queries: DataFrame, *, depth: int | None = None) -> DataFrame:
    """V03. (query_id, correct_rank, rr) of every query: the place of its first correct file, by position in the list."""
    placed = ranking.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "file")))
    if depth is not None:
        placed = placed.filter(F.col("place") <= depth)
    hits = placed.join(truth, ["query_id", "file"]).groupBy("query_id").agg(F.min("place").alias("correct_rank"))
    out = queries.select("query_id").distinct().join(hits, "query_id", "left")
    return out.withColumn("rr", F.coalesce(1.0 / F.col("correct_rank"), F.lit(0.0)))


def _hit(k: int, rank: str = "correct_rank") -> Column:
    return F.coalesce(F.col(rank) <= k, F.lit(False))


def evaluate_predictions(ranking: DataFrame, truth: DataFrame, *, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """V02. Accuracy at each k and MRR over the queries that have a prediction."""
    per = correct_ranks(ranking, truth, ranking)
    return per.agg(F.count(F.lit(1)).alias("bugs"), *[F.round(F.avg(_hit(k).cast("double")), 9).alias(f"top_{k}_accuracy") for k in ks], F.round(F.avg("rr"), 9).alias("mrr"))


def coverage(ranking: DataFrame, queries: DataFrame) -> DataFrame:
    """V03. (query_id, problem): queries without a prediction, and predictions of unknown queries."""
    known, given = queries.select("query_id").distinct(), ranking.select("query_id").distinct()
    missing = known.join(given, "query_id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(given.join(known, "query_id", "left_anti").withColumn("problem", F.lit("extra")))


def summarize(per: DataFrame, by: Sequence[str], *, depth: int, ks: Sequence[int] = KS) -> DataFrame:
    """V04. n, misses, MRR, spread of RR and of ranks (a miss counts depth + 1), hits and accuracy, by the given columns."""
    capped = F.coalesce(F.col("correct_rank"), F.lit(depth + 1)).cast("double")
    spread = lambda x, name: [
        F.round(F.percentile(x, 0.5), 9).alias(f"{name}_median"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 9).alias(f"{name}_sd"),
        F.round(F.percentile(x, 0.75) - F.percentile(x, 0.25), 9).alias(f"{name}_iqr"),
    ]
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct_rank").isNull()).alias("misses"), F.round(F.avg("rr"), 9).alias("mrr"), *spread(F.col("rr"), "rr"), *spread(capped, "rank"),
        *[F.count_if(_hit(k)).alias(f"hits_{k}") for k in ks], *[F.round(F.avg(_hit(k).cast("double")), 9).alias(f"accuracy_{k}") for k in ks],
    )


def _log_factorial(n: Column) -> Column:
    """ln n!: from the product below 16, from Stirling's series (an error under 1e-13) from there on."""
    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, small).otherwise(series)


def mcnemar(b: Column, c: Column) -> Column:
    """V06. Two-sided exact binomial test of b against c discordant pairs; 1 where there are none.

    The tail is summed from its greatest term down, each from the one before; terms more than 20 standard deviations away are under 1e-80 and left out, so the work is that of
    the root of the number of pairs.
    """
    n, least = b + c, F.least(b, c)
    greatest = F.exp(_log_factorial(n) - _log_factorial(least) - _log_factorial(n - least) - n * math.log(2))
    steps = F.least(least, F.ceil(10 * F.sqrt(n.cast("double"))) + 20).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (least - j + 1).cast("double") / (n - least + j).cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    down = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    tail = greatest * F.aggregate(down, start, step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired(first: DataFrame, second: DataFrame, *, ks: Sequence[int] = KS) -> DataFrame:
    """V08. One row: deltas of RR of the queries in both, and McNemar's test at each k."""
    both = first.select("query_id", F.col("correct_rank").alias("r0"), F.col("rr").alias("rr0")).join(second.select("query_id", F.col("correct_rank").alias("r1"), F.col("rr").alias("rr1")), "query_id")
    delta = F.col("rr1") - F.col("rr0")
    gained = {k: (F.count_if(~_hit(k, "r0") & _hit(k, "r1")), F.count_if(_hit(k, "r0") & ~_hit(k, "r1"))) for k in ks}
    row = both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 9).alias("mean_delta"), F.round(F.percentile(delta, 0.5), 9).alias("median_delta"),
        F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("degraded"), F.count_if(delta == 0).alias("unchanged"),
        *[x.alias(f"{n}_{k}") for k in ks for n, x in zip(("gained", "lost"), gained[k], strict=True)],
    )
    return row.select("*", *[F.round(mcnemar(F.col(f"gained_{k}"), F.col(f"lost_{k}")), 9).alias(f"mcnemar_p_{k}") for k in ks])


def wilcoxon_sums(deltas: DataFrame) -> DataFrame:
    """V07. n, w_plus, w_minus and z of the signed-rank test: zeros dropped, average ranks for ties, no tie correction.

    Ranks come from counts per distinct size, range-sorted: a running sum in each task, on top of the sums of the tasks before.
    """
    sized = deltas.filter("delta <> 0").groupBy(F.round(F.abs("delta"), 12).alias("size")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("delta") > 0).alias("up"))
    # Sizes are range-sorted over tasks; a task's rows follow all those of the tasks before it, whose sums are one row a task.
    placed = kept(sized.repartitionByRange("size").withColumn("task", F.spark_partition_id()))
    by = W.partitionBy("task").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("task").agg(F.sum("m").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("m").over(by), F.lit(0)) + F.col("base")
    ranked = placed.join(sums.select("task", "base"), "task").withColumn("rank", before + (F.col("m") + 1) / 2.0)
    one = ranked.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("m") - F.col("up"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return one.withColumn("z", F.round(z, 9))


def normal_tail(z: Column) -> Column:
    """V07. Two-sided p of a standard normal z, by a pandas function: Spark has no error function."""
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: 1.0 if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))

    return F.pandas_udf(tail, "double")(z)


def selector_subsets(per: DataFrame, selected: DataFrame, *, depth: int = 10) -> DataFrame:
    """V09. The summary of selected and of unselected queries."""
    flagged = per.join(selected.select("query_id").distinct().withColumn("s", F.lit(True)), "query_id", "left")
    return summarize(flagged.withColumn("subset", F.when(F.col("s"), F.lit("selected")).otherwise(F.lit("unselected"))), ["subset"], depth=depth)


def false_negatives(per: DataFrame, selected: DataFrame, *, depth: int = 10) -> DataFrame:
    """V09. Unselected queries without a correct file in the first ``depth``."""
    return per.join(selected.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("correct_rank").isNull() | (F.col("correct_rank") > depth)).select("query_id", "correct_rank")


def recall_curve(per: DataFrame, depths: Sequence[int], *, max_depth: int) -> DataFrame:
    """V10. (k, n, hits, recall): recall is null beyond the depth that was ranked."""
    rows = per.select("correct_rank", F.explode(F.array(*[F.lit(k) for k in depths])).alias("k"))
    out = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("correct_rank") <= F.col("k"), F.lit(False))).alias("hits"))
    known = F.col("k") <= max_depth
    return out.select("k", "n", F.when(known, F.col("hits")).alias("hits"), F.when(known, F.round(F.col("hits") / F.col("n"), 9)).alias("recall"))


def usage(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V12, A01. Totals and averages of tokens and seconds of model calls (tokens, seconds), and, of columns that calls has, sums of prompt_tokens and
    completion_tokens and the number of invalid answers."""
    more = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens") if c in calls.columns]
    more += [F.count_if(F.coalesce("invalid", F.lit(False))).alias("invalid_count")] if "invalid" in calls.columns else []
    return calls.groupBy(*by).agg(
        *more,
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.avg("tokens"), F.lit(0.0)), 2).alias("average_tokens"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("total_seconds"), F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 3).alias("average_seconds"),
    )
