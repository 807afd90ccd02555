"""Study tables (A02-A08, V11): costs and retention, transitions, variance over repeats, output validity, key audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import rr_at
from tamarack.operators import evaluation
from tamarack.operators.evaluation import KS
from tamarack.operators.tables import kept


def cost_table(runs: DataFrame) -> DataFrame:
    """A02. runs: dataset, setting (retrieval, full, selective), mrr, calls, tokens, and seconds if they are known. One row per dataset: gains, the
    share of the full gain that the selective setting keeps (null without a gain), and what it saves."""
    spent = [c for c in ("calls", "tokens", "seconds") if c in runs.columns]
    pick = lambda s, c: F.max(F.when(F.col("setting") == s, F.col(c)))
    wide = runs.groupBy("dataset").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("retrieval", "full", "selective") for c in ("mrr", *spent)])
    full, part = F.col("full_mrr") - F.col("retrieval_mrr"), F.col("selective_mrr") - F.col("retrieval_mrr")
    saved = lambda c: F.round(1 - F.try_divide(F.col(f"selective_{c}"), F.col(f"full_{c}")), 9)
    return wide.select("dataset", F.round(full, 9).alias("full_gain"), F.round(part, 9).alias("selective_gain"), F.round(F.when(full > 0, part / full), 9).alias("retention"), *[saved(c).alias(n) for c, n in (("calls", "call_saving"), ("tokens", "token_saving"), ("seconds", "time_saving")) if c in spent])


def transitions(before: DataFrame, after: DataFrame, by: str | None = None) -> DataFrame:
    """A03. Improved, degraded and unchanged queries, and how many came into and fell out of the first 5 and 10."""
    rows = before.select("query_id", F.col("correct_rank").alias("r0"), *([by] if by else [])).join(after.select("query_id", F.col("correct_rank").alias("r1")), "query_id")
    worst = F.lit(2**30)
    a, b = F.coalesce("r0", worst), F.coalesce("r1", worst)
    counts = [F.count_if(b < a).alias("improved"), F.count_if(b > a).alias("degraded"), F.count_if(b == a).alias("unchanged")]
    for k in (5, 10):
        counts += [F.count_if((a > k) & (b <= k)).alias(f"into_{k}"), F.count_if((a <= k) & (b > k)).alias(f"out_of_{k}")]
    return (rows.groupBy(by) if by else rows).agg(*counts)


def variance(repeats: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """A04. Mean, SD (0 of one), least and greatest of each metric over the repeats of a setting."""
    cells = [c for m in metrics for c in (F.round(F.avg(m), 9).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 9).alias(f"{m}_sd"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    return repeats.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), *cells)


def scoped(per: DataFrame, variant: str, selected: DataFrame) -> DataFrame:
    """A05. MRR and hits of each variant over all queries and over the selected ones."""
    flagged = per.join(selected.select("query_id").distinct().withColumn("s", F.lit(True)), "query_id", "left")
    scopes = flagged.withColumn("scope", F.explode(F.when(F.col("s"), F.array(F.lit("all"), F.lit("selected"))).otherwise(F.array(F.lit("all")))))
    hit = lambda k: F.count_if(F.coalesce(F.col("correct_rank") <= k, F.lit(False)))
    return scopes.groupBy(variant, "scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rr"), 9).alias("mrr"), *[hit(k).alias(f"hits_{k}") for k in KS])


def key_audit(records: DataFrame, group: str, keys: Column, names: list[str]) -> DataFrame:
    """A08. Records that hold each key, by group and in total (group null)."""
    return records.withColumn("__keys", keys).rollup(group).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.array_contains("__keys", n)).alias(f"with_{n}") for n in names])


def selector_recall(per: DataFrame, selected: DataFrame, *, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """A03. (k, failures, selected, recall): queries without a correct file in the first k, and how many of them the selector took; recall is null without failures."""
    flagged = per.join(selected.select("query_id").distinct().withColumn("s", F.lit(True)), "query_id", "left")
    failed = lambda k: F.col("correct_rank").isNull() | (F.col("correct_rank") > k)
    rows = flagged.select("query_id", F.coalesce("s", F.lit(False)).alias("s"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), failed(k).alias("failed")) for k in ks])).alias("x")).select("s", "x.*")
    counts = rows.groupBy("k").agg(F.count_if("failed").alias("failures"), F.count_if(F.col("failed") & F.col("s")).alias("selected"))
    return counts.withColumn("recall", F.round(F.try_divide("selected", "failures"), 9))


def case_ranks(per: DataFrame, variant: str, baseline: str, *, depth: int = 10) -> DataFrame:
    """A05, A03. (query_id, variant, rank, rr, delta, note) of each query and variant: its rank within ``depth``, and how its RR differs from the baseline's."""
    rr = F.round(rr_at(F.col("correct_rank"), depth), 9)
    rows = per.select("query_id", variant, F.when(F.col("correct_rank") <= depth, F.col("correct_rank")).alias("rank"), rr.alias("rr"))
    base = rows.filter(F.col(variant) == baseline).select("query_id", F.col("rr").alias("base"))
    met = rows.join(base, "query_id", "left").withColumn("delta", F.round(F.col("rr") - F.col("base"), 9))
    note = F.when(F.col("delta") != 0, F.format_string("%s:RR %.4f->%.4f", F.col("query_id").cast("string"), "base", "rr"))
    return met.select("query_id", variant, "rank", "rr", "delta", note.alias("note"))


def validity(counters: DataFrame, models: DataFrame) -> DataFrame:
    """A06. One row: the number of records, sums of what was returned, valid, invalid, repeated and added, and the models (query_id, model) by name, each once."""
    sums = counters.agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("returned", "valid", "invalid", "duplicates", "added")])
    names = models.select("model").filter("model IS NOT NULL").distinct().agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))
    return sums.crossJoin(F.broadcast(names))  # one row each


def mini_benchmark(cases: DataFrame, predictions: DataFrame, truth: DataFrame, *, deep: int = 50) -> DataFrame:
    """A07. cases (query_id, source ...) with the best rank of a correct file in the case's own source of predictions, and whether it is in the first ``deep``.

    predictions: source, query_id, rank, file; truth: query_id, file. A case that its source has no predictions for fails the job. Cases repeat as given.
    """
    known = predictions.select("source", "query_id").distinct().withColumn("known", F.lit(True))
    hits = predictions.join(truth.distinct(), ["query_id", "file"]).groupBy("source", "query_id").agg(F.min("rank").alias("best"))
    rows = cases.join(known, ["source", "query_id"], "left").join(hits, ["source", "query_id"], "left")
    missing = F.raise_error(F.concat(F.col("query_id").cast("string"), F.lit(" is not in "), "source")).cast("int")
    best = F.when(F.col("known").isNull(), missing).otherwise(F.col("best"))
    return rows.select(*cases.columns, best.alias("best_rank"), F.coalesce(best <= deep, F.lit(False)).alias("in_first"))


def supplement(first: DataFrame, second: DataFrame, truth: DataFrame, queries: DataFrame, selected: DataFrame, *, depths: Sequence[int] = (10, 20, 50), recall_depth: int) -> dict[str, DataFrame]:
    """V11. The summary of both rankings, their paired tests, the first one's recall and its subsets, from one kept evaluation."""
    truth = kept(truth)
    a, b = (kept(evaluation.correct_ranks(r, truth, queries, depth=10)) for r in (first, second))
    both = a.withColumn("method", F.lit("first")).unionByName(b.withColumn("method", F.lit("second")))
    deep = evaluation.correct_ranks(first, truth, queries, depth=recall_depth)
    return {
        "summary": evaluation.summarize(both, ["method"], depth=10), "paired": evaluation.paired(a, b),
        "recall": evaluation.recall_curve(deep, depths, max_depth=recall_depth), "subsets": evaluation.selector_subsets(a, selected),
    }


def long_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """V11. (part, row, metric, value) of all parts: a row's text columns, and k, name it, its numbers are its metrics."""
    out = None
    for part, df in parts.items():
        named = [c for c, t in df.dtypes if t == "string" or c == "k"]
        row = F.concat_ws(",", F.lit(""), *[F.col(c).cast("string") for c in named])
        numbers = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in named])
        rows = df.select(F.lit(part).alias("part"), F.ltrim(row, F.lit(",")).alias("row"), F.inline(numbers))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_supplement(parts: dict[str, DataFrame], folder: str) -> None:
    """V11. Each part as JSON lines in its folder; all are read from the one evaluation that was kept."""
    for part, df in parts.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{part}")
