"""Evidence boosts and retention over ranked candidates.

Candidates are long rows (query_id, file, score ...). Retention is a set rewrite: with m the lesser of the protected
candidates outside the pool and the unprotected ones inside, the m lowest unprotected leave and the m best protected come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import tokenize


def build_query(*parts: Column) -> Column:
    """R03. The parts that are not empty, joined by line feeds."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def common_packages(rows: DataFrame, by: str, order: str, package: str) -> DataFrame:
    """R05. (``by``, package): the common beginning of a group's dotted packages, taken in order and no longer shortened once it has two parts or fewer.

    That is the part of the first package that it shares with the first later one that leaves it two parts or fewer, if there is one, else with all of them: two aggregates, no
    group is gathered. Empty and null packages are left out; a group without any has an empty one.
    """
    known = rows.filter(F.coalesce(F.col(package), F.lit("")) != "").select(by, order, F.split(package, r"\.").alias("parts"))
    place = F.struct(order, "parts")
    first = known.groupBy(by).agg(F.min(place).alias("first"))
    same = F.array_position(F.zip_with(F.col("first.parts"), F.col("parts"), lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(same == 0, F.size("parts")).otherwise(same - 1).cast("int")
    later = known.join(first, by).withColumn("n", shared)
    # The first package meets itself too: as one of the later ones it shortens nothing.
    kept = F.coalesce(F.min(F.when((F.col("n") <= 2) & (place != F.col("first")), F.struct(F.col(order), F.col("parts"), F.col("n"))))["n"], F.min("n"))
    cut = later.groupBy(by).agg(kept.alias("n"), F.min("first").alias("first"))
    groups = rows.select(by).distinct()
    return groups.join(cut, by, "left").select(by, F.coalesce(F.array_join(F.slice("first.parts", F.lit(1), F.col("n")), "."), F.lit("")).alias("package"))


def identifier_terms(*texts: Column) -> Column:
    """R09. Tokens of four characters or more, each once."""
    return F.array_distinct(F.filter(tokenize(F.concat_ws("\n", *texts)), lambda t: F.char_length(t) >= 4))


def direct_boost(names: Column, stem: Column, hints: Column) -> tuple[Column, Column]:
    """R10. 90 for each hint that is a class name, or the file's stem in any case; with the reasons by hint."""

    def reason(h: Column) -> Column:
        return F.when(F.array_contains(names, h), F.concat(F.lit("direct_class_hint:"), h)).when(F.lower(h) == F.lower(stem), F.concat(F.lit("direct_file_hint:"), h))

    reasons = F.array_compact(F.transform(F.array_sort(F.array_distinct(hints)), reason))
    return 90.0 * F.size(reasons), reasons


def identifier_boost(own: Column, terms: Column) -> tuple[Column, Column]:
    """R11. 4 for each of the first eight common terms in order, 32 at most; with the reason."""
    overlap = F.slice(F.array_sort(F.filter(F.array_intersect(own, terms), lambda t: F.char_length(t) >= 4)), 1, 8)
    reason = F.when(F.size(overlap) > 0, F.concat(F.lit("identifier_overlap:"), F.array_join(overlap, ",")))
    return F.least(F.lit(32.0), 4.0 * F.size(overlap)), reason


def six_places(x: Column) -> Column:
    """x, not negative, to six places by its binary value: totals often end in a five at the seventh, where rounding their decimal digits differs."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def hybrid_total(score: Column, context: Column, *boosts: Column) -> Column:
    """R13. Rounded BM25, 0.55 of the rounded context score, and all boosts."""
    total = score + 0.55 * context
    for b in boosts:
        total = total + b
    return total


def retain(ranked: DataFrame, *, k: int, protected: str, cap: int | None = None, resort: bool = True, boost: float = 0.0) -> DataFrame:
    """R14-R16. ranked (query_id, rank, file, total, and a boolean column named by ``protected``) cut to k, protected ones kept.

    Newcomers get ``boost``. With ``resort`` the pool is ranked anew; without, newcomers take the freed ranks in order.
    """
    inside = F.col("rank") <= k
    low = W.partitionBy("query_id").orderBy(F.col("rank").desc())
    high = W.partitionBy("query_id").orderBy("rank")
    every = W.partitionBy("query_id")
    free, come = inside & ~F.col(protected), ~inside & F.col(protected)
    rows = ranked.withColumns({
        "n_free": F.count_if(free).over(every), "n_come": F.count_if(come).over(every),
        "i_free": F.count_if(free).over(low.rowsBetween(W.unboundedPreceding, 0)), "i_come": F.count_if(come).over(high.rowsBetween(W.unboundedPreceding, 0)),
    })
    m = F.least("n_free", "n_come", *([F.lit(cap)] if cap is not None else []))
    leaves, enters = free & (F.col("i_free") <= m), come & (F.col("i_come") <= m)
    names = ranked.columns
    if resort:
        kept = rows.filter((inside & ~leaves) | enters).withColumn("total", F.col("total") + F.when(enters, F.lit(boost)).otherwise(F.lit(0.0)))
        order = W.partitionBy("query_id").orderBy(F.col("total").desc(), "file")
        return kept.withColumn("rank", F.row_number().over(order)).select(names)
    # The i-th best newcomer takes the i-th smallest of the freed ranks; slots are freed from the bottom.
    slots = rows.filter(leaves).select("query_id", F.col("rank").alias("slot"), F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("i_come"))
    stay = rows.filter(inside & ~leaves).select(names)
    new = rows.filter(enters).drop("rank").join(slots, ["query_id", "i_come"]).withColumn("rank", F.col("slot").cast("int")).withColumn("total", F.col("total") + boost)
    return stay.unionByName(new.select(names))
