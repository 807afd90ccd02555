"""Selection of uncertain queries, search among candidates, and completion of a reranker's output (L, E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import is_comment_header, lines, reasons_of, strip, tokenize, truncate_text

RATIO = 1.02
MANY_HINTS = 7


def select(ranking: DataFrame, queries: DataFrame, *, ratio: float = RATIO, many: int = MANY_HINTS) -> DataFrame:
    """L01-L04, L10. (query_id, top1_file, top2_file, score_ratio, first_direct_rank, n_direct, reasons) of the queries to rerank.

    ranking: query_id, rank, file, score, direct (whether the file has a direct hint).
    """
    top = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    seen = ranking.groupBy("query_id").agg(
        top(1, "file").alias("top1_file"), top(2, "file").alias("top2_file"), top(1, "score").alias("top1_score"), top(2, "score").alias("top2_score"),
        F.max(F.when(F.col("rank") == 1, F.col("direct"))).alias("top1_direct"), F.min(F.when(F.col("direct"), F.col("rank"))).alias("first_direct_rank"), F.count_if("direct").alias("n_direct"),
    )
    rows = queries.select("query_id").distinct().join(seen, "query_id", "left")
    share = F.when(F.col("top2_score") > 0, F.col("top1_score") / F.col("top2_score"))
    empty = F.col("top1_file").isNull()
    reasons = F.array_compact(F.array(
        F.when(empty, F.lit("empty_ranking")),
        F.when(share <= ratio, F.lit(f"low_score_ratio<={ratio:g}")),
        F.when(~empty & ~F.coalesce(F.col("top1_direct"), F.lit(False)), F.lit("top1_without_direct_hint")),
        F.when((F.lit(many) > 0) & (F.col("n_direct") >= many), F.lit(f"many_direct_hints>={many}")),
    ))
    out = rows.select("query_id", "top1_file", "top2_file", F.round(share, 9).alias("score_ratio"), "first_direct_rank", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), reasons.alias("reasons"))
    return out.filter(F.size("reasons") > 0)


def direct_candidates(ranked: DataFrame) -> DataFrame:
    """L01. (query_id, rank, file, reasons): the files with direct reasons, and these alone, of ranked (query_id, rank, file, reasons)."""
    return ranked.select("query_id", "rank", "file", reasons_of(F.col("reasons"), "direct_").alias("reasons")).filter(F.size("reasons") > 0)


def prediction_records(ranked: DataFrame, *, method: str, parts: dict[str, bool]) -> DataFrame:
    """R17. (query_id, method, record): a query's ranking with all that ``ranked`` (query_id, rank, file ...) says of a file, as JSON in the order of ranks.

    The method's name has ``+part`` for each part that was on.
    """
    name = "+".join([method, *[p for p, on in parts.items() if on]])
    item = F.struct("rank", *[c for c in ranked.columns if c not in ("query_id", "rank")])
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("ranked_files"))
    record = F.to_json(F.struct("query_id", F.lit(name).alias("method"), *[F.lit(on).alias(p) for p, on in parts.items()], "ranked_files"), {"ignoreNullFields": "false"})
    return rows.select("query_id", F.lit(name).alias("method"), record.alias("record"))


def selection_summary(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """L11. (reason, n, fraction of all queries); the reason ``*`` counts the selected queries."""
    total = queries.select("query_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    every = selected.select(F.explode(F.array_append("reasons", F.lit("*"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return every.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.coalesce(F.try_divide("n", "total"), F.lit(0.0)), 9).alias("fraction"))  # total: one row


def line_hits(sources: DataFrame, queries: DataFrame, pairs: DataFrame, *, most: int = 4) -> DataFrame:
    """E09. (query_id, file, line, text, n_terms): the first lines of a candidate, comments aside, that share a term with the query."""
    terms = queries.select("query_id", F.array_distinct(F.filter(tokenize(F.col("text")), lambda t: F.char_length(t) >= 3)).alias("terms"))
    held = sources.join(pairs.select("file").distinct(), "file", "left_semi")
    cut = held.select("file", F.posexplode(lines(F.col("text"))).alias("i", "raw")).select("file", (F.col("i") + 1).alias("line"), strip(F.col("raw")).alias("raw"))
    cut = cut.filter(~is_comment_header(F.col("raw"))).withColumn("own", F.array_distinct(tokenize(F.col("raw"))))
    met = pairs.join(terms, "query_id").join(cut, "file").withColumn("n_terms", F.size(F.array_intersect("own", "terms"))).filter("n_terms > 0")
    first = W.partitionBy("query_id", "file").orderBy("line")
    return met.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("query_id", "file", "line", truncate_text(F.col("raw"), 220).alias("text"), "n_terms")


def search_candidates(sources: DataFrame, queries: DataFrame, pairs: DataFrame, *, k: int = 10) -> DataFrame:
    """E08. (query_id, rank, file, score): 8 for each term in the path, 6 in class names, 5 in method names, 1 in the
    first 20,000 characters, and 2 for each of four lines that hit. sources: file, path, classes, methods, text.
    """
    terms = queries.select("query_id", F.array_distinct(F.filter(tokenize(F.col("text")), lambda t: F.char_length(t) >= 3)).alias("terms"))
    # Only the candidates' sources are read as tokens and lines.
    sources = sources.join(pairs.select("file").distinct(), "file", "left_semi")
    own = sources.select("file", *[F.array_distinct(tokenize(x)).alias(n) for n, x in (("p", F.col("path")), ("c", F.array_join("classes", " ")), ("m", F.array_join("methods", " ")), ("t", F.substring("text", 1, 20_000)))])
    hits = line_hits(sources, queries, pairs).groupBy("query_id", "file").agg(F.count(F.lit(1)).alias("hits"))
    met = pairs.join(terms, "query_id").join(own, "file").join(hits, ["query_id", "file"], "left")
    shared = lambda c: F.size(F.array_intersect("terms", c))
    score = 8.0 * shared("p") + 6.0 * shared("c") + 5.0 * shared("m") + 1.0 * shared("t")
    found = met.withColumn("base", score).filter("base > 0").withColumn("score", F.round(F.col("base") + 2.0 * F.coalesce("hits", F.lit(0)), 3))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "file")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "file", "score")


def complete(output: DataFrame, pool: DataFrame, *, depth: int = 10) -> DataFrame:
    """E13. A reranker's list made whole: (query_id, rank, file, source).

    output: query_id, position, file; pool: query_id, place, file. Files outside the pool and repeats go; the first
    ``depth`` stay; what lacks is filled from the pool in its order.
    """
    valid = output.join(pool.select("query_id", "file").distinct(), ["query_id", "file"], "left_semi").groupBy("query_id", "file").agg(F.min("position").alias("position"))
    given = valid.select("query_id", "file", F.lit(0).alias("late"), F.col("position").alias("at"))
    rest = pool.join(valid, ["query_id", "file"], "left_anti").groupBy("query_id", "file").agg(F.min("place").alias("at")).select("query_id", "file", F.lit(1).alias("late"), "at")
    order = W.partitionBy("query_id").orderBy("late", "at", "file")
    ranked = given.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return ranked.select("query_id", "rank", "file", F.when(F.col("late") == 0, F.lit("llm")).otherwise(F.lit("fallback")).alias("source"))


def output_counters(output: DataFrame, pool: DataFrame, *, depth: int = 10) -> DataFrame:
    """E13. (query_id, returned, valid, invalid, duplicates, added): counting stops at the item that fills the list."""
    known = pool.select("query_id", "file").distinct().withColumn("known", F.lit(True))
    rows = output.join(known, ["query_id", "file"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "file").orderBy("position")))
    valid = F.col("known") & (F.col("nth") == 1)
    rows = rows.withColumn("so_far", F.count_if(valid).over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)))
    seen = F.col("so_far") < depth
    sizes = pool.groupBy("query_id").agg(F.countDistinct("file").alias("size"))
    counts = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"), F.count_if(seen & valid).alias("valid"), F.count_if(seen & ~F.col("known")).alias("invalid"), F.count_if(seen & F.col("known") & (F.col("nth") > 1)).alias("duplicates"),
    )
    out = sizes.join(counts, "query_id", "left").na.fill(0, ["returned", "valid", "invalid", "duplicates"])
    return out.select("query_id", "returned", "valid", "invalid", "duplicates", (F.least(F.lit(depth), F.col("size")) - F.col("valid")).alias("added"))


def prompt(query: Column, files: Column, top: int) -> Column:
    """E12. The request to a reranker as JSON: the query, the closed pool of candidates, and how many to return."""
    return F.to_json(F.struct(query.alias("query"), files.alias("candidates"), F.lit(top).alias("top_output")))
