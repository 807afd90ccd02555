"""What a reranker is shown of its candidates (E05-E07, E10, E12, E14, E15). Sources are rows (file, package, classes, methods, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import lines, tokenize, truncate_text
from tamarack.operators.rules import TERM_RULES, TermRule, semantic_terms
from tamarack.operators.snippets import snippets
from tamarack.operators.tables import kept

#: How many class and method names a candidate shows to a reranker (E05), an agent (E06) and a verifier.
RERANK, AGENT, VERIFIER, INSPECTED = (10, 40), (8, 20), (10, 35), (12, 40)
#: What a retrieval says of a candidate, as far as a ranking has it.
EVIDENCE = ("bm25_score", "test_context_score", "direct_boost", "identifier_boost", "reference_boost", "pass_chain_boost", "reasons")
#: Characters and items that a long observation keeps.
LONG_TEXT, LONG_LIST = 1_200, 5


def briefs(ranked: DataFrame, sources: DataFrame, *, top: int | None = None, names: tuple[int, int] = RERANK) -> DataFrame:
    """E05-E07. The ``top`` best files of each query that have a source: query_id, rank, score, file, package, class_names, method_names.

    Files without a source are left out and their ranks stay free. ranked: query_id, rank, score, file.
    """
    best = ranked if top is None else ranked.filter(F.col("rank") <= top)
    shown = sources.select("file", "package", F.slice("classes", 1, names[0]).alias("class_names"), F.slice("methods", 1, names[1]).alias("method_names"))
    return best.select("query_id", "rank", "score", "file").join(shown, "file").select("query_id", "rank", "score", "file", "package", "class_names", "method_names")


def full(ranked: DataFrame, sources: DataFrame, queries: DataFrame, *, top: int | None = None, names: tuple[int, int] = RERANK, max_lines: int = 24, rules: tuple[TermRule, ...] = TERM_RULES) -> DataFrame:
    """E05, E07, E10. Briefs with ``relevant_snippet`` (E02) and ``evidence``, what the ranking says of the candidate as JSON.

    ranked: query_id, rank, score, file and columns of EVIDENCE; queries: query_id, query, trace. A candidate's snippet is looked for with the terms that the query stands for in
    this source (E04) before the query's own.
    """
    best = kept(ranked if top is None else ranked.filter(F.col("rank") <= top))
    pairs = best.select("query_id", "file").join(queries, "query_id")
    held = sources.join(best.select("file").distinct(), "file", "left_semi")
    meant = semantic_terms(pairs.select("query_id", "file", tokenize(F.coalesce("query", F.lit(""))).alias("query_terms")).join(held, "file"), rules)
    asked = pairs.join(meant, ["query_id", "file"], "left").withColumn("query", F.concat_ws("\n", F.nullif(F.array_join("terms", " "), F.lit("")), F.coalesce("query", F.lit(""))))
    found = snippets(kept(asked.select("query_id", "file", "query", "trace")), held, max_lines=max_lines).withColumnRenamed("snippet", "relevant_snippet")
    says = [c for c in EVIDENCE if c in ranked.columns]
    evidence = best.select("query_id", "file", F.to_json(F.struct(*says) if says else F.struct(), {"ignoreNullFields": "false"}).alias("evidence"))
    return briefs(best, held, names=names).join(found, ["query_id", "file"]).join(evidence, ["query_id", "file"])


def compact_observations(observations: DataFrame, *, max_chars: int, long_text: int = LONG_TEXT, long_list: int = LONG_LIST) -> DataFrame:
    """E15. (query_id, place, observation): what an agent saw, in order, as JSON within a budget of characters.

    observations: query_id, place, and columns of texts and of lists of texts. If all of a query's fit they stay as they are. Else each that is longer than what is left,
    or than half of the budget, keeps ``long_text`` characters of its texts and ``long_list`` items of its lists and says so, and none comes after the budget is spent.
    Lengths are those of JSON without blanks.
    """
    kinds = {c: t for c, t in observations.dtypes if c not in ("query_id", "place")}
    short = [F.slice(c, 1, long_list).alias(c) if t.startswith("array") else truncate_text(F.col(c), long_text).alias(c) for c, t in kinds.items()]
    rows = observations.select("query_id", "place", F.to_json(F.struct(*kinds)).alias("whole"), F.to_json(F.struct(*short, F.lit(True).alias("_truncated"))).alias("cut"))
    item = F.struct("place", "whole", "cut", F.char_length("whole").alias("n"), F.char_length("cut").alias("m"))
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.char_length("whole") + 1).alias("total"))
    start = F.struct(F.lit(max_chars).alias("left"), F.array().cast("array<int>").alias("kinds"))

    def step(acc: Column, x: Column) -> Column:
        kind = F.when(acc["left"] <= 0, 0).when(x["n"] <= F.least(acc["left"], F.lit(max_chars // 2)), 1).otherwise(2)
        spent = F.when(acc["left"] <= 0, 0).when(x["n"] <= F.least(acc["left"], F.lit(max_chars // 2)), x["n"]).otherwise(x["m"])
        return F.struct((acc["left"] - spent).alias("left"), F.array_append(acc["kinds"], kind).alias("kinds"))

    # A list in JSON has brackets and commas too.
    fits = F.col("total") + 1 <= max_chars
    chosen = F.when(fits, F.transform("items", lambda x: F.lit(1))).otherwise(F.aggregate("items", start, step, lambda acc: acc["kinds"]))
    told = per.select("query_id", F.explode(F.arrays_zip("items", chosen.alias("kinds"))).alias("x")).select("query_id", "x.items.*", F.col("x.kinds").alias("kind")).filter("kind > 0")
    return told.select("query_id", "place", F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("cut")).alias("observation"))


def agent_prompt(query: Column, files: Column, observations: Column, step: Column, *, task: str, rules: tuple[str, ...], tools: tuple[str, ...], max_steps: int, top: int) -> Column:
    """E12. An agent's next request as JSON: the closed pool, what it saw, the tools it may ask for, none at the last step, and how many files it must rank."""
    last = step >= max_steps
    asked = F.struct(F.lit(task).alias("task"), step.alias("step"), F.lit(max_steps).alias("max_steps"), F.array(*[F.lit(r) for r in rules]).alias("rules"),
        F.when(last, F.array(F.lit("finish"))).otherwise(F.array(*[F.lit(t) for t in (*tools, "finish")])).alias("actions"), query.alias("query"), files.alias("candidates"),
        observations.alias("observations"), F.least(F.lit(top), F.size(files)).alias("top_output"))
    return F.to_json(asked, {"ignoreNullFields": "false"})


def verifier_prompt(query: Column, ranking: Column, evidence: Column, observations: Column, *, task: str, rules: tuple[str, ...], top: int) -> Column:
    """E12. A verifier's request as JSON: the ranking that it checks, evidence of its files, and what the agent saw; it asks for no tools."""
    asked = F.struct(F.lit(task).alias("task"), F.array(*[F.lit(r) for r in rules]).alias("rules"), query.alias("query"), ranking.alias("proposed_ranking"), evidence.alias("candidate_evidence"),
        observations.alias("observations"), F.least(F.lit(top), F.size(ranking)).alias("top_output"))
    return F.to_json(asked, {"ignoreNullFields": "false"})


def windows(asked: DataFrame, sources: DataFrame, *, most: int = 80) -> DataFrame:
    """E10. Numbered lines start_line .. end_line of files, ``most`` at most, moved into the file where they lie outside it.

    asked: query_id, file, start_line, end_line. A file that is not among the sources gives ``ok`` false and an error; one
    without lines the window 1 .. 0.
    """
    held = asked.join(sources.select("file", "text"), "file", "left")
    rows = held.withColumn("all", lines(F.col("text"))).withColumn("n", F.size("all"))
    first = F.greatest(F.lit(1), F.col("start_line"))
    last = F.least(F.greatest(first, F.col("end_line")), first + F.lit(most - 1))
    inside = F.col("n") > 0
    rows = rows.withColumn("first", F.when(inside, F.least(first, "n")).otherwise(F.lit(1))).withColumn("last", F.when(inside, F.least(last, "n")).otherwise(F.lit(0)))
    # A window that begins after the last line is that line.
    part = F.slice("all", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)))
    content = F.array_join(F.transform(part, lambda x, i: F.concat((i + F.col("first")).cast("string"), F.lit(": "), x)), "\n")
    known = F.col("text").isNotNull()
    return rows.select(
        "query_id", "file", known.alias("ok"), F.when(~known, F.lit("file is not in the candidate pool")).alias("error"),
        *[F.when(known, x.cast("int")).alias(n) for n, x in (("start_line", F.col("first")), ("end_line", F.col("last")))], F.when(known, content).alias("content"),
    )


def dry_run(shown: DataFrame) -> DataFrame:
    """E14. The answer without a model: candidates in their order, ranked from 1. shown: query_id, rank, file."""
    order = W.partitionBy("query_id").orderBy("rank")
    return shown.select("query_id", F.row_number().over(order).alias("position"), "file")
