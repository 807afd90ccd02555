"""Snippets of candidates for a reranker (E02): the lines of a file that fit a query best, with their surroundings, within a budget of lines.

Lines are scored by the query's terms that they hold. From the best line down, a line's surroundings are laid down in a fixed order until the budget is
full. As data: each scored line is spread over the offsets of its context, a place in the file keeps the first of its spreads, and the first
``max_lines`` places in that order are the snippet. What counts for how much is a table of rules (``LineRule``), so that a project brings its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import has_numeric_output_signal, is_comment_header, lines, relevant_terms, tokenize
from tamarack.operators.evidence import stack_snippet
from tamarack.operators.tables import dealt

# Terms whose lines count three times more and that save a comment, terms that widen the context, terms that a numeric mismatch adds.
HIGH_SIGNAL_TERMS = (
    "addnumber", "addsingletongetter", "allocation", "api", "bounds", "button", "bytebuddy", "chain", "clear", "clone", "constructor", "count",
    "currency", "cycle", "declaration", "declarations", "declare", "declared", "declares", "detected", "extends", "formatcurrency",
    "getdeclaredtype", "getinstance", "getprop", "getter", "implements", "inheritance", "instantiate", "instantiator", "interface",
    "isdisabled", "isloading", "ispending", "isprocessing", "issubmitting", "loading", "maybedeclarequalifiedname", "mock", "negative", "number",
    "numeric", "onclick", "propname", "property", "prototype", "qname", "qualified", "qualifiedname", "recursive", "reseed", "reset", "resolve",
    "resolved", "rhsvalue", "sample", "serialization", "singleton", "stackoverflowerror", "state", "subtype", "tostring", "unresolved",
    "unreviewed", "useconstructor", "usequery", "valueof", "warning", "zero",
)
WIDE_CONTEXT_TERMS = (
    "addnumber", "addsingletongetter", "api", "button", "count", "currency", "formatcurrency", "getinstance", "getter", "isdisabled", "isloading",
    "ispending", "isprocessing", "issubmitting", "loading", "maybedeclarequalifiedname", "mock", "negative", "number", "numeric", "onclick",
    "propname", "property", "prototype", "qname", "qualified", "qualifiedname", "queryfn", "rhsvalue", "singleton", "tostring", "unreviewed",
    "usequery", "valueof", "zero",
)
WIDEST_CONTEXT_TERMS = ("button", "isdisabled", "onclick")
NUMERIC_OUTPUT_TERMS = ("abs", "addnumber", "long", "math", "negative", "number", "string", "tostring", "value", "valueof", "zero")
GETTER_TERMS = ("addsingletongetter", "getter", "getinstance", "singleton")
WIDE, WIDEST = 4, 8


@dataclass(frozen=True)
class LineRule:
    """``points`` for a line that ``pattern`` finds, where the query has one of ``terms`` (any query, if there are none)."""

    points: float
    pattern: str
    terms: tuple[str, ...] = ()
    lower: bool = False


#: Fixed values.
LINE_RULES = (
    LineRule(14.0, r"<\s*button\b|<\s*Button\b", ("button",)),
    LineRule(6.0, r"\bis(?:Loading|Pending|Submitting)\b", ("loading", "isloading", "ispending", "issubmitting")),
    LineRule(10.0, r"\bcurrency\s*:|\b(?:USD|EUR)\b", ("currency", "usd", "eur", "euro")),
    LineRule(4.0, "confirm|continue|create invoice|yes, i confirm", ("confirm",), lower=True),
    LineRule(1.0, r"\b(?:class|interface|enum|record)\s+[A-Za-z_][A-Za-z0-9_]*"),
    LineRule(0.5, r"\b[A-Za-z_][A-Za-z0-9_]*\s*\("),
)


def _words(terms: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def _any(terms: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(terms, _words(words))


def snippet_terms(query: Column) -> Column:
    """The terms that lines are scored by: a query's relevant ones, and those of printed numbers where it speaks of a wrong one."""
    terms = relevant_terms(query)
    return F.when(has_numeric_output_signal(query, terms), F.array_union(terms, _words(NUMERIC_OUTPUT_TERMS))).otherwise(terms)


def line_score(line: Column, own: Column, terms: Column, rules: tuple[LineRule, ...] = LINE_RULES) -> Column:
    """Points of a line with tokens ``own``; null where it holds none of the terms, or is a comment without a telling one."""
    matched = F.array_intersect(own, terms)
    telling = F.size(F.array_intersect(matched, _words(HIGH_SIGNAL_TERMS)))
    score = F.size(matched) + 3.0 * telling
    score += F.when(_any(terms, GETTER_TERMS), 6.0 * F.size(F.array_intersect(own, _words(GETTER_TERMS)))).otherwise(0.0)
    for rule in rules:
        hit = (F.lower(line) if rule.lower else line).rlike(rule.pattern)
        score += F.when(hit & _any(terms, rule.terms) if rule.terms else hit, rule.points).otherwise(0.0)
    return F.when((F.size(matched) > 0) & ~(is_comment_header(line) & (telling == 0)), score)


def snippets(asked: DataFrame, sources: DataFrame, *, max_lines: int = 24, context: int = 1, rules: tuple[LineRule, ...] = LINE_RULES) -> DataFrame:
    """(query_id, file, snippet) of asked (query_id, file, query, trace), pairs each once, for files that sources (file, text) has.

    The lines that the trace names in the file come first (E01). Else the scored lines with their context; a query without terms, and a file
    without a scored line, gets the first ``max_lines`` lines without numbers. Null queries, traces and texts are empty.
    """
    asked = asked.select("query_id", "file", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("trace", F.lit("")).alias("trace"))
    # Only the files that are asked for are cut into lines.
    held = dealt(sources.select("file", F.coalesce("text", F.lit("")).alias("text")).join(asked.select("file").distinct(), "file", "left_semi"), "file")
    pairs = asked.withColumn("pair", F.struct("query_id", "file"))
    stacked = stack_snippet(held, pairs.filter(F.col("trace").rlike(r"\([\w.$]+:\d+\)")).select(F.col("pair").alias("id"), "file", "trace"), most=max_lines)
    stacked = stacked.select(F.col("id.query_id").alias("query_id"), "file", F.col("snippet").alias("stacked"))

    numbered = held.select("file", F.size(lines(F.col("text"))).alias("n"), F.posexplode(lines(F.col("text"))).alias("at", "line"))
    owned = numbered.withColumn("own", F.array_distinct(tokenize(F.col("line"))))
    wanted = asked.select("query_id", "file", snippet_terms(F.col("query")).alias("terms"))
    scored = wanted.join(owned, "file").withColumn("score", line_score(F.col("line"), F.col("own"), F.col("terms"), rules)).filter("score IS NOT NULL")
    wide = F.greatest(F.lit(context), F.when(_any(F.col("terms"), WIDEST_CONTEXT_TERMS), WIDEST).when(_any(F.col("terms"), WIDE_CONTEXT_TERMS), WIDE).otherwise(0))
    place = scored.select("query_id", "file", "at", "n", wide.alias("wide"), F.row_number().over(W.partitionBy("query_id", "file").orderBy(F.col("score").desc(), "at")).alias("nth"))
    # The line, then those behind it, then those before it, from near to far.
    offsets = F.flatten(F.array(F.array(F.lit(0)), F.sequence(F.lit(1), F.col("wide")), F.transform(F.sequence(F.lit(1), F.col("wide")), lambda d: -d)))
    offsets = F.when(F.col("wide") > 0, offsets).otherwise(F.array(F.lit(0)))
    spread = place.select("query_id", "file", "nth", "n", "at", F.posexplode(offsets).alias("step", "offset"))
    spread = spread.withColumn("at", F.col("at") + F.col("offset")).filter((F.col("at") >= 0) & (F.col("at") < F.col("n")))
    firsts = spread.groupBy("query_id", "file", "at").agg(F.min(F.struct("nth", "step")).alias("first"))
    chosen = firsts.withColumn("k", F.row_number().over(W.partitionBy("query_id", "file").orderBy("first"))).filter(F.col("k") <= max_lines)
    by = W.partitionBy("query_id", "file").orderBy("at")
    told = chosen.join(numbered.select("file", "at", "line"), ["file", "at"]).withColumn("gap", F.col("at") > F.lag("at").over(by) + 1)
    shown = F.concat(F.when(F.col("gap"), F.lit("...\n")).otherwise(F.lit("")), (F.col("at") + 1).cast("string"), F.lit(": "), F.col("line"))
    found = told.groupBy("query_id", "file").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown")))).alias("all"))
    found = found.select("query_id", "file", F.array_join(F.transform("all", lambda x: x["shown"]), "\n").alias("found"))

    head = F.array_join(F.slice(lines(F.col("text")), 1, max_lines), "\n")
    out = asked.join(held.select("file", head.alias("head")), "file").join(stacked, ["query_id", "file"], "left").join(found, ["query_id", "file"], "left")
    return out.select("query_id", "file", F.coalesce("stacked", "found", "head").alias("snippet"))
