"""Test sources as context: the classes and methods of failing tests against the files that declare them.

Windows are cut once per file and method, and imports once per file, so a source's text is met with the methods that are looked for in it, not with
every query that names it. Nulls: a query without located classes has no context; a class without a file is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import lines, method_window
from tamarack.operators.evidence import locate
from tamarack.operators.tables import dealt, kept

# Fixed value.
IMPORT = r"(?m)^\s*import\s+((?:[A-Za-z_][A-Za-z0-9_]*\.)+[A-Za-z_][A-Za-z0-9_]*);"
#: Lines of a file that has none of the methods, imports that are shown, and lines of a window.
HEAD, IMPORTS, CONTEXT, SHOWN_CONTEXT = 80, 30, 35, 44


def imports(text: Column) -> Column:
    """Names that a source imports, in order."""
    return F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1))


def _met(classes: DataFrame, methods: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, class, file), sources of these files, and (query_id, file, method) that are looked for."""
    wanted = classes.select("query_id", "class").distinct()
    places = locate(sources.select("file"), wanted.select("class").distinct())
    # Kept, so that its few rows go to the sources, not the sources' texts to them.
    at = kept(wanted.join(places, "class"))
    held = dealt(sources.select("file", F.coalesce("text", F.lit("")).alias("text")).join(at.select("file").distinct(), "file", "left_semi"), "file")
    return at, held, at.select("query_id", "file").distinct().join(methods.select("query_id", "method").distinct(), "query_id")


def _windows(held: DataFrame, asked: DataFrame, context: int, numbered: bool) -> DataFrame:
    """(file, method, window, occurs): the method's window, empty without a declaration, and whether its name occurs at all."""
    pairs = asked.select("file", "method").distinct().join(held, "file")
    return pairs.select("file", "method", method_window(F.col("text"), F.col("method"), context, numbered=numbered).alias("window"), F.contains("text", "method").alias("occurs"))


def _in_order(rows: DataFrame, by: list[str], order: str, part: str) -> DataFrame:
    """Parts of each group, those that are not empty, in order."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col(part) != "", F.struct(order, part)))).alias("parts")).withColumn("parts", F.transform("parts", lambda p: p[part]))


def test_contexts(classes: DataFrame, methods: DataFrame, sources: DataFrame, *, context: int = CONTEXT, head: int = HEAD) -> DataFrame:
    """R07. (query_id, context): per class, in order, the imports of its file, then the windows of the query's methods in it, by name.

    A file in which none of the methods occurs gives its first ``head`` lines instead. classes: query_id, class (dotted); methods: query_id, method;
    sources: file, text.
    """
    at, held, asked = _met(classes, methods, sources)
    found = asked.join(_windows(held, asked, context, False), ["file", "method"])
    windows = _in_order(found, ["query_id", "file"], "method", "window")
    occurs = found.groupBy("query_id", "file").agg(F.max("occurs").alias("occurs"))
    parts = held.select("file", F.array_join(imports(F.col("text")), "\n").alias("imports"), F.array_join(F.slice(lines(F.col("text")), 1, head), "\n").alias("head"))
    rows = at.join(parts, "file").join(windows, ["query_id", "file"], "left").join(occurs, ["query_id", "file"], "left")
    none = F.array().cast("array<string>")
    whole = F.concat(F.array("imports"), F.coalesce("parts", none), F.when(F.coalesce("occurs", F.lit(False)), none).otherwise(F.array("head")))
    told = rows.withColumn("told", F.array_join(F.filter(whole, lambda p: p != ""), "\n"))
    return _in_order(told, ["query_id"], "class", "told").select("query_id", F.array_join("parts", "\n").alias("context"))


def shown_contexts(classes: DataFrame, methods: DataFrame, sources: DataFrame, *, max_chars: int, context: int = SHOWN_CONTEXT) -> DataFrame:
    """E03. (query_id, context) for a prompt: per class file, class, imports and numbered windows, cut to ``max_chars`` with a note."""
    at, held, asked = _met(classes, methods, sources)
    found = asked.join(_windows(held, asked, context, True), ["file", "method"]).filter("window <> ''")
    windows = _in_order(found.withColumn("window", F.concat(F.lit("method: "), "method", F.lit("\n"), "window")), ["query_id", "file"], "method", "window")
    rows = at.join(held.select("file", F.slice(imports(F.col("text")), 1, IMPORTS).alias("imports")), "file").join(windows, ["query_id", "file"], "left")
    some = lambda title, parts, between: F.when(F.size(parts) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(parts, between)))
    parts = F.concat_ws("\n", F.concat(F.lit("file: "), "file"), F.concat(F.lit("class: "), "class"), some("imports", F.col("imports"), "\n"), some("snippets", F.col("parts"), "\n\n"))
    whole = _in_order(rows.withColumn("told", parts), ["query_id"], "class", "told").select("query_id", F.array_join("parts", "\n\n---\n\n").alias("all"))
    cut = F.concat(F.substring("all", 1, max_chars), F.lit("\n...[truncated]"))
    return whole.select("query_id", F.when(F.char_length("all") <= max_chars, F.col("all")).otherwise(cut).alias("context"))
