"""Evidence from tests, traces and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import base_name, lines, simple_name, source_hint, stack_frames

# Fixed values.
TEST_FOLDERS = ("src/test/java", "src/test", "test")
NOISY_HINTS = (
    "Assert", "AssertionFailedError", "BlockJUnit4ClassRunner", "DefaultExecutor", "DelegatingMethodAccessorImpl", "DispatchUtils", "FrameworkMethod",
    "InvokeMethod", "JUnit4TestAdapter", "JUnitTask", "JUnitTestRunner", "Launcher", "Main", "Method", "NativeMethodAccessorImpl", "ParentRunner", "Project",
    "ReflectiveCallable", "RunAfters", "RunBefores", "Target", "Task", "UnknownElement",
)
#: A dotted name of a class, with parts below it in small letters.
DOTTED_CLASS = r"\b(?:[a-z_][A-Za-z0-9_]*+\.)++[A-Z][A-Za-z0-9_]*(?:\$[A-Za-z0-9_]+)?"
MISMATCH_TERMS = ("mismatch", "inconsistent", "required", "found")


def locate(files: DataFrame, classes: DataFrame) -> DataFrame:
    """R06. (class, file): the file of each dotted class. First its place below the test folders, in their order, then a
    file of its name below some ``test`` folder, then any, each the least path. files: file; classes: class.
    """
    named = classes.withColumn("name", F.concat(F.substring_index("class", ".", -1), F.lit(".java")))
    met = named.join(files.withColumn("name", base_name(F.col("file"))), "name")
    place = F.concat(F.replace(F.col("class"), F.lit("."), F.lit("/")), F.lit(".java"))
    rank = F.when(F.array_contains(F.split(F.lower("file"), "/"), "test"), F.lit(len(TEST_FOLDERS))).otherwise(F.lit(len(TEST_FOLDERS) + 1))
    for i, folder in reversed(list(enumerate(TEST_FOLDERS))):
        rank = F.when(F.col("file") == F.concat(F.lit(f"{folder}/"), place), F.lit(i)).otherwise(rank)
    return met.groupBy("class").agg(F.min(F.struct(rank.alias("rank"), "file")).alias("best")).select("class", F.col("best.file").alias("file"))


def direct_hints(tests: Column, trace: Column, package: str) -> Column:
    """R08. Classes that tests, the project's frames and its dotted class names in the trace hint at, each once, in order, without noise.

    A test class hints at the class that its name says it tests; a frame's or named class, unless it is a test, at itself.
    """
    tested = F.transform(tests, lambda t: source_hint(simple_name(t)))

    def own(full: Column) -> Column:
        name = simple_name(full)
        return F.coalesce(source_hint(name), F.when(~name.endswith("Test"), name))

    framed = F.transform(stack_frames(trace, package), lambda frame: own(frame["class"]))
    named = F.transform(F.filter(F.regexp_extract_all(trace, F.lit(DOTTED_CLASS), F.lit(0)), lambda x: x.startswith(package)), own)
    noise = F.array(*[F.lit(x) for x in NOISY_HINTS])
    return F.array_sort(F.array_except(F.array_distinct(F.array_compact(F.concat(tested, framed, named))), noise))


def type_boost(file: Column, class_terms: Column, hints: Column, terms: Column) -> Column:
    """R12. Boost of type-system files where a type checker is hinted at and the terms speak of a type mismatch."""
    has = lambda words: F.arrays_overlap(terms, F.array(*[F.lit(w) for w in words]))
    gate = F.array_contains(hints, "TypeCheck") & F.array_contains(terms, "type") & has(MISMATCH_TERMS)
    inference = F.when(file.endswith("TypeInference.java") & has(("function", "object", "return", "type")), F.lit(130.0)).otherwise(F.lit(0.0))
    typed = F.contains(file, F.lit("/rhino/jstype/")) & F.array_contains(class_terms, "type")
    both = F.array_contains(class_terms, "object") & F.array_contains(terms, "object")
    kind = F.when(typed & both, F.lit(130.0)).when(typed & F.arrays_overlap(class_terms, terms), F.lit(55.0)).otherwise(F.lit(0.0))
    return F.when(gate, F.greatest(inference, kind)).otherwise(F.lit(0.0))


def strong_candidates(ranked: DataFrame, boost: str, least: float, deepest: int | None = None) -> DataFrame:
    """L05. (query_id, n, n_strong): candidates with a boost, and those with ``least`` or more of it in the first ranks."""
    strong = (F.col(boost) >= least) & (F.lit(True) if deepest is None else F.col("rank").between(1, deepest))
    return ranked.groupBy("query_id").agg(F.count_if(F.col(boost) > 0).alias("n"), F.count_if((F.col(boost) > 0) & strong).alias("n_strong"))


def rule_signals(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """L06. (id, rule) of the rules whose term sets a text meets.

    tokens: id, term; rules: rule, part, term, least. A rule holds where every part has ``least`` of its terms or more.
    Rules are rows, so a new one needs no code.
    """
    hits = tokens.distinct().join(rules, "term").groupBy("id", "rule", "part").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    met = hits.filter(F.col("n") >= F.col("least")).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("met"))
    return met.join(rules.groupBy("rule").agg(F.count_distinct("part").alias("parts")), "rule").filter(F.col("met") == F.col("parts")).select("id", "rule")


def stack_snippet(sources: DataFrame, traces: DataFrame, *, most: int = 24, context: int = 5) -> DataFrame:
    """E01. (id, file, snippet): numbered lines around the places that a trace names in a file, ``...`` between gaps.

    sources: file, text; traces: id, file, trace.
    """
    pairs = traces.select("id", "file", F.explode(F.regexp_extract_all("trace", F.lit(r"\(([\w.$]+:\d+)\)"), F.lit(1))).alias("spot"))
    pairs = pairs.filter(F.substring_index("spot", ":", 1) == base_name(F.col("file"))).withColumn("at", F.substring_index("spot", ":", -1).cast("int"))
    wanted = pairs.select("id", "file", F.explode(F.sequence(F.col("at") - context, F.col("at") + context)).alias("line")).distinct()
    numbered = sources.select("file", F.posexplode(lines(F.col("text"))).alias("i", "content")).withColumn("line", F.col("i") + 1)
    by = W.partitionBy("id", "file").orderBy("line")
    rows = wanted.join(numbered, ["file", "line"]).withColumn("k", F.row_number().over(by)).filter(F.col("k") <= most)
    shown = F.concat(F.when(F.col("line") > F.lag("line").over(by) + 1, F.lit("...\n")).otherwise(F.lit("")), F.col("line").cast("string"), F.lit(": "), F.col("content"))
    told = rows.withColumn("shown", shown).groupBy("id", "file").agg(F.array_sort(F.collect_list(F.struct("line", "shown"))).alias("all"))
    return told.select("id", "file", F.array_join(F.transform("all", lambda x: x["shown"]), "\n").alias("snippet"))


def usage_add(left: Column, right: Column) -> Column:
    """E16. Sum of two maps of counts; a key that one lacks counts 0."""
    return F.map_zip_with(left, F.coalesce(right, F.create_map().cast("map<string,bigint>")), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
