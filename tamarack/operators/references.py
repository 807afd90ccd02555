"""Candidates that the texts of the best candidates point at (R15 references, R16 chains of passes), kept in the pool.

Both are joins: names that the pool's best files mention, of classes that the corpus declares, meet the files that declare them. A pool is rows
(query_id, rank, file, total, reasons); ``ranked`` holds every scored file of a query the same way, by the ranking before any retention. It may be a function that
gives those of the pairs (query_id, file) it is asked for, with ranks that are null or more than k beyond the k best: then all others need not be ranked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import base_name, class_terms, has_reason
from tamarack.operators.hybrid import retain
from tamarack.operators.tables import kept

# Fixed values.
CLASS_IDENTIFIER = r"(?U)\b[A-Z][A-Za-z0-9_]{2,}\b"
CONSTRUCTOR = r"(?U)\bnew\s+([A-Z][A-Za-z0-9_]*)\s*\("
REFERENCE_BOOST, REFERENCE_TOP = 260.0, 12
PASS_CHAIN_EVIDENCE_TERMS = (
    "advanced", "check", "collapse", "compiler", "compilation", "fold", "inline", "late", "normalize", "optimization", "optimizations", "options",
    "peephole", "remove", "simple", "substitute",
)
PASS_CHAIN_CLASS_TERMS = (
    "alias", "check", "collapse", "collect", "compiler", "dead", "fold", "inline", "normalize", "optimization", "optimizations", "pass",
    "peephole", "remove", "substitute", "var",
)
OPTIMIZATION_TERMS = ("optimization", "optimizations")


@dataclass(frozen=True)
class Chain:
    """Which chains count: files with a class of ``suffix`` name others by their constructors.

    A named class counts if its terms have one of ``always``, or one that is both of ``classes`` and of the query's ``evidence`` (None: all terms are).
    Each bonus (class terms, query terms, points) adds to the boost where both meet.
    """

    suffix: str = "PassConfig"
    evidence: tuple[str, ...] | None = PASS_CHAIN_EVIDENCE_TERMS
    classes: tuple[str, ...] | None = PASS_CHAIN_CLASS_TERMS
    always: tuple[str, ...] = ("pass", "peephole")
    boost: float = 700.0
    bonuses: tuple[tuple[tuple[str, ...], tuple[str, ...], float], ...] = ((OPTIMIZATION_TERMS, OPTIMIZATION_TERMS, 520.0), (("peephole",), OPTIMIZATION_TERMS, 160.0))
    most: int = 12
    top: int = 20


def _words(terms: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def _within(terms: Column, words: tuple[str, ...] | None) -> Column:
    return terms if words is None else F.array_intersect(terms, _words(words))


def _named(sources: DataFrame, files: DataFrame, pattern: str, group: int) -> DataFrame:
    """(file, name): names in the texts of files, of classes that the corpus declares and the file does not."""
    declared = sources.select(F.explode("classes").alias("name")).distinct()
    held = sources.join(files.select("file").distinct(), "file", "left_semi")
    names = F.array_except(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(group)), F.coalesce("classes", F.array().cast("array<string>")))
    return held.select("file", F.explode(names).alias("name")).join(declared, "name", "left_semi")


def reference_hints(pool: DataFrame, sources: DataFrame, *, top: int = REFERENCE_TOP) -> DataFrame:
    """R15. (query_id, name): classes of the corpus that the ``top`` best files of a pool mention. sources: file, classes, text."""
    best = pool.filter(F.col("rank") <= top).select("query_id", "file")
    return best.join(_named(sources, best, CLASS_IDENTIFIER, 0), "file").select("query_id", "name").distinct()


def chain_hints(pool: DataFrame, sources: DataFrame, terms: DataFrame, chain: Chain = Chain()) -> DataFrame:
    """R16. (query_id, name, origin, boost): classes that configuration files among the best construct, and these files' stems. terms: query_id, terms."""
    best = pool.filter(F.col("rank") <= chain.top).select("query_id", "file")
    config = sources.filter(F.exists("classes", lambda c: c.endswith(chain.suffix)))
    best = best.join(config.select("file"), "file", "left_semi")
    own = class_terms(F.col("name"))
    rows = best.join(_named(sources, best, CONSTRUCTOR, 1), "file").join(terms, "query_id").withColumn("evidence", _within(F.col("terms"), chain.evidence))
    counts = F.arrays_overlap(own, _words(chain.always)) | F.arrays_overlap(_within(own, chain.classes), F.col("evidence"))
    boost = F.lit(chain.boost)
    for classes, words, points in chain.bonuses:
        boost += F.when(F.arrays_overlap(own, _words(classes)) & F.arrays_overlap(F.col("terms"), _words(words)), points).otherwise(0.0)
    kept = rows.filter((F.size("evidence") > 0) & F.coalesce(counts, F.lit(False)))
    return kept.select("query_id", "name", F.regexp_replace(base_name(F.col("file")), r"(?<=.)\.[^.]*$", "").alias("origin"), boost.alias("boost")).distinct()


Ranked = DataFrame | Callable[[DataFrame], DataFrame]


def _outside(found: DataFrame, pool: DataFrame, ranked: Ranked, k: int) -> DataFrame:
    """Rows of found (query_id, file ...) outside of the pool, and of the k best before it, with total and reasons; a file without a score has 0."""
    if not isinstance(ranked, DataFrame):
        found = kept(found)
        ranked = ranked(found.select("query_id", "file"))
    known = ranked.select("query_id", "file", F.col("rank").alias("was"), "total", F.col("reasons").alias("old"))
    rows = found.join(known, ["query_id", "file"], "left").filter(F.col("was").isNull() | (F.col("was") > k))
    rows = rows.join(pool.select("query_id", "file"), ["query_id", "file"], "left_anti")
    return rows.withColumn("total", F.coalesce("total", F.lit(0.0))).withColumn("old", F.coalesce("old", F.array().cast("array<string>")))


def _joined(pool: DataFrame, come: DataFrame, k: int, kept: tuple[str, ...], **how) -> DataFrame:
    """The pool after newcomers (query_id, file, total, reasons) took the places of those that have none of the kept reasons."""
    reason = F.lit(False)
    for prefix in kept:
        reason |= has_reason(F.col("reasons"), prefix)
    order = W.partitionBy("query_id").orderBy(F.col("total").desc(), "file")
    come = come.withColumn("rank", (F.row_number().over(order) + k).cast("int")).withColumn("protected", F.lit(True))
    inside = pool.filter(F.col("rank") <= k).withColumn("protected", reason)
    names = ["query_id", "rank", "file", "total", "reasons", "protected"]
    return retain(inside.select(names).unionByName(come.select(names)), k=k, protected="protected", **how).drop("protected")


def keep_references(pool: DataFrame, ranked: Ranked, sources: DataFrame, *, k: int, top: int = REFERENCE_TOP, boost: float = REFERENCE_BOOST) -> DataFrame:
    """R15. The pool with the files that declare a mentioned class, sorted anew: each takes the place of the last one without a direct reason."""
    declared = sources.select("file", F.explode(F.array_distinct("classes")).alias("name"))
    found = reference_hints(pool, sources, top=top).join(declared, "name").groupBy("query_id", "file").agg(F.array_sort(F.collect_set("name")).alias("names"))
    come = _outside(found, pool, ranked, k)
    reason = F.concat(F.lit("reference_class_hint:"), F.array_join(F.slice("names", 1, 4), ","))
    come = come.select("query_id", "file", (F.col("total") + boost).alias("total"), F.array_append("old", reason).alias("reasons"))
    return _joined(pool, come, k, ("direct_", "reference_"))


def keep_chains(pool: DataFrame, ranked: Ranked, sources: DataFrame, terms: DataFrame, *, k: int, chain: Chain = Chain()) -> DataFrame:
    """R16. The pool with at most ``chain.most`` files that declare a constructed class, in the places that they freed, among themselves by total."""
    declared = sources.select("file", F.explode(F.array_distinct("classes")).alias("name"))
    hints = chain_hints(pool, sources, terms, chain).groupBy("query_id", "name").agg(F.array_sort(F.collect_set("origin")).alias("origins"), F.max("boost").alias("boost"))
    told = F.concat(F.lit("pass_chain_hint:"), F.array_join(F.slice("origins", 1, 3), ","), F.lit("->"), "name")
    found = hints.join(declared, "name").groupBy("query_id", "file").agg(F.array_sort(F.collect_list(F.struct("name", told.alias("told")))).alias("names"), F.max("boost").alias("boost"))
    come = _outside(found, pool, ranked, k)
    more = F.transform(F.slice("names", 1, 4), lambda n: n["told"])
    come = come.select("query_id", "file", (F.col("total") + F.col("boost")).alias("total"), F.concat("old", more).alias("reasons"))
    return _joined(pool, come, k, ("direct_", "reference_", "pass_chain_"), cap=chain.most, resort=False)
