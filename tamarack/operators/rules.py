"""Rules of single projects as data (L07-L09, E04): tests over a query's signals, ordered lists of reasons that stay, and terms that texts stand for.

A rule is a value, not code: another project's rules are another tuple. Signals are columns of one row a query: ``terms`` array<string>, ``files``
array<struct<rank, name, direct>> of its best files, ``top1`` (name), ``score_ratio``, ``n_direct``, ``first_direct_rank``, ``top1_direct``, ``project``. A null number
passes a test only where ``missing`` says so; null texts, arrays and flags pass none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import tokenize


@dataclass(frozen=True)
class Test:
    """One test of a signal: of words (has one of them), of files (one of these names, or with ``other`` none of them, between two ranks), or of a number."""

    of: str
    words: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    missing: bool = False
    other: bool = False

    def met(self) -> Column:
        if self.of == "terms":
            found = F.arrays_overlap("terms", _words(self.words))
        elif self.of in ("files", "direct"):
            found = F.exists("files", lambda f: self._named(f["name"]) & self._between(f["rank"]) & (f["direct"] if self.of == "direct" else F.lit(True)))
        elif self.words:
            found = self._named(F.col(self.of))
        elif self.low is None and self.high is None:
            found = ~F.col(self.of) if self.other else F.col(self.of)
        else:
            found = F.coalesce(self._between(F.col(self.of)), F.lit(self.missing))
        return F.coalesce(found, F.lit(False))

    def _named(self, name: Column) -> Column:
        known = name.isin(*self.words)
        return ~known if self.other else known

    def _between(self, x: Column) -> Column:
        out = x.isNotNull()
        out = out if self.low is None else out & (x >= self.low)
        out = out if self.high is None else out & (x <= self.high)
        return F.when(x.isNotNull(), out)


#: Groups of tests: each group needs one that is met.
Tests = tuple[tuple[Test, ...], ...]


@dataclass(frozen=True)
class Rule:
    reason: str
    tests: Tests


@dataclass(frozen=True)
class Keep:
    """Reasons that stay where the tests are met. A name with ``*`` at its end is a beginning; ``but`` names those that this entry leaves aside."""

    reason: str
    tests: Tests = ()
    but: tuple[str, ...] = ()


@dataclass(frozen=True)
class TermRule:
    """Terms that a source's text or names are looked through for, where a query has one of ``asked`` and one of ``context`` (if there are any)."""

    terms: tuple[str, ...]
    asked: tuple[str, ...]
    context: tuple[str, ...] = ()
    inside: str = ""
    ends: tuple[str, ...] = ()


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _all(tests: Tests) -> Column:
    out = F.lit(True)
    for group in tests:
        one = F.lit(False)
        for test in group:
            one |= test.met()
        out &= one
    return out


def _like(reason: Column, name: str) -> Column:
    return reason.startswith(name[:-1]) if name.endswith("*") else reason == name


# Fixed values.
_PROJECT = (Test("project", ("closure",)),)
GENERIC_TOP_FILES = ("AbstractCommandLineRunner.java", "AbstractCompiler.java", "CommandLineRunner.java", "Compiler.java", "CompilerOptions.java", "DefaultPassConfig.java", "Normalize.java")
CODE_OUTPUT_FILES = ("CodeConsumer.java", "CodeGenerator.java", "CodePrinter.java")
VALIDATOR_FILES = ("AstValidator.java", "SanityCheck.java", "Validator.java")
PATTERN_RULES = (
    Rule("pattern:closure_code_output", (
        _PROJECT, (Test("terms", ("codeprinter", "code")),), (Test("terms", ("codeprinter", "printer")),), (Test("files", CODE_OUTPUT_FILES, 1, 20),), (Test("score_ratio", low=1.15, missing=True),),
    )),
    Rule("pattern:closure_deep_specific_direct_hint", (
        _PROJECT, (Test("direct", GENERIC_TOP_FILES, 6, 20, other=True),), (Test("top1", GENERIC_TOP_FILES),), (Test("score_ratio", high=1.08, missing=True),),
    )),
    Rule("pattern:closure_code_generator_output", (
        _PROJECT, (Test("top1", ("CodePrinter.java",)),), (Test("files", ("CodeGenerator.java",), 1, 20),), (Test("terms", ("numeric", "key", "keys")),), (Test("score_ratio", high=1.05, missing=True),),
    )),
    Rule("pattern:closure_validator_transform_failure", (
        _PROJECT, (Test("top1", VALIDATOR_FILES),), (Test("direct", ("FunctionRewriter.java",), 6, 35),),
        *[(Test("terms", (t,)),) for t in ("illegalstateexception", "expected", "function", "call")],
    )),
)
_NO_DIRECT = Test("top1_direct", other=True)
_MANY = Test("n_direct", low=7)
COST_CONTROL = (
    Keep("low_score_ratio<=*", ((_NO_DIRECT,),)),
    Keep("top1_without_direct_hint", ((_NO_DIRECT,), (Test("first_direct_rank", low=3, missing=True),))),
    Keep("many_direct_hints>=*", ((_MANY,),)),
    Keep("pattern:pass_chain", ((_NO_DIRECT, _MANY, Test("score_ratio", low=1.40)),)),
    Keep("pattern:type_system", ((_NO_DIRECT, Test("score_ratio", high=1.10, missing=True)),)),
    Keep("pattern:type_cycle", ((_NO_DIRECT,),)),
    *[Keep(r.reason) for r in PATTERN_RULES],
)
TIGHT_PATTERNS = (
    Keep("*", but=("pattern:mockito_*", "pattern:type_cycle")),
    Keep("pattern:mockito_*", ((_NO_DIRECT,),)),
    Keep("pattern:mockito_generic", ((_MANY,),)),
    Keep("pattern:mockito_constructor_real_method", ((_MANY,), (Test("score_ratio", high=1.10),))),
    Keep("pattern:mockito_invocation_varargs", ((_MANY,), (Test("cost_control"),))),
    Keep("pattern:mockito_real_method_interface", ((_MANY,), (Test("cost_control"),))),
    Keep("pattern:mockito_injection"),
    Keep("pattern:type_cycle", ((_NO_DIRECT, Test("score_ratio", high=1.02, missing=True)),)),
)
_SCRIPTS = (".ts", ".tsx", ".js", ".jsx")
TERM_RULES = (
    TermRule(("clear", "copy", "next", "random", "reset", "sample", "seed", "set"), ("clone", "copy", "generator", "random", "reseed", "sample", "seed", "state")),
    TermRule(("cycle", "handle", "resolve", "subtype", "type"), ("cycle", "extends", "implements", "inheritance", "interface", "recursive", "stackoverflowerror", "subtype")),
    TermRule(
        ("bytebuddy", "classinstantiator", "constructor", "create", "instantiate", "instantiator", "mock", "mocked", "settings", "type"),
        ("abstract", "constructor", "constructors", "inner", "mocking", "outer", "outerinstance", "spy", "useconstructor"), inside="mockito",
    ),
    TermRule(("amount", "currency", "eur", "euro", "format", "formatcurrency", "invoice", "price", "total", "usd"), ("currency", "dollar", "dollars", "euro", "euros", "usd"), ends=_SCRIPTS),
    TermRule(
        ("button", "confirm", "continue", "create", "creating", "disabled", "handlecreateinvoice", "handlesubmit", "isdisabled", "isloading", "ispending", "isprocessing", "issubmitting",
         "loading", "mutate", "mutation", "onclick", "pending", "processing", "setisprocessing", "submit"),
        ("loading",), ("button", "buttons", "confirm", "skeleton"), ends=_SCRIPTS,
    ),
)


def pattern_reasons(signals: DataFrame, rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """L07. signals with ``patterns``: the reasons of the rules that hold, in the rules' order."""
    return signals.withColumn("patterns", F.array_compact(F.array(*[F.when(_all(r.tests), F.lit(r.reason)) for r in rules])))


def kept_reasons(rows: DataFrame, keeps: tuple[Keep, ...], column: str = "reasons") -> DataFrame:
    """L08, L09. rows with the reasons of ``column`` that an entry keeps, each once, in the order of the entries and then as they stood."""
    none = F.array().cast("array<string>")

    def of(keep: Keep) -> Column:
        def fits(reason: Column) -> Column:
            out = _like(reason, keep.reason)
            for name in keep.but:
                out &= ~_like(reason, name)
            return out

        return F.when(_all(keep.tests), F.filter(F.coalesce(F.col(column), none), fits)).otherwise(none)

    return rows.withColumn(column, F.array_distinct(F.flatten(F.array(*[of(k) for k in keeps]))))


def semantic_terms(pairs: DataFrame, rules: tuple[TermRule, ...] = TERM_RULES, *, head: int = 4_000) -> DataFrame:
    """E04. (query_id, file, terms): terms of the rules that fit query and file, where the source's names, path or first ``head`` characters have them, and all terms of its
    names that share one. pairs: query_id, file, query_terms, methods, classes, text.
    """
    wanted = F.array().cast("array<string>")
    for rule in rules:
        fits = F.arrays_overlap("query_terms", _words(rule.asked))
        if rule.context:
            fits &= F.arrays_overlap("query_terms", _words(rule.context))
        if rule.inside:
            fits &= F.contains(F.lower("file"), F.lit(rule.inside))
        if rule.ends:
            ends = F.lit(False)
            for end in rule.ends:
                ends |= F.col("file").endswith(end)
            fits &= ends
        wanted = F.array_union(wanted, F.when(fits, _words(rule.terms)).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    rows = pairs.select("query_id", "file", F.concat(F.coalesce("methods", none), F.coalesce("classes", none)).alias("names"), F.coalesce("text", F.lit("")).alias("text"), wanted.alias("wanted")).filter(F.size("wanted") > 0)
    own = tokenize(F.concat_ws(" ", F.array_join("names", " "), "file", F.substring("text", 1, head)))
    named = F.filter("names", lambda n: F.arrays_overlap(tokenize(n), F.col("wanted")))
    terms = F.array_union(F.array_intersect("wanted", own), F.flatten(F.transform(named, lambda n: F.array_append(tokenize(n), F.lower(n)))))
    return rows.select("query_id", "file", F.array_sort(terms).alias("terms")).filter(F.size("terms") > 0)
