"""Text functions as column expressions: tokens, stack traces, names, snippets and coercions. None needs Python in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.arrays import let, running

# Fixed values.
NOISY_PREFIXES = ("java.", "java.base/", "jdk.", "jdk.internal.", "org.junit.", "junit.framework.", "org.apache.tools.ant.")
STOP_TOKENS = (
    "a", "an", "abstract", "and", "at", "be", "boolean", "but", "by", "for", "from", "if", "in", "int", "into", "is", "it", "java",
    "junit", "double", "float", "not", "of", "on", "or", "org", "apache", "commons", "com", "google", "javascript", "jscomp", "rhino",
    "jstype", "framework", "assertion", "failed", "lang3", "test", "tests", "src", "main", "long", "class", "public", "private",
    "protected", "static", "final", "void", "return", "that", "the", "this", "to", "was", "with", "you",
)
#: Line ends of Python's str.splitlines.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_camel(name: Column) -> Column:
    """T02. Parts between other characters than letters and digits, cut before a capital that follows a small letter or digit."""
    chunks = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda x: x != "")
    parts = F.flatten(F.transform(chunks, lambda x: F.split(x, "(?<=[a-z0-9])(?=[A-Z])")))
    return F.filter(parts, lambda x: x != "")


def tokenize(text: Column) -> Column:
    """T01. Each run of ASCII letters and digits, lower-cased, followed by its camel parts that differ from it; repeats stay.

    Few texts have a camel boundary; the others skip the search for parts.
    """
    raw = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))

    def of(word: Column) -> Column:
        whole = F.lower(word)
        parts = F.transform(F.split(word, "(?<=[a-z0-9])(?=[A-Z])"), F.lower)
        return F.concat(F.array(whole), F.filter(parts, lambda p: p != whole))

    return F.when(text.rlike("[a-z0-9][A-Z]"), F.flatten(F.transform(raw, of))).otherwise(F.transform(raw, F.lower))


def lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: eleven line ends, no empty line at the end, none of an empty text."""
    parts = F.split(text, LINE_ENDS, -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def strip(text: Column) -> Column:
    """str.strip: white space of all kinds, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def runtime_context(trace: Column) -> Column:
    """T03. The trace without blank lines and frames of the platform; section headers and messages stay."""
    stripped = F.transform(lines(trace), strip)

    def stays(line: Column) -> Column:
        frame = strip(F.substring(line, F.lit(4), F.char_length(line)))
        noisy = F.exists(F.array(*[F.lit(p) for p in NOISY_PREFIXES]), lambda p: frame.startswith(p))
        return (line != "") & (line.startswith("---") | ~line.startswith("at ") | ~noisy)

    return F.array_join(F.filter(stripped, stays), "\n")


def compact_trace(trace: Column, most: int = 3, max_chars: int = 60_000) -> Column:
    """T04. At most ``most`` equal frames in a row, then a note of how many were left out; cut to ``max_chars`` with a note.

    A line that is no frame, or not like the one before, begins a run; a running maximum tells each line where its run began.
    """

    def told(all_: Column, starts: Column) -> Column:
        def shown(line: Column, i: Column) -> Column:
            nth = i - F.element_at(starts, i + 1) + 1
            ends = ~F.coalesce(F.try_element_at(starts, i + 2) == F.element_at(starts, i + 1), F.lit(False))
            note = F.concat(F.lit("\t... repeated identical frame omitted "), (nth - most).cast("string"), F.lit(" time(s)"))
            return F.when(nth <= most, F.array(line)).when(ends, F.array(note)).otherwise(F.array().cast("array<string>"))

        return F.array_join(F.flatten(F.transform(all_, shown)), "\n")

    def runs(all_: Column) -> Column:
        again = lambda line, i: strip(line).startswith("at ") & line.eqNullSafe(F.try_element_at(all_, i)) & (i > 0)
        begins = F.transform(all_, lambda line, i: F.when((i > 0) & again(line, F.greatest(i, F.lit(1))), 0).otherwise(i))
        return running(begins, F.lit(0), lambda a, b: F.greatest(a, b))

    joined = let(lines(trace), lambda all_: let(runs(all_), lambda starts: told(all_, starts)))
    cut = lambda x: F.when(F.char_length(x) <= max_chars, x).otherwise(F.concat(F.substring(x, 1, max_chars), F.lit("\n...[stack trace truncated]")))
    return let(joined, cut)


def focused_trace(trace: Column, wanted: Column) -> Column:
    """T05. The sections (a line ``--- name`` and what follows) of the wanted names; the whole trace where there are none."""
    sections = F.split(trace, r"(?m)^(?=--- )")
    name = lambda s: strip(F.substring(F.element_at(lines(s), 1), F.lit(5), F.char_length(s)))
    kept = F.filter(sections, lambda s: s.startswith("--- ") & F.array_contains(wanted, name(s)))
    return F.when(F.size(kept) > 0, F.array_join(F.flatten(F.transform(kept, lines)), "\n")).otherwise(trace)


def triggering_classes(tests: Column, failure: Column) -> Column:
    """T06. What stands before the first ``::`` of each test, and of the failure, in order, each once."""
    every = F.concat(F.coalesce(tests, F.array().cast("array<string>")), F.array(F.coalesce(failure, F.lit(""))))
    return F.array_distinct(F.filter(F.transform(every, lambda t: strip(F.substring_index(t, "::", 1))), lambda t: t != ""))


def triggering_methods(tests: Column, failure: Column) -> Column:
    """T06. What stands behind the first ``::`` of each test, and of the failure, in order, each once; those without one name no method."""
    every = F.concat(F.coalesce(tests, F.array().cast("array<string>")), F.array(F.coalesce(failure, F.lit(""))))
    behind = lambda t: F.when(F.contains(t, F.lit("::")), F.substring(t, F.instr(t, F.lit("::")) + 2, F.char_length(t)))
    return F.array_distinct(F.filter(F.array_compact(F.transform(every, behind)), lambda t: t != ""))


def stack_terms(trace: Column) -> Column:
    """L06. Tokens of the simple class names and of the methods of a trace's frames, each once."""
    frame = r"(?m)^\s*+at\s++((?:[a-z_][A-Za-z0-9_]*+\.)+[A-Za-z0-9_$]+)\.([A-Za-z0-9_$<>]+)\("
    part = lambda k: F.regexp_extract_all(trace, F.lit(frame), F.lit(k))
    names = F.zip_with(part(1), part(2), lambda c, m: F.concat(tokenize(F.substring_index(c, ".", -1)), tokenize(m)))
    return F.array_distinct(F.flatten(names))


def rr_at(rank: Column, depth: int = 10) -> Column:
    """T15. The reciprocal of a rank within ``depth``, else 0."""
    return F.when(rank <= depth, 1.0 / rank).otherwise(F.lit(0.0))


def parse_depths(raw: str) -> tuple[int, ...]:
    """T15. The numbers of a list such as ``1,3,5``; one at least."""
    found = tuple(int(part) for part in raw.split(",") if part.strip())
    if not found:
        raise ValueError("name one depth at least")
    return found


def stack_frames(trace: Column, package: str) -> Column:
    """T07. (class, method) of the trace's frames in a package, each once, in order."""
    frames = F.regexp_extract_all(trace, F.lit(r"at\s+([\w.$]+)\.([\w$<>]+)\("), F.lit(0))
    pairs = F.transform(frames, lambda x: F.struct(F.regexp_extract(x, r"at\s+([\w.$]+)\.([\w$<>]+)\(", 1).alias("class"), F.regexp_extract(x, r"at\s+([\w.$]+)\.([\w$<>]+)\(", 2).alias("method")))
    return F.array_distinct(F.filter(pairs, lambda p: p["class"].startswith(package)))


def simple_name(name: Column) -> Column:
    """T08. The last part of a dotted name, without what follows ``$``."""
    return F.substring_index(F.substring_index(name, ".", -1), "$", 1)


def strip_test_suffix(name: Column) -> Column:
    """T08. A class name without Test, Tests or TestCase at its end, the first that fits; null where none does."""
    out = F.lit(None).cast("string")
    for suffix in reversed(("Test", "Tests", "TestCase")):
        fits = name.endswith(suffix) & (F.char_length(name) > len(suffix))
        out = F.when(fits, F.substring(name, F.lit(1), F.char_length(name) - len(suffix))).otherwise(out)
    return out


def class_terms(name: Column) -> Column:
    """T09. A class name in small letters and its camel parts, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(F.lower(name)), F.transform(split_camel(name), F.lower)), lambda t: t != ""))


def source_hint(name: Column) -> Column:
    """T08. The class that a test class is likely to test, up to the first underscore; null where its name says nothing."""
    front = F.when(name.startswith("Test") & (F.char_length(name) > 4), F.substring(name, F.lit(5), F.char_length(name)))
    return F.substring_index(F.coalesce(strip_test_suffix(name), front), "_", 1)


def method_window(content: Column, method: Column, context: int = 35, *, numbered: bool = False) -> Column:
    """T10. Lines around the first line that names a method and looks like its declaration, numbered if asked; empty where none does."""
    placed = F.transform(lines(content), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hits = F.filter(placed, lambda p: F.contains(p["x"], method) & p["x"].rlike(r"[\w>\]]\s+\w+\s*\("))
    at = F.try_element_at(hits, F.lit(1))["i"]
    first = F.greatest(at - context // 3, F.lit(0))
    shown = F.transform(placed, lambda p: F.concat((p["i"] + 1).cast("string"), F.lit(": "), p["x"])) if numbered else lines(content)
    return F.when(at.isNull(), F.lit("")).otherwise(F.array_join(F.slice(shown, first + 1, at + context - first), "\n"))


def relevant_terms(query: Column, most: int = 40) -> Column:
    """T11. Tokens of three characters or more that are no stop words, each once, the first ``most``."""
    stops = F.array(*[F.lit(x) for x in STOP_TOKENS])
    return F.slice(F.array_distinct(F.filter(tokenize(query), lambda t: (F.char_length(t) >= 3) & ~F.array_contains(stops, t))), 1, most)


def has_numeric_output_signal(query: Column, terms: Column) -> Column:
    """T12. Whether a query speaks of a number that was printed wrongly: a negative zero, or a comparison or a code printer with digits."""
    has = lambda *words: F.arrays_overlap(terms, F.array(*[F.lit(w) for w in words]))
    both = F.array_contains(terms, "code") & F.array_contains(terms, "printer")
    printer = (F.array_contains(terms, "codeprinter") | both) & has("expected", "numeric", "number", "keys")
    comparison = F.contains(F.lower(query), F.lit("comparisonfailure")) & F.array_contains(terms, "expected")
    return query.rlike(r"(?<![A-Za-z0-9])-0") | (query.rlike(r"(?U)\d") & (printer | comparison))


def is_comment_header(line: Column) -> Column:
    """T12. Whether a line is blank or starts like a comment."""
    s = strip(line)
    return (s == "") | s.startswith("*") | s.startswith("/*") | s.startswith("//") | s.startswith("*/")


def truncate_text(text: Column, most: int) -> Column:
    """T13. A text cut to ``most`` characters with a note in their number."""
    cut = F.regexp_replace(F.substring(text, 1, max(0, most - 15)), r"(?U)\s+$", "")
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit(" ...[truncated]"))).otherwise(text)


def json_object(text: Column) -> Column:
    """T14. The text if it is a JSON object, else its outermost braces if they hold one, else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    usable = lambda x: F.try_parse_json(x).isNotNull() & strip(x).startswith("{")
    return F.when(usable(text), text).when(usable(inner), inner)


def whole_number(text: Column, default: int | None = None) -> Column:
    """T15. A number from text, or the default."""
    return F.coalesce(text.try_cast("bigint"), F.lit(default).cast("bigint"))


def base_name(path: Column) -> Column:
    """T16. The last part of a path."""
    return F.substring_index(path, "/", -1)


def has_reason(reasons: Column, prefix: str) -> Column:
    """T16. Whether one of the reasons starts with the prefix."""
    return F.exists(reasons, lambda r: r.startswith(prefix))


def reasons_of(reasons: Column, prefix: str) -> Column:
    """T16, L01. The reasons that start with the prefix."""
    return F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r.startswith(prefix))


def json_keys(text: Column) -> Column:
    """T17. All keys at any depth of a JSON text, each once: strings that a colon follows, with their escapes resolved.

    Strings are taken from left to right, values too, so that what stands between two of them is never taken for a key.
    Repeats are possessive: a value of any length is matched without recursion.
    """
    strings = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"(?:\s*+:)?'), F.lit(0))
    quoted = F.transform(F.filter(strings, lambda x: x.endswith(":")), lambda x: F.regexp_replace(x, r"\s*+:$", ""))
    plain = lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2)
    decoded = lambda x: F.element_at(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), 1)
    return F.array_distinct(F.transform(quoted, lambda x: F.when(F.contains(x, F.lit("\\")), decoded(x)).otherwise(plain(x))))


def class_file(folder: Column, name: Column) -> Column:
    """S14. The source file of a class: inner classes belong to their outer one's."""
    return F.concat(folder, F.lit("/"), F.replace(F.substring_index(name, "$", 1), F.lit("."), F.lit("/")), F.lit(".java"))
