"""Source files as a table (S03-S09, S12, S14, S15, S22): scan, skip rules, names, checksums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.text import base_name, lines, strip

# Fixed values.
EXTENSIONS = (".java", ".py", ".ts", ".tsx", ".js", ".jsx")
SKIPPED_FOLDERS = (
    ".git", ".mypy_cache", ".pytest_cache", ".venv", "__pycache__", "build", "coverage", "dist", "format_files", "generated",
    "generated-sources", "migrations", "node_modules", "regression_tests", "target", "test", "tests", "venv",
)
SKIPPED_NAMES = r"^test_|^tests\.py$|^conftest\.py$|_test\.py$|\.test\.tsx?$|\.spec\.tsx?$|\.d\.ts$|\.min\.js$"
CLASS = r"(?U)\b(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)"
PY_CLASS = r"(?mU)^[^\S\n]*+class\s+([A-Za-z_][A-Za-z0-9_]*)"
PY_FUNCTION = r"(?mU)^[^\S\n]*+(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
JS_FUNCTION = r"(?U)\b(?:function\s+|const\s+|let\s+|var\s+|async\s+function\s+)([A-Za-z_][A-Za-z0-9_]*)\s*(?:=|\()"
MODIFIERS = "public|protected|private|static|final|synchronized|abstract|native"
#: Characters of a type and what stands around it.
TYPE = r"A-Za-z0-9_<>\[\], ?"
PACKAGE = r"(?mU)^\s*package\s+([A-Za-z_][A-Za-z0-9_.]*);"


def skipped(path: Column) -> Column:
    """S05. Whether a file lies in a skipped folder, of those below the scanned root, or has a skipped name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) | base_name(path).rlike(SKIPPED_NAMES)


def _names(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def class_names(path: Column, content: Column) -> Column:
    """S06. Names of the classes that a file declares, each once, in order."""
    return F.array_sort(F.array_distinct(F.when(path.endswith(".py"), _names(content, PY_CLASS)).otherwise(_names(content, CLASS))))


def declared_methods(content: Column) -> Column:
    """S07. Names before a parenthesis, behind white space, a type, and a modifier or white space that a word ends at; in order.

    A type holds no parenthesis, so each piece between two of them is looked at for itself, from its end: the name, then the run of characters
    of types before it, then the white space and the one character before that. Nothing is read twice, whatever the length of a line.
    """
    ends = lambda text, tail: F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail))

    def declares(head: Column, types: Column) -> Column:
        rest = ends(head, types)
        space = F.regexp_extract(rest, r"(?U)(?<!\s)\s++\z", 0)
        near = F.concat(F.substring(ends(rest, space), -1, 1), space, types)
        # Behind a start that fits, all is of the type's characters, so the first one decides.
        return near.rlike(rf"(?U)\b(?:{MODIFIERS}|\s++){{1,64}}[A-Za-z_][{TYPE}]*+\z")

    def name(piece: Column) -> Column:
        tail = F.regexp_extract(piece, r"(?U)(?<!\s)\s++[A-Za-z_][A-Za-z0-9_]*+\s*+\z", 0)
        head = ends(piece, tail)
        found = declares(head, F.regexp_extract(head, rf"(?<![{TYPE}])[{TYPE}]*+\z", 0))
        return F.when((tail != "") & found, strip(tail))

    pieces = F.split(content, r"\(", -1)
    return F.array_compact(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), name))


def method_names(path: Column, content: Column) -> Column:
    """S07. Names of the methods and functions that a file declares, each once, in order."""
    script = path.rlike(r"\.(ts|tsx|js|jsx)$")
    found = F.when(path.endswith(".py"), _names(content, PY_FUNCTION)).when(script, F.concat(declared_methods(content), _names(content, JS_FUNCTION))).otherwise(declared_methods(content))
    return F.array_sort(F.array_distinct(found))


def package_name(content: Column) -> Column:
    """S08. The first package that a file declares, else empty."""
    return F.regexp_extract(content, PACKAGE, 1)


def document_text(*parts: Column) -> Column:
    """S09. The parts of a source file that are searched, joined by line feeds."""
    return F.concat_ws("\n", *parts)


def relative(path: Column, root: str) -> Column:
    """The part of a path below a root. Either may have a scheme and a host; folders above the root are not looked at."""
    bare = lambda x: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", x)
    # A root without a scheme may be on any host, and relative to the current folder.
    below = "/" + bare(root).strip("/") + "/" if root.strip("/.") else "/"
    full = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.when(full.startswith(below), F.substring(full, F.lit(len(below) + 1), F.char_length(full))).otherwise(F.substring(full, F.instr(full, F.lit(below)) + len(below), F.char_length(full)))


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """S03, S04. file, package, class_names, method_names, content, sha256 of the source files below a folder."""
    pattern = "*{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = found.select(relative(F.col("path"), root).alias("file"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256")).filter(~skipped(F.col("file")))
    return rows.select("file", package_name(F.col("content")).alias("package"), class_names(F.col("file"), F.col("content")).alias("class_names"), method_names(F.col("file"), F.col("content")).alias("method_names"), "content", "sha256")


def id_ranges(text: Column) -> Column:
    """S12. Numbers of a list such as ``1,3-5``, ranges spelt out, repeats kept. A range that ends before it begins is an error."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    low = lambda p: F.substring_index(p, "-", 1).cast("long")
    high = lambda p: F.substring_index(p, "-", -1).cast("long")
    wrong = lambda p: F.raise_error(F.concat(F.lit("invalid range: "), p)).cast("array<bigint>")
    return F.flatten(F.transform(parts, lambda p: F.when(low(p) > high(p), wrong(p)).otherwise(F.sequence(low(p), F.greatest(low(p), high(p))))))


def export_lines(text: Column) -> Column:
    """S15. The lines of a tool's output that are neither blank nor its progress notes."""
    return F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith("Running ant "))


def checksum(rows: DataFrame, key: str, content: str, by: str) -> DataFrame:
    """S22. SHA-256 over the checksums of a group's files in the order of their names, with NUL between.

    A group's rows, sorted on Spark, stream through one hash, so no task holds more of a group than a batch.
    """
    line = F.concat(F.col(key).cast("string"), F.lit("\0"), F.sha2(F.col(content), 256))
    pairs = rows.select(F.col(by).alias("by"), F.col(key).alias("k"), line.alias("line"))
    ordered = pairs.repartition("by").sortWithinPartitions("by", "k", "line").select("by", "line")
    schema = T.StructType([T.StructField("by", ordered.schema["by"].dataType), T.StructField("sha256", T.StringType())])
    return ordered.mapInArrow(_streamed, schema).select(F.col("by").alias(by), "sha256")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by, sha256) of sorted (by, line): lines joined by NUL, those that are null left out."""
    group, digest, first = None, None, True
    for batch in batches:
        names, found = batch.column(0), []
        for name, line in zip(names.to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or name != group:
                if digest is not None:
                    found.append((group, digest.hexdigest()))
                group, digest, first = name, hashlib.sha256(), True
            if line is not None:
                digest.update((line if first else "\0" + line).encode("utf-8", "surrogatepass"))
                first = False
        kind = names.type
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], pa.string())], ["by", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([digest.hexdigest()], pa.string())], ["by", "sha256"])
