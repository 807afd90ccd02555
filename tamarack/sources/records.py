"""Reading and writing of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.tables import kept


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S01. Records of JSON lines; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S01. The same, with bad lines in ``_corrupt_record`` instead of a failure."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """S02. Records as JSON lines, keys in order, nulls kept."""
    df.select(sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_bugs(spark: SparkSession, *paths: str) -> DataFrame:
    """S11. Rows of CSV files with a header, all columns as text; a bad line fails the job. A blank value is null, a quoted empty one is empty.

    Quoted values may hold line ends, so a file is streamed through one task: large tables are several files.
    """
    # Blank values stand as a character that Unicode keeps for internal use until they are null: as "" they would be the empty ones.
    return spark.read.option("header", "true").option("mode", "FAILFAST").option("multiLine", "true").option("nullValue", "\ufdd0").csv(list(paths))


def lookup(rows: DataFrame, wanted: DataFrame, key: str, *, strict: bool = False) -> DataFrame:
    """S11, S13. The rows of wanted keys, in one join for all of them, and ``found``: false for a key that no row has.

    With ``strict`` a key that no row has fails the job.
    """
    out = wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        # The check is part of the column, so that it can't be pruned while the result is read.
        out = out.withColumn("found", F.when(F.col("found"), True).otherwise(F.raise_error(F.concat(F.col(key).cast("string"), F.lit(" is not listed"))).cast("boolean")))
    return out


def manifest_rows(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """S21. (dataset, kind, path, exists) of every path that a manifest names, repeats included.

    manifest: dataset, bugs array<string>, methods array<struct<name, paths>>, selection array<string>, null where a
    dataset has none. files: path, such as a listing by ``binaryFile`` without content.
    """
    plain = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("path")))
    method = lambda m: F.transform(m["paths"], lambda p: F.struct(F.concat(F.lit("method:"), m["name"]).alias("kind"), p.alias("path")))
    none = F.array().cast("array<struct<kind:string,path:string>>")
    every = F.concat(plain(F.col("bugs"), "bugs"), F.coalesce(F.flatten(F.transform("methods", method)), none), plain(F.col("selection"), "selection"))
    named = manifest.select("dataset", F.inline(every))
    held = files.select("path").distinct().withColumn("exists", F.lit(True))
    return named.join(held, "path", "left").select("dataset", "kind", "path", F.coalesce("exists", F.lit(False)).alias("exists"))


def run_rows(runs: DataFrame, files: DataFrame, *, needed: int = 1) -> DataFrame:
    """S23. (run, seconds, n_files, finished, started, sha256, missing) of runs (run, seconds) and their files (run, path, modified, sha256).

    A run finished when the newest of its files was written, and started as many seconds before as it took; ``sha256`` is one of its files' checksums in the order of
    their paths. A run with fewer than ``needed`` files is ``missing`` some. Null times and checksums count as none.
    """
    line = F.concat_ws(" ", F.coalesce("sha256", F.lit("")), "path")
    held = files.groupBy("run").agg(F.count(F.lit(1)).alias("n_files"), F.max("modified").alias("finished"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))
    out = runs.join(held, "run", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("long")))
    started = F.timestamp_micros(F.unix_micros("finished") - F.round(F.col("seconds") * 1_000_000).cast("long"))
    return out.select("run", "seconds", "n_files", "finished", started.alias("started"), "sha256", (F.col("n_files") < needed).alias("missing"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """S23. (path, modified, size, sha256) of the files below a folder; each is read in its own task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """S02b. Append to a Parquet table the rows whose key it does not hold yet; what was appended. A job that is started again writes no key twice.

    The table may not exist. Of several new rows with a key the least stays.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    one = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    new = one.join(spark.read.parquet(path).select(key), key, "left_anti").select(rows.columns) if known else one
    new = kept(new)
    new.write.mode("append").parquet(path)
    return new


def selected_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """S16. The selected ids of one or more selection reports, each once."""
    return spark.read.option("multiLine", "true").schema("selected_bug_ids array<string>").json(list(paths)).select(F.explode("selected_bug_ids").alias("query_id")).distinct()


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """S17. Keys that occur more than once, with their counts: a keyed load must have none."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def write_csv(df: DataFrame, path: str, missing: str | dict[str, str] = "NA", columns: list[str] | None = None, *, quoted: bool = True) -> None:
    """S18. CSV with a header. ``columns`` fixes the columns, those that df lacks hold ``missing``, as do nulls; "" leaves both empty.

    ``missing`` may name the columns that have another word than ``NA``. Values that are empty themselves are quoted, so that they differ from nulls.
    ``quoted=False`` writes values as they are, joined by commas.
    """
    names = columns or df.columns
    word = {c: missing.get(c, "NA") if isinstance(missing, dict) else missing for c in names}
    # What stays null is written as nothing at all.
    lost = {c: F.lit(None if quoted and w == "" else w).cast("string") for c, w in word.items()}
    text = df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), lost[c]) if c in df.columns else lost[c]).alias(c) for c in names])
    if quoted:
        text.write.mode("overwrite").option("header", "true").option("emptyValue", '""').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    else:
        head = df.sparkSession.createDataFrame([(",".join(names),)], "value string")
        head.unionByName(text.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in names]).alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """S19. Records as indented JSON, keys in order, nulls kept, each followed by a line feed."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), options).alias("value")).write.mode("overwrite").text(path)


def write_prompts(prompts: DataFrame, path: str, *by: str) -> None:
    """S26. A folder per value of ``by`` with the column ``prompt`` as text, such as one per query and step."""
    prompts.repartition(*by).select(*by, F.col("prompt").alias("value")).write.mode("overwrite").partitionBy(*by).option("lineSep", "\n").text(path)


def markdown_table(df: DataFrame, *order: str) -> DataFrame:
    """S20. The lines of a Markdown table of df, in the order of columns ``order``: numbers with four places, ``NA`` for null."""
    cells = [four_places(F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    head = [("| " + " | ".join(df.columns) + " |", 0), ("| " + " | ".join("---" for _ in df.columns) + " |", 1)]
    rows = df.select(markdown_row(*cells).alias("line"), F.lit(2).alias("part"), F.struct(*(order or df.columns)).alias("key"))
    top = df.sparkSession.createDataFrame(head, "line string, part int").withColumn("key", F.lit(None).cast(rows.schema["key"].dataType))
    return rows.unionByName(top).orderBy("part", "key").select("line")


def markdown_row(*cells: Column) -> Column:
    """S20. A row of a Markdown table: numbers with four places, ``NA`` for null."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("NA")) for c in cells]), F.lit(" |"))


def four_places(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.4f", x))
