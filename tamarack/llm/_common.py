"""Helpers shared by the operators of this folder: staged tables and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the session has it.

    A local session without it, as in tests, gets a temporary folder. On a cluster that is an error: executors would write to
    disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Settings while a table is staged: its shuffle files go once it is written, and texts, which are long, come in small batches.
_STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STAGING}
    try:
        for k, v in _STAGING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Paths of the tables staged inside of ``scratch``.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read it, not those that made it.
    """
    path, table = staged(df, name)
    if _made.get() is not None:
        _made.get().append(path)
    return table


def staged(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The same, with the table's path, for a table that outlives ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarack-{name}-{uuid.uuid4().hex}"
    with staging(spark):
        df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators stage inside are deleted at the end: what is made of them must have been written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        drop_tables(spark, *_made.get())
        _made.reset(token)


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder, for small tables that are read several times."""
    shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with staging(df.sparkSession):
        return df.checkpoint()


#: A row of a filter holds so many bits, as 512 longs.
PAGE = 32768


def slots_of(value: Column, bits: int) -> list[Column]:
    """The two places of a value in a filter of ``bits`` bits; both are in one page, so one lookup answers for a value."""
    page = F.pmod(F.xxhash64(value, F.lit(1)), F.lit(bits // PAGE)) * PAGE
    hash_ = F.xxhash64(value, F.lit(2))
    return [page + hash_.bitwiseAND(F.lit(PAGE - 1)), page + F.shiftright(hash_, 24).bitwiseAND(F.lit(PAGE - 1))]


def bitmaps(slots: DataFrame) -> DataFrame:
    """(page, bitmap) with a bit for each value of column ``slot``: a filter in rows of 4 kB, one in 32,768 bits at most."""
    # Slots travel, not bitmaps: a task may hit all pages, and each would be a bitmap of its own before they are merged.
    paged = slots.select(F.floor(F.col("slot") / PAGE).cast("int").alias("page"), (F.col("slot") % PAGE).alias("bit")).repartition("page")
    return paged.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: ``pages`` (page, words as longs), checkpointed since it is probed again and again, and its size in bits."""

    pages: DataFrame
    bits: int


def bits_for(rows: int, most: int) -> int:
    """The size of a filter of ``rows`` values: 32 bits a value, a power of two, one page at least and ``most`` bits at most."""
    return min(most, max(PAGE, 1 << max(0, 32 * rows - 1).bit_length()))


def filter_from(slots: DataFrame, bits: int) -> Filter:
    """A filter with the bits of column ``slot``."""
    word = lambda k: F.conv(F.hex(F.substring("bitmap", 8 * k + 1, F.lit(8))), 16, -10).cast("long")
    return Filter(checkpoint(bitmaps(slots).select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE // 64 - 1)), word).alias("words"))), bits)


def filter_of(values: DataFrame, column: str, most: int, rows: int | None = None) -> Filter:
    """A filter of the values of a column; ``rows`` is how many there are, at most. Beyond ``most`` bits it only holds more than it was given."""
    bits = bits_for(values.count() if rows is None else rows, most)
    return filter_from(values.select(F.explode(F.array(*slots_of(F.col(column), bits))).alias("slot")), bits)


def probe(rows: DataFrame, column: str, found: Filter) -> DataFrame:
    """rows with a column ``__maybe``: false where the filter is certain not to hold the value."""
    slots = slots_of(F.col(column), found.bits)
    rows = rows.withColumn("__page", F.floor(slots[0] / PAGE).cast("int"))
    # bits / 8 bytes of pages at most, so the broadcast is bounded.
    rows = rows.join(F.broadcast(found.pages.select(F.col("page").alias("__page"), F.col("words").alias("__words"))), "__page", "left")

    def marked(slot: Column) -> Column:
        bit = F.pmod(slot, F.lit(PAGE))
        # bitmap_construct_agg counts bits from the low end of each byte, and a long's first byte is its high end.
        return F.getbit(F.element_at("__words", F.shiftright(bit, 6).cast("int") + 1), (bit.bitwiseAND(F.lit(7)) + F.lit(56) - bit.bitwiseAND(F.lit(56))).cast("int")) == 1

    return rows.withColumn("__maybe", F.coalesce(marked(slots[0]) & marked(slots[1]), F.lit(False))).drop("__page", "__words")


def filter_bytes(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A filter with one bit for each hash, at its value mod ``bits``, as bytes: bits / 8 of them, whatever the input."""
    slot = F.pmod(F.col(column), F.lit(bits))
    out = bytearray(bits // 8)
    for page, bitmap in bitmaps(hashes.select(slot.alias("slot"))).toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = bitmap
    return bytes(out)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts without other letters than ASCII take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_group(rows: DataFrame, key: str, spread: Column, salts: int, parts: list[Column], totals: list[Column]) -> DataFrame:
    """Join aggregates of each ``key`` to all its rows, with no task that gets a whole hot group.

    Rows are first summed by (key, salt), then the at most ``salts`` partial rows of a key by key.
    The totals go back over (key, salt), so a key's rows meet them in ``salts`` different tasks.
    ``parts`` are aggregates over rows, ``totals`` aggregates over their results.
    """
    salted = rows.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    partial = salted.groupBy(key, "__salt").agg(*parts)
    total = partial.groupBy(key).agg(*totals)
    back = partial.select(key, "__salt").join(total, key)
    return salted.join(back, [key, "__salt"]).drop("__salt")
