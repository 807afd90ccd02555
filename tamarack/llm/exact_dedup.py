"""Exact deduplication by two passes over a Bloom filter (operator 9), in DataFrame functions alone.

Pass one hashes each text to two slots of a bit array of fixed size, counts the rows of each slot and keeps
the slots with two rows or more as bitmaps. Pass two probes them: a row whose two slots are both marked may be
repeated and is shuffled by its digest; any other row is unique for certain and passes straight through.

The filter has 32 bits a row and ``filter_bits`` at most (64 MB by default), whatever the number of rows, so it is
broadcast. With more rows it marks more slots: more rows are shuffled, the result is the same.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null doc_id is smaller than
any other; of rows repeated in full exactly one is kept; an empty table gives an empty table; other columns of
the input are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Filter, ascii_lower, bits_for, filter_from, probe, slots_of, stage, with_group


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


#: Bits of a filter at most, 64 MB. Up to 16 million rows a filter has 32 bits a row.
FILTER_BITS = 1 << 29


def repeated_slots(digests: DataFrame, most: int = FILTER_BITS) -> Filter:
    """Pass one: a filter of the slots that at least two rows of ``digests`` (column digest) hit."""
    bits = bits_for(digests.count(), most)
    slots = digests.select(F.explode(F.array(*slots_of(F.col("digest"), bits))).alias("slot"))
    return filter_from(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), bits)


def exact_groups(docs: DataFrame, *, filter_bits: int = FILTER_BITS, salts: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = docs.select("doc_id", F.unhex(F.sha2(_normal(F.col("text")), 256)).alias("digest"))
    hashed = stage(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")
    probed = probe(hashed, "digest", repeated_slots(hashed, filter_bits))
    alone = probed.filter("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    some = probed.filter("__maybe").select("doc_id", "row", "digest")
    met = with_group(
        some, "digest", F.xxhash64("row"), salts,
        [F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last")],
        [F.sum("n").alias("group_size"), F.max("last").alias("keep")],
    )
    shared = met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), "digest")
    return alone.unionByName(shared).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_copies(docs: DataFrame, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one row of each group of equal texts: the largest doc_id's.

    Only rows that may be repeated are shuffled with their texts; the others never leave their task.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.unhex(F.sha2(_normal(F.col("text")), 256)).alias("digest"))
    digests = stage(packed.select("digest"), "digests")
    probed = probe(packed, "digest", repeated_slots(digests, filter_bits))
    alone = probed.filter("not __maybe").select("doc")
    rest = [F.col(f"doc.`{c}`") for c in names if c not in ("doc_id", "text")]
    order = F.struct(F.col("doc.doc_id"), F.col("doc.text"), *[x.cast("string") for x in rest])
    one = probed.filter("__maybe").groupBy("digest").agg(F.max_by("doc", order).alias("doc")).select("doc")
    return alone.unionByName(one).select([F.col(f"doc.`{c}`").alias(c) for c in names])
