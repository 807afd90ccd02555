"""Mixing sources to target weights along a time-varying curriculum (operator 3), in DataFrame functions alone.

Each source has a weight, which sets its share of all words, and a schedule: weights at equally spaced times of
training, joined by straight lines. The schedule's integral from 0 to t, scaled to 1 at t = 1, is the share of the
source's words that training has taken by t. A document that starts after ``u`` of its source's demand is met
where that integral reaches ``u``; solving the piecewise quadratic for t gives its training position, and documents
are range-sorted by it.

Targets: a source gets (its weight / all weights) of all words, but at most ``max_repeats`` times its own size;
what is above is dealt to the others by weight until none is above. In closed form: sources are capped in the
order of cap / weight, and the level is the first at which the next source stays below its cap.

Documents of a source are taken in the order of md5(doc_id), whole epochs first; the document at which the
target is reached is taken in part, so a source's taken words meet its target to a word.

Running sums over a source are made in two steps, over 4,096 buckets of md5 prefixes and then inside each bucket,
so that a source with a third of all rows is spread over as many tasks.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; documents without
words are taken 0 times; with no words at all every target is 0; rows that are repeated in full are
documents of their own; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules in the same order: relative weight at the times 0, 1/2 and 1.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MAX_REPEATS = 3
#: Hex digits of md5(doc_id) that make a bucket.
BUCKET_DIGITS = 3


def _cycle(index: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source_key, rank, source_size, target) of rows with source_key, source and size. A row per source: its windows stay small."""
    by_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    named = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = named.withColumn("weight", _cycle(F.col("rank"), weights)).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    every, before = W.partitionBy(F.lit(1)), order.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumns({
        "words": F.sum(F.col("source_size").cast("double")).over(every),
        "weights": F.sum("weight").over(every),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "place": F.row_number().over(order),
    })
    w = w.withColumn("level", (F.col("words") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    holds = F.col("cap") / F.col("weight") >= F.col("level")
    w = w.withColumn("level", F.min_by("level", F.when(holds, F.col("place"))).over(every))
    return w.select("source_key", "rank", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _position(share: Column, schedule: Sequence[float]) -> Column:
    """The time at which the integral of the schedule (weights at equally spaced times) reaches ``share`` of its whole.

    A share of 1 or more, which the mix does not reach, keeps its value: it sorts after all that is taken.
    """
    n = len(schedule) - 1
    whole = sum((a + b) / 2 / n for a, b in zip(schedule, schedule[1:], strict=False))
    v = [x / whole for x in schedule]
    at, done = share, 1.0
    for k in reversed(range(n)):
        until, done = done, done - (v[k] + v[k + 1]) / 2 / n
        more = F.greatest(share - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(v[k] * v[k]) + more * (2.0 * n * (v[k + 1] - v[k])), F.lit(0.0)))
        step = F.coalesce(F.try_divide(2.0 * more, F.lit(v[k]) + root), F.lit(0.0))
        at = F.when(share < F.lit(until), F.lit(k / n) + step).otherwise(at)
    return at


def _mixed(docs: DataFrame, weights: Sequence[float], max_repeats: int, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, rank (of the source) and share (of the source's demand met before the document)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source_key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    named = docs.select("doc_id", "source", source_key.alias("source_key"), size.alias("size"), key.alias("key"), *carry)
    sizes = stage(named.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sizes")
    sums = sizes.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("size"))
    ahead = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source_key", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    known = starts.join(source_targets(sums, weights, max_repeats), "source_key")
    rows = sizes.drop("source").join(known, ["source_key", "bucket"])
    inside = W.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.round("target").cast("long")
    whole = F.coalesce(F.try_divide(words, F.col("source_size")), F.lit(0.0)).cast("long")
    rest = words - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    share = F.coalesce(F.try_divide(F.col("before").cast("double"), F.col("target")), F.lit(0.0))
    return rows.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), "rank", share.alias("share"), *carry)


def _placed(rank: Column, share: Column, schedules: Sequence[Sequence[float]]) -> Column:
    place = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        place = F.when(F.pmod(rank, F.lit(len(schedules))) == i, _position(share, schedule)).otherwise(place)
    return F.round(place, 9)


def curriculum(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by position:
    doc_id, size, source_size, target, taken, position (of the first copy).
    """
    position = _placed(F.col("rank"), F.col("share"), schedules).alias("position")
    out = _mixed(docs, weights, max_repeats).select("doc_id", "size", "source_size", "target", "taken", position)
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents as the mix takes them, with the columns of docs: a row per copy, range-sorted by training position.

    The copy at which a source's target is reached keeps its first words only. Takes meet their texts by doc_id and a
    hash of the row, so texts are shuffled once to meet them and once to be sorted.
    """
    names = docs.columns
    tie = F.xxhash64("source", "text")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    # A row travels in one column, so that its names meet no others.
    takes = _mixed(docs.select("doc_id", "text", "source", tie.alias("tie")), weights, max_repeats, ["tie"]).filter("taken > 0")
    same = W.partitionBy("own", "tie")
    takes = takes.withColumn("own", own).withColumn("nth", F.row_number().over(same.orderBy("taken"))).drop("doc_id")
    packed = docs.select(own.alias("own"), tie.alias("tie"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    packed = packed.withColumn("nth", F.row_number().over(same.orderBy("tie")))
    met = packed.join(takes, ["own", "tie", "nth"])
    met = met.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    text = F.when(words < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int")), "")).otherwise(F.col("doc.text"))
    kinds = dict(docs.dtypes)
    fixed = {"text": text, **({"n_chars": F.char_length(text).cast(kinds["n_chars"])} if "n_chars" in kinds else {})}
    position = _placed(F.col("rank"), F.col("share") + F.col("epoch") * F.col("source_size") / F.col("target"), schedules)
    out = met.select(position.alias("position"), F.struct(*[fixed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names]).alias("doc"))
    ordered = out.repartitionByRange("position", F.xxhash64("doc.text")).sortWithinPartitions("position")
    return ordered.select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
