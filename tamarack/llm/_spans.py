"""Places of matches in texts as column expressions whose work is linear in a text, however long it is and however many matches it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.arrays import let, running

SPAN = "array<struct<start:int,end:int,kind:int,text:string,left:string>>"


def located(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, context: int = 0) -> Column:
    """array<struct<start, end, kind, text, left>> of the leftmost matches that do not overlap, in code points; ``keep`` tests a match's text.

    ``left`` is at most ``context`` characters before the match and behind the one before it, after a line feed if that one is nearer.

    Matches and the pieces between them have lengths whose running sums are the places. The pattern must not be able to match nothing.
    """
    match = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)

    def placed(m: Column, b: Column) -> Column:
        lengths = F.zip_with(m, F.slice(b, F.lit(1), F.size(m)), lambda x, y: F.char_length(x) + F.char_length(y))
        ends = running(lengths, F.lit(0), lambda x, y: x + y)
        left = lambda x: F.substring(F.concat(F.lit("\n"), x), -context, context) if context else F.lit("")
        ended = F.zip_with(F.slice(b, F.lit(1), F.size(m)), ends, lambda x, e: F.struct(left(x).alias("left"), e.alias("end")))
        start = lambda x, e: (e["end"] - F.char_length(x)).cast("int")
        spans = F.zip_with(m, ended, lambda x, e: F.struct(start(x, e).alias("start"), e["end"].cast("int").alias("end"), F.lit(kind).alias("kind"), x.alias("text"), e["left"].alias("left")))
        return F.filter(spans, lambda s: keep(s["text"])) if keep else spans

    return let(match, lambda m: let(between, lambda b: placed(m, b))).cast(SPAN)


def when_any(text: Column, pattern: str, spans: Column) -> Column:
    """Most texts have no match: they skip the arrays."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def clear_of(found: Column, base: Column) -> Column:
    """The spans of ``found`` that overlap none of ``base``, by start: one sort, and two running maxima."""
    near = -1 << 31

    def events(spans: Column, other: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(other).alias("found"), s["end"].alias("end"), s.alias("span")))

    def swept(e: Column) -> Column:
        ends = running(F.transform(e, lambda s: F.when(s["found"] == 0, s["end"]).otherwise(F.lit(near))), F.lit(near), lambda x, y: F.greatest(x, y))
        starts = F.reverse(running(F.transform(F.reverse(e), lambda s: F.when(s["found"] == 0, -s["start"]).otherwise(F.lit(near))), F.lit(near), lambda x, y: F.greatest(x, y)))
        # The greatest end of base spans that start before or with it, and the next base start behind it.
        free = F.zip_with(e, F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("before"), b.alias("behind"))), lambda s, x: F.struct(s.alias("s"), ((s["found"] == 1) & (x["before"] <= s["start"]) & ((x["behind"] == near) | (-x["behind"] >= s["end"]))).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"]["span"])

    swept_ = let(F.array_sort(F.concat(events(found, 1), events(base, 0))), swept)
    return F.when((F.size(found) > 0) & (F.size(base) > 0), swept_.cast(SPAN)).otherwise(found)


def spans_text(spans: Column, kinds: tuple[str, ...], by_kind: bool = False) -> Column:
    """kind:start:end of each span joined by commas: by start and then kind, or by kind and then start."""
    order = ("kind", "start") if by_kind else ("start", "kind")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in (*order, "end")])))
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
