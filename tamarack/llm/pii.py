"""Personal data (operator 13) by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the matches of four patterns: e-mail addresses, IP addresses, card and phone numbers. The lexical pattern of a match is the two words
before it, in small letters and with 0 for digits. Words with four digits or more that no seed overlaps are candidates. Seeds and candidates are instances
(their letters and digits alone, so that one number written in two ways is one instance) of lexical patterns, edges of a graph:

    confidence of a pattern = sum of its instances' scores / (its instances + 1)
    score of an instance = 1 for a seed, else the greatest confidence of its patterns

are worked out by turns, ``rounds`` times. Candidates whose score is ``least`` or more are spans of the kind ``context``, such as a phone number without its
country behind words that stand before phone numbers, or a known card number with dots. With the 1 in the divisor, three seeds and nothing else give a pattern 0.75.

Patterns and instances with very many rows are summed over salts first; no group is gathered in a task. All places are code points.

Defined cases: a null or empty text has no spans; a candidate without words before it has no pattern; a corpus without seeds, or an empty table, adds no
spans; spans of different kinds may overlap, those of the method never overlap a seed's; repeated rows are searched each for itself; other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, stage, with_group
from ._spans import SPAN, clear_of, located, spans_text, when_any

KINDS = ("email", "ip", "card", "phone", "context")
#: The patterns. A match can only begin where a run of its first characters does, or where the match before ended; said so, they never read a run twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Runs of letters, digits and the signs of identifiers with a digit, up to the last letter or digit.
CANDIDATE = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+@/-]*+[0-9](?:[A-Za-z0-9._%+@/-]*[A-Za-z0-9])?"
CANDIDATE_LEAST, DIGITS_LEAST = 6, 4
#: Characters in which the words before a match are looked for.
CONTEXT = 80
LEAST, ROUNDS, SALTS = 0.75, 3, 16
#: Seeds with fewer letters and digits are instances of their kind alone: short ones would meet other numbers.
TELLING = 8


def seeds(text: Column, context: int = CONTEXT) -> Column:
    """Spans of the four patterns, each kind in order."""
    count = lambda m: F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    card = lambda m: F.when(count(m).between(16, 19), F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))).otherwise(F.lit(False))
    found = (
        when_any(text, "@", located(text, EMAIL, 0, None, context)),
        when_any(text, r"[0-9]\.[0-9]", located(text, IP, 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z"), context)),
        when_any(text, r"[0-9](?:[\x20-]?[0-9]){15}", located(text, CARD, 2, card, context)),
        when_any(text, r"\+[0-9]", located(text, PHONE, 3, lambda m: count(m).between(8, 15), context)),
    )
    return F.concat(*found)


def candidates(text: Column, base: Column) -> Column:
    """Spans of words with digits that overlap none of base."""
    digits = lambda m: F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    found = located(text, CANDIDATE, 4, lambda m: (F.char_length(m) >= CANDIDATE_LEAST) & (digits(m) >= DIGITS_LEAST), CONTEXT)
    return clear_of(when_any(text, "[0-9]", found), base)


def lexical_pattern(left: Column) -> Column:
    """The last two words, in small letters and with 0 for digits; null where there are none."""
    words = F.regexp_replace(F.regexp_replace(F.lower(left), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")
    return F.nullif(F.substring_index(F.trim(words), " ", -2), F.lit(""))


def _instance(span: Column) -> Column:
    plain = F.lower(F.regexp_replace(span["text"], "[^A-Za-z0-9]", ""))
    return F.when((span["kind"] < 4) & (F.char_length(plain) < TELLING), F.concat_ws(":", span["kind"].cast("string"), plain)).otherwise(plain)


def scored_edges(edges: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """pattern, instance, seed, confidence, score of edges (pattern, instance, seed): each pair of both once, seed true where the instance is one."""
    edges = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        sums = [F.sum("total").alias("total"), F.sum("n").alias("n")]
        met = with_group(edges, "pattern", F.xxhash64("instance"), SALTS, [F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")], sums)
        met = met.select("pattern", "instance", "seed", (F.col("total") / (F.col("n") + 1)).alias("confidence"))
        met = with_group(met, "instance", F.xxhash64("pattern"), SALTS, [F.max("confidence").alias("best")], [F.max("best").alias("best")])
        score = F.when(F.col("seed"), 1.0).otherwise(F.col("best"))
        edges = checkpoint(met.select("pattern", "instance", "seed", "confidence", score.alias("score")))
    return edges


def contextual(occurrences: DataFrame, *, least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """row, start, end of the candidates that are taken, of occurrences (row, start, end, kind, pattern, instance)."""
    known = F.col("kind") < 4
    pairs = occurrences.groupBy("pattern", "instance").agg(F.max(known).alias("seed"))
    pairs = with_group(pairs, "instance", F.xxhash64("pattern"), SALTS, [F.max("seed").alias("any")], [F.max("any").alias("any")])
    edges = scored_edges(checkpoint(pairs.select("pattern", "instance", F.col("any").alias("seed"))), rounds=rounds)
    taken = edges.filter(F.col("score") >= least).select("pattern", "instance", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    unseen = occurrences.filter(~known).withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    return unseen.join(taken, ["pattern", "instance", "salt"], "left_semi").select("row", "start", "end")


def personal_data(docs: DataFrame, *, least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context of every row of docs (doc_id, text)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.withColumn("base", seeds(F.col("text"))).withColumn("more", candidates(F.col("text"), F.col("base")))
    found = stage(found.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", "more"), "found")
    span = F.col("span")
    every = found.select("row", F.explode(F.concat("base", "more")).alias("span"))
    every = every.select("row", span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), lexical_pattern(span["left"]).alias("pattern"), _instance(span).alias("instance"))
    occurrences = stage(every.filter("pattern IS NOT NULL"), "occurrences")
    context = F.struct("start", "end", F.lit(4).alias("kind"), F.lit("").alias("text"), F.lit("").alias("left"))
    taken = contextual(occurrences, least=least, rounds=rounds).groupBy("row").agg(F.collect_list(context).cast(SPAN).alias("context"))
    out = found.select("doc_id", "row", "base").join(taken, "row", "left").withColumn("context", F.coalesce("context", F.array().cast(SPAN)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])], F.sha2(spans_text(F.col("base"), KINDS, True), 256).alias("base_sha256"),
        spans_text(F.concat("base", "context"), KINDS, True).alias("spans"), F.size("context").cast("long").alias("n_context"),
    )
