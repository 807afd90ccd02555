"""Secret scans (operator 2), in DataFrame functions alone: three patterns, and character Markov models.

Patterns: assignments of passwords and tokens, access key ids and long hexadecimal strings. The models: two first-order
Markov chains over characters, one of random strings and one of ordinary ones, trained from labelled samples:
the values that the patterns find and generated strings are random; all runs of the same alphabet outside the
patterns' spans and under 20 characters (longer ones are what is judged, so they have no label), and identifiers put together from common words of programs (camel case, capitals, snake case,
paths, with digits) are ordinary, and so are rules (one character over and over) and alphabets. The ordinary chain is a fixed mixture of the chains of
those three, so that identifiers count the same in a corpus of any size. Transitions of all documents are counted; a count is one row per pair of
characters, 4,489 at most, so the tables fit on the driver whatever the corpus. A further string of 20 characters or more
is a secret where the mean log-likelihood ratio per transition is above ``min_ratio``.

Offsets are code points. Matches of a pattern, in order, and the pieces between them have lengths whose running sums
are the offsets, so no position is searched twice; spans that overlap are found by one sort. Work is linear in a text but for that sort.

Defined cases: a null or empty text has no spans; a corpus without labelled random strings adds no spans beyond
the patterns'; spans of different kinds may overlap, a model's span never overlaps a pattern's; repeated rows are scanned
each for itself; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

import math
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage
from ._spans import clear_of, located, spans_text, when_any

#: The patterns, and how long group or match must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the models judge.
CHARACTER = r"[A-Za-z0-9+/_=-]"
CANDIDATE_LEAST = 20
CANDIDATE = f"{CHARACTER}{{{CANDIDATE_LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Common words of program text, of which labelled identifiers are made.
IDENTIFIER_WORDS = """account action active add address after all allow api app array async auth available background base batch before
block body bool boundary buffer build byte cache call cancel change channel char check class clean clear client clock close code collection
column command commit common compare compile config connect container content context control convert copy core count create cursor custom
data database date debug default delete depth description device dialog dictionary directory disable display document download driver dynamic
edit element empty enable encode end engine entity entry env error event example execute expected export expression extension external failure
feature fetch field file filter find first flag float flush folder footer force format frame free from function generate get global graph
group handler has hash header height helper host html http id image import index info init input insert instance int interface internal
invalid item iterator job json key kernel keyboard label language last layer layout left length level library line link list listener load
lock log loop manager map mask match matrix max memory menu merge message meta method migration min mode model module monitor mouse move name
native network new next node normal notify null number object offset open operation option order output override owner page panel param parent
parse partition path pattern pending permission pixel plugin pointer policy position prefix previous print priority private process product
profile progress project property protocol provider public push query queue quick range raw read record recursive reference refresh region
register release remote remove render replace report request require reset resource response result return right root route row rule run
sample save scale schedule schema scope screen script scroll search section select sequence serial server service session set setting shadow
shape share shift show signal simple size skip snapshot socket sort source space split stack start state static status step stop storage store
stream string structure style submit suffix support switch symbol sync system table tag target task template temp test text thread threshold
time title toggle tool top total trace track transaction transform tree trigger type unit unknown unlock update upload url usage user utility
valid value vector verify version video view visible wait warning watch web weight width window word worker wrapper write xml year zone"""
#: Shares of the corpus's strings, the identifiers and the rules in the ordinary chain, and how often each rule is a sample.
SHARES, RULE_TIMES = (0.47, 0.47, 0.06), 500
#: Different transitions of a random string at least: rules of one or two characters have fewer.
DISTINCT_LEAST = 8
#: Mean log-likelihood ratio per transition above which a string is random.
MIN_RATIO = 0.5


def pattern_spans(text: Column) -> Column:
    """Spans of the three patterns, unsorted."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    assign = when_any(text, ASSIGN, located(text, ASSIGN, 0, value))
    access = when_any(text, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", located(text, ACCESS, 1, lambda m: F.char_length(m) >= ACCESS_LEAST))
    digits = when_any(text, f"[0-9a-f]{{{HEX_LEAST},}}", located(text, f"[0-9a-f]{{{HEX_LEAST},}}", 2))
    return F.concat(assign, access, digits)


def _pairs(strings: DataFrame) -> DataFrame:
    """(first, second, n) over the characters of column ``value``; at most len(ALPHABET) squared rows."""
    # Equal strings are counted first, so a common word is taken apart once.
    each = strings.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    pairs = each.select("times", F.explode(F.regexp_extract_all("value", F.lit(f"(?=({CHARACTER}{CHARACTER}))"), F.lit(1))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("times").alias("n"))


def ordinary_strings(base: DataFrame) -> DataFrame:
    """All runs of the alphabet that no pattern's span overlaps and that are too short to be judged, of base (text, base)."""
    pattern = f"{CHARACTER}{{2,}}"
    free = F.transform(clear_of(located(F.col("text"), pattern, 3), F.col("base")), lambda s: s["text"])
    runs = F.when(F.size("base") > 0, free).otherwise(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return base.select(F.explode(runs).alias("value")).filter(F.char_length("value") < CANDIDATE_LEAST)


def rules(spark) -> DataFrame:
    """Labelled ordinary strings that no words are in: each character over and over, and alphabets as they stand on a page and on keys."""
    rows = (ascii_lowercase, "qwertyuiopasdfghjklzxcvbnm", "01234567890", "1234567890")
    repeated = F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.repeat(c, F.lit(2)))
    # Many times, so that the smoothing of transitions that rules never make weighs nothing.
    return spark.range(RULE_TIMES).select(F.explode(F.concat(repeated, F.array(*[F.lit(r) for x in rows for r in {x, x.upper()}]))).alias("value"))


def random_strings(spark, rows: int) -> DataFrame:
    """``rows`` labelled random strings of each of six shapes, from digests of 0, 1, 2 ..."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    encoded = F.base64(F.unhex(digest))
    letters = F.regexp_replace(encoded, "[^A-Za-z0-9]", "x")
    shapes = F.array(digest, F.upper(digest), encoded, letters, F.upper(letters), F.lower(letters))
    return spark.range(rows).select(F.explode(shapes).alias("value"))


def identifiers(spark, rows: int) -> DataFrame:
    """``rows`` labelled identifiers of three words in each of six shapes, the words taken by hashes of 0, 1, 2 ..."""
    words = IDENTIFIER_WORDS.split()
    pick = lambda k: F.element_at(F.split(F.lit(" ".join(words)), " "), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)).cast("string")
    three = spark.range(rows).select(F.array(*[pick(k) for k in range(3)]).alias("w"), number.alias("number"))
    capital = F.transform("w", F.initcap)
    shapes = F.array(
        F.concat(F.element_at("w", 1), F.array_join(F.slice(capital, 2, 2), ""), "number"), F.array_join(capital, ""), F.upper(F.array_join("w", "_")),
        F.concat_ws("_", F.array_join("w", "_"), "number"), F.concat(F.lit("/"), F.array_join("w", "/"), F.lit("/"), "number"), F.concat_ws("-", F.array_join("w", "-"), "number"),
    )
    return three.select(F.explode(shapes).alias("value"))


def log_ratios(random: DataFrame, *ordinary: tuple[DataFrame, float]) -> list[float]:
    """Log-likelihood ratio of each transition, indexed by place of first * size + place of second character.

    All inputs hold a column ``value``; the ordinary ones' chains are mixed by their weights. Only the tables of pair counts, of
    bounded size, reach the driver.
    """
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    chains = []
    for strings in (random, *[x for x, _ in ordinary]):
        counts = [[1.0] * size for _ in range(size)]
        for pair, n in _pairs(strings).collect():
            if pair[0] in place and pair[1] in place:
                counts[place[pair[0]]][place[pair[1]]] += n
        chains.append([n / sum(row) for row in counts for n in row])
    weights = [w for _, w in ordinary]
    return [math.log(p) - math.log(sum(w * x for w, x in zip(weights, q, strict=True))) for p, *q in zip(*chains, strict=True)]


def transitions(value: Column) -> Column:
    """The pairs of neighbouring characters of a string, in order."""
    return F.regexp_extract_all(value, F.lit("(?s)(?=(..))"), F.lit(1))


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a string of the alphabet: its pairs of characters, each looked up once."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    at = lambda pair, i: F.instr(F.lit(ALPHABET), F.substring(pair, i, 1)) - 1
    total = F.aggregate(transitions(value), F.lit(0.0), lambda acc, pair: acc + F.element_at(table, at(pair, 1) * len(ALPHABET) + at(pair, 2) + 1))
    return total / (F.char_length(value) - 1)


def scan(docs: DataFrame, *, min_ratio: float = MIN_RATIO, random_rows: int = 2_000, identifier_rows: int = 20_000) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("base", pattern_spans(F.col("text")))
    free = clear_of(when_any(F.col("text"), CANDIDATE, located(F.col("text"), CANDIDATE, 3)), F.col("base"))
    spans = stage(base.select("doc_id", "base", free.alias("found")), "spans")

    value = F.when(F.col("s.kind") == 0, F.regexp_extract("s.text", ASSIGN, 2)).otherwise(F.col("s.text"))
    labelled = spans.select(F.explode("base").alias("s")).select(value.alias("value"))
    spark = docs.sparkSession
    ordinary = zip((ordinary_strings(base), identifiers(spark, identifier_rows), rules(spark)), SHARES, strict=True)
    ratios = log_ratios(labelled.unionByName(random_strings(spark, random_rows)), *ordinary)

    more = F.filter("found", lambda c: (F.size(F.array_distinct(transitions(c["text"]))) >= DISTINCT_LEAST) & (mean_ratio(c["text"], ratios) > min_ratio))
    out = spans.select("doc_id", "base", F.when(F.size("found") > 0, more).otherwise(F.col("found")).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"), spans_text(F.concat("base", "more"), KINDS).alias("spans"), F.size("more").cast("long").alias("n_markov"),
    )
