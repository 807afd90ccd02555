"""Operators 11 to 13 against brute force, on awkward rows, on rows that force the ways for hot groups and rare names, and on empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack.llm import collocations, conversation_repair, pii
from tamarack.llm._spans import SPAN, clear_of, located


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 8))) for _ in range(n))


# Operator 11


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, digest(*x[1:])))


def repaired(rows):
    """The row of one conversation: every sequence of edits, best by (cost, letters), forward over the rows."""
    rows = after_damage(rows)
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def better(into, state, path):
        if state not in into or path[:2] < into[state][:2]:
            into[state] = path

    def inserts(states):
        for _ in range(3):
            for q, (c, a, r) in list(states.items()):
                better(states, 3 if q == 2 else 2, (c + 5, a + "I", (*r, ("assistant" if q == 2 else "user") + ":")))
        return states

    inserts(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new, more = {}, 5 * (fault == "truncated")
        for q, (c, a, r) in best.items():
            better(new, q, (c + 2, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            if (q, role[:1]) in go:
                better(new, go[q, role[:1]], (c + more, a + "K", (*r, f"{role}:{text}")))
            better(new, 3 if q == 2 else 2, (c + 1 + more, a + "R", (*r, f"{'assistant' if q == 2 else 'user'}:{text}")))
        best = inserts(new)
    cost, audit, left = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = rng.choice(["Yes.", "no", "", " \t", "Why?", "Well.", None, "é!  \n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), text))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(7)] + rows[:5] + [(n, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_repair_against_brute_force(spark, monkeypatch, block):
    """Blocks of three rows make every longer conversation meet over several blocks."""
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = conversations(block, 60)
    clash = [f"'x' AS `{c}`" for c in ("who", "digest", "n", "b", "code", "kind", "dated", "at", "audit", "blank", "chunk", "__salt")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *clash).repartition(3)
    found = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(df).collect()}
    by_conv = {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert found == {c: repaired(r) for c, r in by_conv.items()}


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """One conversation over many blocks and tasks; a copy of its last row many times over."""
    monkeypatch.setattr(conversation_repair, "BLOCK", 64)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", f"cut {t}"])) for t in range(900)] + [(1, 900, "user", "Again.")] * 300 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(df).collect()}
    assert found == {1: repaired(rows[:-1]), 2: repaired(rows[-1:])}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(empty).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(7, dropped, "user", "Hi.")], empty.schema)
    assert tuple(conversation_repair.repair(only).first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Operator 12


def mined(rows, least, top):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        kept = {g: f for g, f in found.items() if f >= least and len(g) > 1}
        scored = []
        for g, a in kept.items():
            score, k = min((2000000 * a // (found[g[:k]] + found[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and 100 * f >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, f in kept.items())
            if not inside:
                scored.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    words = prose(rng, 60).split()
    hot = [" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(25)]
    rows = []
    for k in range(250):
        text = " ".join(rng.choice([rng.choice(words), rng.choice(hot), rng.choice(words) + rng.choice(".,;:!?\n\x0b"), rng.choice(words).upper(), "É" + rng.choice(words)]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text if k % 50 else None))
    return rows + [("en", ""), ("en", " \t. ,"), ("en", "the same again " * 3000), rows[3], rows[3]]


@pytest.mark.parametrize("limits", [{}, {"head": 40}, {"head": 0}], ids=["ids", "some names", "names alone"])
def test_collocations_against_brute_force(spark, phrase_rows, limits, monkeypatch):
    """With few ids, most words and phrases are counted by their names; small limits make tiles dense and hand coordinates out early."""
    monkeypatch.setattr(collocations, "CELLS", collocations.CELLS)
    df = spark.createDataFrame(phrase_rows, "lang string, text string").selectExpr("*", "'x' AS word", "'x' AS n", "'x' AS key", "'x' AS value").repartition(3)
    found = collocations.collocations(df, top=50, least=12, **({"tail_bits": 1 << 16} | limits)).collect()
    assert sorted(tuple(r) for r in found) == mined(phrase_rows, 12, 50)


def test_tiles_count_like_a_dictionary():
    import numpy as np

    rng = np.random.default_rng(1)
    tiles, want = collocations.Tiles(), Counter()
    for _ in range(4):
        a, b = rng.integers(-3, 900, 300_000), rng.integers(-3, 900, 300_000)
        a[:200_000] %= 40
        b[:200_000] %= 40
        a, b = a[(a != -1) & (b != -1)], b[(a != -1) & (b != -1)]
        tiles.add(a, b)
        tiles.merge()
        want.update(zip(a.tolist(), b.tolist(), strict=True))
    assert tiles.tiles
    found = Counter()
    for batch in [*tiles.dense(), *tiles.give()]:
        for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("first", "second", "n")), strict=True):
            found[a, b] += n
    assert found == want


def test_collocations_of_nothing(spark, empty, awkward):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(awkward, least=10_000).collect() == []


# Operator 13

KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([ -]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    return [(kind, m.start(), m.end()) for kind, (p, keep) in KINDS.items() for m in re.finditer(p, text or "") if keep(m.group())]


def test_seeds_against_python(spark):
    """Awkward neighbours of the four patterns, and random strings of their characters."""
    rng = random.Random(8)
    texts = ["a@b.c_d@e.f", "x@y", "a.b@c.d.e..f@g.h", "é@b.c @@ a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.00.0.1", "1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (487) 555-7209.", "+1((((", "++1 2345678", "+12345678901234567", None, "", "1" * 40]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for alphabet in ("ab1@._- ", "0123.. ", "0123456789 -", "+1234567 ().-", "a1@.+ -(25") for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in pii.personal_data(df).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in KINDS]


def scored(edges, rounds):
    seed = {i for _, i, s in edges if s}
    score = {i: float(i in seed) for _, i, _ in edges}
    pairs = {(p, i) for p, i, _ in edges}
    for _ in range(rounds):
        conf = {}
        for p in {p for p, _ in pairs}:
            own = [score[i] for q, i in pairs if q == p]
            conf[p] = sum(own) / (len(own) + 1)
        score = {i: 1.0 if i in seed else max(conf[p] for p, j in pairs if j == i) for i in score}
    return {(p, i): (round(conf[p], 9), round(score[i], 9)) for p, i in pairs}


def test_graph_against_brute_force(spark):
    rng = random.Random(4)
    edges = list({(f"p{rng.randint(0, 12)}", f"i{rng.randint(0, 40)}") for _ in range(150)})
    seeds = {f"i{k}" for k in range(18)}
    rows = [(p, i, i in seeds) for p, i in edges]
    df = spark.createDataFrame(rows, "pattern string, instance string, seed boolean")
    found = {(r.pattern, r.instance): (round(r.confidence, 9), round(r.score, 9)) for r in pii.scored_edges(df, rounds=3).collect()}
    assert found == scored(rows, 3)


def test_contexts_find_unseen_identifiers(spark):
    """Numbers without a country code behind words that stand before phone numbers; a card with dots; nothing in plain text."""
    rng = random.Random(2)
    rows = [(k, f"{prose(rng, 5)} call me: +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} {prose(rng, 5)}") for k in range(12)]
    rows += [(20, "please call me: 555-018-2345 soon"), (21, "order no 555-018-9999 shipped"), (22, "card 4111 1111 1111 1111"), (23, "seen 4111.1111.1111.1111 there"), (24, "version 10.2.33331 of 2024"), (25, None), (25, None)]
    found = sorted(((r.doc_id, r.spans) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id >= 20), key=str)
    text = dict(rows)
    at = lambda k, s: f"{text[k].index(s)}:{text[k].index(s) + len(s)}"
    assert found == [(20, "context:" + at(20, "555-018-2345")), (21, ""), (22, "card:5:24"), (23, "context:" + at(23, "4111.1111.1111.1111")), (24, ""), (25, ""), (25, "")]


def test_personal_data_of_awkward_rows(awkward, empty):
    assert pii.personal_data(empty).collect() == []
    assert pii.personal_data(awkward).count() == awkward.count()


def test_places_of_many_matches(spark):
    """Half a million characters with 40,000 matches of two kinds: linear, well under the time that a growing array would take."""
    text = " ".join(f"a{k}@b.cd {k}" for k in range(40_000))
    df = spark.createDataFrame([(text,), ("x" * 1_000_000,), ("1" * 1_000_000,), ("a." * 500_000,)], "text string")
    began = time.perf_counter()
    found = df.select(pii.seeds(F.col("text")).alias("base"), "text").select(F.size("base").alias("n"), F.size(pii.candidates(F.col("text"), F.col("base"))).alias("m")).collect()
    assert sorted((r.n, r.m) for r in found) == [(0, 0), (0, 0), (0, 1), (40_000, sum(k > 99_999 for k in range(40_000)))]
    assert time.perf_counter() - began < 60


def test_clear_of_against_pairs(spark):
    rng = random.Random(1)
    some = lambda n: [(a, a + rng.randint(1, 9), 0, "x", "") for a in (rng.randint(0, 60) for _ in range(rng.randint(0, n)))]
    df = spark.createDataFrame([(some(6), some(4)) for _ in range(300)], f"found {SPAN}, base {SPAN}")
    for r in df.select("found", "base", clear_of(F.col("found"), F.col("base")).alias("free")).collect():
        assert sorted(tuple(s) for s in r.free) == sorted(tuple(s) for s in r.found if not any(b.start < s.end and s.start < b.end for b in r.base))


def test_located_against_python(spark):
    texts = ["ab12 34é5😀6", "", "x" * 1000, " ".join(f"k{i}" for i in range(3000)), "12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", located(F.col("t"), "[0-9]+", 1, context=3).alias("s")).collect():
        ends = [0, *[m.end() for m in re.finditer("[0-9]+", r.t)]]
        assert [(s.start, s.end, s.text, s.left) for s in r.s] == [(m.start(), m.end(), m.group(), ("\n" + r.t[e : m.start()])[-3:]) for m, e in zip(re.finditer("[0-9]+", r.t), ends, strict=False)]
