"""Snippets, test contexts and candidates found through texts, against plain loops on small sources."""

import random
import re

from tamarack.operators import contexts, references, snippets
from tests.test_text import tokens

WORDS = "button api currency zero getter confirm value alpha beta gamma delta render total class record USD isLoading getInstance toString".split()


def source(rng, n):
    shapes = ("{} {}", "  {}({}", "// {} {}", "", "* {}", "class {} {}", "<Button {}", "currency: {}", "yes, i confirm {} {}", "\t{}.{} é")
    return "\n".join(rng.choice(shapes).format(*rng.choices(WORDS, k=2)) for _ in range(n))


def best_lines(text, query, most, context):
    stops = set(snippets.relevant_terms.__globals__["STOP_TOKENS"])
    terms = set(list(dict.fromkeys(t for t in tokens(query) if len(t) >= 3 and t not in stops))[:40])
    digits = re.search(r"\d", query)
    if re.search(r"(?<![A-Za-z0-9])-0", query) or (digits and "expected" in terms and "comparisonfailure" in query.lower()):
        terms |= set(snippets.NUMERIC_OUTPUT_TERMS)
    rows = text.splitlines()
    places = []
    for i, line in enumerate(rows):
        own = set(tokens(line))
        hit, telling = own & terms, own & terms & set(snippets.HIGH_SIGNAL_TERMS)
        bare = line.strip()
        if not hit or (not telling and (not bare or bare.startswith(("*", "/*", "//")))):
            continue
        points = len(hit) + 3 * len(telling) + (6 * len(own & set(snippets.GETTER_TERMS)) if terms & set(snippets.GETTER_TERMS) else 0)
        for rule in snippets.LINE_RULES:
            if (not rule.terms or terms & set(rule.terms)) and re.search(rule.pattern, line.lower() if rule.lower else line):
                points += rule.points
        places.append((-points, i))
    wide = max(context, 8 if terms & set(snippets.WIDEST_CONTEXT_TERMS) else 4 if terms & set(snippets.WIDE_CONTEXT_TERMS) else 0)
    order = [i + d for _, i in sorted(places) for d in [0, *range(1, wide + 1), *range(-1, -wide - 1, -1)]]
    chosen = sorted(list(dict.fromkeys(i for i in order if 0 <= i < len(rows)))[:most])
    if not chosen:
        return "\n".join(rows[:most])
    return "\n".join(("...\n" if k and i > chosen[k - 1] + 1 else "") + f"{i + 1}: {rows[i]}" for k, i in enumerate(chosen))


def test_snippets_against_a_loop(spark):
    rng = random.Random(6)
    files = {f"src/F{k}.java": source(rng, rng.choice([0, 1, 5, 40, 90])) for k in range(12)} | {"src/none.java": None}
    queries = {k: " ".join(rng.choices(WORDS, k=rng.randint(0, 4))) + rng.choice(["", " ComparisonFailure expected 12", " was -0.0", " the"]) for k in range(14)} | {99: None}
    asked = [(q, f, t, None) for q, t in queries.items() for f in files] + [(5, "gone.java", "api", None)]
    pairs = spark.createDataFrame(asked, "query_id long, file string, query string, trace string")
    sources = spark.createDataFrame(list(files.items()), "file string, text string")
    got = {(r.query_id, r.file): r.snippet for r in snippets.snippets(pairs, sources, max_lines=9).collect()}
    assert got == {(q, f): best_lines(files[f] or "", t or "", 9, 1) for q, f, t, _ in asked if f in files}


def test_a_trace_comes_first(spark):
    pairs = spark.createDataFrame([(1, "a/F.java", "api", "at x.F.run(F.java:4)"), (1, "b/G.java", "api", "at x.F.run(F.java:4)")], "query_id long, file string, query string, trace string")
    sources = spark.createDataFrame([(f, "\n".join(f"line {k}" for k in range(1, 21))) for f in ("a/F.java", "b/G.java")], "file string, text string")
    got = {r.file: r.snippet for r in snippets.snippets(pairs, sources, max_lines=3).collect()}
    assert got == {"a/F.java": "1: line 1\n2: line 2\n3: line 3", "b/G.java": "line 1\nline 2\nline 3"}


def test_contexts_of_tests(spark):
    texts = {
        "src/test/java/a/AppTest.java": "package a;\nimport b.C;\n import b.d.E;\nclass AppTest {\n  void one() {\n    check();\n  }\n}",
        "test/other/Plain.java": "\n".join(f"row {k}" for k in range(9)),
        "main/Named.java": "// two is only named here\nint x;",
    }
    sources = spark.createDataFrame(list(texts.items()), "file string, text string")
    classes = spark.createDataFrame([(1, "a.AppTest"), (1, "other.Plain"), (1, "x.Named"), (1, "no.Where"), (2, "a.AppTest"), (3, "no.Where"), (1, "a.AppTest")], "query_id long, class string")
    methods = spark.createDataFrame([(1, "one"), (1, "two"), (1, "one")], "query_id long, method string")
    got = {r.query_id: r.context for r in contexts.test_contexts(classes, methods, sources, context=6, head=3).collect()}
    assert got == {
        1: "b.C\nb.d.E\n import b.d.E;\nclass AppTest {\n  void one() {\n    check();\n  }\n}\nrow 0\nrow 1\nrow 2",
        2: "b.C\nb.d.E\npackage a;\nimport b.C;\n import b.d.E;",
    }
    shown = {r.query_id: r.context for r in contexts.shown_contexts(classes, methods, sources, max_chars=1000, context=3).collect()}
    head = "file: src/test/java/a/AppTest.java\nclass: a.AppTest\nimports:\nb.C\nb.d.E"
    assert shown[2] == head
    assert shown[1] == head + "\nsnippets:\nmethod: one\n4: class AppTest {\n5:   void one() {\n6:     check();\n7:   }\n\n---\n\nfile: test/other/Plain.java\nclass: other.Plain\n\n---\n\nfile: main/Named.java\nclass: x.Named"
    assert contexts.shown_contexts(classes, methods, sources, max_chars=10).collect()[0].context.endswith("\n...[truncated]")


def chained(pool, ranked, newcomers, k, kept, most=None, resort=True):
    """A pool after newcomers (file, total, reasons), best first, each took the place of the last file without a kept reason."""
    pool, freed = list(pool), []
    for item in sorted(newcomers, key=lambda x: (-x[1], x[0])):
        slot = next((i for i in range(len(pool) - 1, -1, -1) if not any(r.startswith(kept) for r in pool[i][2])), None)
        if slot is None or (most is not None and len(freed) >= most):
            break
        pool[slot] = item
        freed.append(slot)
    if resort:
        pool.sort(key=lambda x: (-x[1], x[0]))
    else:
        for slot, item in zip(sorted(freed), sorted((pool[i] for i in freed), key=lambda x: (-x[1], x[0])), strict=True):
            pool[slot] = item
    return pool


def corpus(rng, n):
    names = [f"{a}{b}" for a in ("Fold", "Inline", "Check", "Peephole", "Alias", "Tree") for b in ("Pass", "Variables", "Node", "PassConfig")]
    out = {}
    for k in range(n):
        own = rng.sample(names, rng.choice([0, 1, 2, 3]))
        body = " ".join(rng.choice([f"new {rng.choice(names)}(", rng.choice(names), "Ab", "return x"]) for _ in range(rng.randint(2, 12)))
        out[f"d/F{k:02d}.v.java"] = (own, body)
    return out


def test_references_and_chains_against_a_loop(spark):
    rng = random.Random(9)
    files, k = corpus(rng, 40), 10
    declared = {n for own, _ in files.values() for n in own}
    terms = {1: ["fold", "optimization", "check"], 2: ["tree"], 3: ["inline", "late"], 4: [], 5: ["check"], 6: ["optimization", "peephole"]}
    ranked = {}
    for q in terms:
        order = rng.sample(sorted(files), 30)  # the other ten have no score
        ranked[q] = [(f, float(100 - i), ["direct_class_hint:x"] if rng.random() < 0.25 else ["identifier_overlap:y"]) for i, f in enumerate(order)]
    rows = [(q, i + 1, *x) for q, r in ranked.items() for i, x in enumerate(r)]
    df = spark.createDataFrame(rows, "query_id long, rank int, file string, total double, reasons array<string>")
    sources = spark.createDataFrame([(f, own, body) for f, (own, body) in files.items()], "file string, classes array<string>, text string")
    asked = spark.createDataFrame(list(terms.items()), "query_id long, terms array<string>")
    known = {q: {f: (t, r) for f, t, r in x} for q, x in ranked.items()}

    def outside(q, pool):
        taken = {f for f, _, _ in ranked[q][:k]} | {f for f, _, _ in pool}
        return [f for f in files if f not in taken]

    want = {}
    for q in terms:
        pool = ranked[q][:k]
        hints = {n for f, _, _ in pool[:4] for n in re.findall(r"\b[A-Z]\w{2,}\b", files[f][1]) if n in declared and n not in files[f][0]}
        come = []
        for f in outside(q, pool):
            names = sorted(set(files[f][0]) & hints)
            if names:
                t, r = known[q].get(f, (0.0, []))
                come.append((f, t + 260, [*r, "reference_class_hint:" + ",".join(names[:4])]))
        want[q] = chained(pool, ranked[q], come, k, ("direct_", "reference_"))
    pool = df.filter(f"rank <= {k}")
    kept = references.keep_references(pool, df, sources, k=k, top=4)
    as_lists = lambda d: {q: [(r.file, r.total, list(r.reasons)) for r in sorted(d, key=lambda r: r["rank"]) if r.query_id == q] for q in terms}
    assert as_lists(kept.collect()) == want
    assert want != {q: ranked[q][:k] for q in terms}

    want = {q: ranked[q][:k] for q in terms}
    chain = references.Chain(most=2)
    split = lambda n: {p.lower() for p in re.findall("[A-Z][a-z]+", n)} | {n.lower()}
    for q in terms:
        evidence = set(terms[q]) & set(chain.evidence)
        hints = {}
        for f, _, _ in want[q]:
            if evidence and any(n.endswith("PassConfig") for n in files[f][0]):
                for n in re.findall(r"\bnew\s+([A-Z]\w*)\s*\(", files[f][1]):
                    own = split(n)
                    if n in declared and n not in files[f][0] and (own & {"pass", "peephole"} or own & set(chain.classes) & evidence):
                        hints.setdefault(n, set()).add(f.split("/")[-1][: -len(".java")])
        come = []
        for f in outside(q, want[q]):
            names = sorted(set(files[f][0]) & set(hints))
            if names:
                t, r = known[q].get(f, (0.0, []))
                boost = max(700 + (160 if "peephole" in split(n) and "optimization" in terms[q] else 0) for n in names)
                come.append((f, t + boost, [*r, *[f"pass_chain_hint:{','.join(sorted(hints[n])[:3])}->{n}" for n in names[:4]]]))
        want[q] = chained(want[q], ranked[q], come, k, ("direct_", "reference_", "pass_chain_"), 2, False)
    got = as_lists(references.keep_chains(pool, df, sources, asked, k=k, chain=chain).collect())
    assert got == want
    assert any(r.startswith("pass_chain_hint") for p in want.values() for _, _, rs in p for r in rs)
