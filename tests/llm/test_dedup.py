import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tamarack.llm import compact_windows, components, exact_dedup, minhash, suffix_dedup
from tests.conftest import SF
from tests.llm.conftest import prose

LONG = compact_windows.LEAST
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_exact_groups_on_awkward_rows(awkward, empty):
    got = exact_dedup.exact_groups(awkward).collect()
    rows = awkward.collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()].append(r.doc_id)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)  # of rows repeated in full one is kept
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_a_full_filter_changes_nothing(spark):
    docs = small(spark)
    want = {tuple(r) for r in exact_dedup.exact_groups(docs).collect()}
    assert {tuple(r) for r in exact_dedup.exact_groups(docs, filter_bits=1 << 15, salts=2).collect()} == want


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    ra, rb = sorted((find(a), find(b)))
                    parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_against_brute_force(spark, width):
    docs = small(spark)
    rng = random.Random(2)
    base = prose(rng, 120).split()
    chain = [base[:]]
    for _ in range(12):  # a chain whose ends are unlike each other
        x = chain[-1][:]
        for k in rng.sample(range(120), 2):
            x[k] = prose(rng, 1)
        chain.append(x)
    rows = [(5000 + i, " ".join(x)) for i, x in enumerate(chain)] + [(6000, "a b"), (6001, "A  b"), (6002, ""), (6003, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: r for r in minhash.near_groups(docs, width=width).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_groups_on_awkward_rows(awkward, empty):
    got = minhash.near_groups(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].component_id == by[4].component_id == by[5].component_id == by[6].component_id == by[15].component_id == 3
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[1].kept
    lone = [r for r in got if r.doc_id is None and r.n_shingles]
    assert lone and all(r.component_id is None and r.kept for r in lone)
    left = minhash.drop_near_copies(awkward)
    assert left.columns == awkward.columns and {4, 5, 6}.isdisjoint({r.doc_id for r in left.collect()})
    assert minhash.near_groups(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


def test_a_null_doc_id_does_not_hide_known_ones(spark):
    text = prose(random.Random(5), 40)
    got = minhash.near_groups(spark.createDataFrame([(None, text), (9, text), (4, text + " more")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 4, False), (9, 4, False), (4, 4, True)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def brute_repeats(docs):
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        marks = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                marks[k] += 1
                marks[k + 100] -= 1
            seen.add(b[k : k + 100])
        cut = np.cumsum(marks[:-1]) > 0
        spans = int((cut[1:] & ~cut[:-1]).sum() + (len(cut) > 0 and cut[0]))
        left = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((i, len(b), int(cut.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def periodic(rng):
    base = "".join(rng.choice("abc é") for _ in range(700))
    rows = []
    for i in range(60):
        k = rng.random()
        a = rng.randint(0, 500)
        rows.append((i, base[: rng.randint(80, 700)] if k < 0.3 else "ab" * rng.randint(10, 300) if k < 0.5 else prose(rng, 9) + base[a : a + rng.randint(60, 300)] + "zz" * rng.randint(0, 60)))
    return rows + [(200, None), (201, ""), (202, rows[3][1]), (203, "a" * 100), (204, "a" * 100), (205, "b" * 99), (206, "b" * 99)]


@pytest.mark.parametrize(("piece", "held", "sorted_"), [(20_000, 100_000, 4_000), (2, 100_000, 4_000), (2, 3, 2)])
def test_repeats_against_brute_force(spark, monkeypatch, piece, held, sorted_):
    """Buckets as they are, dealt out by their windows, and with so little room that equal windows meet only behind the shuffle."""
    for name, value in (("PIECE", piece), ("HELD", held), ("SORTED", sorted_)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = periodic(random.Random(4))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in got} == set(brute_repeats(rows)) and len(got) == len(rows)


@pytest.mark.parametrize("chunk", [1 << 16, 1, 40])
def test_suffixes_sort_like_their_bytes(monkeypatch, chunk):
    """Pointers in the order of the bytes, equal only for 100 equal ones, whatever is refined together."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    motif = rng.integers(0, 3, 150).astype(np.uint8)
    for raw in (rng.integers(0, 2, 900), np.tile([1, 2, 3], 200), np.zeros(400), np.concatenate([motif, motif[:130], rng.integers(0, 256, 60), motif]), np.zeros(0), np.array([5])):
        raw = raw.astype(np.uint8)
        pointer = suffix_dedup.sort_suffixes(raw)[: raw.size]
        padded = raw.tobytes() + b"\0" * 400
        for i, j in zip(*(rng.integers(0, max(1, raw.size), 4000) for _ in "ab"), strict=True) if raw.size else ():
            if pointer[i] == pointer[j]:
                assert padded[i : i + 100] == padded[j : j + 100]
            else:
                assert (pointer[i] < pointer[j]) == (padded[i:] < padded[j:])
        starts = np.arange(max(0, raw.size - 99))
        ids = suffix_dedup.window_classes(raw, starts)
        named = {}
        for k, i in zip(starts.tolist(), ids.tolist(), strict=True):
            assert named.setdefault(padded[k : k + 100], i) == i
        assert len(set(named.values())) == len(named)


def test_classes_over_the_ends_of_tasks(spark):
    """Classes and buckets that go on over many tasks, or end where a task does."""
    import pandas as pd

    rng = random.Random(3)
    rows = sorted({(rng.choice([1, 1, 2, 3, 4, 5]), rng.choice([7, 7, 7, 8, 9]), rng.randint(0, 400), 0, rng.randint(0, 3), 9) for _ in range(600)} | {(k, 0, 1, 0, 0, 9) for k in range(10, 16)})
    want, firsts = [], {}
    for anchor, whole, *place, _ in rows:
        firsts.setdefault(anchor, {}).setdefault(whole, tuple(place))
    for anchor, whole, doc_id, tie, first, last in rows:
        if firsts[anchor][whole] != (doc_id, tie, first):
            want.append((anchor, doc_id, tie, first, last, False))
        elif len(firsts[anchor]) > 1:
            want.append((anchor, doc_id, tie, first, last, True))
    for tasks in (1, 3, 17, 120, len(rows)):
        cuts = sorted(rng.sample(range(1, len(rows)), tasks - 1))
        parts = [pd.DataFrame(rows[a:b], columns=suffix_dedup._STRETCH) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        out = pd.concat([x for part in parts for x in suffix_dedup._classes(iter([part.iloc[:5], part.iloc[5:]])) if len(x)])
        found = spark.createDataFrame(out.astype({"several": bool}), ", ".join(f"{c} long" for c in suffix_dedup._STRETCH) + ", state int, several boolean")
        got = [tuple(r) for r in suffix_dedup._settled(found).collect()]
        assert sorted(got) == sorted(want)


def test_a_bucket_of_many_stretches_and_a_very_long_text(spark):
    """Over 20,000 stretches around one line, and a text of more than 4 MiB with repeats over the place where it is cut."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(110))
    rows = [(k, f"{k:07d}" * 9 + line + f"{k * 7:07d}" * 9) for k in range(21_000)]
    long = "".join(rng.choices("abcdefghijklmnop ", k=4_500_000))
    cut = suffix_dedup.LONGEST
    rows += [(30_000, long), (30_001, "x" * 50 + long[cut - 200 : cut + 200] + "y" * 50), (30_002, long[-150:])]
    got = {r.doc_id: tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {r[0]: r for r in brute_repeats(rows)}


def test_repeats_of_all_documents(spark):
    rows = sorted((r.doc_id, r.text) for r in small(spark).collect())
    got = suffix_dedup.remove_repeats(small(spark), with_text=True).collect()
    assert {tuple(r)[:5] for r in got} == set(brute_repeats(rows))


def test_repeats_on_awkward_rows(awkward, empty):
    got = suffix_dedup.remove_repeats(awkward).collect()
    assert len(got) == awkward.count() and sum(r.n_removed == r.n_bytes for r in got if r.doc_id == 3) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeated_passages_are_all_found(spark):
    docs = small(spark)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) for r in docs.collect()}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    got = compact_windows.repeated_passages(docs).collect()
    covered = defaultdict(list)
    for r in got:
        a, b = words[r.doc_id][r.start : r.end], words[r.other_id][r.other_start : r.other_end]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-5 and r.similarity >= 0.8
        covered[r.doc_id].append((r.start, r.end))
        covered[r.other_id].append((r.other_start, r.other_end))
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in covered[i])


def test_passages_on_awkward_rows(awkward, empty):
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(awkward).collect()}
    assert {(8, 7), (4, 3), (14, 3), (6, 3)} <= got
    assert compact_windows.repeated_passages(empty).count() == 0


def test_windows_are_those_of_the_whole_tree():
    rng = np.random.default_rng(3)
    for n, kinds in ((10, 2**31), (46, 2**31), (200, 2**31), (200, 20), (300, 3)):
        h = rng.integers(0, kinds, n, dtype=np.uint64) << np.uint64(32)
        want = set()
        for c in range(n):
            left, right = c, c
            while left and h[left - 1] >= h[c]:
                left -= 1
            while right < n - 1 and h[right + 1] >= h[c]:
                right += 1
            first = left + int(np.flatnonzero(h[left : right + 1] == h[c])[0])  # equal hashes are one node
            if right - left + 1 >= 8:
                want.add((left, first, right))
        left, c, d, right = compact_windows.windows_of(h, 8)
        assert set(zip(left.tolist(), c.tolist(), right.tolist(), strict=True)) == want and len(c) == len(want)
        assert (h[d] == h[c]).all() and (c <= d).all() and (d <= right).all()


def test_changed_words_do_not_break_a_passage():
    rng = random.Random(8)
    vocabulary = prose(rng, 5000).split()
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    tested = 0
    for n in (50, 51, 60, 75, 100, 120, 150):
        places = [(k,) for k in (0, 2, n // 4, n // 3, n // 2, n - 1)] + [(n // 3, 2 * n // 3), (n // 4, n // 2), (0, n - 1), (n // 2, n // 2 + 1)]
        for spots in places:
            for kind in ("change", "insert"):
                one = draw(n)
                two = one[:]
                for k in reversed(spots):
                    two[k : k + (kind == "change")] = ["other"]
                x, y = sets(one), sets(two)
                if len(x & y) < 0.8 * len(x | y):
                    continue
                tested += 1
                heads = [draw(rng.randint(20, 60)) for _ in range(2)]
                a, b = (h + w + draw(30) for h, w in zip(heads, (one, two), strict=True))
                got = compact_windows.passages(" ".join(a).encode(), " ".join(b).encode())
                lo, hi = len(heads[0]), len(heads[1])
                cover = [min(q, lo + n) - max(p, lo) >= 0.8 * n and min(s, hi + len(two)) - max(r, hi) >= 0.8 * n for p, q, r, s, _ in got]
                assert any(cover), (n, spots, kind, got)
                for p, q, r, s, like in got:
                    x, y = sets(a[p:q]), sets(b[r:s])
                    assert q - p >= 50 and s - r >= 50 and like >= 0.8 and abs(len(x & y) / len(x | y) - like) < 1e-9
    assert tested > 100


def test_hits_on_either_side_of_a_band_meet(spark):
    rows, far = [], []
    for k, d in enumerate((-33, -17, -16, -1, 0, 15, 16, 31)):
        for step in (1, 7, 16):  # two hash functions, one hit each, on diagonals d and d + step
            pair = 100 * k + step
            rows += [(0, pair, 0, 0, 100 + d, 100 + d, 200, 1000, 0, 0, 100, 100, 199), (1, pair, 0, 0, 150 + d + step, 150 + d + step, 210, 1000, 0, 5, 150, 150, 205)]
    # Shingles that repeat on both sides agree on any diagonal.
    rows += [(0, 7000, 0, 0, 100, 180, 200, 1000, 0, 0, 10, 190, 199), (1, 7000, 0, 0, 50, 90, 210, 1000, 0, 5, 100, 110, 205)]
    far = [(0, 5000, 0, 0, 100, 100, 200, 1000, 0, 0, 100, 100, 199), (1, 5000, 0, 0, 300, 300, 400, 1000, 0, 5, 100, 100, 205)]
    names = "j int, doc_idx long, tiex long, lx int, cx int, dx int, rx int, doc_idy long, tiey long, ly int, cy int, dy int, ry int"
    got = compact_windows.candidates_of(spark.createDataFrame(rows + far, names)).collect()
    assert {r.doc_idx for r in got} == {r[1] for r in rows} and all((r.lx, r.rx, r.ly, r.ry, r.n_hashes) == (0, 210, 0, 205, 2) for r in got)


def test_a_word_put_in_where_a_band_ends(spark):
    rng = random.Random(12)
    rows = []
    for k in range(150):  # alike from the start, one word added in the middle of the smaller doc_id
        w = prose(rng, 60).split()
        rows += [(2 * k, " ".join(w[:30] + ["added"] + w[30:] + prose(rng, 40).split())), (2 * k + 1, " ".join(w + prose(rng, 40).split()))]
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 140 and all(a == b + 1 for a, b in got)


def test_near_copies_are_found_where_no_pivot_is_like_them(spark):
    """Pairs with a passage of 70 to 110 words, one word changed or put in, around a line that documents of lesser and greater ids have too."""
    rng = random.Random(21)
    vocabulary = prose(rng, 4000).split()
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, pairs = [], []
    for k in range(60):
        line = draw(12)
        passage = draw(rng.randint(30, 50)) + line + draw(rng.randint(28, 48))
        other = passage[:]
        at = rng.randrange(len(other))
        other[at : at + k % 2] = ["changed"]
        rows += [(k, " ".join(draw(60) + line + draw(60))), (5000 + k, " ".join(draw(60) + line + draw(60)))]  # the pivots of the line's shingles
        rows += [(1000 + k, " ".join(draw(40) + passage + draw(30))), (2000 + k, " ".join(draw(25) + other + draw(50)))]
        pairs.append((2000 + k, 1000 + k))
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & set(pairs)) >= 0.9 * len(pairs) and got <= set(pairs)


def test_a_line_repeated_in_many_documents_makes_one_window_each(spark):
    rng = random.Random(22)
    line = prose(rng, 9) + "\n"
    rows = [(i, prose(rng, 30) + "\n" + line * 400 + prose(rng, 30)) for i in range(12)]
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} | {r.other_id for r in found} == set(range(12))
    h = compact_windows.shingles_of(rows[0][1])[0]
    assert len(compact_windows.windows_of(h * np.uint64(2654435769))[0]) < 20


def test_no_pair_is_lost_around_a_line_that_all_documents_have(spark):
    """Passages that are mostly one common line, whose pivots are unlike them: every pair is listed, and no other."""
    rng = random.Random(31)
    vocabulary = prose(rng, 4000).split()
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, rows, pairs = draw(38), [], set()
    for k in range(40):
        before, after = draw(rng.randint(9, 13)), draw(rng.randint(9, 13))
        other = after[:]
        if k % 2:
            other[-3:-2] = ["changed"]
        rows += [(k, " ".join(draw(40) + line + draw(40))), (9000 + k, " ".join(draw(40) + line + draw(40)))]
        rows += [(1000 + k, " ".join(draw(30) + before + line + after + draw(30))), (2000 + k, " ".join(draw(20) + before + line + other + draw(40)))]
        pairs.add((2000 + k, 1000 + k))
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pairs


def test_rare_places_meet_where_two_stretches_share_enough():
    rng = np.random.default_rng(5)
    for missing in (0, 5, compact_windows.MISSING):
        for _ in range(30):
            one = rng.choice(10**6, compact_windows.LEAST, replace=False)
            two = one.copy()
            two[rng.choice(one.size, missing, replace=False)] = rng.integers(10**6, 2 * 10**6, missing)
            counts = {x: int(rng.integers(2, 9)) for x in np.union1d(one, two).tolist()}
            counts.update({x: 1 for x in np.setxor1d(one, two).tolist() if rng.integers(2)})
            a, b = ({int(t[p]) for p in compact_windows.rare_places(np.array([counts[x] for x in t.tolist()]), t)} for t in (one, two))
            assert a & b


def test_places_that_no_chain_can_hold():
    words, known = np.arange(120), np.ones(116, bool)
    known[40:45] = False  # one changed word
    assert compact_windows.chainable(known, words).all()
    known[[*range(60, 65), *range(80, 85), *range(100, 105)]] = False
    got = compact_windows.chainable(known, words)
    assert got[:40].all() and not got[65:80].any()


def test_a_short_run_of_one_word_is_no_rare_place():
    """A run that words known to no other document cut off is in no passage; one of 50 words or more is, and so is its shingle."""
    for n, found in ((20, False), (LONG - 1, False), (LONG, True), (90, True)):
        items = np.concatenate((np.arange(1000, 1060), np.full(n, 7), np.arange(2000, 2060)))
        got = compact_windows.rare_places(np.where(items == 7, 300, 1), items)
        assert bool(got.size) == found and (items[got] == 7).all()


def test_near_copies_and_runs_of_words_stay_linked(spark):
    """Copies of one text with changed words, and texts with runs of the same words: what is alike by brute force is linked, directly or not."""
    rng = random.Random(41)
    vocabulary = prose(rng, 3000).split()
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, texts = draw(160), []
    for _ in range(24):
        copy = base[:]
        for k in rng.sample(range(160), rng.randint(0, 7)):
            copy[k] = rng.choice(vocabulary)
        texts.append(copy)
    for _ in range(24):
        texts.append([w for x in rng.sample(["the", "and", "is", "of"], 3) for w in [x] * rng.choice((20, 30, 45, 60, 80))] + draw(20))
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    hashes = [compact_windows.shingles_of(x)[0] for _, x in rows]
    alike = [(j, i) for j in range(len(rows)) for i in range(j) if compact_windows.passages_between(hashes[j], hashes[i])]
    got = [(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    linked = {r.node: r.component for r in components.components(spark.createDataFrame(got, "u long, v long")).collect()}
    assert len(alike) > 200 and all(linked[a] == linked[b] for a, b in alike)
