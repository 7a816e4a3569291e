"""Licences, substring removal, SimHash, decontamination: against plain versions, with odd rows."""
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline  # noqa: F401 - its worker functions travel by value
from colloquy.llm import decontam, licenses, simhash, substring_dedup

DOCS = "doc_id long, text string, fp string, kept string"


def plain_repeats(rows, window):
    """doc_id -> (words, kept text) by a set of all windows seen before."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = (text or "").encode().split()
        gone = set()
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            if key in seen:
                gone.update(range(j, j + window))
            seen.add(key)
        out.append((doc, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters,window", [(2, 20), (3, 8), (40, 20), (1, 5)])
def test_repeats_equal_a_set_of_windows(spark, letters, window):
    rng = random.Random(letters)
    word = lambda: f"w{rng.randrange(letters)}é"
    shared = [word() for _ in range(60)]
    rows = [(None, "a b"), (7, None), (8, ""), (9, "  \t\n "), (10, "only three words"), (11, "x " * 300)]
    for i in range(20, 60):
        w = [word() for _ in range(rng.randrange(1, 90))]
        cut = rng.randrange(len(w))
        a = rng.randrange(40)
        rows.append((i, " ".join(w[:cut] + (shared[a:a + rng.randrange(60)] if i % 3 else []) + w[cut:])))
    rows += [rows[-1], (99, " ".join(["nbsp"] * 30)), (5, rows[-2][1])]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS).repartition(3)
    got = substring_dedup.remove_repeats(df, "doc_id", "text", window).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str) == plain_repeats(rows, window)
    for r in got:
        assert r.n_words - sum(s.end - s.first for s in r.removed) == len(r.kept.split(" ")) * bool(r.kept)


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0


def plain_fingerprint(text, n=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    s = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    names = list(root)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in names}


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab AB c d é ß".split()) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "Word"), (204, "WORD"), (205, "É"), (206, "é"), (rows[0][0], rows[0][1]), (None, "a b")]
    got = simhash.simhash_groups(spark.createDataFrame([(d, t, "f", "k") for d, t in rows], DOCS), "doc_id", "text")
    prints = defaultdict(list)
    for d, t in rows:
        prints[plain_fingerprint(t)].append(d)
    roots = plain_components(prints, 3)
    least = defaultdict(list)
    for p, ids in prints.items():
        least[roots[p]] += [i for i in ids if i is not None]
    want = sorted(((d, plain_fingerprint(t), min(least[roots[plain_fingerprint(t)]], default=None)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("small,deferred", [(8, 20_000), (2, 40), (8, 0)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, small, deferred):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "DEFERRED", deferred)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):  # chains of small steps around a centre, all in few keys
            base ^= sum(1 << b for b in rng.sample(range(32), rng.randrange(0, 4)))
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, p) for p in signed], "id long, fp long").repartition(5)
    roots = plain_components(prints, 3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 3).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    again = {p: p for p in prints}

    def find(x):
        while again[x] != x:
            x = again[x]
        return x
    for a, b in edges:
        again[find(a)] = find(b)
    groups = lambda d, f: {frozenset(v) for v in _by(d, f).values()}
    assert groups(prints, roots.get) == groups(prints, find)
    assert len(edges) < 20 * len(prints)


def _by(items, key):
    out = defaultdict(set)
    for i in items:
        out[key(i)].add(i)
    return out


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "the of and tion er ing st re on ha".split() for b in "th nd ou le at".split()]
    text = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(text)]
    edited = text[3].split()
    edited[60] = "changed"
    rows += [(100, text[0]), (101, text[0].upper()), (102, " ".join(edited)), (103, " ".join(rng.sample(text[4].split(), 120))),
             (104, None), (105, ""), (None, text[5]), (106, "tiny text"), (107, "Tiny text")]
    df = spark.createDataFrame([(d, t, "f", "k") for d, t in rows], DOCS)
    kept = {r.doc_id for r in simhash.without_near_duplicates(df, "doc_id", "text").collect()}
    assert kept == set(range(25)) | {103, 104, None, 106}
    assert simhash.without_near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_exact_repeats_go_too(spark):
    text, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    rows = [(1, text), (1, text), (1, text), (2, text), (3, other), (3, other), (4, None), (4, ""), (4, other + " end"), (None, text), (None, text)]
    df = spark.createDataFrame([(d, t, "g", "s") for d, t in rows], "doc_id long, text string, gone string, _same string").withColumn("same", F.lit("x"))
    kept = simhash.without_near_duplicates(df.repartition(5), "doc_id", "text")
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, (r.text or "")) for r in kept.collect())
    assert got == sorted([(0, text), (0, text), (1, text), (3, other), (4, ""), (4, other + " end")])


def test_near_duplicates_of_many_edited_copies(spark):
    """Copies that are nearer to the base text than to each other are all joined through it."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    zipf = [1 / (i + 1) for i in range(3000)]
    base = rng.choices(words, zipf, k=300)
    rows = [(1000, " ".join(base))]
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(5, 295), 6):
            w[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    shingles = {d: {tuple(t.split()[i:i + 5]) for i in range(296)} for d, t in rows}
    like = {d: len(s & shingles[1000]) / len(s | shingles[1000]) for d, s in shingles.items()}
    want = {d for d, x in like.items() if x >= 0.8}
    assert len(want) > 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.root for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert want - {min(want)} <= got.keys() and {got[d] for d in want - {min(want)}} == {min(want)}


@pytest.mark.parametrize("sides", [1, 2])
def test_a_run_is_joined_as_all_its_pairs_join_it(sides):
    rng = np.random.default_rng(14)
    for n in (1, 2, 60):
        sets = [np.unique(rng.choice(14, 11).astype(np.uint64)) for _ in range(n)]
        root, side = rng.integers(0, max(1, n // 2), n), np.arange(n) % sides
        keys = np.c_[np.arange(n), np.zeros(n, int), np.zeros(n, int)]
        found = simhash.joined(1, root, side, keys, sets)
        like = [(i, j) for i in range(n) for j in range(i) if simhash.similarity(sets[i], sets[j]) >= 0.8 and (side[i] != side[j] or len(set(side)) == 1)]
        assert all((max(p), min(p)) in like for p in found)
        groups = []
        for edges in (found, like):
            of = root.copy()
            for i, j in edges:
                of[of == of[i]] = of[j]
            groups.append({frozenset(np.flatnonzero(of == x)) for x in of})
        assert groups[0] == groups[1]
        assert simhash.joined(2, root, side, keys, sets) == []  # each pair in the run of its first common key only


@pytest.mark.parametrize("block", [2000, 3])
def test_near_duplicates_test_what_stars_leave_apart(spark, monkeypatch, block):
    """Chains of texts, each like the next only: their middle is no star."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    rows = []
    for c in range(4):
        w = [f"c{c}w{i}" for i in range(200)]
        for i in range(25):
            rows.append((rng.randrange(10**9), " ".join(w)))
            w[8 * i % 200:8 * i % 200 + 8] = [f"c{c}new{i}w{j}" for j in range(8)]
    ids = [d for d, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.root for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    for c in range(4):
        chain = ids[25 * c:25 * c + 25]
        assert {d: got.get(d, d) for d in chain} == {d: min(chain) for d in chain}


def test_near_duplicates_come_from_fingerprints_first(spark, monkeypatch):
    """Near-copies are found by their fingerprints alone, too; fingerprints that agree by chance join nothing."""
    rng = random.Random(17)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    # a line repeated so often that it outvotes all other shingles: equal fingerprints, few common five-word shingles
    loud = "one two three four five\n" * 300
    rows = [(1, base), (2, base + " end"), (3, base.upper()), (4, loud + " ".join(f"a{i}" for i in range(60))), (5, loud + " ".join(f"b{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.a, r.b) for r in simhash.print_links(df).collect()}
    assert (4, 5) in found and {1, 2, 3} <= {x for p in found for x in p}
    monkeypatch.setattr(simhash, "min_keys", lambda h: h[:0])  # the worker functions travel by value: no key at all
    assert {r.doc_id: r.root for r in simhash.near_duplicates(df, "doc_id", "text").collect()} == {2: 1, 3: 1}


@pytest.mark.parametrize("edits", [5, 6])
def test_near_duplicates_have_no_other_filter_than_their_shingles(spark, edits):
    """Pairs just over 0.8, of any number of words and any fingerprint."""
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(300):
        w = [f"{i}w{j}" for j in range(60 * edits)]
        rows.append((2 * i, " ".join(w)))
        for k in range(edits):
            w[30 + 55 * k] = f"{i}edit{k}"
        rows.append((2 * i + 1, " ".join(w)))
        want.add(2 * i + 1)
    passage = [" ".join(f"p{i}" for i in range(100))] * 3
    rows += [(5000, passage[0]), (5001, "\n".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.root for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert got == {d: d - 1 for d in want | {5001}}


def test_near_duplicates_of_long_texts_are_exact(spark):
    """Pairs a little over and a little under 0.8 of far more than 512 shingles."""
    rows, want = [], {}
    for i in range(120):
        w = [f"{i}w{j}" for j in range(3004)]
        rows.append((2 * i, " ".join(w)))
        changed = 330 if i % 2 else 337
        rows.append((2 * i + 1, " ".join([f"{i}new{j}" for j in range(changed)] + w[changed:])))
        if (3000 - changed) / (3000 + changed) >= 0.8:
            want[2 * i + 1] = 2 * i
    assert len(want) == 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.root for r in simhash.near_duplicates(df, "doc_id", "text").collect()} == want


def plain_score(item, text):
    """Smith-Waterman by the textbook."""
    a, b = [[w.lower().strip(".,") for w in x.split()] for x in (item, text)]
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[-1] - 1))
        row = new
        best = max(best, max(row))
    return best / (2 * len(a))


def test_leaks_equal_all_alignments(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 40)))) for i in range(12)] + [(50, "Short item."), (51, ""), (52, None)]
    items.append(items[0])
    docs = []
    for i in range(60):
        w = rng.choices(words, k=rng.randrange(0, 150))
        if i % 3 == 0:
            leak = items[i % 12][1].split()
            for _ in range(len(leak) * (i % 5) // 12):
                leak[rng.randrange(len(leak))] = "edited"
            if i % 2:
                leak.insert(len(leak) // 2, "inserted")
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in leak]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a Short, item"), (None, items[1][1]), (103, f"{items[2][1]} and {'x ' * 60} {items[2][1]}")]
    df = spark.createDataFrame([(d, t, "f", "k") for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(df, "doc_id", "text", bench, "item_id", "text").collect()
    best = {}
    for r in got:
        best[r.doc_id, r.item_id] = max(r.score, best.get((r.doc_id, r.item_id), 0))
    want = {}
    for d, t in docs:
        for i, x in set(items):
            if t and x and x.split():
                s = plain_score(x, t)
                if s >= (0.5 if len(x.split()) >= 8 else 1):
                    want[d, i] = s
    assert best.keys() == want.keys() and all(best[k] == pytest.approx(want[k]) for k in want)
    assert sum(r.doc_id == 103 for r in got) == 2
    clean = decontam.without_leaks(df, "text", bench, "item_id", "text").collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in want}
    assert clean[0].fp == "f"
    assert decontam.find_leaks(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert decontam.find_leaks(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_leaks_of_edited_copies_that_are_alone(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(24))) for i in range(4)]
    edited = [(i, " ".join("changed" if j in (3, 7, 11, 15, 19) else w for j, w in enumerate(t.split()))) for i, t in items]
    docs = spark.createDataFrame([*edited, (9, "i0w0 i0w1 i0w2 and no more")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, "doc_id", "text", bench, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in found) == [(i, i, pytest.approx(33 / 48)) for i in range(4)]
    assert [r.doc_id for r in decontam.without_leaks(docs, "text", bench, "item_id", "text").collect()] == [9]


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 25)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(10))) for i in range(6)]
    docs = spark.createDataFrame([(i, "before " + t) for i, t in items], "doc_id long, text string")
    found = decontam.find_leaks(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first, r.end) for r in found) == [(i, i, 1.0, 1, 11) for i in range(6)]


def test_licences(spark):
    prose = "Some prose about nothing in particular. " * 9
    rows = [("a/LICENSE", licenses.TEMPLATES[1][1]), ("a/x/one", prose), ("a/x/two", prose + "\nLicensed under the Apache License, Version 2.0.\n" + prose),
            ("a/x/deep/three", None), ("b/four", prose), ("a/x/deep/GPL", "This work is licensed under the GNU General Public License, version 3."),
            ("a/x/deep/er/five", ""), ("five", "a license of another kind"), (None, prose), ("a/x/one", prose), ("b/six", "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(p, t, "z", "y") for p, t in rows], "path string, text string, license string, origin string")
    got = sorted(((r.path, r.license, r.origin, r.licensed_by) for r in licenses.license_scan(df, "path", "text").collect()), key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "file", "a/LICENSE"), ("a/x/one", "MIT", "inherited", "a/LICENSE"), ("a/x/one", "MIT", "inherited", "a/LICENSE"),
        ("a/x/two", "Apache-2.0", "header", "a/x/two"), ("a/x/deep/three", "GPL-3.0", "inherited", "a/x/deep/GPL"),
        ("a/x/deep/GPL", "GPL-3.0", "file", "a/x/deep/GPL"), ("a/x/deep/er/five", "GPL-3.0", "inherited", "a/x/deep/GPL"),
        ("five", None, None, None), ("", None, None, None), ("b/four", "CC-BY-NC-4.0", "inherited", "b/six"), ("b/six", "CC-BY-NC-4.0", "file", "b/six")], key=str)
    assert licenses.license_scan(df.limit(0), "path", "text").count() == 0


def test_fingerprint_counts_long_texts_in_parts(monkeypatch):
    words = [f"w{i % 97}".encode() for i in range(500)]
    whole = simhash.fingerprint(words, 3)
    monkeypatch.setattr(simhash, "COUNTED", 64)
    assert simhash.fingerprint(words, 3) == whole == plain_fingerprint(" ".join(f"w{i % 97}" for i in range(500)))
    assert np.bitwise_count(np.uint64(whole)) > 0
