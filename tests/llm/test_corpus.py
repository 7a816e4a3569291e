"""Importance resampling, the language model and collocation mining against plain versions, exact inverses and held-out rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations, importance, maxent

ODD = [(None, "the quick brown fox " * 6), (1, None), (2, ""), (3, " \n\t.,;"), (4, "Straße ÉTÉ x1 \x00 y-z_w"), (5, "the the the " * 9)]


def plain_resample(rows, target, lengths, buckets, least, percent):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), Counter(zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in lengths for i in range(len(words) - n + 1))

    scanned = [(i, *grams(x)) for i, x in rows]
    s, t = sum((g for _, _, g in scanned), Counter()), sum((grams(x)[1] for x in target), Counter())
    big_s, big_t = float(s.total() + buckets), float(t.total() + buckets)
    out = []
    for i, n, g in scanned:
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b, c in g.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, g.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    ranks = Counter()
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        ranks[r, k + 1] += 1
    return Counter((i, f, w, s) for i, n, f, w, s in out), ranks


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_equals_plain(spark, longest):
    rng = random.Random(7)
    word = lambda: rng.choice(["Alpha", "beta", "Größe", "x9", "the", "of", "ünd", "k" * 30])
    rows = ODD + [(i, rng.choice([" ", ", ", "\n--"]).join(word() for _ in range(rng.randrange(1, 90)))) for i in range(6, 150)]
    rows += [rows[20], rows[20], (20, rows[30][1])]
    target = ["The of the beta", None, "", "x9 x9 größe"]
    docs = spark.createDataFrame([(i, x, 0, 0, "s") for i, x in rows], "doc_id long, text string, weight int, rank int, doc string").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(docs, "doc_id", "text", bench, "text", range(1, longest + 1), 997, 10, 30).collect()
    all_rows, ranks = plain_resample(rows, target, range(1, longest + 1), 997, 10, 30)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == all_rows
    assert Counter(((r.doc_id, r.n_words, r.n_features, r.weight, r.score), r["rank"]) for r in got if r["rank"] is not None) == ranks


def test_overlapped_scan_gives_every_run():
    text = importance.collapsed(b"One, two--THREE  four ")
    assert text == b"one two three four"
    found = [m[0] for m in importance.ngram_pattern(2).finditer(text, overlapped=True)]
    assert found == [b"one two", b"two three", b"three four"]
    assert len(importance.ngram_buckets(b"", [importance.ngram_pattern(1)], 10)) == 0


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20)], "doc_id long, text string")
    assert importance.resample(none, "doc_id", "text", some, "text").count() == 0
    assert [r["rank"] for r in importance.resample(some, "doc_id", "text", none, "text", percent=100).orderBy("rank").collect()] == [1, 2]


def test_long_text_is_scanned_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000 + "end"), (2, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in importance.resample(docs, "doc_id", "text", docs.select(F.lit("end").alias("text")), "text").collect()}
    assert got == {1: 400_001, 2: 1}


# -- the language model ---------------------------------------------------------------------------

def lm_rows(rng, n=240):
    """Two word stocks that never meet in a text, so that the words before tell a lot."""
    stocks = [[f"{a}{k}" for k in range(60)] for a in ("ab", "yz")]
    rows = []
    for i in range(n):
        stock = stocks[rng.random() < 0.5]
        rows.append((i, " ".join(rng.choices(stock, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 60))).title()))
    return rows + [(None, "Ab1 ab2"), (7, "ab1 unknown\x1cword é É"), (501, None), (502, ""), (503, " \t\n"), (504, "w" * 70_000), rows[3], rows[3]]


LM = "doc_id long, text string, score double, slots string, block int"


def scored_by_maxent(spark, rows, left_out=1):
    df = spark.createDataFrame([(i, x, 0.0, "s", 1) for i, x in rows], LM).repartition(6)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == left_out
    return maxent.score_texts(df, "doc_id", "text", held).collect()


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores_equal_plain(spark):
    rows = lm_rows(random.Random(5))
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + [None]
    count = Counter(w for i, x in rows if not is_held(i) for w in split(x))
    n, v = count.total(), len(count)
    want = Counter((i, is_held(i), len(split(x)), sum(count[w] > 0 for w in split(x)), n,
                    round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(x)), 6)) for i, x in rows)
    got = scored_by_maxent(spark, rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_history_helps_held_out_texts(spark):
    got = scored_by_maxent(spark, lm_rows(random.Random(8), 2500))
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score > r.base_score for r in unseen) > 0.95 * len(unseen) > 250
    # which stock a text draws from is worth log10 2 = 0.3 a word at most; half of it is learned from 60,000 words
    assert sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen) > 0.15


def test_reruns_agree(spark):
    rows = lm_rows(random.Random(6), 60)
    a, b = (sorted((str(r.doc_id), r.score) for r in scored_by_maxent(spark, rows)) for _ in range(2))
    assert [x for x, _ in a] == [x for x, _ in b] and np.allclose([x for _, x in a], [x for _, x in b], atol=1e-9)


def random_model(rng):
    counts = maxent.Counts(1000, 900, 10, np.zeros(maxent.START), np.zeros(maxent.START), np.full(maxent.START, 0.5))
    counts.n[:200], counts.kinds[:200] = rng.integers(1, 9, 200), 1
    counts.n[maxent.HEAD:], counts.kinds[maxent.HEAD:] = 50, 20
    model = maxent.untrained(counts)
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32)
    return model, counts


def test_probabilities_sum_to_one():
    model, counts = random_model(np.random.default_rng(2))
    histories = [[5, 17, 3], [maxent.HEAD + 2, 0, 150]]
    outcomes = [c for c in range(maxent.START) if counts.n[c] > 0]
    for h in histories:
        p = [10 ** maxent.log10_given(model, np.array([*h, c]), np.arange(4))[3] for c in outcomes]
        assert abs(sum(p) - 1) < 1e-4
    d = counts.discount[maxent.HEAD]
    assert math.isclose(sum((2.5 - d) / 50 for _ in range(20)) + 20 * d / 50, 1)


def test_class_and_gradient_equal_plain_loops():
    rng = np.random.default_rng(3)
    model, _ = random_model(rng)
    codes = rng.integers(0, 200, 40)
    codes[::7] = maxent.HEAD + 3
    place = np.concatenate([np.arange(25), np.arange(15)])

    def loss(m):
        return -maxent.log10_given(m, codes, place).sum() * math.log(10)

    before, weights = loss(model), model.weights.copy()
    touched = np.zeros(2 * maxent.ROWS)
    rows = maxent.hashed(maxent.feature_rows(codes, place), 63)
    kind, _ = maxent.class_and_word(codes)
    p = maxent.softmax(model.classes, model.weights, rows)
    for t in range(40):  # plain loops over one token's features
        z = model.classes + sum(weights[rows[k, t]].astype(float) for k in range(len(rows)))
        assert np.allclose(p[t], np.exp(z) / np.exp(z).sum(), atol=1e-5)
    row, output = int(rows[0, 5]), 1
    g = sum((p[t, output] - (kind[t] == output)) * int((rows[:, t] == row).sum()) for t in range(40))
    model.weights = model.weights.astype(np.float64)
    eps = 1e-4
    model.weights[row, output] += eps
    up = loss(model)
    model.weights[row, output] -= 2 * eps
    assert abs((up - loss(model)) / (2 * eps) - g) < 1e-2
    model.weights = weights.copy()
    for _ in range(5):
        maxent.learn_from(model, touched, codes, place)
    assert loss(model) < before - 5 and touched.sum() == 5 * len(rows) * (40 + (codes < maxent.HEAD).sum())


def test_language_model_without_training_or_rows(spark):
    none = spark.createDataFrame([], LM)
    assert maxent.score_texts(none, "doc_id", "text", F.lit(False)).count() == 0
    got = maxent.score_texts(spark.createDataFrame([(1, "a b", 0.0, "", 1)], LM), "doc_id", "text", F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and math.isfinite(got[0].score)


# -- collocations ---------------------------------------------------------------------------------

@pytest.mark.parametrize("n,bits", [(2, 8), (3, 15), (4, 16), (5, 16), (5, 25), (2, 32), (5, 32), (4, 21)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * bits)
    packing = collocations.Packing(n, bits)
    top = min(1 << bits, 50)
    words = [rng.integers(0, top, 4000) for _ in range(n)]
    words[0][:20] = (1 << bits) - 1
    limbs = packing.pack(words)
    assert all((a == b).all() for a, b in zip(packing.unpack(packing.restore(packing.permute(limbs))), words))
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], 4000)
    want = Counter()
    for *gram, c in zip(*words, counts):
        want[tuple(map(int, gram))] += int(c)
    whole = collocations.Filter.of(packing, 0, packing.permute(limbs), counts)
    parts = [collocations.Filter.of(packing, 0, packing.permute([x[k::3] for x in limbs]), counts[k::3]) for k in range(3)]
    merged = collocations.Filter.merged([collocations.Filter.from_row(packing, 0, 0, p.to_row()) for p in parts])
    for f in (whole, merged):
        assert {g: int(c) for *g, c in zip(*f.grams(), f.counts) for g in [tuple(map(int, g))]} == want
    found = {}
    for segment, part in merged.split(3):
        back = collocations.Filter.from_row(packing, 3, segment, part.to_row())
        found |= {tuple(map(int, g)): int(c) for *g, c in zip(*back.grams(), back.counts)}
    assert found == want
    assert len(whole.to_row()["rest"]) < 8 * n * len(want) / 2


def plain_collocations(rows, longest, least, top):
    f, n = Counter(), Counter()
    for lang, x in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    found = {}
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in many.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(q != p and g == lang and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in many.items() if len(q) > len(p))
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, ps in found.items() for i, (s, a, p, left, right, total) in enumerate(sorted(ps)[:top]))


@pytest.mark.parametrize("grams", [2_000_000, 9_000])
def test_collocations_equal_plain(spark, monkeypatch, grams):
    monkeypatch.setattr(collocations, "FILTER_GRAMS", grams)
    monkeypatch.setattr(collocations, "MERGE_BITS", 2)
    rng = random.Random(4)
    stock = ["New", "york", "city", "of", "The", "é", "x y", "a" * 40, "rare%d"]
    rows = []
    for i in range(300):
        ws = [rng.choice(stock).replace("%d", str(rng.randrange(500))) for _ in range(rng.randrange(0, 40))]
        ws += rng.choice([[], ["united", "states", "of", "america"] * 2, ["ta"] * 6])
        rows.append((rng.choice([None, "und", "en", "en", "en", "fr"]), rng.choice([" ", " \t", ", ", "\n"]).join(ws) + rng.choice(["", ".", "?! end"])))
    rows += [("en", None), (None, ""), ("de", " .,\n"), ("en", "one two " * 30_000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], "lang string, text string, rank int, group string, a int").repartition(9)
    got = collocations.collocations(df, "lang", "text", least=8, top=40)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5, 8, 40)


def test_runs_with_rare_pairs_are_not_counted_longer(spark, monkeypatch):
    """All words are common, nearly all pairs are rare: of their longer runs next to nothing reaches a filter."""
    sent, made = Counter(), collocations.shard_filters

    def seen(*args, **named):
        filters = made(*args, **named)
        sent.update({r["size"]: r["n"] for r in filters.groupBy("size").agg(F.sum("n").alias("n")).collect()})
        return filters

    monkeypatch.setattr(collocations, "shard_filters", seen)
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b"]), " ".join(f"w{rng.randrange(300)}" for _ in range(2000))) for _ in range(30)]
    rows += [("a", "w1 w2 w3 w4. " * 20)]
    grams, _, _ = collocations.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), F.col("lang"), F.col("text"), 5, 20)
    assert grams.where("size(gram) = 4 AND f >= 20").count() == 1
    assert sent[2] > 20_000 and all(sent[k] < 6_000 for k in (3, 4, 5))


def test_sieve_holds_what_was_put_in(spark):
    pairs = [(g, [a, b]) for g in ("a", "ü") for a in range(60) for b in range(a % 7)]
    sieve = collocations.Sieve.of(spark.createDataFrame(pairs, "group string, gram array<long>").repartition(5))
    for g in ("a", "ü"):
        a, b = (np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60))
        held = sieve.holds(g, a, b)
        assert held[b < a % 7].all() and held.sum() < 1.2 * (b < a % 7).sum()


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none, "lang", "text").count() == 0
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(few, "lang", "text").count() == 0


def test_maxent_row_sums_by_every_path():
    """Rows met once, a few times, often and most often are summed alike; logits out of range are shifted, others not."""
    rng = np.random.default_rng(2)
    size = 3 * maxent.OFTEN
    rows = np.concatenate([np.full(2 * maxent.OFTEN, 7), rng.integers(8, 40, maxent.OFTEN // 2), rng.integers(100, 400, maxent.OFTEN // 2)])
    rows = np.stack([rows, rng.integers(1000, 2 * maxent.ROWS, size), rng.permutation(rows)])
    gradient = rng.normal(size=(size, maxent.WIDTH)).astype(np.float32)
    want, met = np.zeros((2 * maxent.ROWS, maxent.WIDTH)), np.bincount(rows.ravel(), minlength=2 * maxent.ROWS)
    for r in rows:
        np.add.at(want, r, gradient)
    found, sums, n = maxent.row_sums(rows, gradient)
    assert n.min() == 1 and n.max() > maxent.OFTEN and ((n > maxent.FEW) & (n <= maxent.OFTEN)).any() and ((n > 1) & (n <= maxent.FEW)).any()
    assert (found == np.flatnonzero(met)).all() and (n == met[found]).all() and np.allclose(sums, want[found], atol=1e-3)
    bias = np.zeros((4, maxent.WIDTH), np.float32)
    bias[1] = -300
    bias[2, 0], bias[3, 5:] = 300, -1e4
    for part in (bias, bias[[0, 3]], bias[[0, 1]]):
        z, s = maxent.exponents(part, np.zeros((1, maxent.WIDTH), np.float32), np.zeros((3, len(part)), np.int64))
        exact = np.exp(part.astype(float) - part.max(axis=1, keepdims=True))
        assert np.isfinite(s).all() and np.allclose(z / s[:, None], exact / exact.sum(axis=1, keepdims=True), atol=1e-6)
