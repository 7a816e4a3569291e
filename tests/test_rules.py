"""Hand-computed and property tests of scoring, thresholds, packing, policy and noise."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import probs as P, text as T
from colloquy.operators import bootstrap as B, grids as G, noise as N, packing as PK, policy as PO, scoring as S


def preds(spark, rows, model="m"):
    return spark.createDataFrame([(model, "d", str(i), [float(x) for x in z], y, bool(i % 2)) for i, (z, y) in enumerate(rows)],
                                 "model string, decision string, id string, logits array<double>, y int, hard boolean")


def test_scores_by_hand(spark):
    # softmax of log-probabilities gives them back
    rows = [(np.log([.9, .1]), 0), (np.log([.2, .8]), 0), (np.log([.5, .5]), 1), (np.log([.3, .7]), 1)]
    t = S.score_table(S.score_rows(preds(spark, rows)), 2).first()
    assert t.n == 4 and t.accuracy == 0.5
    assert math.isclose(t.brier, (0.02 + 1.28 + 0.5 + 0.18) / 4)
    assert math.isclose(t.macro_f1, (2 / 4 + 2 / 4) / 2)
    assert math.isclose(t.mean_confidence, 2.9 / 4)
    assert t.hard_n == 2 and t.hard_accuracy == 0.5
    th = S.score_table(S.score_rows(preds(spark, rows), theta=0.75), 2).first()
    assert th.accuracy == 0.25 and math.isclose(th.ece, t.ece)


def test_confidence_on_an_edge_belongs_to_the_lower_bin(spark):
    edges = S.bin_edges(15)
    d = spark.createDataFrame([(e,) for e in edges] + [(math.nextafter(edges[3], 1),)], "c double")
    got = [r.b for r in d.select(S.bin_index(F.col("c"), 15).alias("b")).collect()]
    assert got == [0, *range(15), 3]


def test_every_grid_point_is_its_own_bucket(spark):
    grid = [round(i * 0.005, 3) for i in range(201)]
    d = spark.createDataFrame([(g, math.nextafter(g, 0)) for g in grid], "p double, q double")
    got = d.select(G.bucket(F.col("p")).alias("a"), G.bucket(F.col("q")).alias("b")).collect()
    assert [r.a for r in got] == list(range(201))
    assert [r.b for r in got[1:]] == list(range(200))


def test_curves_are_monotone_and_p_equal_theta_counts(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([("d", rng.choice([.5, .505, rng.random()]), rng.randrange(2)) for _ in range(400)], "decision string, p double, y int")
    c = {r.i: r for r in G.threshold_counts(d).collect()}
    assert all(c[i].tp >= c[i + 1].tp and c[i].fp >= c[i + 1].fp for i in range(200))
    ps = [(r.p, r.y) for r in d.collect()]
    assert c[100].tp == sum(p >= 0.5 and y for p, y in ps)
    pick = G.choose_threshold_f1(d).first()

    def f1(t):
        out = []
        for k in (0, 1):
            tp = sum((p >= t) == bool(k) and y == k for p, y in ps)
            fp = sum((p >= t) == bool(k) and y != k for p, y in ps)
            fn = sum((p >= t) != bool(k) and y == k for p, y in ps)
            if tp + fp + fn:
                out.append(2 * tp / (2 * tp + fp + fn))
        return sum(out) / len(out)

    scores = [f1(i * 5 / 1000) for i in range(201)]
    tied = [i for i, s in enumerate(scores) if s >= max(scores) - 1e-12]
    assert (pick.theta, pick.tied) == (tied[(len(tied) - 1) // 2] * 5 / 1000, len(tied))


def test_operating_point_infeasible(spark):
    c = spark.createDataFrame([("s", i, i / 2, .9 - i / 10) for i in range(3)], "split string, i int, theta double, rate double")
    bad = G.choose_operating_point(c, "rate", 0.1).first()
    assert not bad.feasible and bad.theta == 1.0
    ok = G.choose_operating_point(c, "rate", 0.85).first()
    assert ok.feasible and ok.theta == 0.5


def test_temperature_recovered_and_bound_flagged(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    f = S.fit_temperature(preds(spark, [(2.0 * a, b) for a, b in zip(z, y)])).first()
    assert abs(f.temperature - 2.0) < 0.12 and not f.at_bound and f.nll_after <= f.nll_before

    def nll(t):
        s = 2.0 * z / t
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    assert nll(f.temperature) <= min(nll(f.temperature * 1.0001), nll(f.temperature / 1.0001)) + 1e-12
    sep = S.fit_temperature(preds(spark, [([5.0, 0.0], 0), ([0.0, 5.0], 1)] * 5)).first()
    assert sep.at_bound and abs(sep.temperature - 0.25) < 1e-6


def test_bootstrap_is_partition_free_paired_and_near_wilson(spark):
    rng = random.Random(1)
    rows = S.score_rows(preds(spark, [([rng.random(), rng.random()], rng.randrange(2)) for _ in range(1500)]))
    a = {r.b: r.accuracy for r in B.replicates(rows.repartition(1), 300, 7, 2).collect()}
    b = {r.b: r.accuracy for r in B.replicates(rows.repartition(13), 300, 7, 2).collect()}
    assert a == pytest.approx(b) and len(a) == 300
    t = S.score_table(rows, 2).first()
    lo, hi = np.quantile(list(a.values()), [.025, .975])
    assert abs(lo - t.acc_lo) < .01 and abs(hi - t.acc_hi) < .01
    w = B.poisson_weights(np.arange(20_000, dtype=np.uint64), 0, 4)
    assert abs(w.mean() - 1) < .02 and abs(w.var() - 1) < .05
    twin = rows.unionByName(rows.withColumn("model", F.lit("n")))
    reps = B.replicates(twin, 50, 7, 2)
    pts = S.score_table(twin, 2).select("model", "decision", *B.METRICS)
    d = B.paired_differences(reps, pts, spark.createDataFrame([("d", "m", "n")], "decision string, a string, b string")).collect()
    assert all(r.difference == 0 and r.lo == 0 and r.hi == 0 for r in d)


def pack_by_rows(user, agent, turns, speaking, budget):
    import json

    def size(t, a, u):
        return len(json.dumps({"agent_speaking": speaking, "recent_turns": t, "agent_last_utterance": a, "user_partial": u}, ensure_ascii=False))

    k = max(k for k in range(len(user) + 1) if size([], "", " ".join(user[len(user) - k:])) <= budget)
    u, whole = " ".join(user[len(user) - k:]), k == len(user)
    j = max(j for j in range(len(agent) + 1) if size([], " ".join(agent[len(agent) - j:]), u) <= budget) if whole else 0
    a = " ".join(agent[len(agent) - j:])
    pool = turns if whole and j == len(agent) else []
    m = max(m for m in range(len(pool) + 1) if size(pool[len(pool) - m:], a, u) <= budget)
    return size(pool[len(pool) - m:], a, u), m, len(turns) - m, len(agent) - j, len(user) - k


@pytest.mark.parametrize("budget", [95, 130, 180, 260, 1000])
def test_packer_equals_row_packer(spark, budget):
    rng = random.Random(budget)

    def say(n):
        return [rng.choice(["a", "yes", "because", "don't", "über"]) for _ in range(rng.randrange(n))]

    data = [(str(i), rng.random() < .5, say(25), say(20), [(rng.choice(["user", "agent"]), " ".join(say(8))) for _ in range(rng.randrange(6))]) for i in range(120)]
    d = spark.createDataFrame([(i, s, " ".join(u), " ".join(a), t) for i, s, u, a, t in data],
                              "id string, agent_speaking boolean, user_partial string, agent_last string, recent_turns array<struct<speaker:string,text:string>>")
    cols = ("size", "turns_kept", "turns_dropped", "agent_words_dropped", "user_words_dropped")
    want = {i: pack_by_rows(u, a, [{"speaker": w, "text": x} for w, x in t if x], s, budget) for i, s, u, a, t in data}
    got = {r.id: tuple(r[c] for c in cols) for r in PK.pack_chars(d, budget).collect()}
    assert got == want
    by_counter = {r.id: tuple(r[c] for c in cols) for r in PK.pack_with_counter(d, budget, len).collect()}
    assert by_counter == want
    with pytest.raises(ValueError):
        PK.pack_chars(d, 50)


def test_policy_texts_and_refusals(spark):
    d = spark.createDataFrame([(.8, [.2, .3, .5], .6), (.1, [.5, .4, .1], .6)], "pc double, pr array<double>, pe double")
    labels = ("transfer", "balance", "out_of_scope")

    def at(ms):
        return [r.d for r in d.select(PO.pause_policy(F.col("pc"), F.col("pr"), F.col("pe"), F.lit(ms), labels).alias("d")).collect()]

    a, b = at(300.0)
    assert (a.action, a.route, a.escalate) == ("respond", "out_of_scope", True)
    assert a.reason == "turn_complete 0.80 >= 0.785; escalate 0.60 >= 0.505, passed on"
    assert (b.action, b.route, b.escalate) == ("keep_listening", None, False)
    assert b.reason == "turn_complete 0.10 < 0.785, silence 300 ms < 2000 ms"
    assert at(2000.0)[1].action == "respond_after_timeout" and at(2000.0)[1].route == "transfer"
    bad = d.withColumn("pe", F.lit(float("nan")))
    with pytest.raises(Exception, match="must be a probability"):
        bad.select(PO.pause_policy(F.col("pc"), F.col("pr"), F.col("pe"), F.lit(1.0), labels)).collect()
    x = spark.createDataFrame([([.5, .05, .45], .1), ([.3, .05, .65], .1), ([.5, .09, .41], .1), ([1.0, 0.0, 0.0], .505)], "p array<double>, e double")
    acts = [r.d.action for r in x.select(PO.barge_policy(F.col("p"), F.col("e")).alias("d")).collect()]
    assert acts == ["keep_talking", "ignore", "stop_and_listen", "stop_and_listen"]


def test_noise_tracks_its_level(spark):
    text = " ".join(f"w{i}" for i in range(400))
    d = spark.createDataFrame([(str(i), text) for i in range(20)], "id string, t string")
    vocab = F.array(*[F.lit(f"v{i}") for i in range(50)])
    for level in (0.0, 0.1, 0.2):
        out = [r.n.split() for r in d.select(N.asr_noise(F.col("t"), F.col("id"), F.lit(level), vocab, 1, "user").alias("n")).collect()]
        kept = sum(w.startswith("w") for ws in out for w in ws) / 8000
        assert abs(kept - (1 - level)) < 0.02
        swapped = sum(w.startswith("v") for ws in out for w in ws) / 8000
        assert abs(swapped - level / 2) < 0.02


def test_stated_probabilities(spark):
    rows = ['{"true": 3, "false": 1}', '{"true": -1}', '{"true": "x", "false": 2}', 'not json', '{}']
    d = spark.createDataFrame([(r,) for r in rows], "a string")
    p, ok = P.stated_probs(F.col("a"), ("false", "true"))
    got = [(list(r.p), r.ok) for r in d.select(p.alias("p"), ok.alias("ok")).collect()]
    assert got == [([.25, .75], True), ([.5, .5], False), ([1.0, 0.0], True), ([.5, .5], False), ([.5, .5], False)]


def test_entities_are_undone_once(spark):
    rows = [("a &amp;lt;b&amp;gt; &lt;c&gt;", "a &lt;b&gt; <c>"), ("caf&eacute; &#8217;x&#x27;", "café ’x'"), ("no entity & none", "no entity & none"), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    got = [r.c for r in df.select(T.clean_message(F.col("t"), F.lit(False)).alias("c")).collect()]
    assert got == [b for _, b in rows]


def test_long_numbers_stay_whole(spark):
    df = spark.createDataFrame([(7,), (12345,), (123451,), (123459,), (1234567890123,)], "n long")
    assert [r.p for r in df.select(T.padded(F.col("n"), 5).alias("p")).collect()] == ["00007", "12345", "123451", "123459", "1234567890123"]


def test_last_label_does_not_depend_on_order(spark):
    from colloquy.operators import sampling as S

    rows = [("a", "true", 5, 1), ("a", "false", 5, 2), ("b", "false", 5, None), ("b", "true", 5, None), ("c", "true", 1, 9), ("c", "false", 2, 1)]
    want = {"a": "false", "b": "true", "c": "false"}
    for parts in (1, 17):
        for data in (rows, rows[::-1]):
            df = spark.createDataFrame(data, "id string, label string, at long, seq long").repartition(parts)
            assert {r.id: r.label for r in S.latest_label(df).collect()} == want


def test_pauses_wait_for_the_latest_end(spark):
    from colloquy.streaming import streams as W

    df = spark.createDataFrame([(1, 0, 5000), (1, 100, 200), (1, 6000, 6100), (1, 100, 200)], "call_id long, start_ms long, end_ms long")
    for width in (50, 100_000):
        got = sorted((r.kind, r.end_ms, r.silence_ms) for r in W.pauses_batch(df, width).collect())
        assert got == [("max_wait", 6100, 2000), ("user_pause", 5000, 300), ("user_pause", 6100, 300)]


def test_every_event_is_a_line(spark):
    from colloquy.sources import driver_tables as D

    sf = "/root/testdata/sf0.1"
    seg = D.segments(spark, sf)
    assert seg.count() == D.table(spark, sf, "events").count()
    g = seg.groupBy("call_id").agg(F.count("seg").alias("n"), F.count_distinct("seg").alias("d"), F.max("seg").alias("m"))
    assert g.where("n <> d OR m <> n - 1").isEmpty()


def test_deep_threads_and_cycles(spark):
    from colloquy.operators import threads as TH

    n = 50_000
    chain = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    ring = spark.range(n, n + 3).selectExpr("id", f"{n} + (id - {n} + 1) % 3 AS parent_id")
    roots = TH.thread_roots(chain.unionAll(ring))
    assert roots.where(f"id < {n} AND root = 0").count() == n and roots.where(f"id >= {n} AND root IS NULL").count() == 3


def test_any_text_is_made_nfkc(spark):
    rows = ["ﬁne ½", "cafe\u0301", "\U0001D400b", "plain text", "Ｆｕｌｌ", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r.n for r in df.select(T.normalize_any(F.col("t")).alias("n")).collect()]
    assert got == ["fine 1 2", "café", "ab", "plain text", "full", None]
    from colloquy.operators import noise, sampling

    both = spark.createDataFrame([("1", "train", "ﬁne cafe\u0301"), ("2", "test", "FINE café"), ("3", "test", "other")], "id string, split string, text string")
    assert {r.id for r in sampling.dedupe_against_train(both).collect()} == {"1", "3"}
    assert {r.word: r.n for r in noise.top_vocab(both, 9).collect()} == {"fine": 2, "café": 2, "other": 1}


def test_text_features_compute_their_text_once(spark):
    """A costly text under the n-grams and the normalisation is not computed again wherever it is named."""
    text = F.regexp_replace("t", "costly", "x")
    d = spark.createDataFrame([("it's costly 'so' costly", "a b"), ("", ""), ("one", "c")], "t string, c string")
    got = d.select(T.ngram_features(T.normalize_text(text), F.col("c")).alias("f"))
    assert [r.f for r in got.collect()] == [["it's", "x", "so", "x", "it's x", "x so", "so x", "ctx:a", "ctx:b"], [], ["one", "ctx:c"]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("costly") == 1


def test_character_classes_are_judged_in_one_pass(spark):
    """Whether a text needs mapping is one pass over it, however long it is; a single such character anywhere still counts."""
    import unicodedata

    long = "Grün, Été: plain words. " * 100_000
    texts = ["", None, "plain", long, long + "ﬁ", "ﬁ" + long, "it`s", long + "it’s", "a\nb\u0085ﬁ c", "x 𝔘\n", "½", "don“t”", "tail\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in d.select("i", T.nfkc(F.col("t")).alias("k"), T.normalize_any(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i].k == (None if t is None else unicodedata.normalize("NFKC", t))
    assert got[6].n == "it's" and got[7].n.endswith("words it's") and got[8].n == "a b fi c" and got[4].n.endswith(" words fi")
    plan = d.select(T.normalize_any(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and all(part.split(", ", 1)[1].startswith("\\A[") for part in plan.split("RLIKE(")[1:])
