"""Sequence operators on one key that holds most rows, against plain loops, with the size of the largest piece of work."""
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import calls as C, floor as FL, scoring as S, threads as TH


@pytest.mark.parametrize("fan", [2, 256])
def test_fold_of_a_hot_line(spark, monkeypatch, fan):
    monkeypatch.setattr(C, "FOLD_FAN", fan)
    rng = random.Random(fan)
    rows = []
    for line, n in ((0, 1500), (4, 40), (5, 1)):
        end = n * 300 + 5000
        for seg in range(n):
            onset = rng.randrange(0, end)
            rows.append((1, seg + 10_000 * line, line, end, onset, rng.random() < 0.3, onset + rng.choice([1, 40, 700, 9000]) + 0.25))
    want = {}
    for line in (0, 4, 5):
        mine = sorted((r for r in rows if r[2] == line), key=lambda r: (r[4], r[1]))
        end, cut, met = float(mine[0][3]), False, []
        for _, seg, _, full, onset, stops, eff in mine:
            if onset < end:
                met.append(seg)
                if stops:
                    end, cut = min(eff, float(full)), True
        want[line] = (end, cut, met)
    over = spark.createDataFrame(rows, "call_id bigint, seg int, line int, line_end bigint, onset bigint, stops boolean, effective_ms double").repartition(7)
    folded = C.fold_onsets(over)
    got = {r.line: (r.spoken_end, r.was_cut) for r in C.cut_lines(folded).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    met = folded.select("line", F.explode("met").alias("seg")).groupBy("line").agg(F.sort_array(F.collect_list("seg")).alias("m")).collect()
    assert {r.line: r.m for r in met} == {k: sorted(v[2]) for k, v in want.items()}
    assert over.groupBy("line", F.floor(F.col("onset") / C.FOLD_MS)).count().agg(F.max("count")).first()[0] < len(rows) / 15


@pytest.mark.parametrize("width", [1, 3, 256])
def test_current_turn_of_a_hot_key(spark, width):
    rng = random.Random(width)
    rows = [("c" if i % 3 else f"c{i}", i, rng.choice([None, "A"]) if i > 300 else "A", -1 if i < 250 else 250, rng.choice(["", "x", "yes no"])) for i in range(400)]
    ann = spark.createDataFrame(rows, "conv_id string, idx bigint, caller string, anchor bigint, text string").repartition(5)
    got = {(r.conv_id, r.idx): (r.turn_text, r.turn_start) for r in FL.current_turn(ann, width).collect()}
    for conv, idx, caller, anchor, _ in rows:
        mine = [r for r in rows if r[0] == conv and r[2] == caller and r[3] == anchor and r[1] <= idx]
        assert got[conv, idx] == (" ".join(r[4] for r in mine if r[4]), mine[0][1])


def plain_snapshot(segs, ends, history, t, decided):
    """All speech so far, each agent word by its own end, each user segment as a whole."""
    parts = [(float("-inf"), k, 0, 0, who, x) for k, who, x in history]
    for i, who, at, dur, text in segs:
        words = text.split()
        if at >= t and i != decided:
            continue
        upto = min(t, at + dur, ends.get(i, float("inf")))
        n = 0 if upto <= at else min(len(words), int(len(words) * (upto - at) / dur + 1e-9))
        if who == "agent":
            parts += [(at + (k + 1) * dur / len(words), 0, i, k, "agent", w) for k, w in enumerate(words[:n])]
        else:
            said = words[:n] or (words[:1] if i == decided else [])
            parts += [(min(at + dur, t), 1, i, 0, "user", " ".join(said))] if said else []
    turns = []
    for *_, who, x in sorted(parts):
        if turns and turns[-1][0] == who:
            turns[-1][1] += " " + x
        else:
            turns.append([who, x])
    user = turns.pop()[1] if turns and turns[-1][0] == "user" else ""
    agent = turns.pop()[1] if turns and turns[-1][0] == "agent" else ""
    return user, agent, [tuple(x) for x in turns]


@pytest.mark.parametrize("with_history", [False, True])
def test_snapshots_equal_plain(spark, with_history):
    rng = random.Random(3)
    segs, points, lines, want, past = [], [], [], {}, []
    for call, n in ((1, 60), (2, 6), (3, 1)):
        at, mine, ends = 0, [], {}
        free = {"user": 0, "agent": 0}
        for i in range(n):
            who = rng.choice(["user", "agent"])
            at = max(at + rng.randrange(0, 900), free[who])
            dur = rng.choice([400, 1000, 2500, 4000])
            free[who] = at + dur
            mine.append((i, who, at, dur, " ".join(f"{who[0]}{i}w{k}" for k in range(rng.randrange(1, 9)))))
            if who == "agent":
                ends[i] = float(at + dur) if rng.random() < 0.6 else at + dur * rng.choice([0.25, 0.5, 0.6])
        history = [(k, who, f"before {call} {k}") for k, who in enumerate(["agent", "user", "user"][:call])] if with_history else []
        past += [(call, *h) for h in history]
        segs += [(call, i, who, at, dur, at + dur, text) for i, who, at, dur, text in mine]
        lines += [(call, i, at, ends[i], False) for i, who, at, dur, _ in mine if who == "agent"]
        for i, who, at, dur, _ in mine:
            if who == "user":
                for event, t in ((C.OVER, float(min(at + dur, at + 600))), (C.PAUSE, at + dur + 300.0)):
                    points.append((call, i, event, t))
                    want[call, i, event] = plain_snapshot(mine, ends, history, t, i if event == C.OVER else None)
    seg = spark.createDataFrame(segs, "call_id bigint, seg int, who string, at_ms bigint, dur_ms bigint, end_ms bigint, text string").repartition(5)
    spoken = spark.createDataFrame(lines, "call_id bigint, line int, line_at bigint, line_end double, was_cut boolean")
    p = spark.createDataFrame(points, "call_id bigint, seg int, event string, t double")
    history = spark.createDataFrame(past, "call_id bigint, k int, speaker string, text string") if with_history else None
    got = {(r.call_id, r.seg, r.event): (r.user_partial, r.agent_last, [tuple(x) for x in r.recent_turns]) for r in C.snapshot_at(p, seg, spoken, history).collect()}
    assert got == want


def test_whole_calls_are_joined_last(spark):
    """A point is joined to its call's turns by the call alone, and after that to nothing, so rows with whole calls are not sent on."""
    seg = spark.createDataFrame([(1, 0, "user", 0, 400, 400, "one two"), (1, 1, "agent", 500, 300, 800, "three")],
                                "call_id bigint, seg int, who string, at_ms bigint, dur_ms bigint, end_ms bigint, text string")
    lines = spark.createDataFrame([(1, 1, 500, 800.0, False)], "call_id bigint, line int, line_at bigint, line_end double, was_cut boolean")
    points = spark.createDataFrame([(1, 0, C.PAUSE, 700.0)], "call_id bigint, seg int, event string, t double")
    plan = C.snapshot_at(points, seg, lines)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join " in line)
    assert "call_id" in top and "event" not in top and "seg" not in top, top


def test_ancestors_by_jumps(spark):
    rng = random.Random(9)
    parent = {i: rng.randrange(max(0, i - 3), i) for i in range(1, 300)} | {301: 302, 302: 301}
    rows = [(i, parent.get(i)) for i in range(303) if i != 300]
    table = spark.createDataFrame(rows, "id bigint, parent_id bigint")
    for depth in (1, 5, 32):
        got = {(r.cid, r.d): r.node for r in TH.ancestors(table.select("id"), table, depth).collect()}
        want = {}
        for i, _ in rows:
            at = i
            for d in range(1, depth + 1):
                at = parent.get(at)
                if at is None:
                    break
                want[i, d] = at
        assert got == want


def test_a_block_of_candidates_shares_its_texts(spark):
    """Contexts of chains, a wide fan and lone messages equal a plain loop; a text goes to a block, not to each of its candidates."""
    rng = random.Random(4)
    parent = {i: i - 1 for i in range(1, 400)} | {i: 17 for i in range(400, 800)} | {i: rng.randrange(400, i) for i in range(801, 1000)}
    inbound = {i: rng.random() < 0.7 for i in range(1003)}
    text = {i: rng.choice(["", "one", f"m{i}", f"two words{i}"]) for i in inbound}
    m = spark.createDataFrame([(i, inbound[i], text[i], parent.get(i)) for i in inbound], "id bigint, inbound boolean, text string, parent_id bigint")
    cands = m.where("inbound").select("id", F.lit(1).alias("more"))
    pairs = 0
    want = {}
    for i in (i for i in inbound if inbound[i]):
        turns, at, path = [], i, []
        while len(path) < 32 and parent.get(at) is not None:
            at = parent[at]
            path.append(at)
        pairs += len(path)
        for at in reversed(path):
            if text[at]:
                who = "user" if inbound[at] else "agent"
                if turns and turns[-1][0] == who:
                    turns[-1] = (who, turns[-1][1] + " " + text[at])
                else:
                    turns.append((who, text[at]))
        last = turns.pop()[1] if turns and turns[-1][0] == "agent" else ""
        want[i] = (1, last, turns[-8:])
    got = {r.id: (r.more, r.agent_last, [tuple(x) for x in r.recent_turns]) for r in TH.ancestor_context(cands, m, 32, 8).collect()}
    assert got == want
    sent = TH.path_blocks(cands, TH.known_parents(m), 32).select("_block", F.explode("_path")).distinct().count()
    assert sent * 4 < pairs, (sent, pairs)


def test_rows_without_context_do_not_come_first(spark):
    """A writer that judges the rows to come by a task's first 100 sees contexts among them, whichever join sends the texts."""
    m = spark.createDataFrame([(i, True, "some words " * 20, i - 1 if i % 40 >= 8 else None) for i in range(4000)], "id bigint, inbound boolean, text string, parent_id bigint")
    try:
        for limit in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            rows = TH.ancestor_context(m.select("id"), m, 32, 8).select(F.spark_partition_id().alias("part"), F.size("recent_turns").alias("n")).collect()
            some = [p for p in {r.part for r in rows} if any(r.n for r in rows if r.part == p)]
            for p in some:
                first = [r.n for r in rows if r.part == p][:100]
                assert sum(map(bool, first)) >= 20, (limit, p, first)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_newton_finds_the_minimum(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for scale in (0.05, 0.3, 1.0, 6.0):
        z = rng.normal(size=(300, 4)) * 3
        p = np.exp(z * scale) / np.exp(z * scale).sum(1, keepdims=True)
        y = [int(rng.choice(4, p=q)) for q in p]
        df = spark.createDataFrame([("m", "d", str(i), [float(v) for v in a], b) for i, (a, b) in enumerate(zip(z, y))], "model string, decision string, id string, logits array<double>, y int")

        def nll(u):
            s = z * np.exp(u)
            top = s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(300), y]))

        lo, hi = np.log(1 / 10), np.log(1 / 0.1)
        for _ in range(300):  # the interval shrinks by thirds
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if nll(a) < nll(b) else (a, hi)
        f = S.fit_temperature(df, bounds=(0.1, 10.0)).first()
        assert abs(np.log(f.temperature) + (lo + hi) / 2) < 1e-6 and abs(f.nll_after - nll(-np.log(f.temperature))) < 1e-12
