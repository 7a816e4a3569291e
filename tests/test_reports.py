"""Report layouts, served thresholds and the guard of saved results on small fixtures."""
import pytest

from colloquy.operators import calls as O, grids as G, report as R, scoring as M


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_cells(spark):
    d = spark.sql("SELECT * FROM VALUES (0.0125D, -0.02D, 0.03D), (NULL, NULL, NULL), (-0.0004D, 0.0D, 1.0D) AS t(x, lo, hi)")
    c = d.select(R.signed_cell(d.x, d.lo, d.hi).alias("s"), R.pair_cell(d.x, d.hi).alias("p")).collect()
    assert [r.s for r in c] == ["+0.013 [-0.020, +0.030]", "n/a", "+0.000 [+0.000, +1.000]"]
    assert [r.p for r in c] == ["0.013 (0.030)", "n/a", "0.000 (1.000)"]
    half = spark.sql("SELECT 0.5D AS x, CAST(NULL AS DOUBLE) AS y")
    assert half.select(R.pair_cell(half.x, half.y)).first()[0] == "0.500 (n/a)"


def test_latency_table(spark):
    p = spark.createDataFrame([("a", "total_ms", 10.04, 20.0, 30.0), ("a", "forward_ms", 5.0, 6.0, 7.0), ("b", "total_ms", 60.0, 70.0, 120.0),
                               ("b", "pack_ms", 1.0, 1.0, 1.0)], "row string, component string, p50 double, p95 double, p99 double")
    v = spark.createDataFrame([("a", 50.0, True), ("b", 100.0, False)], "row string, budget_ms double, fits boolean")
    t = table(R.latency_table(p, v, spark.createDataFrame([("a",), ("b",), ("c",)], "row string")), "row")
    assert t["a"] == {"row": "a", "p50": "10.0", "p95": "20.0", "p99": "30.0", "forward": "5.0", "packing": "n/a", "budget": "yes (<= 50 ms)"}
    assert t["b"]["budget"] == "no (<= 100 ms)" and t["b"]["forward"] == "n/a" and t["b"]["packing"] == "1.0"
    assert set(t["c"].values()) == {"c", "TODO"}


def test_arms_table(spark):
    p = spark.createDataFrame([("a", "x", 10.0, 11.0), ("a", "y", 12.0, 13.0), ("b", "x", 1.0, 2.0)], "row string, arm string, p50 double, p99 double")
    s = spark.createDataFrame([("a", "x", 70.0, []), ("a", "y", 81.0, ["power", "heat"])], "row string, arm string, hottest double, throttled array<string>")
    t = table(R.arms_table(p, s, spark.createDataFrame([("a",), ("b",)], "row string"), "x", "y"), "row")
    assert t["a"] == {"row": "a", "x": "10.0 / 11.0", "y": "12.0 / 13.0", "change": "+20.0%", "hottest": "70 / 81", "throttled": "heat, power"}
    assert set(t["b"].values()) == {"b", "TODO"}  # one arm alone is no comparison


def test_paired_and_operating_tables(spark):
    d = spark.createDataFrame([("r", "m", "n", "f1", 0.1, 0.05, 0.15), ("r", "m", "n", "hard", None, None, None)],
                              "decision string, a string, b string, metric string, difference double, lo double, hi double")
    lay = spark.createDataFrame([("m", "n"), ("m", "o")], "a string, b string")
    t = table(R.paired_table(d, lay, [("r", "f1"), ("r", "hard")]), "b")
    assert t["n"]["r_f1"] == "+0.100 [+0.050, +0.150]" and t["n"]["r_hard"] == "n/a" and t["o"]["r_f1"] == "TODO"
    i = spark.createDataFrame([("m", 0.09, True, 0.04, None)], "model string, theta double, feasible boolean, false_stop double, missed double")
    y = spark.createDataFrame([("m", 1.0, False, 0.2, 850.4), ("n", 0.5, True, 0.1, 0.0)],
                              "model string, theta double, feasible boolean, premature double, added_delay_ms double")
    t = table(R.operating_table(i, y, spark.createDataFrame([("m",), ("n",), ("o",)], "model string")), "model")
    assert t["m"] == {"model": "m", "theta_interrupt": "0.090", "false_stop": "0.040", "missed": "n/a",
                      "theta_yield": "1.000 (target unreachable)", "premature": "0.200", "added_delay_ms": "850"}
    assert t["n"]["theta_interrupt"] == "TODO" and t["n"]["theta_yield"] == "0.500" and set(t["o"].values()) == {"o", "TODO"}


def parts(spark, rows):
    return spark.createDataFrame(rows, "name string, theta double, source string, checkpoint string, vad_pause_ms double, max_wait_ms double")


FOUR = [("theta_interrupt", 0.1, "i", "runs/x/", None, None), ("theta_yield", 0.2, "y", "runs\\x", 300.0, 2000.0),
        ("theta_escalate", 0.3, "e", "runs/x", None, None), ("theta_oos", 0.4, "o", "runs/x//", None, None)]


def test_served_policy(spark):
    got = G.served_policy(parts(spark, FOUR), 300, 2000).first()
    assert got.checkpoint == "runs/x" and got.thetas == {n: t for n, t, *_ in FOUR} and got.sources["theta_oos"] == "o"


@pytest.mark.parametrize("rows, wait, says", [
    (FOUR[:3], 2000, "no threshold named theta_oos"), (FOUR, 1500, "other timings"),
    (FOUR[:3] + [("theta_oos", 0.4, "o", "runs/y", None, None)], 2000, "different checkpoints: runs/x, runs/y"),
    (FOUR[:3] + [("theta_oos", 0.4, "o", None, None, None)], 2000, "different checkpoints"), ([], 2000, "no threshold named")])
def test_served_policy_fails(spark, rows, wait, says):
    with pytest.raises(Exception, match=says):
        G.served_policy(parts(spark, rows), 300, wait).collect()


def test_saved_guard(spark):
    form = "model string, decision string, acc double, confusion array<int>, fingerprint string"
    now = spark.createDataFrame([("a", "d", 0.5, [1, 2], "f"), ("b", "d", 0.5, [1, 2], "f"), ("c", "d", None, [1], "f"), ("e", "d", 0.1, [1], "f")], form)
    old = spark.createDataFrame([("a", "d", 0.5 + 1e-14, [1, 2], "f"), ("b", "d", 0.6, [2, 1], "g"), ("c", "d", None, [1], "f"), ("z", "d", None, None, None)], form)
    got = {tuple(r) for r in M.saved_guard(now, old, ["acc"], exact=["confusion", "fingerprint"]).collect()}
    everything = ("acc", "confusion", "fingerprint")
    assert got == {(m, "d", k) for m in ("b", "e", "z") for k in everything}


def test_timeline_in_time_order(spark):
    seg = spark.createDataFrame([(1, i, 100 * i, 100 * i + 90) for i in range(4)], "call_id long, seg long, at_ms long, end_ms long")
    acts = spark.createDataFrame([("n", 1, 2, O.PAUSE, "respond", "respond", None, None, True, 150.0), ("p", 1, 2, O.PAUSE, "keep_listening", "respond", None, None, False, 400.0),
                                  ("p", 1, 0, O.PAUSE, "respond", None, None, None, None, 300.0)],
                                 "agent string, call_id long, seg long, event string, action string, want string, want_route string, want_escalate boolean, ok boolean, decided_at_ms double")
    missed = spark.createDataFrame([("n", 1, 1, True, "stop_and_listen", False), ("p", 1, 1, True, "stop_and_listen", True)],
                                   "agent string, call_id long, seg long, over_agent boolean, want string, counts boolean")
    got = O.timeline_points(acts, missed, seg, ("n", "p")).orderBy("point").collect()
    assert [(r.point, r.seg, r.t_ms) for r in got] == [(1, 2, 150.0), (2, 1, 190.0), (3, 0, 300.0)]
    assert (got[0].n, got[0].p, got[0].n_ok, got[0].p_ok) == ("respond", "keep_listening", True, False)
    assert (got[1].n, got[1].n_missed, got[1].p_missed, got[1].want) == (None, False, True, "stop_and_listen")
    assert got[2].n is None and got[2].n_missed is None and got[2].p_ok is None


def test_replay_summary_counts_passes(spark):
    acts = spark.createDataFrame([("n", 1, True, None), ("p", 1, True, 4.0), ("p", 1, None, 8.0), ("p", 1, False, 0.0)], "agent string, call_id long, ok boolean, compute_ms double")
    missed = spark.createDataFrame([("n", 1, True)], "agent string, call_id long, counts boolean")
    expect = spark.createDataFrame([(i,) for i in range(7)], "seg int")
    got = table(O.replay_summary(acts, missed, expect.limit(0), expect), "agent")
    assert got["n"] == {"agent": "n", "ok": 1, "points": 2, "passes": 0, "compute_p50": None, "compute_max": None, "expected": 7, "divergences": 0}
    assert (got["p"]["passes"], got["p"]["compute_p50"], got["p"]["compute_max"], got["p"]["points"]) == (2, 6.0, 8.0, 2)
