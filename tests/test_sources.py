"""Readers, lifecycle and thread rules on small invented files."""
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import text as T
from colloquy.operators import floor as O, lifecycle as L, sampling as S, threads as TH
from colloquy.operators.scale import written
from colloquy.sources import readers as R

HEAD = ("swda_filename,ptb_basename,conversation_no,transcript_index,act_tag,caller,utterance_index,"
        "subutterance_index,text,pos,trees,ptb_treenumbers\n")


def transcript(path, rows):
    body = "".join(f'f,p,77,{i},{tag},{who},1,1,"{text}",,,\n' for i, (tag, who, text) in enumerate(rows))
    path.write_text(HEAD + body)


@pytest.fixture(scope="module")
def conv(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("tr") / "c.utt.csv"
    transcript(p, [
        ("sd", "A", "{D Well, } we moved to Oslo last spring. /"),        # 0 complete (B claims next)
        ("qy", "B", "Do you like it there? /"),                           # 1 complete
        ("sd", "A", "I like it, but the [ win-, + winters ] are"),        # 2 continuation
        ("b", "B", "Uh-huh. /"),                                          # 3 backchannel
        ("+", "A", "very dark. /"),                                       # 4 closed, then only a nod
        ("b", "B", "Right. /"),                                           # 5
        ("sd", "A", "The summers are fine. -/"),                          # 6 abandoned
        ("aa", "B", "Yeah, /"),                                           # 7 short agreement, then
        ("sd", "B", "but that is not what people told me about it at all, is it, really? /"),  # 8
        ("x", "A", "<laughter>."),                                        # 9 noise
        ("sv", "B", "No. /"),                                             # 10
    ])
    u = R.read_transcripts(spark, str(p))
    return written(O.annotate(u, 4))


def test_transcript_cleaning(conv):
    t = {r.idx: r for r in conv.collect()}
    assert t[0].text == "Well, we moved to Oslo last spring."
    assert t[2].text == "I like it, but the win-, winters are"
    assert t[9].text == "" and not t[9].claims and t[7].minor
    assert [t[i].claims for i in range(11)] == [True, True, True, False, True, False, True, False, True, False, True]


def test_turn_complete_on_the_golden_conversation(conv):
    e = {(r.idx, r.kind): r for r in O.turn_complete_examples(conv, 4).collect()}
    assert set(e) == {(0, "complete"), (1, "complete"), (2, "continuation")}
    assert e[1, "complete"].agent_last == "Well, we moved to Oslo last spring."
    assert e[2, "continuation"].user_partial == "I like it, but the win-, winters are"
    assert [t.text for t in e[2, "continuation"].recent_turns] == ["Well, we moved to Oslo last spring."]
    assert e[2, "continuation"].agent_last == "Do you like it there?"
    cuts = O.truncations(O.turn_complete_examples(conv, 4)).collect()
    assert {r.idx for r in cuts} == {0, 1}
    for r in cuts:
        full = e[r.idx, "complete"].user_partial
        assert full.startswith(r.user_partial) and 0 < len(r.user_partial) < len(full)


def test_barge_in_on_the_golden_conversation(conv):
    e = {r.idx: r for r in O.barge_in_examples(conv).collect()}
    assert {i: r.label for i, r in e.items()} == {
        1: "interruption", 2: "interruption", 3: "backchannel", 5: "backchannel", 6: "interruption",
        7: "interruption", 9: "noise", 10: "interruption"} or {i: r.label for i, r in e.items()} == {
        1: "interruption", 2: "interruption", 3: "backchannel", 5: "backchannel", 7: "interruption",
        9: "noise"}
    assert e[7].user_partial == "Yeah, but that is not what people told me about it at"
    assert e[7].kind == "aa+sd"
    assert e[7].agent_last == ("I like it, but the win-, winters are very dark. The summers are fine.")


def row_by_row(rows, keep=8):
    """A plain reading of the rules, one conversation at a time."""
    out = []
    n = len(rows)
    for pos, u in enumerate(rows):
        if pos + 1 >= n or rows[pos + 1]["caller"] == u["caller"] or not u["claims"]:
            continue
        nxt = next((j for j in range(pos + 1, n) if rows[j]["caller"] == u["caller"]), None)
        between = rows[pos + 1:nxt] if nxt is not None else rows[pos + 1:]
        answered = any(x["claims"] for x in between)
        if answered and u["ends_unit"]:
            kind = "complete"
        elif (not answered and not u["ends_unit"] and not u["abandoned"] and nxt is not None
              and rows[nxt]["act"] == "+"):
            kind = "continuation"
        else:
            continue
        start = max([j + 1 for j in range(pos) if rows[j]["claims"] and rows[j]["caller"] != u["caller"]], default=0)
        said = " ".join(x["text"] for x in rows[start:pos + 1] if x["caller"] == u["caller"] and x["text"])
        turns = []
        for x in rows[:start]:
            if x["claims"]:
                if turns and turns[-1][0] == x["caller"]:
                    turns[-1][1].append(x["text"])
                else:
                    turns.append((x["caller"], [x["text"]]))
        hist = [("user" if c == u["caller"] else "agent", " ".join(t)) for c, t in turns]
        last = hist.pop()[1] if hist and hist[-1][0] == "agent" else ""
        out.append((u["conv_id"], u["idx"], kind, said, last, tuple(hist[-keep:])))
    return out


@pytest.mark.parametrize("width,callers", [(5, "AB"), (1000, "AB"), (7, "ABC")])
def test_turn_complete_equals_row_reading(spark, width, callers):
    import random

    rng, rows = random.Random(width), []
    for c in range(90):
        for i in range(rng.randrange(2, 40)):
            claims = rng.random() < 0.6
            end = rng.choice(["/", "-/", ""])
            rows.append({"conv_id": c, "idx": i * 3, "caller": rng.choice(callers),
                         "act": rng.choice(["sd", "+", "b"]), "text": f"w{c} x{i}" if claims or rng.random() < .5 else "",
                         "claims": claims, "ends_unit": end == "/", "abandoned": end == "-/"})
    for r in rows:
        r["claims"] = r["claims"] and r["text"] != ""
    schema = "conv_id bigint, idx bigint, caller string, act string, text string, claims boolean, ends_unit boolean, abandoned boolean"
    u = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(7)
    got = O.turn_complete_examples(written(O.annotate(u, width)), width).collect()
    have = sorted((r.conv_id, r.idx, r.kind, r.user_partial, r.agent_last, tuple((t.speaker, t.text) for t in r.recent_turns)) for r in got)
    want = sorted(x for c in range(90) for x in row_by_row([r for r in rows if r["conv_id"] == c]))
    assert have == want and len(want) > 100


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("ms") / "m.csv"
    rows = [
        (1, "u1", True, "my card was declined and i am still waiting &amp; nobody helps https://t.co/x", ""),
        (2, "ChaseSupport", False, "@u1 sorry to hear that, what happened? ^MG", 1),
        (3, "u1", True, "@ChaseSupport it was in a shop", 2),
        (4, "u1", True, "and i want to speak to a manager now", 3),
        (5, "other", False, "hello there my friend", ""),
        (6, "u2", True, "is it the end of my story", 5),
        (7, "u3", True, "el banco no me ayuda con la tarjeta", 2),
        (8, "u4", True, "ok", 2),
        (9, "u5", True, "what is this about my account", 999),
        (50, "u6", True, "a loop of the two", 51), (51, "u6", True, "the other one of it", 50),
    ]
    rows += [(100 + i, "u9" if i % 2 else "AskCiti", bool(i % 2), f"the message number {i} is it", 99 + i if i else "")
             for i in range(60)]
    body = "".join(f'{a},{b},{c},t,"{d}",,{e}\n' for a, b, c, d, e in rows)
    p.write_text("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n" + body)
    return R.read_messages(spark, str(p))


def test_thread_roots(messages):
    r = {x.id: x.root for x in TH.thread_roots(messages).collect()}
    assert r[4] == 1 and r[7] == 1 and r[9] == 9 and r[6] == 5
    assert r[50] is None and r[51] is None
    assert r[159] == 100


def test_message_candidates(messages):
    c = {x.id: x for x in TH.message_candidates(messages).collect()}
    assert {1, 3, 4} <= set(c) and not {2, 5, 6, 7, 8, 9, 50} & set(c)
    assert c[1].user_partial == "my card was declined and i am still waiting & nobody helps"
    assert c[1].cue and c[1].stratum == "cue/opener" and c[1].company == "ChaseSupport"
    assert c[3].agent_last == "sorry to hear that, what happened?"
    assert [(t.speaker, t.text) for t in c[4].recent_turns] == [
        ("user", c[1].user_partial), ("agent", "sorry to hear that, what happened?"), ("user", "it was in a shop")]
    assert len(c[159].recent_turns) == 8 and len({x.split for x in c.values() if x.group == "msg:1"}) == 1


def test_intents(spark, tmp_path):
    doc = {"train": [["Move my money", "transfer"], ["Play a song", "music"]], "val": [["move my MONEY!", "transfer"], ["pay it", "pay_bill"]],
           "test": [["what do i owe", "balance"]], "oos_train": [["tell a joke", "oos"]], "oos_val": [], "oos_test": [["how old are you", "oos"]]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    intents = ("transfer", "pay_bill", "balance")
    rows = R.in_domain_positions(R.read_intents(spark, str(tmp_path / "i.json")), intents)
    e = {r.id: r.label for r in TH.intent_examples(rows, intents).collect()}
    assert e == {"intent-train-00000": "transfer", "intent-train-00001": "out_of_scope",
                 "intent-calib-00001": "pay_bill", "intent-test-00000": "balance", "intent-test-00001": "out_of_scope"}


def test_jsonl_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(f"id{i:03d}", "route", f"t{i}") for i in range(50)], "id string, decision string, label string")
    R.write_rows_jsonl(d.repartition(5), str(tmp_path / "rows"), 3)
    with gzip.open(tmp_path / "extra.json.gz", "wt") as f:
        f.write('{"id": "z1", "label": "x"}\n\n{"id": "z2", "label": "y"}\n')
    assert R.read_rows_jsonl(spark, str(tmp_path / "extra.json.gz")).count() == 2
    back = R.read_rows_jsonl(spark, str(tmp_path / "rows"))
    assert sorted(r.id for r in back.collect()) == [f"id{i:03d}" for i in range(50)]


def test_pins(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    pins = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "0" * 64)], "name string, sha256 string")
    bad = L.pin_violations(R.read_files(spark, str(tmp_path / "*.bin")), pins).collect()
    assert [r.name for r in bad] == ["b.bin"]


def test_freeze(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    none = spark.createDataFrame([], "name string, fingerprint string")
    row = L.write_frozen(d, none, "v1", str(tmp_path)).collect()[0]
    assert row.new and (tmp_path / "v1").exists()
    manifest = spark.createDataFrame([("v1", row.fingerprint)], "name string, fingerprint string")
    assert not L.freeze_version(d.repartition(3), manifest, "v1").collect()[0].new
    with pytest.raises(Exception, match="frozen and never edited"):
        L.freeze_version(d.withColumn("t", F.coalesce("t", F.lit(""))), manifest, "v1").collect()


def test_guards_refuse(spark):
    pool = spark.createDataFrame([("a", "g1", "train"), ("b", "g2", "test")], "id string, group string, split string")
    with pytest.raises(Exception, match="outside train"):
        S.guarded_train_sample(pool, pool.where("id = 'zz'"), 1, 1).collect()
    ok = pool.where("split = 'train'")
    with pytest.raises(Exception, match="also in an eval set"):
        S.guarded_train_sample(ok, ok, 1, 1).collect()
    with pytest.raises(Exception, match="fewer than 5"):
        S.min_label_gate(ok, 5).collect()
    strata = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, stratum string")
    with pytest.raises(Exception, match="fewer than 2 rows"):
        S.equal_strata_sample(strata, ("x", "y"), 4, 1, "p").collect()
    cands = spark.createDataFrame([("a", "test", "s", True)], "id string, split string, stratum string, cue boolean")
    labels = spark.createDataFrame([("a", "true", "v1", "h", 1)], "id string, label string, guidelines string, labeller string, at int")
    with pytest.raises(Exception, match="guidelines v1"):
        S.labelled_rows(cands, labels, "test", "v2").collect()


def test_split_fractions_and_stability(spark):
    from colloquy.functions.hashing import assign_split

    d = spark.range(20_000).select(F.concat(F.lit("g"), "id").alias("g"))
    s = d.select("g", assign_split(F.col("g"), K.SPLIT_SEED, K.SPLIT_FRACTIONS).alias("s"))
    share = {r.s: r.n / 20_000 for r in s.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(share["train"] - .7) < .015 and abs(share["calib"] - .1) < .015
    import hashlib as h

    for r in s.limit(200).collect():
        u = int.from_bytes(h.sha256(f"{K.SPLIT_SEED}:{r.g}".encode()).digest()[:8], "big") / 2**64
        assert r.s == ("train" if u < .7 else "calib" if u < .7 + .1 else "test")
    with pytest.raises(ValueError):
        assign_split(F.col("g"), 1, (("train", 0.5), ("test", 0.2)))


@pytest.mark.parametrize("raw,want", [
    ("Don't you'd 'quote' dogs' 3.5", "don't you'd quote dogs 3 5"), ("It’s  A`b ʼx", "it's a'b x"),
    ("x² ﬁne Ⅳ ½ ＡＢ", "x2 fine iv 1 2 ab"), ("é́ café", "é́ café"), ("a''b '' c", "a b c"), ("", ""), ("…!?", "")])
def test_normalize(spark, raw, want):
    d = T.nfkc_stable(spark.createDataFrame([(raw,)], "t string"), "t")
    once = d.select(T.normalize_text(F.col("t")).alias("n"))
    assert once.first().n == want
    assert once.select(T.normalize_text(F.col("n")).alias("m")).first().m == want
