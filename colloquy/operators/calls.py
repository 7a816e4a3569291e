"""Call timelines: decision points, agents' acts on a logical clock, scores and divergences.

segments: (call_id, seg, who, at_ms, dur_ms, end_ms, text). The recording is fixed; only the agent's
own lines are cut. Interval questions use time buckets inside a call, as-of questions use
`chunk_scan`, so a very long call is spread over many tasks.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy import constants as K
from colloquy.operators.policy import Policy, barge_policy, pause_policy
from colloquy.operators.scale import chunk_scan, covering, written

BUCKET_MS = 10_000
SCAN_MS = 600_000
#: Onsets of a line are folded in chunks of this many ms, chunks in groups of FOLD_FAN.
FOLD_MS, FOLD_FAN = 10_000, 256
OVER, PAUSE = "user_speech_during_agent", "user_pause"


def speech_over_agent(seg: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(call_id, seg, line, onset, user_end, line_at, line_end): onsets inside an agent line."""
    if lines is None:
        lines = seg.where("who = 'agent'").select(
            "call_id", F.col("seg").alias("line"), F.col("at_ms").alias("line_at"),
            F.col("end_ms").alias("line_end"))
    users = seg.where("who = 'user'").select("call_id", "seg", F.col("at_ms").alias("onset"),
                                             F.col("end_ms").alias("user_end"))
    hits = covering(users, lines, "call_id", "onset", "line_at", "line_end", width=BUCKET_MS)
    return hits.groupBy("call_id", "seg", "onset", "user_end").agg(F.min_by(
        F.struct("line", "line_at", "line_end"), "line").alias("l")).select(
        "call_id", "seg", "onset", "user_end", "l.*")


def _after(e: Column, start: Column, to: Column) -> Column:
    """A stretch of onsets as a function of a line's end: beyond its first stop's onset it gives one end, whatever came in."""
    return F.when(e > start, to).otherwise(e)


def _handed_on(parts: str, name: str, end: Column) -> Column:
    """[(name, end)]: the end that reaches each part of an ordered array of stretches."""
    empty = F.struct(end.alias("end"), F.array().cast(f"array<struct<{name}:bigint,end:double>>").alias("out"))
    return F.aggregate(parts, empty, lambda s, p: F.struct(
        _after(s["end"], p["start"], p["to"]).alias("end"),
        F.array_append(s["out"], F.struct(p[name].alias(name), s["end"].alias("end"))).alias("out")))["out"]


def _composed(parts: str) -> Column:
    """(start, to) of an ordered array of stretches as one stretch."""
    stops = F.filter(parts, lambda p: p["start"].isNotNull())
    return F.struct(F.get(stops, F.lit(0))["start"].alias("start"), F.aggregate(
        stops, F.lit(float("inf")), lambda e, p: _after(e, p["start"], p["to"])).alias("to"))


def fold_onsets(over: DataFrame) -> DataFrame:
    """(call_id, line, line_end, chunk, spoken_end, was_cut, met): each line's onsets folded in order, in chunks of the clock.

    over: speech_over_agent rows with `stops` BOOLEAN and `effective_ms`. A stop shortens the line, and later speech sees the
    shortened line. Onsets ascend, so a stretch of them leaves an end alone that lies before its first stop and maps all
    others to the same end: chunks are reduced to (first stop, end after it), these are composed in groups of FOLD_FAN and then
    over the line, and a second pass folds every chunk from the end that reaches it. No task holds more than a chunk's onsets, FOLD_FAN
    chunks, or one row for every FOLD_FAN chunks of a line.
    """
    key = ["call_id", "line", "line_end"]
    o = over.withColumn("chunk", F.floor(F.col("onset") / FOLD_MS))
    line_end = F.col("line_end").cast("double")
    chunks = o.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct(
        "onset", "seg", "stops", F.least(F.col("effective_ms").cast("double"), line_end).alias("eff")))).alias("on"))
    stop = F.transform(F.filter("on", lambda x: x["stops"]), lambda x: F.struct(x["onset"].cast("double").alias("start"), x["eff"].alias("to")))
    parts = chunks.withColumn("stops", stop).select(*key, "chunk", _composed("stops").alias("f")).select(*key, "chunk", "f.*")
    groups = parts.groupBy(*key, F.floor(F.col("chunk") / FOLD_FAN).alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "start", "to"))).alias("parts"))
    tops = groups.select(*key, "group", _composed("parts").alias("f")).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("group", "f.start", "f.to"))).alias("parts"))
    to_group = tops.select(*key, F.explode(_handed_on("parts", "group", line_end)).alias("g")).select(*key, "g.group", F.col("g.end").alias("in"))
    to_chunk = groups.join(to_group, [*key, "group"]).select(*key, F.explode(_handed_on("parts", "chunk", F.col("in"))).alias("c"))
    to_chunk = to_chunk.select(*key, "c.chunk", F.col("c.end").alias("in"))
    start = F.struct(F.col("in").alias("end"), F.lit(False).alias("cut"), F.array().cast("array<int>").alias("met"))

    def step(s, x):
        meets = x["onset"] < s["end"]
        cuts = meets & x["stops"]
        return F.struct(F.when(cuts, x["eff"]).otherwise(s["end"]).alias("end"), (s["cut"] | cuts).alias("cut"),
                        F.when(meets, F.array_append(s["met"], x["seg"])).otherwise(s["met"]).alias("met"))

    folded = chunks.join(to_chunk, [*key, "chunk"]).withColumn("s", F.aggregate("on", start, step))
    return folded.select(*key, "chunk", F.col("s.end").alias("spoken_end"), F.col("s.cut").alias("was_cut"), F.col("s.met").alias("met"))


def cut_lines(folded: DataFrame) -> DataFrame:
    """(call_id, line, line_end, spoken_end, was_cut): each line spoken over with its final end, from `fold_onsets`."""
    return folded.groupBy("call_id", "line", "line_end").agg(F.max_by("spoken_end", "chunk").alias("spoken_end"),
                                                             F.bool_or("was_cut").alias("was_cut"))


def spoken_lines(seg: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every agent line with the end this agent gave it."""
    lines = seg.where("who = 'agent'").select(
        "call_id", F.col("seg").alias("line"), F.col("at_ms").alias("line_at"),
        F.col("end_ms").cast("double").alias("full_end"))
    c = cuts.select("call_id", "line", "spoken_end", "was_cut")
    return lines.join(c, ["call_id", "line"], "left").select(
        "call_id", "line", "line_at", F.coalesce("spoken_end", "full_end").alias("line_end"),
        F.coalesce("was_cut", F.lit(False)).alias("was_cut"))


def next_starts(seg: DataFrame) -> DataFrame:
    """(call_id, seg, next_at): the first start at or after each user segment's end."""
    starts = seg.select("call_id", F.col("at_ms").alias("t"), F.lit(1).alias("kind"), "seg")
    ends = seg.where("who = 'user'").select("call_id", F.col("end_ms").alias("t"),
                                            F.lit(0).alias("kind"), "seg")
    s = chunk_scan(ends.unionByName(starts), ["call_id"], ["t", "kind", "seg"], SCAN_MS,
                   next_after={"next_at": F.when(F.col("kind") == 1, F.col("t"))})
    return s.where("kind = 0").select("call_id", "seg", "next_at")


def pause_points(seg: DataFrame, lines: DataFrame | None = None, vad_ms: int = K.VAD_PAUSE_MS,
                 starts: DataFrame | None = None) -> DataFrame:
    """(call_id, seg, end_ms, gap_ms): user ends outside agent lines with enough silence after.

    `starts` are the next_starts of the segments, if they are there already."""
    if lines is None:
        lines = seg.where("who = 'agent'").select(
            "call_id", F.col("seg").alias("line"), F.col("at_ms").alias("line_at"),
            F.col("end_ms").alias("line_end"))
    users = seg.where("who = 'user'").select("call_id", "seg", "end_ms")
    busy = covering(users, lines.select("call_id", "line_at", "line_end"), "call_id", "end_ms",
                    "line_at", "line_end", width=BUCKET_MS).select("call_id", "seg").distinct()
    free = users.join(busy, ["call_id", "seg"], "left_anti").join(
        next_starts(seg) if starts is None else starts, ["call_id", "seg"])
    gap = F.col("next_at") - F.col("end_ms")
    return free.withColumn("gap_ms", gap).where(F.col("gap_ms").isNull() | (
        F.col("gap_ms") >= vad_ms)).drop("next_at")


def word_timing(seg: DataFrame) -> DataFrame:
    """(call_id, seg, word_no, word, word_end_ms): words spread evenly over their segment."""
    w = F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")
    s = seg.withColumn("_n", F.size(w)).select("*", F.posexplode(w).alias("_j", "word"))
    end = F.col("at_ms") + (F.col("_j") + 1) * (F.col("dur_ms") / F.col("_n"))
    return s.select("call_id", "seg", F.col("_j").alias("word_no"), "word",
                    end.alias("word_end_ms"))


def words_by(text: Column, at: Column, dur: Column, t: Column, until: Column | None = None
             ) -> Column:
    """The words of a segment finished by t; nothing is said after `until`."""
    w = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
    end = at + dur if until is None else F.least((at + dur).cast("double"), until)
    upto = F.least(t.cast("double"), end.cast("double"))
    n = F.floor(F.size(w) * (upto - at) / dur + 1e-9)
    n = F.when(upto <= at, 0).otherwise(F.least(n, F.size(w))).cast("int")
    return F.slice(w, F.lit(1), F.greatest(n, F.lit(0)))


def call_words(seg: DataFrame, lines: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(call_id, pos, kind, i, k, who, words): all that is said in a call, in the order in which it ends, once.

    An agent's word ends by itself, a user segment as a whole. `history` (call_id, k, speaker, text) comes first.
    """
    w = F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")
    ends = lines.select("call_id", F.col("line").alias("seg"), "line_end")
    agent = seg.where("who = 'agent'").join(ends, ["call_id", "seg"], "left")
    said = words_by(F.col("text"), F.col("at_ms"), F.col("dur_ms"), F.lit(float("inf")), F.col("line_end"))
    agent = agent.withColumn("_per", F.col("dur_ms") / F.size(w)).select("call_id", "at_ms", "_per", F.col("seg").cast("bigint").alias("i"),
                                                                         F.posexplode(said).alias("k", "words"))
    # rounded, so that a word that ends with the millisecond compares equal to it
    agent = agent.select("call_id", F.round(F.col("at_ms") + (F.col("k") + 1) * F.col("_per"), 6).alias("pos"), F.lit(0).alias("kind"), "i", "k",
                         F.lit("agent").alias("who"), "words")
    user = seg.where("who = 'user' AND dur_ms > 0").select(
        "call_id", F.col("end_ms").cast("double").alias("pos"), F.lit(2).alias("kind"), F.col("seg").cast("bigint").alias("i"), F.lit(0).alias("k"),
        F.lit("user").alias("who"), F.array_join(w, " ").alias("words"))
    out = agent.unionByName(user)
    if history is None:
        return out
    past = history.select("call_id", F.lit(float("-inf")).alias("pos"), F.lit(0).alias("kind"), F.col("k").cast("bigint").alias("i"), F.lit(0).alias("k"),
                          F.col("speaker").alias("who"), F.array_join(w, " ").alias("words"))
    return out.unionByName(past)


def _clock(c: str) -> Column:
    """The clock by which a call is cut into chunks; history lies before its start."""
    return F.greatest(F.col(c), F.lit(-1.0))


def snapshot_at(points: DataFrame, seg: DataFrame, lines: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """What is known at each point (call_id, seg, event, t): the call so far as merged turns.

    Adds user_partial, agent_last, recent_turns and agent_speaking. At a speech-over point the decided segment contributes at
    least one word. Words are put in order and merged to turns once a call, not once a point: a point looks up the last word
    before it, takes the turns before that word's and its turn up to it, and adds the user speech that is still going on.
    A snapshot holds its whole call so far, so its size is bounded by the call, not by the table.
    """
    key = ["call_id", "seg", "event"]
    order = ["pos", "kind", "i", "k"]
    words = chunk_scan(call_words(seg, lines, history), ["call_id"], order, SCAN_MS, order_value=_clock("pos"), lag={"_prev": F.col("who")})
    fresh = F.col("_prev").isNull() | (F.col("_prev") != F.col("who"))
    words = chunk_scan(words, ["call_id"], order, SCAN_MS, order_value=_clock("pos"), cumsum={"g": fresh.cast("bigint")})
    words = written(words.select("call_id", *order, "who", "words", "g"))
    p = points.select(*key, F.col("t").cast("double").alias("t"))
    # after the agent's words that end by t, before the user segments that end then: those still count as going on
    asks = p.select("call_id", F.col("t").alias("pos"), F.lit(1).alias("kind"), F.col("seg").cast("bigint").alias("i"),
                    F.when(F.col("event") == OVER, 0).otherwise(1).alias("k"), F.lit(None).cast("bigint").alias("g"), "seg", "event", "t")
    both = words.select("call_id", *order, "g").unionByName(asks, allowMissingColumns=True)
    at = chunk_scan(both, ["call_id"], order, SCAN_MS, order_value=_clock("pos"), last_before={"_g": F.col("g")}).where("event IS NOT NULL").select(
        *key, "t", F.col("_g").alias("g"))
    turns = words.groupBy("call_id", "g").agg(F.first("who").alias("speaker"), F.array_sort(F.collect_list(F.struct(*order, "words"))).alias("said"))
    text = F.array_join(F.transform("said", lambda x: x["words"]), " ")
    whole = turns.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "speaker", text.alias("text")))), lambda x: F.struct(
        x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("_all"))
    heard = F.filter("said", lambda x: (x["pos"] < F.col("t")) | ((x["pos"] == F.col("t")) & (x["kind"] == 0)))
    last = at.join(turns, ["call_id", "g"]).select(*key, F.struct("speaker", F.array_join(F.transform(heard, lambda x: x["words"]), " ").alias("text")).alias("_last"))

    users = seg.where("who = 'user'").select("call_id", F.col("seg").alias("i"), "at_ms", "dur_ms", "end_ms", "text")
    spans = users.select("call_id", "i", "at_ms", "dur_ms", "end_ms", "text", (F.col("end_ms") + 1).alias("_until"))
    own = (F.col("event") == OVER) & (F.col("i") == F.col("seg"))
    going = covering(p, spans, "call_id", "t", "at_ms", "_until", width=BUCKET_MS).where((F.col("at_ms") < F.col("t")) & (F.col("t") <= F.col("end_ms")) & ~own).drop("_until")
    decided = p.where(F.col("event") == OVER).join(users.withColumn("seg", F.col("i")), ["call_id", "seg"]).where(F.col("t") <= F.col("end_ms"))
    going = going.unionByName(decided)
    by_now = words_by(F.col("text"), F.col("at_ms"), F.col("dur_ms"), F.col("t"))
    first = F.slice(F.split(F.trim("text"), r"\s+"), 1, 1)
    going = going.withColumn("w", F.when(own & (F.size(by_now) == 0), first).otherwise(by_now)).where(F.size("w") > 0)
    going = going.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.array_join("w", " ").alias("x")))), lambda r: r["x"]), " ").alias("_now"))

    none = F.array().cast("array<struct<speaker:string,text:string>>")
    talking = covering(p, lines.select("call_id", "line_at", "line_end"), "call_id", "t", "line_at", "line_end", width=BUCKET_MS).select(*key).distinct()
    talking = talking.withColumn("agent_speaking", F.lit(True))
    # the call's turns come last: after them a row holds its whole call, and is not sent anywhere any more
    out = at.join(last, key, "left").join(going, key, "left").join(talking, key, "left").na.fill(False, ["agent_speaking"]).join(whole, "call_id", "left")
    before = F.when(F.col("g") > 1, F.slice("_all", F.lit(1), F.col("g").cast("int") - 1)).otherwise(none)
    out = out.withColumn("_t", F.when(F.col("_last").isNull(), none).otherwise(F.array_append(before, F.col("_last")))).drop("_all", "_last")
    end = F.try_element_at("_t", F.lit(-1))
    joins = F.coalesce(end["speaker"] == "user", F.lit(False))
    added = F.struct(F.lit("user").alias("speaker"), F.when(joins, F.concat_ws(" ", end["text"], "_now")).otherwise(F.col("_now")).alias("text"))
    rest = F.when(joins, F.slice("_t", F.lit(1), F.size("_t") - 1)).otherwise(F.col("_t"))
    out = out.withColumn("_t", F.when(F.col("_now").isNull(), F.col("_t")).otherwise(F.array_append(rest, added)))

    def pop(df, who, name):
        last = F.try_element_at("_t", F.lit(-1))
        is_who = F.coalesce(last["speaker"] == who, F.lit(False))
        return df.withColumn(name, F.when(is_who, last["text"]).otherwise("")).withColumn(
            "_t", F.when(is_who, F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0)))
                         ).otherwise(F.col("_t")))

    out = pop(pop(out, "user", "user_partial"), "agent", "agent_last")
    return out.select(*key, F.col("t"), "user_partial", "agent_last", F.col("_t").alias("recent_turns"), "agent_speaking")


ACT = ("call_id", "seg", "event", "action", "route", "escalate", "reason", "decided_at_ms",
       "effective_ms", "budget_ms", "timer")


def _acts(df: DataFrame, agent: str) -> DataFrame:
    return df.select(F.lit(agent).alias("agent"), *[
        F.col(c).cast("double").alias(c) if c.endswith("_ms") else F.col(c) for c in ACT])


def _met(over: DataFrame, folded: DataFrame) -> DataFrame:
    met = folded.select("call_id", F.explode("met").alias("seg"))
    return over.join(met, ["call_id", "seg"], "left_semi")


def before_acts(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What does not depend on the agent, written once for all of them: speech over the agent's full lines, and the starts after user ends."""
    return written(speech_over_agent(seg)), written(next_starts(seg))


def policy_acts(seg: DataFrame, probs: DataFrame, route_labels, budgets: dict,
                cfg: Policy = Policy(), window_ms: int = K.BARGE_WINDOW_MS, known: tuple | None = None):
    """(acts, lines) of the deciding agent. probs: call_id, seg, p_barge, p_complete, p_escalate,
    p_route. Each decision costs its event's budget; the safety net answers at max_wait. `known`: what `before_acts` wrote."""
    over, starts = known or (speech_over_agent(seg), None)
    over = over.join(probs.select("call_id", "seg", "p_barge", "p_escalate"),
                                       ["call_id", "seg"])
    d = barge_policy(F.col("p_barge"), F.col("p_escalate"), cfg)
    at = F.least(F.col("user_end"), F.col("onset") + window_ms).cast("double")
    over = over.withColumn("d", d).withColumn("decided_at_ms", at).withColumn(
        "effective_ms", at + float(budgets[OVER])).withColumn(
        "stops", F.col("d.action") == "stop_and_listen")
    over = written(over)    # read by the fold, the acts and, through the cuts, the pauses
    folded = written(fold_onsets(over))
    lines = spoken_lines(seg, cut_lines(folded))
    barge = _met(over, folded).select("*", "d.*").withColumn("event", F.lit(OVER)).withColumn(
        "budget_ms", F.lit(float(budgets[OVER]))).withColumn("timer", F.lit(False))
    p = pause_points(seg, lines, cfg.vad_pause_ms, starts).join(
        probs.select("call_id", "seg", "p_complete", "p_route", "p_escalate"), ["call_id", "seg"])

    def decide(ms):
        return pause_policy(F.col("p_complete"), F.col("p_route"), F.col("p_escalate"),
                            F.lit(float(ms)), route_labels, cfg)

    p = p.withColumn("first", decide(cfg.vad_pause_ms)).withColumn("late", decide(cfg.max_wait_ms))
    net = (F.col("first.action") == "keep_listening") & (
        F.col("gap_ms").isNull() | (F.col("gap_ms") >= cfg.max_wait_ms))
    late = F.struct(F.col("late.action").alias("action"), F.col("late.escalate").alias("escalate"),
                    F.col("late.route").alias("route"), F.concat_ws(
                        "; then ", "first.reason", "late.reason").alias("reason"))
    t = (F.col("end_ms") + cfg.vad_pause_ms).cast("double")
    b = float(budgets[PAUSE])
    pause = p.withColumn("d", F.when(net, late).otherwise(F.col("first"))).withColumn(
        "decided_at_ms", t).withColumn("effective_ms", F.when(
            net, (F.col("end_ms") + cfg.max_wait_ms).cast("double")).otherwise(t + b)).withColumn(
        "timer", net).withColumn("budget_ms", F.lit(b)).withColumn("event", F.lit(PAUSE)).select(
        "*", "d.*")
    return _acts(barge, "policy").unionByName(_acts(pause, "policy")), lines


def naive_acts(seg: DataFrame, silence_ms: int = K.NAIVE_SILENCE_MS, vad_ms: int = K.VAD_PAUSE_MS, known: tuple | None = None):
    """(acts, lines) of an agent with a silence timeout that stops at any user speech. `known`: what `before_acts` wrote."""
    # read by the fold, the acts and, through the cuts, the pauses
    over, starts = known or (written(speech_over_agent(seg)), None)
    over = over.withColumn("stops", F.lit(True)).withColumn("effective_ms", F.col("onset").cast("double"))
    folded = written(fold_onsets(over))
    lines = spoken_lines(seg, cut_lines(folded))
    none = F.lit(None).cast("string")
    barge = _met(over, folded).select(
        "call_id", "seg", F.lit(OVER).alias("event"), F.lit("stop_and_listen").alias("action"),
        none.alias("route"), F.lit(False).alias("escalate"),
        F.lit("any user speech stops the agent").alias("reason"),
        F.col("onset").alias("decided_at_ms"), "effective_ms", F.lit(0.0).alias("budget_ms"),
        F.lit(False).alias("timer"))
    p = pause_points(seg, lines, vad_ms, starts)
    answers = F.col("gap_ms").isNull() | (F.col("gap_ms") >= silence_ms)
    waited = F.when(answers, F.lit(silence_ms)).otherwise(F.col("gap_ms"))
    pause = p.select(
        "call_id", "seg", F.lit(PAUSE).alias("event"),
        F.when(answers, "respond_after_timeout").otherwise("keep_listening").alias("action"),
        none.alias("route"), F.lit(False).alias("escalate"),
        F.when(answers, f"silence {silence_ms} ms >= timeout {silence_ms} ms").otherwise(F.concat(
            F.lit("the user resumed after "), F.col("gap_ms").cast("string"),
            F.lit(" ms of silence"))).alias("reason"),
        (F.col("end_ms") + waited).alias("decided_at_ms"),
        (F.col("end_ms") + waited).alias("effective_ms"), F.lit(0.0).alias("budget_ms"),
        F.lit(True).alias("timer"))
    return _acts(barge, "naive").unionByName(_acts(pause, "naive")), lines


def wanted_acts(seg: DataFrame, expect: DataFrame, budgets: dict, cfg: Policy = Policy(),
                window_ms: int = K.BARGE_WINDOW_MS):
    """(acts, lines) of an agent that does what the expectations want, on the policy's timing."""
    e = expect.select("call_id", "seg", "over_agent", F.col("want"), F.col("route").alias("w_route"),
                      F.coalesce("escalate", F.lit(False)).alias("w_esc"))
    over = speech_over_agent(seg).join(e.where("over_agent"), ["call_id", "seg"], "left")
    at = F.least(F.col("user_end"), F.col("onset") + window_ms).cast("double")
    over = over.withColumn("action", F.coalesce("want", F.lit("keep_talking"))).withColumn(
        "decided_at_ms", at).withColumn("effective_ms", at + float(budgets[OVER])).withColumn(
        "stops", F.col("action") == "stop_and_listen")
    over = written(over)    # read by the fold, the acts and, through the cuts, the pauses
    folded = written(fold_onsets(over))
    lines = spoken_lines(seg, cut_lines(folded))
    both = {"reason": F.lit("wanted"), "timer": F.lit(False), "escalate": F.coalesce(
        "w_esc", F.lit(False))}
    barge = _met(over, folded).withColumns({**both, "route": F.lit(None).cast("string"),
                                          "event": F.lit(OVER),
                                          "budget_ms": F.lit(float(budgets[OVER]))})
    p = pause_points(seg, lines, cfg.vad_pause_ms).join(e.where("NOT over_agent"),
                                                        ["call_id", "seg"], "left")
    t = (F.col("end_ms") + cfg.vad_pause_ms).cast("double")
    pause = p.withColumns({**both, "action": F.coalesce("want", F.lit("keep_listening")),
                           "route": F.col("w_route"), "event": F.lit(PAUSE), "decided_at_ms": t,
                           "effective_ms": t + float(budgets[PAUSE]),
                           "budget_ms": F.lit(float(budgets[PAUSE]))})
    return _acts(barge, "wanted").unionByName(_acts(pause, "wanted")), lines


def score_acts(acts: DataFrame, expect: DataFrame) -> DataFrame:
    """Acts with want, want_route, want_escalate and ok (NULL where nothing is expected)."""
    e = expect.select("call_id", "seg", F.when(F.col("over_agent"), OVER).otherwise(PAUSE).alias(
        "event"), "want", F.col("route").alias("want_route"), F.col("escalate").alias(
        "want_escalate"))
    j = acts.join(e, ["call_id", "seg", "event"], "left")
    same = F.when(F.col("want") == "respond", F.col("action").isin(
        "respond", "respond_after_timeout")).otherwise(F.col("want") == F.col("action"))
    route_ok = F.col("want_route").isNull() | F.col("want_route").eqNullSafe(F.col("route"))
    esc_ok = F.col("want_escalate").isNull() | (F.col("want_escalate") == F.col("escalate"))
    waited = (F.col("want") == "keep_listening") & (F.col("action") == "keep_listening")
    return j.withColumn("ok", F.when(F.col("want").isNull(), F.lit(None).cast("boolean")).when(
        waited, True).otherwise(same & route_ok & esc_ok))


def missed_points(acts: DataFrame, lines: DataFrame, expect: DataFrame, seg: DataFrame
                  ) -> DataFrame:
    """(agent, call_id, seg, over_agent, want, why, counts): expectations without a decision point.

    One agent's acts and lines. Wanting a stop from an agent that had already stopped is harmless.
    """
    done = acts.select("call_id", "seg", (F.col("event") == OVER).alias("over_agent"))
    m = expect.join(done, ["call_id", "seg", "over_agent"], "left_anti").join(
        seg.select("call_id", "seg", "at_ms"), ["call_id", "seg"])
    # asks hand nothing on, so that equal ones may come in any order; they carry what is asked through the scan
    asks = m.select("call_id", F.col("at_ms").cast("double").alias("t"), F.lit(1).alias("kind"),
                    "seg", "over_agent", "want")
    stops = lines.where("was_cut").select("call_id", F.col("line_end").alias("t"),
                                          F.lit(0).alias("kind"), F.col("line").alias("seg"))
    m = chunk_scan(asks.unionByName(stops, allowMissingColumns=True), ["call_id"], ["t", "kind", "seg"], SCAN_MS,
                   last_before={"stopped_at": F.when(F.col("kind") == 0, F.col("t"))}).where("kind = 1")
    quiet = F.col("over_agent") & F.col("stopped_at").isNotNull()
    why = (F.when(quiet, F.concat(F.lit("agent silent since "),
                                  F.format_string("%.2f", F.col("stopped_at") / 1000), F.lit(" s")))
           .when(~F.col("over_agent"), "user covered by agent speech")
           .otherwise("nothing to decide at this point"))
    counts = ~(quiet & (F.col("want") == "stop_and_listen"))
    return m.select("call_id", "seg", "over_agent", "want", why.alias("why"),
                    counts.alias("counts"))


def divergences(acts: DataFrame, agents: int) -> DataFrame:
    """(call_id, seg, event) where agents acted differently, or only some had to decide."""
    key = ["call_id", "seg", "event"]
    did = acts.groupBy(*key, "action", "route", "escalate").agg(F.count(F.lit(1)).alias("n"))
    g = did.groupBy(*key).agg(F.count(F.lit(1)).alias("ways"), F.sum("n").alias("n"))
    return g.where((F.col("ways") > 1) | (F.col("n") < agents)).select(*key)


def agent_score(outcomes: DataFrame, missed: DataFrame) -> DataFrame:
    """(agent, call_id, level, ok, points): acted as wanted of scored points, per call and in all."""
    o = outcomes.where("ok IS NOT NULL").select("agent", "call_id", F.col("ok").cast("int").alias("k"))
    m = missed.where("counts").select("agent", "call_id", F.lit(0).alias("k"))
    u = o.unionByName(m).groupBy("agent", "call_id").agg(F.sum("k").alias("k"),
                                                         F.count(F.lit(1)).alias("n"))
    return u.groupingSets([[F.col("agent")], [F.col("agent"), F.col("call_id")]], "agent", "call_id"
                          ).agg(F.grouping("call_id").cast("int").alias("level"), F.sum("k").alias(
                              "ok"), F.sum("n").alias("points"))


def consequences(outcomes: DataFrame, seg: DataFrame) -> DataFrame:
    """What each act led to: after_ms, before_next_ms, unsaid_ms and a short text."""
    user_at = F.when(F.col("who") == "user", F.col("at_ms"))
    nxt = seg.select("call_id", "seg", "who", "at_ms", "end_ms")
    users = chunk_scan(nxt, ["call_id"], "seg", 4096, next_after={"next_user": user_at}).where(
        "who = 'user'").select("call_id", "seg", "end_ms", "next_user")
    line = speech_over_agent(seg).select("call_id", "seg", "line_end")
    o = outcomes.join(users, ["call_id", "seg"]).join(next_starts(seg), ["call_id", "seg"]).join(
        line, ["call_id", "seg"], "left")
    follows = F.coalesce(F.col("next_user") == F.col("next_at"), F.lit(False))
    cut_in = follows & (F.col("effective_ms") < F.col("next_user"))
    o = o.withColumns({
        "after_ms": F.when(F.col("event") == PAUSE, F.col("effective_ms") - F.col("end_ms")),
        "before_next_ms": F.when((F.col("event") == PAUSE) & cut_in,
                                 F.col("next_user") - F.col("effective_ms")),
        "unsaid_ms": F.when((F.col("event") == OVER) & (F.col("action") == "stop_and_listen"),
                            F.col("line_end") - F.col("effective_ms"))})
    mid = F.coalesce(F.col("want") == "keep_listening", F.lit(False))
    how = F.when(F.col("timer") & (F.col("budget_ms") > 0), "safety net").when(
        F.col("timer"), "timeout").otherwise("decision")

    def ms(c):
        return F.format_string("%.0f", F.col(c))

    answered = F.concat(F.lit("answered "), ms("after_ms"), F.lit(" ms into the silence"))
    text = (F.when((F.col("event") == PAUSE) & (F.col("action") == "keep_listening"),
                   "waited on")
            .when(F.col("before_next_ms").isNotNull() & mid, F.concat(
                answered, F.lit(", cutting in "), ms("before_next_ms"),
                F.lit(" ms ahead of the next words")))
            .when(F.col("before_next_ms").isNotNull(), F.concat(
                answered, F.lit("; user back after "), ms("before_next_ms"), F.lit(" ms")))
            .when(F.col("event") == PAUSE, F.concat(answered, F.lit(" ("), how, F.lit(")")))
            .when(F.col("action") == "stop_and_listen", F.concat(
                F.lit("yielded at "), F.format_string("%.2f", F.col("effective_ms") / 1000),
                F.lit(" s ("), ms("unsaid_ms"), F.lit(" ms unspoken)")))
            .when(F.col("action") == "keep_talking", "held the floor")
            .otherwise("held the floor, input ignored"))
    return o.withColumn("consequence", text).drop("next_user", "next_at", "line_end", "end_ms")


def timeline_points(outcomes: DataFrame, missed: DataFrame, seg: DataFrame, agents) -> DataFrame:
    """Every decision point of a call in time order, with what each agent did there, or that it never came to decide.

    outcomes: (agent, call_id, seg, event, action, want, want_route, want_escalate, ok, decided_at_ms); missed: (agent, call_id, seg,
    over_agent, want, counts). A point's time is the earliest decision, or its line's end where no agent decided; ties go by line,
    speech over the agent first. Per agent: its action, ok (NULL: nothing was expected, or no decision) and whether the miss counts.
    """
    o = outcomes.select("agent", "call_id", "seg", "event", "action", "want", "want_route", "want_escalate", "ok", "decided_at_ms",
                        F.lit(None).cast("boolean").alias("counts"))
    m = missed.select("agent", "call_id", "seg", F.when(F.col("over_agent"), OVER).otherwise(PAUSE).alias("event"), "want", "counts")
    both = o.unionByName(m, allowMissingColumns=True)
    own = [F.max(F.when(F.col("agent") == a, F.col(c))).alias(f"{a}_{n}" if n else a)
           for a in agents for c, n in (("action", ""), ("ok", "ok"), ("counts", "missed"))]
    wants = [F.max(c).alias(c) for c in ("want", "want_route", "want_escalate")]
    g = both.groupBy("call_id", "seg", "event").agg(*wants, F.min("decided_at_ms").alias("_first"), *own)
    g = g.join(seg.select("call_id", "seg", "end_ms"), ["call_id", "seg"])
    s = g.withColumns({"t_ms": F.coalesce("_first", F.col("end_ms").cast("double")),
                       "_o": F.when(F.col("event") == OVER, 0).otherwise(1)}).drop("_first", "end_ms")
    return chunk_scan(s, ["call_id"], ["t_ms", "seg", "_o"], SCAN_MS, cumsum={"point": F.lit(1).cast("bigint")}).drop("_o")


def script_violations(seg: DataFrame, expect: DataFrame) -> DataFrame:
    """(call_id, seg, rule): overlapping lines of one speaker, the agent starting while the user
    speaks, duplicate expectations, expectations off user segments, routes at speech-over."""
    w = ["call_id", "who"]
    s = chunk_scan(seg.select("call_id", "seg", "who", "at_ms", "end_ms"), w, "seg", 4096,
                   lag={"prev_end": F.col("end_ms")})
    overlap = s.where("prev_end > at_ms").select("call_id", "seg", F.lit(
        "same speaker overlaps").alias("rule"))
    order = chunk_scan(seg.select("call_id", "seg", "at_ms"), ["call_id"], "seg", 4096,
                       lag={"prev_at": F.col("at_ms")}).where("prev_at > at_ms").select(
        "call_id", "seg", F.lit("starts not in order").alias("rule"))
    agents = seg.where("who = 'agent'").select("call_id", "seg", F.col("at_ms").alias("at"))
    users = seg.where("who = 'user'").select("call_id", F.col("at_ms").alias("s"),
                                             F.col("end_ms").alias("e"))
    barge = covering(agents, users, "call_id", "at", "s", "e", width=BUCKET_MS).select(
        "call_id", "seg", F.lit("agent starts while the user speaks").alias("rule")).distinct()
    twice = expect.groupBy("call_id", "seg", "over_agent").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("call_id", "seg", F.lit("more than one expectation").alias("rule"))
    astray = expect.join(seg.where("who = 'user'").select("call_id", "seg"), ["call_id", "seg"],
                         "left_anti").select("call_id", "seg", F.lit(
                             "expectation is not on a user segment").alias("rule"))
    routed = expect.where("over_agent AND route IS NOT NULL").select(
        "call_id", "seg", F.lit("a route is only decided at a pause").alias("rule"))
    out = overlap
    for d in (order, barge, twice, astray, routed):
        out = out.unionByName(d)
    return out


def timing_violations(seg: DataFrame, expect: DataFrame, budgets: dict, cfg: Policy = Policy(),
                      naive_ms: int = K.NAIVE_SILENCE_MS) -> DataFrame:
    """(call_id, seg, event, problem): recordings whose timing does not show what is wanted."""
    acts, lines = wanted_acts(seg, expect, budgets, cfg)
    o = score_acts(acts, expect)
    first_word = (F.col("at_ms") + F.col("dur_ms") / F.size(F.split(F.trim("text"), r"\s+")))
    words = seg.where("who = 'agent'").select("call_id", F.col("seg").alias("line"),
                                              first_word.alias("first_word"))
    over = speech_over_agent(seg).select("call_id", "seg", "line", "onset", "line_end").join(
        words, ["call_id", "line"])
    starts = seg.select("call_id", F.col("at_ms").alias("next_at"), F.col("seg").alias("i"), "who")
    first_at = starts.groupBy("call_id", "next_at").agg(F.min_by("who", "i").alias("next_who"))
    ends = seg.where("who = 'user'").select("call_id", "seg", "end_ms")
    nxt = next_starts(seg).join(ends, ["call_id", "seg"]).join(first_at, ["call_id", "next_at"],
                                                               "left")
    j = o.join(over.drop("line"), ["call_id", "seg"], "left").join(nxt, ["call_id", "seg"])
    gap = F.col("next_at") - F.col("end_ms")
    floor = cfg.vad_pause_ms + float(budgets[PAUSE])
    at_over = F.col("event") == OVER
    problems = F.when(F.col("want").isNull(), F.array(F.lit("no expectation"))).when(
        at_over, F.array_compact(F.array(
            F.when(F.col("onset") < F.col("first_word"), "before the agent's first word"),
            F.when(F.col("effective_ms") >= F.col("line_end"), "decision lands after the line")))
    ).when(F.col("want") == "keep_listening", F.array_compact(F.array(
        F.when(F.col("next_at").isNull() | (F.col("next_who") != "user"), "the user must speak next")
        .when(~((gap > naive_ms) & (gap < cfg.max_wait_ms) & (gap >= floor)),
              "mid-thought gap out of range")))
    ).otherwise(F.array_compact(F.array(
        F.when(F.col("next_at").isNotNull() & (F.col("next_who") != "agent"),
               "the agent must speak next").when(gap < cfg.max_wait_ms, "reply before max wait"))))
    found = j.select("call_id", "seg", "event", F.explode(problems).alias("problem"))
    m = missed_points(acts, lines, expect, seg).select(
        "call_id", "seg", F.when(F.col("over_agent"), OVER).otherwise(PAUSE).alias("event"),
        F.lit("no decision point").alias("problem"))
    return found.unionByName(m)


def decision_budgets(latency: DataFrame, rows: dict, config: dict) -> DataFrame:
    """(event, budget_ms) from the p50 of each event's latency row; another configuration fails."""
    event = None
    for e, r in rows.items():
        event = F.when(F.col("row") == r, e) if event is None else event.when(F.col("row") == r, e)
    ok = F.lit(True)
    for c, v in config.items():
        ok = ok & F.col(c).eqNullSafe(F.lit(v))
    checked = F.when(ok, True).otherwise(F.raise_error(F.concat(
        F.col("row"), F.lit(" is not the served configuration"))).cast("boolean"))
    return latency.withColumn("event", event).where(F.col("event").isNotNull() & checked).select(
        "event", F.col("p50").alias("budget_ms"))


def replay_summary(outcomes: DataFrame, missed: DataFrame, diverging: DataFrame, expect: DataFrame) -> DataFrame:
    """(agent, ok, points, expected, divergences, passes, compute_p50, compute_max) over all calls.

    `expected` counts the scripts' expected decision points. An outcome's compute_ms is the measured time of its forward pass, NULL
    or 0 where there was none; an agent without passes has NULL there.
    """
    s = agent_score(outcomes, missed).where("level = 1").select("agent", "ok", "points")
    from colloquy.operators.scale import attach_row, exact_quantiles

    ran = outcomes.where("compute_ms <> 0")
    q = exact_quantiles(ran, ["agent"], "compute_ms", (0.5,)).select("agent", F.col("n").alias("passes"), F.get("q", F.lit(0)).alias("compute_p50"))
    top = ran.groupBy("agent").agg(F.max("compute_ms").alias("compute_max"))
    s = s.join(q.join(top, "agent"), "agent", "left").na.fill(0, ["passes"])
    counted = attach_row(s, expect.agg(F.count(F.lit(1)).alias("expected")))
    return attach_row(counted, diverging.agg(F.count(F.lit(1)).alias("divergences")))
