"""Who holds the floor: runs, floor turns, turn-so-far, history and the decision examples.

Input utterances: (conv_id, idx, caller, act, text, norm, claims, ends_unit, abandoned); `idx`
orders a conversation. Sequence state is computed with `chunk_scan`, so one very long conversation
is spread over many tasks. `turn_no` counts floor turns (maximal runs of one caller among claiming
utterances); `stint` is the number of floor turns that were over when the row's caller took or will
take the floor; `anchor` is the idx of the last claim by anybody else (-1: none).
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, text as T
from colloquy.operators.scale import chunk_scan

CONV = ["conv_id"]
HISTORY_BLOCK = 512
TURN_CHUNK = 256


def speaker_runs(u: DataFrame, width: int) -> DataFrame:
    s = chunk_scan(u, CONV, "idx", width, lag={"prev_caller": F.col("caller")},
                   keep_chunk=True)
    new = F.col("prev_caller").isNull() | (F.col("prev_caller") != F.col("caller"))
    return chunk_scan(s, CONV, "idx", width, cumsum={"run_id": new.cast("bigint")})


def annotate(u: DataFrame, width: int) -> DataFrame:
    """Adds neighbours, run_id, turn_no, turn_caller, stint and anchor."""
    claimed_by = F.when(F.col("claims"), F.col("caller"))
    s = chunk_scan(u, CONV, "idx", width, lag={"prev_caller": F.col("caller")},
                   lead={"next_caller": F.col("caller")},
                   last_before={"prev_claimer": claimed_by,
                                "prev_claim_idx": F.when(F.col("claims"), F.col("idx"))},
                   next_after={"next_claim_idx": F.when(F.col("claims"), F.col("idx"))},
                   keep_chunk=True)
    new_run = F.col("prev_caller").isNull() | (F.col("prev_caller") != F.col("caller"))
    new_turn = F.col("claims") & (F.col("prev_claimer").isNull()
                                  | (F.col("prev_claimer") != F.col("caller")))
    s = s.withColumn("new_turn", new_turn.cast("bigint"))
    before = F.coalesce("prev_claim_idx", F.lit(-1).cast("bigint"))
    s = chunk_scan(s, CONV, "idx", width, cumsum={"run_id": new_run.cast("bigint"),
                                                  "turn_no": F.col("new_turn")},
                   last_before={"_opened": F.when(F.col("new_turn") == 1, before)})
    s = s.withColumn("turn_caller", F.when(F.col("claims"), F.col("caller")).otherwise(
        F.col("prev_claimer")))
    holds = F.coalesce(F.col("turn_caller") == F.col("caller"), F.lit(False))
    anchor = F.when(F.col("new_turn") == 1, before).when(holds, F.col("_opened")).otherwise(before)
    return s.withColumn("stint", F.col("turn_no") - holds.cast("bigint")).withColumn(
        "anchor", anchor).drop("_opened", "prev_claim_idx")


def _ordered(idx: str, value: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col(value).alias("t"))))


def _said(rows: Column) -> Column:
    return F.array_join(F.transform(F.filter(rows, lambda r: r["t"] != ""), lambda r: r["t"]), " ")


def floor_turns(ann: DataFrame) -> DataFrame:
    """(conv_id, turn_no, caller, text, first_idx, last_idx, parts)."""
    g = ann.where("claims").groupBy("conv_id", "turn_no").agg(
        F.first("caller").alias("caller"), _ordered("idx", "text").alias("parts"),
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return g.withColumn("text", _said(F.col("parts")))


def current_turn(ann: DataFrame, width: int = TURN_CHUNK) -> DataFrame:
    """Everything the row's caller has said since the other side's last claim, row included.

    Rows are joined within chunks of `width` places; each chunk is handed the text of the turn's chunks before it, so a long
    turn is many tasks and only one row a chunk meets in one.
    """
    turn = ["conv_id", "caller", "anchor"]
    d = ann.withColumn("_chunk", F.floor(F.col("idx") / F.lit(width)))
    w = Window.partitionBy(*turn, "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("text") != "", F.col("text"))
    inside = d.withColumn("_in", F.array_join(F.collect_list(said).over(w), " ")).withColumn("_first", F.min("idx").over(w))
    chunks = d.groupBy(*turn, "_chunk").agg(_said(_ordered("idx", "text")).alias("_all"), F.min("idx").alias("_least"))
    before = Window.partitionBy(*turn).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*turn, "_chunk", F.array_join(F.collect_list(F.when(F.col("_all") != "", F.col("_all"))).over(before), " ").alias("_past"),
                           F.min("_least").over(before).alias("_start"))
    a, b = inside.alias("a"), chunks.alias("b")
    same = F.lit(True)
    for c in (*turn, "_chunk"):
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    text = F.concat_ws(" ", F.nullif(F.col("b._past"), F.lit("")), F.nullif(F.col("a._in"), F.lit("")))
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in ann.columns], text.alias("turn_text"), F.least("b._start", "a._first").alias("turn_start"))


def turn_history(turns: DataFrame, keep: int = K.MAX_HISTORY_TURNS + 1) -> DataFrame:
    """(conv_id, turn_no, past): the last `keep` floor turns up to and including turn_no.

    Blocks of turns with a halo of `keep - 1` rows: bounded windows, one shuffle.
    """
    home = F.floor(F.col("turn_no") / HISTORY_BLOCK)
    near_end = F.col("turn_no") % HISTORY_BLOCK > HISTORY_BLOCK - keep
    t = turns.select("conv_id", "turn_no", "caller", "text", home.alias("home"), F.explode(
        F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"))
    w = Window.partitionBy("conv_id", "block").orderBy("turn_no").rowsBetween(-(keep - 1), 0)
    return t.withColumn("past", F.collect_list(F.struct("turn_no", "caller", "text")).over(w)
                        ).where("home = block").select("conv_id", "turn_no", "past")


def _roles(past: Column, user: Column) -> Column:
    return F.transform(past, lambda t: F.struct(
        F.when(t["caller"] == user, "user").otherwise("agent").alias("speaker"),
        t["text"].alias("text")))


def last_turns(turns: Column, n: int) -> Column:
    return F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), n)


def with_history(points: DataFrame, turns: DataFrame, upto: str, user: str, *,
                 split_agent: bool = True, max_turns: int = K.MAX_HISTORY_TURNS) -> DataFrame:
    """Adds recent_turns (and agent_last) from the floor turns up to number `upto`."""
    past = turn_history(turns, max_turns + 1).withColumnRenamed("turn_no", upto)
    p = points.join(past, ["conv_id", upto], "left")
    empty = F.array().cast("array<struct<turn_no:bigint,caller:string,text:string>>")
    roles = _roles(F.coalesce(F.col("past"), empty), F.col(user))
    if not split_agent:
        return p.withColumn("recent_turns", last_turns(roles, max_turns)).drop("past")
    p = p.withColumn("_r", roles).drop("past")
    tail = F.try_element_at("_r", F.lit(-1))
    is_agent = F.coalesce(tail["speaker"] == "agent", F.lit(False))
    kept = F.when(is_agent, F.slice("_r", 1, F.greatest(F.size("_r") - 1, F.lit(0)))
                  ).otherwise(F.col("_r"))
    return p.withColumn("agent_last", F.when(is_agent, tail["text"]).otherwise("")).withColumn(
        "recent_turns", last_turns(kept, max_turns)).drop("_r")


def history_before(ann: DataFrame) -> DataFrame:
    """Every claiming utterance with the history its caller had when taking the floor."""
    pts = ann.where("claims").select("conv_id", "idx", "caller", "stint")
    return with_history(pts, floor_turns(ann), "stint", "caller")


def turn_complete_examples(ann: DataFrame, width: int) -> DataFrame:
    """complete / continuation examples at each change of caller after a claiming utterance."""
    s = chunk_scan(ann, ["conv_id", "caller"], "idx", width,
                   lead={"next_own_idx": F.col("idx"), "next_own_act": F.col("act")})
    answered = F.col("next_claim_idx").isNotNull() & (
        F.col("next_own_idx").isNull() | (F.col("next_claim_idx") < F.col("next_own_idx")))
    kind = F.when(answered & F.col("ends_unit"), "complete").when(
        ~answered & ~F.col("ends_unit") & ~F.col("abandoned")
        & (F.col("next_own_act") == K.CONTINUATION_TAG), "continuation")
    pts = s.where(F.col("claims") & (F.col("next_caller") != F.col("caller"))).withColumn(
        "kind", kind).where(F.col("kind").isNotNull())
    pts = pts.select("conv_id", "idx", "caller", "stint", "anchor", "kind", F.col("text").alias("last_text"))
    own = ann.groupBy("conv_id", "caller", "anchor").agg(_ordered("idx", "text").alias("own"))
    p = pts.join(own, ["conv_id", "caller", "anchor"])
    p = p.withColumn("before", _said(F.filter("own", lambda r: r["idx"] < F.col("idx")))).drop("own")
    p = p.withColumn("user_partial", F.trim(F.concat_ws(" ", "before", "last_text")))
    p = with_history(p, floor_turns(ann), "stint", "caller")
    return p.where(T.normalize_text(F.col("user_partial")) != "").withColumn(
        "label", F.when(F.col("kind") == "complete", "true").otherwise("false"))


def truncations(complete: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Each complete turn cut at a keyed word boundary inside its last utterance."""
    n = T.n_words(F.col("last_text"))
    h = H.keyed_md5(seed, "cut", F.col("conv_id"), F.col("idx"))
    keep = (F.lit(1) + H.hex_int(h, 1, 8) % F.greatest(n - 1, F.lit(1))).cast("int")
    head = F.array_join(F.slice(F.split("last_text", " "), F.lit(1), keep), " ")
    cut = complete.where((F.col("kind") == "complete") & (n >= 2)).withColumn(
        "user_partial", F.trim(F.concat_ws(" ", "before", head)))
    return cut.where(T.normalize_text(F.col("user_partial")) != "").withColumn(
        "kind", F.lit("truncation")).withColumn("label", F.lit("false"))


def run_label(tags: Column) -> Column:
    def all_in(allowed):
        return (F.size(tags) > 0) & F.forall(tags, lambda t: t.isin(*allowed))
    return (F.when(F.exists(tags, lambda t: t.isin(*K.INTERRUPTION_TAGS)), "interruption")
            .when(all_in(K.BACKCHANNEL_TAGS), "backchannel")
            .when(all_in(K.NOISE_TAGS), "noise"))


def run_tags(ann: DataFrame) -> DataFrame:
    """(conv_id, run_id, tags in order of first use, label). Tags collapse before the shuffle."""
    first = ann.groupBy("conv_id", "run_id", "act").agg(F.min("idx").alias("at"))
    g = first.groupBy("conv_id", "run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "act"))), lambda s: s["act"]).alias("tags"))
    return g.withColumn("label", run_label(F.col("tags")))


def barge_in_examples(ann: DataFrame, partial_words: int = K.PARTIAL_WORDS) -> DataFrame:
    """Moments where a new run starts while the other caller's current turn has claimed words."""
    starts = ann.where((F.col("prev_caller") != F.col("caller"))
                       & (F.col("act") != K.CONTINUATION_TAG)
                       & (F.col("prev_claimer") == F.col("prev_caller")))
    starts = starts.select("conv_id", "idx", "caller", "run_id",
                           (F.col("turn_no") - F.col("new_turn")).alias("agent_turn"))
    runs = run_tags(ann).where(F.col("label").isNotNull())
    # a non-empty text has a word, so the run's first `partial_words` non-empty texts are enough
    w = Window.partitionBy("conv_id", "run_id").orderBy("idx")
    heads = ann.where(F.col("text") != "").withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= partial_words).groupBy("conv_id", "run_id").agg(
        _said(_ordered("idx", "text")).alias("run_text"))
    turns = floor_turns(ann)
    agent = turns.select("conv_id", F.col("turn_no").alias("agent_turn"), "parts")
    p = starts.join(runs, ["conv_id", "run_id"]).join(heads, ["conv_id", "run_id"], "left").join(
        agent, ["conv_id", "agent_turn"])
    p = p.withColumn("agent_last", _said(F.filter("parts", lambda r: r["idx"] < F.col("idx"))))
    p = p.where(T.normalize_text(F.col("agent_last")) != "").drop("parts")
    p = p.withColumn("before_turn", F.col("agent_turn") - 1)
    p = with_history(p, turns, "before_turn", "caller", split_agent=False)
    return p.select(
        "conv_id", "idx", "caller", "label",
        F.array_join(F.slice("tags", 1, 4), "+").alias("kind"),
        T.first_words(F.coalesce("run_text", F.lit("")), partial_words).alias("user_partial"),
        "agent_last", "recent_turns")


def turn_final_words(examples: DataFrame, min_count: int = K.TURN_FINAL_MIN_COUNT) -> DataFrame:
    """Words that end complete turns at least as often as truncations, from train only."""
    w = T.last_word(T.normalize_text(F.col("user_partial")))
    g = examples.where("split = 'train'").groupBy(w.alias("word")).agg(
        F.count_if(F.col("kind") == "complete").alias("complete"),
        F.count_if(F.col("kind") == "truncation").alias("cut"))
    return g.where((F.col("cut") >= min_count) & (F.col("cut") > 0)).withColumn(
        "ratio", F.col("complete") / F.col("cut")).where("ratio >= 1.0")


def mark_turn_final(examples: DataFrame, words: DataFrame) -> DataFrame:
    e = examples.withColumn("word", T.last_word(T.normalize_text(F.col("user_partial"))))
    j = e.join(words.select("word", F.lit(True).alias("_f")), "word", "left")
    return j.withColumn("hard", (F.col("kind") == "truncation") & F.col("_f").isNotNull()
                        ).drop("_f", "word")


def _prefixes(norm: Column) -> Column:
    w = T.words(norm)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))),
                       lambda i: F.array_join(F.slice(w, F.lit(1), i), " "))


def shared_forms(examples: DataFrame, min_count: int = K.SHARED_FORM_MIN_COUNT,
                 min_share: float = K.SHARED_FORM_MIN_SHARE) -> DataFrame:
    """Forms that both classes use: exact backchannels that also open interruptions (train only)."""
    t = examples.where("split = 'train'").withColumn("n", T.normalize_text(F.col("user_partial")))
    b = t.where("label = 'backchannel' AND n <> ''").groupBy(F.col("n").alias("form")).agg(
        F.count(F.lit(1)).alias("n_b")).where(F.col("n_b") >= min_count)
    i = t.where("label = 'interruption'").select(F.explode(_prefixes(F.col("n"))).alias("form")
                                                 ).groupBy("form").agg(F.count(F.lit(1)).alias("n_i"))
    j = b.join(i, "form").where(F.col("n_i") >= min_count)
    return j.where(F.least("n_b", "n_i") / (F.col("n_b") + F.col("n_i")) >= min_share)


def mark_shared(examples: DataFrame, forms: DataFrame, key: list[str]) -> DataFrame:
    e = examples.withColumn("n", T.normalize_text(F.col("user_partial")))
    tries = e.select(*key, F.explode(F.when(
        F.col("label") == "backchannel", F.array("n")).when(
        F.col("label") == "interruption", _prefixes(F.col("n")))).alias("form"))
    hit = tries.join(forms.select("form"), "form").select(*key).distinct().withColumn(
        "_h", F.lit(True))
    return e.join(hit, key, "left").withColumn("hard", F.col("_h").isNotNull()).drop("_h", "n")
