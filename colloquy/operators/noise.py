"""Recogniser-like noise on the user's words, keyed by (seed, id, level, field, word)."""
from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, text as T
from colloquy.functions.probs import let
from colloquy.operators.scale import attach_row


def top_vocab(texts: DataFrame, n: int = K.NOISE_VOCAB) -> DataFrame:
    """(word, n): the n most common normalised words, ties by word."""
    w = texts.select(T.normalize_any(F.col("text")).alias("_n")).select(F.explode(T.words(F.col("_n"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def vocab_row(vocab: DataFrame) -> DataFrame:
    """The vocabulary (at most its fixed size) as one ordered array."""
    return vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("k"), "word"))), lambda s: s["word"]).alias("vocab"))


def asr_noise(text: Column, row_id: Column, level: Column, vocab: Column, seed, field: str | Column
              ) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    key = F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), level.cast("string"), f)

    def draw(part):
        return F.md5(F.concat_ws(":", key, part))

    def word(w, i):
        def chosen(h):
            swap = F.get(vocab, (H.hex_int(h, 9, 8) % F.size(vocab)).cast("int"))
            return let(H.unit32(h), lambda u: F.when(u < level / 2, F.lit(None)).when(
                u < level, swap).otherwise(w))

        return let(draw(i.cast("string")), chosen)

    def cut(kept):
        size = F.size(kept)
        drop = let(draw(F.lit("tail")), lambda h: F.when(
            (size > 0) & (H.unit32(h) < level), 1 + H.hex_int(h, 9, 8) % F.greatest(
                F.least(F.lit(2), size), F.lit(1))).otherwise(0).cast("int"))
        return F.array_join(F.slice(kept, F.lit(1), size - drop), " ")

    def noisy(words):
        kept = F.filter(F.transform(words, word), lambda w: w.isNotNull())
        return F.when(level <= 0, F.array_join(words, " ")).otherwise(let(kept, cut))

    return let(let(T.normalize_text(text), T.words), noisy)


def noisy_rows(examples: DataFrame, vocab: DataFrame, seed=K.SPLIT_SEED, levels=K.NOISE_LEVELS
               ) -> DataFrame:
    """Each example at every noise level. Only the user's words change, never the agent's."""
    d = attach_row(examples.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))),
                   vocab_row(vocab))
    v, lv = F.col("vocab"), F.col("level")
    turns = F.transform("recent_turns", lambda t, i: F.struct(
        t["speaker"].alias("speaker"), F.when(t["speaker"] == "user", asr_noise(
            t["text"], F.col("id"), lv, v, seed, F.concat(F.lit("turn"), i.cast("string"))
        )).otherwise(t["text"]).alias("text")))
    return d.withColumn("recent_turns", turns).withColumn("user_partial", asr_noise(
        F.col("user_partial"), F.col("id"), lv, v, seed, "user")).drop("vocab")
