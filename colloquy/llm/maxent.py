"""A hashed maximum-entropy language model with a class-factored softmax."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import dropped, saved
from colloquy.llm.dictionary import counted_words, local_ids, packed, unpacked, with_answers, word_blocks

#: Outputs of both softmaxes: classes, and words of a class.
WIDTH = 64
#: Classes of frequent words (the first one's first word is the end); the others hold the remaining words by their ending.
FREQUENT = 40
ENDINGS = WIDTH - FREQUENT
#: Words of the frequent classes, end included. Longer words than LONGEST bytes are never among them.
HEAD = FREQUENT * WIDTH
LONGEST = 64
#: Rows of either weight matrix; features are hashed to them.
ROWS = 8192
#: Each round learns from its own share of the documents, all documents once in all.
ROUNDS = 3
BATCH, RATE = 4096, 1.0
#: Rows that a batch meets more often than this are summed by a matrix product; up to FEW times, pass by pass.
OFTEN, FEW = 400, 4
#: Weight rows travel in chunks of this many.
CHUNK = 512
START = HEAD + ENDINGS


@dataclass
class Model:
    """Weights of class and word features, per row the sum of squared gradients, and the log probabilities without features."""
    weights: np.ndarray  # 2 ROWS x WIDTH: class features, then word features
    squares: np.ndarray  # 2 ROWS
    classes: np.ndarray  # WIDTH
    words: np.ndarray  # FREQUENT x WIDTH


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def feature_rows(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """3 x n hashes of every token's history: the word before, the one before that (a skip), and both as a pair."""
    def back(k: int) -> np.ndarray:
        out = np.full(len(codes), START, np.uint64)
        at = np.flatnonzero(place >= k)
        out[at] = codes[at - k]
        return out

    a, b = back(1), back(2)
    width = np.uint64(START + 1)
    return np.stack([a, b + width, (a + np.uint64(1)) * width * np.uint64(4) + b])


def hashed(features: np.ndarray, salt) -> np.ndarray:
    x = (features * np.uint64(64) + np.asarray(salt, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(ROWS)).astype(np.int64)


def logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(weights, rows[0], axis=0)
    more = np.empty_like(z)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=more, mode="clip")
        z += more
    z += bias
    return z


def exponents(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of every output's logit, tokens x WIDTH, and their sums; logits that might leave the range of floats are shifted first."""
    z, ones = logits(bias, weights, rows), np.ones(WIDTH, np.float32)
    wide = z.max(initial=0) > 40
    if not wide:
        np.exp(z, out=z)
        sums = z @ ones
        wide = sums.min(initial=1) < 1e-15  # as it is in any row without a logit over -40
        if wide:
            z = logits(bias, weights, rows)
    if wide:
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        sums = z @ ones
    return z, sums


def softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z, sums = exponents(bias, weights, rows)
    z /= sums[:, None]
    return z


def class_and_word(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code's class and its place there; a word of an ending's class has place -1."""
    head = codes < HEAD
    return np.where(head, codes // WIDTH, FREQUENT + codes - HEAD), np.where(head, codes % WIDTH, -1)


def log10_given(model: Model, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 of P(class | history) P(word | class, history); for a word of an ending's class of the first factor alone."""
    out = np.empty(len(codes))
    for i in range(0, len(codes), BATCH):
        lo = max(0, i - 2)
        features = feature_rows(codes[lo:i + BATCH], place[lo:i + BATCH])[:, i - lo:]
        kind, word = class_and_word(codes[i:i + BATCH])
        n = np.arange(len(kind))
        z, sums = exponents(model.classes, model.weights, hashed(features, 63))
        p = z[n, kind].astype(np.float64) / sums
        head = np.flatnonzero(word >= 0)
        if len(head):
            z, sums = exponents(model.words[kind[head]], model.weights, ROWS + hashed(features[:, head], kind[head]))
            p[head] *= z[np.arange(len(head)), word[head]].astype(np.float64) / sums
        out[i:i + BATCH] = np.log10(np.maximum(p, 1e-30))
    return out


def row_sums(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sum, n): the gradients of a batch summed by weight row; rows are features x tokens. A row met often is summed by a product
    of matrices, one met up to FEW times by adding its first, second, … gradients, each row once a pass, the others one after the other."""
    size = rows.shape[1]
    short = rows.ravel().astype(np.uint16)  # 2 ROWS fit, and short integers sort by radix
    order = np.argsort(short, kind="stable")
    flat, token = short[order], order % size
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    n = np.diff(np.concatenate([starts, [len(flat)]]))
    by_count = np.argsort(-n, kind="stable")
    falling = -n[by_count]
    hot = by_count[:np.searchsorted(falling, -OFTEN, "left")]
    sums = np.take(gradient, token[starts], axis=0)
    if len(hot):
        met = np.repeat(np.arange(len(hot)), n[hot])
        at = np.concatenate([token[starts[h]:starts[h] + n[h]] for h in hot])
        sums[hot] = np.bincount(met * size + at, minlength=len(hot) * size).reshape(len(hot), size).astype(np.float32) @ gradient
    for turn in range(1, FEW):
        few = by_count[np.searchsorted(falling, -FEW, "left"):np.searchsorted(falling, -turn, "left")]
        sums[few] += np.take(gradient, token[starts[few] + turn], axis=0)
    rest = by_count[len(hot):np.searchsorted(falling, -FEW, "left")]
    if len(rest):
        first = np.cumsum(n[rest]) - n[rest]
        at = np.repeat(starts[rest] - first, n[rest]) + np.arange(n[rest].sum())
        sums[rest] = np.add.reduceat(np.take(gradient, token[at], axis=0), first, axis=0)
    return flat[starts].astype(np.int64), sums, n


def step(model: Model, touched: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One descent step on the weight rows of a batch, each scaled by the row's past squares."""
    found, sums, n = row_sums(rows, gradient)
    squares = model.squares[found] + np.einsum("ij,ij->i", sums, sums)
    model.squares[found] = squares
    sums *= (RATE / np.sqrt(squares + 1.0)).astype(np.float32)[:, None]
    model.weights[found] -= sums
    touched[found] += n


def learn_from(model: Model, touched: np.ndarray, codes: np.ndarray, place: np.ndarray) -> None:
    """Gradient steps over a run of documents, batch by batch."""
    for i in range(0, len(codes), BATCH):
        lo = max(0, i - 2)
        features = feature_rows(codes[lo:i + BATCH], place[lo:i + BATCH])[:, i - lo:]
        kind, word = class_and_word(codes[i:i + BATCH])
        n = np.arange(len(kind))
        rows = hashed(features, 63)
        p = softmax(model.classes, model.weights, rows)
        p[n, kind] -= 1
        head = np.flatnonzero(word >= 0)
        if len(head):
            below = ROWS + hashed(features[:, head], kind[head])
            q = softmax(model.words[kind[head]], model.weights, below)
            q[np.arange(len(head)), word[head]] -= 1
            step(model, touched, below, q)
        step(model, touched, rows, p)


def places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 … within each document."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(starts, lengths)


def coded(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
    return unpacked(batch.column("codes")[i].as_py(), int(lengths.sum())), lengths


_PARTS = "chunk int, learner long, touched binary, squares binary, delta binary"


def trained_round(encoded: DataFrame, model: Model, turn: int) -> Model:
    """The model after one round. Each task learns on from `model` over its blocks' documents of this turn; what its steps added
    to a row counts by how often it met the row. The matrices have a fixed size, so tasks send, and the driver keeps, no more than that."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(model.weights.copy(), model.squares.copy(), model.classes, model.words)
        touched, first = np.zeros(2 * ROWS), None
        for batch in batches:
            for i in range(batch.num_rows):
                codes, lengths = coded(batch, i)
                first = batch.column("block")[i].as_py() if first is None else first
                chosen = batch.column("slots")[i].values.to_numpy() == turn
                learn_from(mine, touched, codes[np.repeat(chosen, lengths)], places(lengths[chosen]))
        delta, squares = mine.weights - model.weights, mine.squares - model.squares
        for c in range(0, 2 * ROWS, CHUNK):
            if touched[c:c + CHUNK].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), pa.array([first], pa.int64())]
                    + [pa.array([x[c:c + CHUNK].tobytes()], pa.binary()) for x in (touched.astype("<f4"), squares.astype("<f4"), delta.astype("<f4"))],
                    ["chunk", "learner", "touched", "squares", "delta"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, s = (np.frombuffer(r[x], "<f4").astype(np.float64)[:, None] for x in ("touched", "squares"))
                d = np.frombuffer(r["delta"], "<f4").reshape(-1, WIDTH)
                old = sums.get(r["chunk"], (0.0, 0.0, 0.0))
                sums[r["chunk"]] = (old[0] + n, old[1] + n * s, old[2] + n * d)
        for c, (n, s, d) in sums.items():
            over = np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([0], pa.int64())]
                + [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (n, s / over, d / over)], ["chunk", "learner", "touched", "squares", "delta"])

    read = encoded.select("block", "slots", "lengths", "codes")
    # sorted, so that sums, and with them reruns, agree
    added = read.mapInArrow(learn, _PARTS).repartition("chunk").sortWithinPartitions("chunk", "learner").mapInArrow(merge, _PARTS)
    out = Model(model.weights.copy(), model.squares.copy(), model.classes, model.words)
    for r in added.collect():
        rows = slice(r["chunk"], r["chunk"] + CHUNK)
        out.weights[rows] += np.frombuffer(r["delta"], "<f4").reshape(-1, WIDTH)
        out.squares[rows] += np.frombuffer(r["squares"], "<f4")
    return out


@dataclass
class Counts:
    """What is known of the training tokens: N, V, and per code its tokens, distinct words and discount."""
    tokens: int
    distinct: int
    ends: int
    n: np.ndarray
    kinds: np.ndarray
    discount: np.ndarray


def training_counts(words: DataFrame, docs: int) -> Counts:
    """From the coded words (word, c, code), HEAD + ENDINGS rows at most, and the number of training documents, each with one end."""
    n, kinds, discount = np.zeros(START), np.zeros(START), np.full(START, 0.5)
    rows = words.groupBy("code").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("kinds"), F.count_if(F.col("c") == 1).alias("once"),
                                     F.count_if(F.col("c") == 2).alias("twice")).collect()
    for r in rows:
        n[r["code"]], kinds[r["code"]] = r["n"], r["kinds"]
        if r["once"]:
            discount[r["code"]] = min(max(r["once"] / (r["once"] + 2 * r["twice"]), 0.1), 0.9)
    n[0], kinds[0] = docs, min(docs, 1)
    return Counts(int(n.sum()), int(kinds.sum()), docs, n, kinds, discount)


def untrained(counts: Counts) -> Model:
    """No features: classes and words by their counts, a half added to each that may occur: words that were seen, the end, and any ending."""
    seen = counts.kinds[:HEAD] > 0
    seen[0] = True
    held = seen.reshape(FREQUENT, WIDTH)
    head = counts.n[:HEAD].reshape(FREQUENT, WIDTH)
    classes = np.concatenate([np.where(held.any(axis=1), head.sum(axis=1) + 0.5, 0.0), counts.n[HEAD:] + 0.5])
    classes = np.where(classes > 0, np.log(np.maximum(classes, 0.5) / classes.sum()), -1e4)
    words = np.where(held, np.log(head + 0.5), -1e4)
    top = words.max(axis=1, keepdims=True)
    words = words - top - np.log(np.exp(words - top).sum(axis=1, keepdims=True))
    return Model(np.zeros((2 * ROWS, WIDTH), np.float32), np.zeros(2 * ROWS), classes.astype(np.float32), words.astype(np.float32))


def encoder(counts: Counts):
    """A block's words as codes, with each document's known words, base score and log10 P(word | ending's class)."""
    whole = counts.tokens + 0.5 * (counts.distinct + 1)

    def encode(block: pa.RecordBatch, answers: dict[str, np.ndarray]) -> pa.RecordBatch:
        ids, lengths, size = local_ids(block)
        c, code = np.zeros(size), np.zeros(size, np.int64)
        if size:
            c[answers["pos"]], code[answers["pos"]] = answers["word"] // START, answers["word"] % START
        of, spread, lost = counts.n[code], counts.kinds[code], counts.discount[code]
        base = np.log10((c + 0.5) / whole)
        tail = np.where(c > 0, c - lost, lost * spread) / np.maximum(of, 1)
        tail = np.where(code < HEAD, 0.0, np.log10(np.where(of > 0, tail, 1.0)))
        ends = np.cumsum(lengths)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[ids])])[np.concatenate([[0], ends])])
        codes = np.insert(code[ids], ends, 0)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (
            (lengths + 1).astype(np.int32), total((c > 0).astype(np.int64)) + (counts.ends > 0), total(base) + np.log10((counts.ends + 0.5) / whole), total(tail))]
        return pa.RecordBatch.from_arrays([block.column("block"), block.column("docs"), block.column("slots"), *lists, pa.array([packed(codes)], pa.binary())],
                                          ["block", "docs", "slots", "lengths", "known", "base", "tail", "codes"])

    return encode


def score_texts(docs: DataFrame, doc: str, text: str, held_out) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The documents for which `held_out` (a Column) is not true teach: all of them, each once, in ROUNDS rounds of local
    gradient steps whose results are averaged. `score` is log10 P(text), the end included; the probabilities of all words, known
    or not, sum to 1 after every history. A frequent word has a class of WIDTH words, with features for both factors;
    any other word a class by the CRC-32 of its last two characters, where known words share by discounted count and all unknown
    ones together get what the discounts free. Word counts stay in Spark and grow with the corpus; the model's size is fixed.
    Null and empty texts consist of the end alone. Repeated rows each count. A null id is scored like any other. Without
    training documents all words are unknown. An empty table gives an empty result. Other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(False))
    slot = F.when(held, -1).otherwise(F.pmod(F.xxhash64(F.col(doc)), F.lit(ROUNDS))).cast("int")
    rows = docs.select(F.lit("").alias("group"), F.col(doc).alias("doc"), slot.alias("slot"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    blocks = word_blocks(rows, tokens)
    counted = counted_words(blocks)
    totals = counted.where("first")
    head = totals.where((F.col("c") > 0) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(HEAD - 1)
    head = head.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "word"))).alias("w")).select(F.posexplode("w").alias("rank", "w"))
    head = F.broadcast(head.select(F.col("w.word").alias("word"), (F.col("rank") + 1).alias("rank")))  # HEAD words of LONGEST bytes at most
    ending = HEAD + F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(ENDINGS))
    words = counted.join(head, "word", "left").withColumn("code", F.coalesce("rank", ending).cast("int"))
    taught = blocks.agg(F.sum(F.size(F.filter("slots", lambda s: s >= 0)))).first()[0] or 0
    counts = training_counts(words.where("first"), taught)
    answers = words.select("block", F.col("pos").cast("int").alias("pos"), (F.col("c") * START + F.col("code")).alias("word"))  # one number for both
    encoded = saved(with_answers(blocks.select("block", "words", "docs", "slots", "lengths", "ids"), answers, encoder(counts),
                                 f"block long, docs array<{kind}>, slots array<int>, lengths array<int>, known array<long>, base array<double>, tail array<double>, codes binary"))
    dropped(blocks)
    dropped(counted)
    model = untrained(counts)
    for turn in range(ROUNDS if taught else 0):
        model = trained_round(encoded, model, turn)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, lengths = coded(batch, i)
                given = np.concatenate([[0], np.cumsum(log10_given(model, codes, places(lengths)))])
                sums = np.diff(given[np.concatenate([[0], np.cumsum(lengths)])])
                listed = {c: batch.column(c)[i].values for c in ("docs", "slots", "known", "base", "tail")}
                yield pa.RecordBatch.from_arrays(
                    [listed["docs"], pa.array(listed["slots"].to_numpy() < 0), pa.array(lengths), listed["known"],
                     pa.array(np.full(len(lengths), counts.tokens)), listed["base"], pa.array(sums + listed["tail"].to_numpy())],
                    ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = encoded.mapInArrow(score, f"doc {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc", doc)
