"""Quality: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import text_slices, utf8
from colloquy.llm.toxicity import sample_of

#: Bytes of a chunk and from one chunk's start to the next one's: neighbours overlap by more than a filter's width.
CHUNK, STRIDE = 256, 240
#: Filters and their width in bytes (even: inference looks bytes up in pairs).
FILTERS, WIDTH = 16, 6
#: Labelled rows to learn from at most, and chunks of each that are drawn evenly over the whole text.
SAMPLE, SAMPLE_CHUNKS = 6_000, 8
STEPS, BATCH, RATE = 600, 128, 0.02
#: Chunks convolved at a time.
BLOCK = 128


def chunks(text: bytes) -> np.ndarray:
    """The text as overlapping rows of CHUNK bytes, the last one filled up with zero bytes; an empty text has one row."""
    n = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


@dataclass
class Network:
    """Filters (WIDTH x 256 x FILTERS: what each byte adds at each place), their bias, and the output weights."""
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    def pairs(self) -> np.ndarray:
        """Tables for two bytes at a time: (WIDTH / 2) x 65,536 x FILTERS."""
        f = self.filters.astype(np.float32)
        return np.stack([(f[o + 1][:, None, :] + f[o][None, :, :]).reshape(-1, f.shape[2]) for o in range(0, WIDTH, 2)])

    def pooled(self, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Per chunk and filter the greatest activation, not below 0."""
        out = np.empty((len(rows), len(self.bias)), np.float32)
        for at in range(0, len(rows), BLOCK):
            block = np.ascontiguousarray(rows[at:at + BLOCK])
            two = block[:, :-1].astype(np.int32) + (block[:, 1:].astype(np.int32) << 8)
            n = CHUNK - WIDTH + 1
            z = pairs[0].take(two[:, :n], axis=0)
            for k in range(1, len(pairs)):
                z += pairs[k].take(two[:, 2 * k:2 * k + n], axis=0)
            out[at:at + BLOCK] = z.max(axis=1)
        return np.maximum(out + self.bias.astype(np.float32), 0)

    def scores(self, texts: list[bytes], pairs: np.ndarray) -> np.ndarray:
        """One probability per text: the mean of its chunks' outputs through the logistic function."""
        logits, held = np.zeros(len(texts)), []
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))

        def flush() -> None:
            if held:
                value = self.pooled(np.concatenate([h[1] for h in held]), pairs).astype(float) @ self.out
                owner = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                sums[:] += np.bincount(owner, value, len(texts))
                counts[:] += np.bincount(owner, minlength=len(texts))
                held.clear()

        for i, text in enumerate(texts):
            rows = chunks(text)
            for at in range(0, len(rows), 8 * BLOCK):
                held.append((i, rows[at:at + 8 * BLOCK]))
                if sum(len(h[1]) for h in held) >= 8 * BLOCK:
                    flush()
        flush()
        logits = sums / np.maximum(counts, 1) + self.base
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def train(texts: list[np.ndarray], good: np.ndarray, seed: int = 7) -> Network:
    """Fit the network to documents given as chunk rows: Adam on the logistic loss, gradients through each filter's best place.

    Filters start as byte sequences of the training texts. One class only: a constant score near its rate.
    """
    rng = np.random.default_rng(seed)
    rate = (good.sum() + 0.5) / (len(good) + 1)
    net = Network(rng.normal(0, 0.05, (WIDTH, 256, FILTERS)), np.full(FILTERS, -0.5 * WIDTH), rng.normal(0, 0.1, FILTERS), float(np.log(rate / (1 - rate))))
    if not len(texts) or good.min() == good.max():
        net.out[:] = 0
        return net
    classes = [np.flatnonzero(good == c) for c in (0, 1)]
    for f in range(FILTERS):
        doc = texts[rng.choice(classes[f % 2])]
        row, at = rng.integers(len(doc)), rng.integers(CHUNK - WIDTH)
        net.filters[np.arange(WIDTH), doc[row, at:at + WIDTH], f] += 1
    params = [net.filters, net.bias, net.out, np.array([net.base])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    while step < STEPS:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            rows = np.concatenate([texts[i] for i in docs])
            size = np.array([len(texts[i]) for i in docs])
            owner = np.repeat(np.arange(len(docs)), size)
            f32, n = net.filters.astype(np.float32), CHUNK - WIDTH + 1
            z = f32[0].take(rows[:, :n], axis=0)
            for o in range(1, WIDTH):
                z += f32[o].take(rows[:, o:o + n], axis=0)
            place = z.argmax(axis=1)
            h = np.maximum(np.take_along_axis(z, place[:, None, :], axis=1)[:, 0] + net.bias, 0)
            mean = np.stack([np.bincount(owner, h[:, f], len(docs)) for f in range(FILTERS)], axis=1) / size[:, None]
            logit = mean @ net.out + params[3][0]
            delta = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - good[docs]) / len(docs)
            dh = (delta / size)[owner][:, None] * net.out * (h > 0)
            df = np.zeros_like(net.filters)
            for o in range(WIDTH):
                byte = np.take_along_axis(rows, place + o, axis=1)
                np.add.at(df[o], (byte, np.arange(FILTERS)[None, :]), dh)
            grads = [df + 1e-5 * net.filters, dh.sum(axis=0), mean.T @ delta + 1e-4 * net.out, np.array([delta.sum()])]
            step += 1
            pace = RATE * (1 - 0.9 * min(1, step / STEPS))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.base = float(params[3][0])
    return net


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, *, sample: int = SAMPLE) -> Network:
    """Train on at most `sample` labelled rows; SAMPLE_CHUNKS chunks of each, drawn evenly over the text, come to the driver."""
    taught = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(sample_of(labels, label_id, label, sample)), F.col("_id") == F.col("_label_id")).select("_id", "_text", "_label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                rows = [chunks(t) for t in utf8(batch, "_text")]
                rows = [r[np.unique(np.linspace(0, len(r) - 1, SAMPLE_CHUNKS).astype(int))] for r in rows]
                yield pa.RecordBatch.from_pydict({"id": batch.column("_id").cast(pa.string()), "label": batch.column("_label"),
                                                  "rows": pa.array([r.tobytes() for r in rows], pa.binary())})

    got = taught.mapInArrow(cut, "id string, label double, rows binary").collect()
    got.sort(key=lambda r: (r.id, r.rows))  # the fit must not depend on the order of arrival
    return train([np.frombuffer(r.rows, np.uint8).reshape(-1, CHUNK) for r in got], np.array([float(r.label > 0.5) for r in got]))


def scored(docs: DataFrame, text: str, network: Network) -> DataFrame:
    """All rows and columns with `score` in 0..1 (higher: more likely good). Whole texts count; null counts as empty.

    Rows do not influence each other; a column named score is replaced. Memory is bounded by blocks of chunks.
    """
    kept = [c for c in docs.columns if c != "score"]
    base = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = network.pairs()
        for whole in batches:
            for batch in text_slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(utf8(batch, text), pairs))], [*kept, "score"])

    return base.mapInArrow(work, schema)
