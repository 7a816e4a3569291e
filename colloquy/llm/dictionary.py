"""Documents as blocks with vocabularies of their own: a word crosses the network once a block, not once an occurrence."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import saved, text_slices, utf8

#: A block ends when its texts reach this size; a single longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: The token that stands for an end of a piece; its id is -1.
BREAK = b"\n"


def packed(x: np.ndarray) -> bytes:
    """Integers from 0 to 2^32 - 1 as four planes of bytes, compressed: most are small, so the high planes nearly vanish."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class LocalIds(dict):
    """Words numbered in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) - 1
        return value


class Block:
    """The documents of one group since the last block was given out."""

    def __init__(self):
        self.ids, self.parts, self.docs, self.slots, self.bytes = LocalIds({BREAK: -1}), [], [], [], 0

    def add(self, doc, slot: int, tokens: list[bytes], size: int) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens)))
        self.docs.append(doc)
        self.slots.append(slot)
        self.bytes += size + 64

    def row(self, group: str, kind: pa.DataType) -> pa.RecordBatch:
        counts = np.zeros(len(self.ids) - 1, np.int64)
        for part, slot in zip(self.parts, self.slots):
            if slot >= 0:
                found, n = np.unique(part, return_counts=True)
                counts[found[found >= 0]] += n[found >= 0]
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        flat = np.concatenate([*self.parts, np.empty(0, np.int32)])
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), one(words), one(pa.array(counts)), one(pa.array(self.docs, kind)), one(pa.array(self.slots, pa.int32())),
             one(pa.array([len(p) for p in self.parts], pa.int32())), pa.array([packed(flat + 1)], pa.binary())],
            ["group", "words", "counts", "docs", "slots", "lengths", "ids"])


def word_blocks(rows: DataFrame, tokens: Callable[[bytes], list[bytes]], limit: int = BLOCK_BYTES) -> DataFrame:
    """(group, doc, slot, text) to (block, group, words, counts, docs, slots, lengths, ids), one row a block, written once.

    `words` are a block's distinct words, `counts` their occurrences in documents of slots from 0 on, `ids` the
    documents' words, one document after the other, as places in `words` from 1 on (0 is a break), packed. Null texts are empty.
    """
    kind = rows.schema["doc"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size, of = {}, 0, pa.int64()
        for batch in batches:
            of = batch.schema.field("doc").type
            for part in text_slices(batch, "text"):
                columns = (part.column(c).to_pylist() for c in ("group", "doc", "slot"))
                for group, doc, slot, text in zip(*columns, utf8(part, "text")):
                    block = blocks.get(group) or blocks.setdefault(group, Block())
                    block.add(doc, slot, tokens(text), len(text))
                    size += len(text) + 64
                    if size >= limit:
                        yield from (b.row(g, of) for g, b in blocks.items())
                        blocks, size = {}, 0
        yield from (b.row(g, of) for g, b in blocks.items())

    packed = rows.select("group", "doc", "slot", "text").mapInArrow(
        pack, f"group string, words array<string>, counts array<long>, docs array<{kind}>, slots array<int>, lengths array<int>, ids binary")
    return saved(packed.select(F.monotonically_increasing_id().alias("block"), "*"))


def counted_words(blocks: DataFrame) -> DataFrame:
    """(block, group, pos, word, c, first): every distinct word of every block with its count over all blocks of the group, and
    whether this block is the word's first; written once. A word has one row a block, so no word has more rows than there are blocks.
    """
    pairs = (blocks.select("block", "group", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
             .select("block", "group", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n")))
    everywhere = Window.partitionBy("group", "word")
    return saved(pairs.select("block", "group", "pos", "word", F.sum("n").over(everywhere).alias("c"),
                              (F.min("block").over(everywhere) == F.col("block")).alias("first")))


def local_ids(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a block's row: its documents' words as places in its words (-1: a break), its documents' lengths, the number of its words."""
    lengths = block.column("lengths")[0].values.to_numpy().astype(np.int64)
    return unpacked(block.column("ids")[0].as_py(), int(lengths.sum())) - 1, lengths, block.column("n_words")[0].as_py()


def with_answers(blocks: DataFrame, answers: DataFrame, encode: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """`encode` on every block (with `n_words` for its words) and the answers (block, pos, …) to its words, as columns in no order.
    Blocks bound both sides."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {c: right.column(c).to_numpy() for c in right.schema.names}
        return pa.Table.from_batches([encode(b.slice(i, 1), columns) for b in left.to_batches() for i in range(b.num_rows)])

    narrow = blocks.withColumn("n_words", F.size("words")).drop("words", "counts")
    return narrow.groupBy("block").cogroup(answers.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(one, schema)
