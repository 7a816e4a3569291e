"""Collocations from counting quotient filters of n-grams."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.common import dropped, mixed, saved
from colloquy.llm.dictionary import local_ids, packed, unpacked, with_answers, word_blocks
from colloquy.operators.scale import range_ranks

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_TOKEN = re.compile(rb"[^ \t\n]+|\n")
#: A filter is given out when it has counted this many n-grams.
FILTER_GRAMS = 2_000_000
#: Filters of 2^MERGE_BITS shards meet in one merge, for a 2^MERGE_BITS-th of their keys.
MERGE_BITS = 8
#: Words of blocks that a task holds before it gives out their numbers.
ANSWERS = 1_000_000
#: N-grams that are packed and permuted at a time.
PACK_GRAMS = 1 << 17
#: Bits of a sieve for each pair in it, the most bits that one has, and those of a chunk of it.
PAIR_BITS, SIEVE_BITS, CHUNK_BITS = 32, 27, 16


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) with a line feed where a piece ends."""
    return _TOKEN.findall(text.lower().translate(_ENDS))


class Packing:
    """n word ids of `bits` bits in limbs of at most 64 bits, and an invertible permutation of the packed keys."""
    ROUNDS = 4

    def __init__(self, n: int, bits: int):
        limbs = max(2, -(-n // (64 // bits)))
        self.n, self.bits = n, bits
        self.places = [list(map(int, p)) for p in np.array_split(np.arange(n), limbs)]
        self.widths = [len(p) * bits for p in self.places]

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for places in self.places:
            limb = np.zeros(len(words[0]), np.uint64)
            for p in places:
                limb = (limb << np.uint64(self.bits)) | words[p].astype(np.uint64)
            out.append(limb)
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        mask, out = np.uint64((1 << self.bits) - 1), {}
        for limb, places in zip(limbs, self.places):
            for k, p in enumerate(reversed(places)):
                out[p] = (limb >> np.uint64(k * self.bits)) & mask
        return [out[p] for p in range(self.n)]

    def _shift(self, limbs: list[np.ndarray], turn: int, i: int) -> np.ndarray:
        others = sum((mixed(x, 16 * turn + j) for j, x in enumerate(limbs) if j != i), np.uint64(turn))
        return mixed(others, i) >> np.uint64(64 - self.widths[i])

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        """Every limb in turn is xored with a hash of the others, which can be undone."""
        limbs = list(limbs)
        for turn in range(self.ROUNDS):
            for i in range(len(limbs)):
                limbs[i] = limbs[i] ^ self._shift(limbs, turn, i)
        return limbs

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        limbs = list(limbs)
        for turn in reversed(range(self.ROUNDS)):
            for i in reversed(range(len(limbs))):
                limbs[i] = limbs[i] ^ self._shift(limbs, turn, i)
        return limbs


def small_ints(x: np.ndarray) -> bytes:
    """Non-negative integers, a byte each; those of 255 and more follow in full."""
    large = x >= 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes()


def small_ints_from(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<i8", -1, n)
    return x


class Filter:
    """A counting quotient filter: permuted keys in ascending order, each with its exact count.

    All keys agree in their first `prefix` bits. Written out, the next bits (the quotient) are kept as run lengths and only what
    is left (the full remainder) a key each, so nothing is lost: permutation and packing can be undone.
    """

    def __init__(self, packing: Packing, prefix: int, limbs: list[np.ndarray], counts: np.ndarray):
        self.packing, self.prefix, self.limbs, self.counts = packing, prefix, limbs, counts

    @classmethod
    def of(cls, packing: Packing, prefix: int, limbs: list[np.ndarray], counts: np.ndarray | None = None) -> Filter:
        """The filter of permuted keys in any order, equal ones counted together; each counts once if there are no counts."""
        flat = len(limbs) == 2 and sum(packing.widths) <= 64
        if flat and counts is None:
            low = np.uint64(packing.widths[1])
            key = (limbs[0] << low) | limbs[1]
            key.sort()
            starts = np.flatnonzero(np.append(np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
            counts, key = np.diff(np.append(starts, len(key))), key[starts]
            return cls(packing, prefix, [key >> low, key & ((np.uint64(1) << low) - np.uint64(1))], counts)
        counts = np.ones(len(limbs[0]), np.int64) if counts is None else counts
        order = np.argsort((limbs[0] << np.uint64(packing.widths[1])) | limbs[1]) if flat else np.lexsort(limbs[::-1])
        limbs, counts = [x[order] for x in limbs], counts[order]
        new = np.ones(len(counts), bool)
        if len(counts):
            new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
        starts = np.flatnonzero(new)
        return cls(packing, prefix, [x[starts] for x in limbs], np.add.reduceat(counts, starts) if len(starts) else counts)

    def quotients(self, bits: int) -> np.ndarray:
        """The `bits` bits after the prefix."""
        width = self.packing.widths[0]
        left = self.limbs[0] & np.uint64((1 << (width - self.prefix)) - 1)
        return (left >> np.uint64(width - self.prefix - bits)).astype(np.int64)

    def split(self, bits: int) -> Iterator[tuple[int, Filter]]:
        """The parts that agree in `bits` further bits."""
        q = self.quotients(bits)
        ends = np.searchsorted(q, np.arange((1 << bits) + 1))
        for part in np.flatnonzero(np.diff(ends)):
            cut = slice(ends[part], ends[part + 1])
            yield int(part), Filter(self.packing, self.prefix + bits, [x[cut] for x in self.limbs], self.counts[cut])

    def to_row(self) -> dict:
        width, n = self.packing.widths[0], len(self.counts)
        bits = min(width - self.prefix, max(n, 1).bit_length() - 1)
        runs = np.bincount(self.quotients(bits), minlength=1 << bits)
        low = [self.limbs[0] & np.uint64((1 << (width - self.prefix - bits)) - 1), *self.limbs[1:]]
        sizes = [width - self.prefix - bits, *self.packing.widths[1:]]
        rest = b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-s // 8)]).tobytes() for x, s in zip(low, sizes))
        return {"n": n, "quotient": bits, "runs": small_ints(runs), "rest": rest, "counts": small_ints(self.counts)}

    @classmethod
    def from_row(cls, packing: Packing, prefix: int, segment: int, row: dict) -> Filter:
        width, n, bits = packing.widths[0], row["n"], row["quotient"]
        sizes, limbs, at = [width - prefix - bits, *packing.widths[1:]], [], 0
        for s in sizes:
            bytes_each = -(-s // 8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :bytes_each] = np.frombuffer(row["rest"], np.uint8, n * bytes_each, at).reshape(n, bytes_each)
            at += n * bytes_each
            limbs.append(wide.reshape(-1).view("<u8").astype(np.uint64))
        q = np.repeat(np.arange(1 << bits, dtype=np.uint64), small_ints_from(row["runs"], 1 << bits))
        top = (np.uint64(segment) << np.uint64(bits)) | q
        if sizes[0] < 64:
            limbs[0] |= top << np.uint64(sizes[0])
        return cls(packing, prefix, limbs, small_ints_from(row["counts"], n))

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        limbs = [np.concatenate(x) for x in zip(*(f.limbs for f in filters))]
        return cls.of(filters[0].packing, filters[0].prefix, limbs, np.concatenate([f.counts for f in filters]))

    def grams(self) -> list[np.ndarray]:
        """The n-grams that the keys stand for, as one array of word ids a place."""
        return self.packing.unpack(self.packing.restore(self.limbs))


def numbered_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(group, word, f, id) of the words that occur `least` times in their group, (block, n, pos, local, part) of where blocks
    have them, and the number of parts; written once.

    A word's rows meet in one task, a part, which counts the words of each group: a word is told by that number and the part, and
    its id, local * parts + part, needs no join. A block's places of words and their local numbers are packed, one row for each part.
    """
    pairs = (blocks.select("block", "group", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
             .select("block", "group", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n")))
    by = Window.partitionBy("group", "word").orderBy("block")
    everywhere = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = pairs.select("block", "group", "pos", "word", F.sum("n").over(everywhere).alias("f"), F.row_number().over(by).alias("k"))
    rows = rows.where(F.col("f") >= least).select("block", "group", "pos", F.when(F.col("k") == 1, F.col("word")).alias("word"), "f")
    schema = {"group": pa.string(), "word": pa.string(), "f": pa.int64(), "local": pa.int64(), "part": pa.int64(),
              "block": pa.int64(), "n": pa.int64(), "pos": pa.binary(), "locals": pa.binary()}

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(kind) if c in columns else pa.nulls(size, kind) for c, kind in schema.items()], list(schema))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, held, size = TaskContext.get().partitionId(), {}, [], 0

        def answers() -> pa.RecordBatch:
            block, pos, local = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(block, kind="stable")
            block, pos, local = block[order], pos[order], local[order]
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(starts[1:], len(block))
            return batch(len(starts), part=pa.array(np.full(len(starts), part)), block=pa.array(block[starts]), n=pa.array(ends - starts),
                         pos=pa.array([packed(pos[i:j]) for i, j in zip(starts, ends)], pa.binary()),
                         locals=pa.array([packed(local[i:j]) for i, j in zip(starts, ends)], pa.binary()))

        for rows in batches:
            first = rows.column("word").is_valid().to_numpy(zero_copy_only=False)
            groups = rows.column("group").dictionary_encode()
            codes, local = groups.indices.to_numpy(), np.empty(rows.num_rows, np.int64)
            for code, group in enumerate(groups.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                local[at] = words.get(group, 0) + np.cumsum(first[at]) - 1
                words[group] = int(local[at[-1]]) + 1
            new = rows.filter(pa.array(first))
            if new.num_rows:
                yield batch(new.num_rows, group=new.column("group"), word=new.column("word"), f=new.column("f"),
                            local=pa.array(local[first]), part=pa.array(np.full(new.num_rows, part)))
            held.append((rows.column("block").to_numpy(), rows.column("pos").to_numpy().astype(np.uint32), local.astype(np.uint32)))
            size += rows.num_rows
            if size >= ANSWERS:
                yield answers()
                held, size = [], 0
        if size:
            yield answers()

    found = saved(rows.mapInArrow(number, "group string, word string, f long, local long, part long, block long, n long, pos binary, locals binary"))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    words = found.where("word IS NOT NULL").select("group", "word", "f", (F.col("local") * parts + F.col("part")).alias("id"))
    return words, found.where("block IS NOT NULL").select("block", "n", "pos", F.col("locals").alias("local"), "part"), parts


def common_runs(parts: int) -> Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch]:
    """A block's text as ids of common words from 1 on, packed, with 0 between runs; runs of one word are left out."""

    def encode(block: pa.RecordBatch, answers: dict[str, np.ndarray]) -> pa.RecordBatch:
        ids, lengths, size = local_ids(block)
        ends = np.cumsum(lengths)
        known = np.full(size + 1, -1, np.int64)  # the last place stands for breaks
        for n, pos, local, part in zip(*(answers[c] for c in ("n", "pos", "local", "part"))):
            known[unpacked(pos, n)] = unpacked(local, n) * parts + part
        seq = np.insert(known[ids], ends, -1) if len(ends) else known[ids]
        word = seq >= 0
        near = np.zeros(len(seq), bool)
        near[1:] |= word[:-1]
        near[:-1] |= word[1:]
        pairs = np.count_nonzero(word[1:] & word[:-1])
        seq = seq[near & (word | np.roll(near, 1))] if len(seq) else seq
        return pa.RecordBatch.from_arrays([block.column("group"), pa.array([len(seq)], pa.int64()), pa.array([pairs], pa.int64()),
                                           pa.array([packed(seq + 1)], pa.binary())], ["group", "size", "pairs", "ids"])

    return encode


class Sieve:
    """A bitmap of pairs of words of a group: it holds every pair that was put in, and lets a few others pass."""

    def __init__(self, bits: int, marks: bytes = b""):
        self.bits, self.marks = bits, np.frombuffer(marks, np.uint8)

    def places(self, group: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        pair = (first.astype(np.uint64) << np.uint64(32)) ^ second.astype(np.uint64)
        return (mixed(pair ^ np.uint64(xxhash.xxh64_intdigest(group))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, group: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.places(group, first, second)
        return (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    @classmethod
    def of(cls, pairs: DataFrame) -> Sieve:
        """The sieve of the pairs (group, gram), of bounded size: the more pairs there are beyond it, the more others pass."""
        empty = cls(min(max(pairs.count() * PAIR_BITS, 1 << CHUNK_BITS).bit_length(), SIEVE_BITS))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column("gram").flatten().to_numpy()
                groups = batch.column("group").dictionary_encode()
                codes = groups.indices.to_numpy()
                for code, group in enumerate(groups.dictionary.to_pylist()):
                    own = codes == code
                    at = np.unique(empty.places(group, words[::2][own], words[1::2][own]))
                    yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK_BITS), pa.array(at & ((1 << CHUNK_BITS) - 1))], ["chunk", "bit"])

        def chunk(table: pa.Table) -> pa.Table:
            marks = np.zeros(1 << CHUNK_BITS, np.uint8)
            marks[table.column("bit").to_numpy()] = 1
            return pa.table({"chunk": table.column("chunk")[:1], "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

        marks = bytearray((1 << empty.bits) // 8)
        size = (1 << CHUNK_BITS) // 8
        for row in pairs.select("group", "gram").mapInArrow(places, "chunk long, bit long").groupBy("chunk").applyInArrow(chunk, "chunk long, marks binary").collect():
            marks[row["chunk"] * size:(row["chunk"] + 1) * size] = row["marks"]
        return cls(empty.bits, bytes(marks))


_FILTER = "group string, size int, shard long, segment long, n int, quotient int, runs binary, rest binary, counts binary"


def filter_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"group": pa.string(), "size": pa.int32(), "shard": pa.int64(), "segment": pa.int64(), "n": pa.int32(), "quotient": pa.int32()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in
                                       ("group", "size", "shard", "segment", "n", "quotient", "runs", "rest", "counts")})


def cut_rows(packing: Packing, group: str, shard: int, whole: Filter, segment: int, bits: int) -> pa.RecordBatch:
    """A filter of one segment as one row for each of its parts by `bits` further bits."""
    return filter_batch([{"group": group, "size": packing.n, "shard": shard, "segment": (segment << bits) | part, **f.to_row()} for part, f in whole.split(bits)])


def cut_bits(packing: Packing, prefix: int, step: int) -> int:
    return min(step, max(packing.widths[0] - prefix, 0))


def shard_filters(runs: DataFrame, sizes: range, bits: int, left: int, sieve: Broadcast | None = None) -> DataFrame:
    """Filters of all n-grams of `sizes` words, of those whose pairs pass the sieve if there is one; a task ends a filter for every
    FILTER_GRAMS n-grams of a group and size, which is then one of 2^left shards. They come cut by the first bits of their keys, for the
    first merge."""
    step = min(MERGE_BITS, left)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, ended = {}, {}, 0
        passes = Sieve(*sieve.value) if sieve is not None else None

        def end(group, size):
            nonlocal ended
            packing = Packing(size, bits)
            limbs = [np.concatenate(x).astype(np.uint64) for x in zip(*kept.pop((group, size)))]
            held.pop((group, size))
            found = Filter.of(packing, 0, limbs)
            ended += 1
            shard = int(mixed(np.array([TaskContext.get().partitionId() << 32 | ended], np.uint64))[0]) % (1 << left)
            return cut_rows(packing, group, shard >> step, found, 0, cut_bits(packing, 0, step))

        for batch in batches:
            for i in range(batch.num_rows):
                group, seq = batch.column("group")[i].as_py(), unpacked(batch.column("ids")[i].as_py(), batch.column("size")[i].as_py()) - 1
                pair = (seq[:-1] >= 0) & (seq[1:] >= 0)
                if passes is not None:
                    at = np.flatnonzero(pair)
                    pair[at] = passes.holds(group, seq[at], seq[at + 1])
                whole = pair
                for size in range(2, sizes.stop):
                    whole = whole[:-1] & pair[size - 2:] if size > 2 else whole
                    at = np.flatnonzero(whole)
                    if not len(at):
                        break
                    if size not in sizes:
                        continue
                    packing = Packing(size, bits)
                    for part in np.array_split(at, -(-len(at) // PACK_GRAMS)):
                        limbs = packing.permute(packing.pack([seq[part + k] for k in range(size)]))
                        kept.setdefault((group, size), []).append([x.astype(np.uint32) if w <= 32 else x for x, w in zip(limbs, packing.widths)])
                        held[group, size] = held.get((group, size), 0) + len(part)
                        if held[group, size] >= FILTER_GRAMS:
                            yield end(group, size)
                while sum(held.values()) > FILTER_GRAMS * 3 // 2:  # many groups: the largest first
                    yield end(*max(held, key=held.get))
        for key in list(kept):
            yield end(*key)

    return runs.mapInArrow(count, _FILTER)


def merged_filters(runs: DataFrame, sizes: range, bits: int, least: int, grams: int, sieve: Broadcast | None = None) -> DataFrame:
    """(group, gram array<long>, f) of all n-grams of `sizes` words that occur `least` times or more; `grams` is about how many are counted.

    Each round cuts every filter by MERGE_BITS further bits of its keys and merges what 2^MERGE_BITS shards have of one part, so a
    merge holds about one shard's keys and the rows of a round grow with the shards, not with their square. Keys are permuted, so parts
    are of like size whatever the words.
    """
    left = max(-(-grams // FILTER_GRAMS) - 1, 0).bit_length()  # bits of shard numbers that are still apart
    parts = shard_filters(runs, sizes, bits, left, sieve)
    step = min(MERGE_BITS, left)
    prefixes = {n: cut_bits(Packing(n, bits), 0, step) for n in sizes}
    left -= step
    while True:
        def joined(table: pa.Table, prefixes=prefixes) -> Filter:
            rows = table.to_pylist()
            size = rows[0]["size"]
            return Filter.merged([Filter.from_row(Packing(size, bits), prefixes[size], r["segment"], r) for r in rows])

        def merge(table: pa.Table) -> pa.Table:
            r = {c: table.column(c)[0].as_py() for c in ("group", "size", "shard", "segment")}
            return pa.Table.from_batches([filter_batch([{**r, **joined(table).to_row()}])])

        def common(table: pa.Table) -> pa.Table:
            found = joined(table)
            enough = found.counts >= least
            words = Filter(found.packing, found.prefix, [x[enough] for x in found.limbs], found.counts[enough]).grams()
            flat = pa.array(np.stack(words, axis=1).astype(np.int64).ravel())
            ends = pa.array(np.arange(enough.sum() + 1, dtype=np.int32) * found.packing.n)
            group = pa.array([table.column("group")[0].as_py()] * int(enough.sum()), pa.string())
            return pa.table({"group": group, "gram": pa.ListArray.from_arrays(ends, flat), "f": pa.array(found.counts[enough])})

        met = parts.groupBy("group", "size", "shard", "segment")
        if left == 0:
            return met.applyInArrow(common, "group string, gram array<long>, f long")
        step = min(MERGE_BITS, left)
        left -= step
        before, prefixes = prefixes, {n: p + cut_bits(Packing(n, bits), p, step) for n, p in prefixes.items()}

        def cut(batches: Iterator[pa.RecordBatch], before=before, step=step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    packing = Packing(r["size"], bits)
                    whole = Filter.from_row(packing, before[packing.n], r["segment"], r)
                    yield cut_rows(packing, r["group"], r["shard"] >> step, whole, r["segment"], cut_bits(packing, before[packing.n], step))

        parts = saved(met.applyInArrow(merge, _FILTER)).mapInArrow(cut, _FILTER)


def phrase_counts(docs: DataFrame, lang: Column, text: Column, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group, gram, f) of all phrases of 1 to `longest` words that occur `least` times or more, (group, id, word) of their words,
    and (group, n), the occurrences of all words.

    A phrase occurs no more often than its parts, so only words that occur `least` times get ids, only runs of such words are
    counted further, and of longer runs only those all of whose pairs occur `least` times, as far as a sieve tells; the counts are exact.
    """
    rows = docs.select(lang.alias("group"), F.lit(0).alias("doc"), F.lit(0).alias("slot"), text.alias("text"))
    blocks = word_blocks(rows, tokens)
    words, answers, parts = numbered_words(blocks, least)
    runs = saved(with_answers(blocks.select("block", "group", "words", "lengths", "ids"), answers, common_runs(parts), "group string, size long, pairs long, ids binary"))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = saved(blocks.select("group", n.alias("n")).groupBy("group").agg(F.sum("n").alias("n")))
    dropped(blocks)
    bits = max(int(words.agg(F.max("id")).first()[0] or 0).bit_length(), 8)
    grams = words.select("group", F.array("id").alias("gram"), "f")
    if longest >= 2:
        pairs = saved(merged_filters(runs, range(2, 3), bits, least, runs.agg(F.sum("pairs")).first()[0] or 0))
        grams = grams.unionByName(pairs)
    if longest >= 3:
        passes = Sieve.of(pairs)
        sieve = docs.sparkSession.sparkContext.broadcast((passes.bits, passes.marks.tobytes()))  # no class of ours: workers need not have this package
        # a longer phrase starts with a pair, so those of a size are no more than the pairs
        most = (longest - 2) * (pairs.agg(F.sum("f")).first()[0] or 0)
        grams = grams.unionByName(merged_filters(runs, range(3, longest + 1), bits, least, most, sieve))
    return saved(grams), words.select("group", "id", "word"), sizes


def collocations(docs: DataFrame, lang: str, text: str, longest: int = 5, least: int = 100, scale: int = 1000, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `longest` words of every language.

    Words are lower-cased (A-Z) and stand between blanks inside pieces that end at . , ; : ! ? or a line break. A phrase with
    a >= `least` occurrences is cut where floor(scale a n / (l r)) is lowest (ties: after fewest words); it is left
    out if a longer candidate that holds it has `share` percent of its occurrences. A null language is `und`; null and empty
    texts have no words; repeated rows each count; ties rank by a, then by the phrase's UTF-8 bytes. An empty table, or one without
    such phrases, gives an empty result. Other columns are not read. All products are exact decimals.
    """
    grams, words, sizes = phrase_counts(docs, F.coalesce(F.col(lang), F.lit("und")), F.col(text), longest, least)
    phrases = grams.where(F.size("gram") >= 2).select("group", "gram", F.col("f").alias("a"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("gram", F.lit(1), F.col("k")).alias("first"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("rest"))
    part = lambda gram, f: grams.select("group", F.col("gram").alias(gram), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["group", "first"]).join(part("rest", "r"), ["group", "rest"]).join(sizes, "group")
    # 19 + 19 digits: a n stays under 10^38, and so does l r, for any 64-bit counts that a corpus can have
    value = (F.lit(scale).cast("decimal(5,0)") * (whole("a") * whole("n")).cast("decimal(33,0)"))
    cuts = cuts.withColumn("up", value).withColumn("down", (whole("l") * whole("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("group", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = phrases.where(F.size("gram") >= 3).select("group", F.col("a").alias("of"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(gram) - 1), w -> transform(sequence(1, size(gram) - w + 1), i -> slice(gram, i, w))))")).alias("gram"))
    inner = inner.groupBy("group", "gram").agg(F.max("of").alias("of"))
    kept = best.join(inner, ["group", "gram"], "left").where(F.col("of").isNull() | (F.col("of") * 100 < F.col("a") * share))
    spelt = (kept.select("group", "gram", F.posexplode("gram").alias("pos", "id")).join(words, ["group", "id"])
             .groupBy("group", "gram").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("pos", "word")))["word"]).alias("phrase")))
    rows = kept.join(spelt, ["group", "gram"]).select(F.col("group").alias("lang"), "phrase", "a", "c.l", "c.r", "n", "c.score")
    ranked = range_ranks(rows, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], "rank").where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
