"""Benchmark leaks in training documents: n-gram seeds, then Smith-Waterman alignment."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import WordIds, mixed, text_slices, utf8

#: Words of a seed; items with fewer words are one seed themselves.
SEED_WORDS = 3
#: Benchmark words that are broadcast at a time; a larger benchmark is searched for in blocks of this size.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of the score of the whole item; items of fewer than SHORT words need all of it.
LEAST_SCORE = 0.5
SHORT = 8
#: Words around an item's expected place that are aligned with it, as a share of its length.
SLACK = 0.5


class _Folded(WordIds):
    """Ids of words without case and without punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}*_-|#$%&").encode()
        value = WordIds.__missing__(self, plain or word)
        self[word] = value
        return value


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n ids from each position on."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        h = mixed(h + ids[i:len(ids) - n + 1 + i], i)
    return h


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, end in the item, end in the text). One array operation per word of the item."""
    at = np.arange(len(text) + 1) * -GAP
    row, best = np.zeros(len(text) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, row[:-1] + np.where(text == word, MATCH, MISMATCH))
        new = np.maximum(new, row + GAP)
        new = np.maximum(new, np.maximum.accumulate(new + at) - at)  # gaps along the text
        row = np.maximum(new, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


class Items:
    """A block of benchmark items as arrays: words, and seeds with the item and place that each stands in."""

    def __init__(self, rows: list[tuple]):
        ids = _Folded()
        self.names = [r[0] for r in rows]
        self.words = [ids.of(r[1].encode().split()) for r in rows]
        seeds, item, place = [], [], []
        for i, w in enumerate(self.words):
            g = grams(w, min(SEED_WORDS, len(w)))
            seeds.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        self.seed, self.item, self.place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (seeds, item, place))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.keys, self.begin = np.unique(self.seed, return_index=True)
        self.begin = np.r_[self.begin, len(self.seed)]
        self.lengths = sorted({min(SEED_WORDS, len(w)) for w in self.words if len(w)})

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, position) of every seed that stands in a sequence of word ids."""
        keys, places = [], []
        for n in self.lengths:
            g = grams(ids, n)
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            found = np.flatnonzero(self.keys[at] == g)
            keys.append(at[found])
            places.append(found)
        return (np.concatenate(keys), np.concatenate(places)) if keys else (np.empty(0, int), np.empty(0, int))

    def leaks(self, ids: np.ndarray) -> Iterator[tuple]:
        """(item name, score, first word, end) of every stretch of a document that aligns with an item."""
        key, pos = self.hits(ids)
        if not len(key):
            return
        n = self.begin[key + 1] - self.begin[key]
        entry = np.repeat(self.begin[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.item[entry], np.repeat(pos, n) - self.place[entry]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        size = np.array([len(self.words[i]) for i in item])
        slack = np.ceil(SLACK * size).astype(np.int64)
        low, high = np.maximum(0, start - slack), np.minimum(len(ids), start + size + slack)
        new = np.r_[True, (item[1:] != item[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])]
        # ends grow with starts inside an item; across items the item itself differs
        cuts = np.r_[np.flatnonzero(new), len(item)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            words, lo, hi = self.words[item[a]], int(low[a:b].min()), int(high[a:b].max())
            yield from self._aligned(self.names[item[a]], words, ids, lo, hi)

    def _aligned(self, name, words: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> Iterator[tuple]:
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            least = (LEAST_SCORE if len(words) >= SHORT else 1) * MATCH * len(words)
            # no alignment scores more than all of the item's words that stand in the stretch
            if MATCH * np.isin(words, ids[lo:hi]).sum() < least:
                continue
            score, item_end, end = align(words, ids[lo:hi])
            if score < least:
                continue
            _, _, back = align(words[:item_end][::-1], ids[lo:lo + end][::-1])
            first = lo + end - back
            yield name, score / (MATCH * len(words)), first, lo + end
            # another copy may stand before or after this one
            todo += [s for s in ((lo, first), (lo + end, hi)) if 2 * (s[1] - s[0]) >= len(words)]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The distinct items with words, a bounded number of words at a time."""
    rows, words = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").distinct().toLocalIterator():
        if n := len(r.t.encode().split()):
            if rows and words + n > BLOCK_WORDS:
                yield Items(rows)
                rows, words = [], 0
            rows.append((r.i, r.t))
            words += n
    if rows:
        yield Items(rows)


def find_leaks(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, score, first, end): every stretch of words of a document that aligns with a benchmark item.

    Words are compared without case and outer punctuation. Score: Smith-Waterman (match 2, mismatch and gap -1) as a
    share of the whole item's; 0.5 or more counts, for items under 8 words 1. Each item is searched for by all its three-word
    seeds, however rare or common. The benchmark is taken in blocks of bounded size; documents are read once per block
    and never shuffled. Texts and items that are null or without words match nothing, repeated items count once, repeated
    documents give a row each; null ids are passed on. No items: an empty result.
    """
    ids_of = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kinds = dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {dict(ids_of.dtypes)['doc_id']}, item_id {kinds}, score double, first long, end long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = _Folded(), shared.value
            for whole in batches:
                for batch in text_slices(whole, "_text"):
                    rows = [(i, *leak) for i, t in zip(batch.column("doc_id").to_pylist(), utf8(batch, "_text")) for leak in block.leaks(ids.of(t.split()))]
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column("doc_id").type), *map(pa.array, cols[1:])],
                                                         ["doc_id", "item_id", "score", "first", "end"])

        found = found.unionAll(ids_of.mapInArrow(work, schema))
    return found


def without_leaks(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The rows of `docs`, all columns, in whose text no benchmark item is found; rows are judged one by one."""
    for items in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = _Folded(), shared.value
            for whole in batches:
                for batch in text_slices(whole, text):
                    clean = [next(block.leaks(ids.of(t.split())), None) is None for t in utf8(batch, text)]
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
