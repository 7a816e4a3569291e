"""Removal of long repeated word sequences, found by recompression.

Every document is parsed in rounds: a round names maximal runs of one symbol, then pairs of neighbouring symbols. A
name is a hash of what it stands for, so all tasks give equal word sequences equal names, except near their ends, where the
neighbours outside may take part. The parse is cut to symbols of about three words. Symbols that stand in one place of
the corpus only cannot lie inside a repeat, so Spark first finds the shared symbols, then compares only windows whose
interior is made of shared ones. Text is shuffled once, by document, and that exchange serves all three passes.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import WordIds, mixed

#: Bytes of text of a group of documents, which one task parses at a time; one document at least.
GROUP_BYTES = 4 << 20
GROUPS_LEAST = 64
#: Rounds of pair naming; runs are named in the first, where repeated words are.
ROUNDS = 4
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D


class Parse:
    """Words of a group of documents in one array, with a border symbol after each document."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        ids = WordIds()
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(np.r_[0, self.sizes + 1])[:-1] if len(texts) else np.empty(0, np.int64)
        total = int(self.sizes.sum()) + len(texts)
        self.ids = np.zeros(total, np.uint64)
        self.border = np.zeros(total, bool)
        for at, w in zip(self.first, self.words):
            self.ids[at:at + len(w)] = ids.of(w)
            self.border[at + len(w)] = True
        counts = np.maximum(0, self.sizes - window + 1)
        self.doc = np.repeat(np.arange(len(texts)), counts)  # of each window
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.start = self.first[self.doc] + within if len(texts) else np.empty(0, np.int64)
        self.window = window
        self._rounds()

    def _rounds(self) -> None:
        """Symbols after all rounds, and per window the symbols [low, high) that its own words fix."""
        sym, border = self.ids, self.border
        low, high = self.start, self.start + self.window
        for r in range(ROUNDS):
            if r == 0:
                new = np.r_[True, sym[1:] != sym[:-1]] | border if len(sym) else np.empty(0, bool)
                run = np.cumsum(new) - 1
                at = np.flatnonzero(new)
                length = np.diff(np.r_[at, len(sym)])
                # the runs at a window's ends may go on outside
                low, high = run[low] + 1, run[high - 1]
                sym = np.where(length > 1, mixed(sym[at] + mixed(length.astype(np.uint64), 90)), sym[at])
                border = border[at]
            left = (mixed(sym, 10 + r) & np.uint64(1)) == 0
            pair = left[:-1] & ~left[1:] & ~border[:-1] & ~border[1:]
            second = np.r_[False, pair] if len(sym) else np.empty(0, bool)
            index = np.r_[np.cumsum(~second) - 1, np.count_nonzero(~second)]
            # a right part at the window's start, or a left part at its end, may pair with what is outside
            low = np.minimum(low, len(sym))
            low = index[low + ~np.r_[left, True][low]]
            high = np.maximum(high, 1)
            high = np.where(left[high - 1], high - 1, high)
            high = np.where(high > 0, index[np.maximum(high, 1) - 1] + 1, 0)
            named = np.where(np.r_[pair, False], mixed(sym + mixed(np.r_[sym[1:], sym[:1]], 50 + r), 30 + r), sym) if len(sym) else sym
            sym, border = named[~second], border[~second]
        self.sym, self.inner, self.low, self.high = sym, ~border, low, high

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct symbols, which of them each symbol is, and which occur here more than once."""
        names, which, counts = np.unique(self.sym[self.inner], return_inverse=True, return_counts=True)
        return names, which, counts > 1

    def candidates(self, shared: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Windows whose fixed symbols are all shared (also those that fix none)."""
        lone = np.zeros(len(self.sym), np.int64)
        lone[self.inner] = ~shared[which]
        upto = np.r_[0, np.cumsum(lone)]
        return np.flatnonzero(upto[np.maximum(self.high, self.low)] == upto[self.low])

    def hashes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window's words: two polynomials of the word ids, one of them cut to 32 bits."""
        out = []
        for base, ids in ((_B1, self.ids), (_B2, mixed(self.ids, 70))):
            inverse = pow(base, -1, 1 << 64)
            n = len(ids)
            down = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), inverse, np.uint64)])[:n]
            upto = np.r_[np.uint64(0), np.cumsum(ids * down)]
            up = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])[:n]
            at = self.start[windows]
            out.append(mixed((upto[at + self.window] - upto[at]) * up[at]))
        return out[0], out[1].astype(np.uint32)


def _pack(**arrays: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in arrays.items()}


def _firsts(parse: Parse, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidate windows sorted by hash, then by place; which of them are first of their hash here."""
    h1, h2 = parse.hashes(windows)
    order = np.lexsort((windows, h2, h1))
    h1, h2, windows = h1[order], h2[order], windows[order]
    first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.empty(0, bool)
    return h1, h2, windows, first


def remove_repeats(docs: DataFrame, doc_id: str, text: str, window: int = 20) -> DataFrame:
    """(doc_id, n_words, removed, kept) for every row: words in windows that also start earlier are removed.

    A window is `window` consecutive words; earlier means a smaller doc_id, or the same document and an earlier start.
    `removed` lists spans (first word, end), `kept` joins the other words by one space. Windows are judged on the input.
    Null and empty texts have no words. Rows of equal doc_id count in the order of their texts; null ids come last.
    An empty table gives an empty result. Windows are compared by 96 bits of hashes.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(GROUPS_LEAST, -(-total // GROUP_BYTES))
    d = d.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    parted = "bucket long, g long, n long, a binary, b binary, c binary, d binary"
    reply = "g long, kind int, bucket long, bits binary"

    def opened(t: pa.Table) -> tuple[list, list, Parse]:
        ids, texts = t.column("doc_id").to_pylist(), [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        return ids, texts, Parse(texts, window)

    def split(keys: np.ndarray) -> list[np.ndarray]:
        """Positions of sorted 64-bit keys by bucket, order kept."""
        bucket = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return np.split(order, np.searchsorted(bucket[order], np.arange(1, groups)))

    def answered(rows: pa.Table, kind: int, places: list[np.ndarray], n: int) -> np.ndarray:
        bits = np.zeros(n, bool)
        for r in rows.to_pylist():
            if r["kind"] == kind:
                at = places[r["bucket"]]
                bits[at] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(at)).astype(bool)
        return bits

    def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist(rows, schema)

    parted_arrow = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), *((x, pa.binary()) for x in "abcd")])
    reply_arrow = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])

    def name_symbols(t: pa.Table) -> pa.Table:
        _, _, parse = opened(t)
        names, _, _ = parse.distinct()
        g = t.column("g")[0].as_py()
        # 32 bits beside the bucket: a chance match only makes a window a candidate
        return table([{"bucket": b, "g": g, "n": len(at)} | _pack(a=(names[at] >> np.uint64(32)).astype(np.uint32))
                      for b, at in enumerate(split(names)) if len(at)], parted_arrow)

    def share(t: pa.Table) -> pa.Table:
        rows = t.select(["bucket", "g", "n", "a"]).to_pylist()
        keys = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in rows])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        found = np.zeros(len(keys), bool)
        found[order] = np.r_[same, False] | np.r_[False, same]
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        return table([{"g": r["g"], "kind": 0, "bucket": r["bucket"], "bits": np.packbits(f).tobytes()}
                      for r, f in zip(rows, np.split(found, cuts)) if f.any()], reply_arrow)

    def shared_windows(parse: Parse, replies: pa.Table) -> np.ndarray:
        names, which, often = parse.distinct()
        shared = often | answered(replies, 0, split(names), len(names))
        return parse.candidates(shared, which)

    def name_windows(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], parted_arrow)
        ids, _, parse = opened(t)
        h1, h2, windows, first = _firsts(parse, shared_windows(parse, replies))
        h1, h2, docs_of = h1[first], h2[first], parse.doc[windows[first]]
        places = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        g, rows = t.column("g")[0].as_py(), []
        for b, at in enumerate(split(h1)):
            if len(at):
                own, which = np.unique(docs_of[at], return_inverse=True)
                rows.append({"bucket": b, "g": g, "n": len(at)} | _pack(
                    a=h1[at], b=h2[at], c=places[own], d=which.astype(np.uint16 if len(own) < 65536 else np.uint32)))
        return table(rows, parted_arrow)

    def find_first(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        h1 = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        h2 = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])
        place = np.concatenate([np.frombuffer(r["c"], np.int64)[np.frombuffer(r["d"], np.uint16 if len(r["c"]) < 8 * 65536 else np.uint32)]
                                for r in rows])
        order = np.lexsort((place, h2, h1))
        later = np.zeros(len(h1), bool)
        later[order] = np.r_[False, (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        return table([{"g": r["g"], "kind": 1, "bucket": r["bucket"], "bits": np.packbits(f).tobytes()}
                      for r, f in zip(rows, np.split(later, cuts)) if f.any()], reply_arrow)

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                            ("removed", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
        if not t.num_rows:
            return table([], schema)
        ids, _, parse = opened(t)
        h1, _, windows, first = _firsts(parse, shared_windows(parse, replies))
        again = ~first
        again[first] = answered(replies, 1, split(h1[first]), int(first.sum()))
        at = parse.start[windows[again]]
        cover = np.cumsum(np.bincount(at, minlength=len(parse.ids) + 1) - np.bincount(at + window, minlength=len(parse.ids) + 1)) > 0
        rows = []
        for i, (w, a) in enumerate(zip(parse.words, parse.first)):
            gone = cover[a:a + len(w)]
            spans, kept = [], w
            if gone.any():
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans = [{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                kept = [w[j] for j in np.flatnonzero(~gone)]
            rows.append((ids[i], len(w), spans, b" ".join(kept)))
        cols = list(zip(*rows))
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], schema.field(2).type),
                                     pa.array(cols[3], pa.binary()).cast(pa.string())], schema=schema)

    symbols = d.groupBy("g").applyInArrow(name_symbols, parted)
    shares = symbols.groupBy("bucket").applyInArrow(share, reply)
    named = d.groupBy("g").cogroup(shares.groupBy("g")).applyInArrow(name_windows, parted)
    firsts = named.groupBy("bucket").applyInArrow(find_first, reply)
    return d.groupBy("g").cogroup(shares.unionAll(firsts).groupBy("g")).applyInArrow(
        remove, "doc_id long, n_words long, removed array<struct<first: long, end: long>>, kept string")
