"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text, normalised by length."""
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import text_slices

# Characters that look like Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m",
              "т": "t", "в": "b", "н": "h", "г": "r", "ӏ": "l", "ո": "n", "ս": "u", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
              "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʀ": "r", "ѵ": "v", "ԛ": "q", "ԝ": "w"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Phrases in which a listed word is harmless; more are learned from the labelled rows.
EXCEPTIONS = ("clown fish", "trash can", "pathetic fallacy")

#: Labelled rows to learn from at most: those of the smallest hashes. Their texts are read in place, and only counts are gathered.
SAMPLE = 12_000
#: Lengths of word beginnings that may enter the lexicon; entries of the lexicon at most.
STEMS = range(3, 9)
ENTRIES = 2_000
#: Least number of toxic texts with an entry, and least log-odds of it.
SUPPORT, ODDS = 5, 2.5

_LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + "​-‏⁠﻿­]")
_SUBSTITUTE = re.compile(r"(?<=[^\W\d_])[" + "".join(DIGITS) + r"]+|[" + "".join(DIGITS) + r"]+(?=[^\W\d_])|(?<=[^\W\d_])["
                         + re.escape("".join(SIGNS)) + r"]{1,2}(?=[^\W\d_])|(?<!\S)\$(?=[^\W\d_])")
_BLANK = re.compile(r"[\W_]+")
_TABLE = str.maketrans(HOMOGLYPHS | {c: None for c in "​‌‍‎‏⁠﻿­"})
_LETTERS = str.maketrans(DIGITS | SIGNS)


def fold(text: str) -> str:
    """Lower-case words between single blanks, look-alikes and digit substitutions undone, invisible characters gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _LOOKALIKE.search(text):
        text = text.translate(_TABLE)
    text = _SUBSTITUTE.sub(lambda m: m[0].translate(_LETTERS), text)
    return f" {_BLANK.sub(' ', text).strip()} "


def entries_of(words: set[str]) -> Iterator[str]:
    """What a lexicon may hold of these words: the words, and their beginnings, marked by a star."""
    for w in words:
        yield w
        for n in STEMS:
            if n <= len(w):
                yield w[:n] + "*"


@dataclass
class Lexicon:
    """Weighted entries (words, or beginnings ending in a star), exception phrases, and the logistic scale of a score."""
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, ...] = (-3.0, 3.0, 0.0)
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "scale": self.scale, "automaton": None}

    def _built(self):
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                key = " " + (e[:-1] if e.endswith("*") else e + " ")
                a.add_word(key, (len(key), w))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self.automaton = a
        return self.automaton

    def features(self, text: str) -> tuple[float, float]:
        """(sum of weights, words): every word counts its heaviest entry; words of an exception phrase count nothing."""
        folded = fold(text)
        n = folded.count(" ") - 1 if folded.strip() else 0
        if not self.weights:
            return 0.0, n
        heaviest, spared = {}, []
        for end, (size, weight) in self._built().iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                heaviest[start] = max(weight, heaviest.get(start, weight))
        return sum(w for s, w in heaviest.items() if not any(a <= s < b for a, b in spared)), n

    def score(self, text: str) -> float:
        return float(_logistic(_inputs(np.array([self.features(text)])), np.array(self.scale))[0])


def _inputs(features: np.ndarray) -> np.ndarray:
    """Intercept, total weight, and weight per hundred words (short texts count as twenty words), both damped."""
    total, words = np.maximum(features[:, 0], 0), features[:, 1]
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 20))], axis=1)


def _logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def fit_scale(features: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; with one class only, the rate of that class."""
    x = _inputs(features)
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = _logistic(x, beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def sample_of(labels: DataFrame, label_id: str, label: str, limit: int) -> DataFrame:
    """(_label_id, _label) of at most `limit` labelled rows, those of the smallest hashes: bounded, so it may be broadcast."""
    return (labels.select(F.col(label_id).alias("_label_id"), F.col(label).cast("double").alias("_label"))
            .where("_label_id is not null and _label is not null").distinct()
            .orderBy(F.xxhash64("_label_id", "_label"), "_label_id", "_label").limit(limit))


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, *, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled documents: entries whose texts are toxic far more often than others.

    At most `sample` labelled rows teach. Document counts of words and word beginnings are summed by Spark; the
    lexicon's at most 2,000 entries come to the driver. Of a beginning and what extends it one stays: the extension if it has nearly all toxic texts, else the
    beginning if it is as pure.
    Contexts of listed words that only harmless texts have become exception phrases. No labels: an empty lexicon.
    """
    taught = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(sample_of(labels, label_id, label, sample)), F.col("_id") == F.col("_label_id")).select("_text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, totals = Counter(), Counter(), [0, 0]

        def out(a: Counter, b: Counter) -> pa.RecordBatch:
            keys = list(a.keys() | b.keys())
            return pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()), "toxic": pa.array([a[k] for k in keys], pa.int64()),
                                               "clean": pa.array([b[k] for k in keys], pa.int64())})

        for whole in batches:
            for batch in text_slices(whole, "_text"):
                for t, y in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                    (toxic if y > 0.5 else clean).update(set(entries_of(set(fold(t or "").split()))))
                    totals[y <= 0.5] += 1
                if len(toxic) + len(clean) > 400_000:
                    yield out(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield out(toxic, clean)
        yield pa.RecordBatch.from_pydict({"entry": pa.array([""]), "toxic": pa.array([totals[0]]), "clean": pa.array([totals[1]])})

    counts = taught.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the totals come along as the empty entry; log-odds are compared on the driver for the few with support
    likely = counts.where((F.col("entry") == "") | ((F.col("toxic") >= SUPPORT) & (F.col("toxic") > 2 * F.col("clean"))))
    rows = likely.orderBy(F.col("entry") != "", F.col("toxic").desc(), "entry").limit(20 * ENTRIES).collect()
    n1, n0 = next(((r.toxic, r.clean) for r in rows if r.entry == ""), (0, 0))
    odds = {r.entry: (float(np.log((r.toxic + .5) / (n1 + 1)) - np.log((r.clean + .5) / (n0 + 1))), r.toxic) for r in rows if r.entry}
    good = {e: o for e, o in odds.items() if o[0] >= ODDS}
    # a beginning is no entry if one of its words, or a longer beginning, has nearly all of its toxic texts
    explained = {p for e, o in good.items() for n in STEMS if n <= len(e.rstrip("*")) and (p := e.rstrip("*")[:n] + "*") != e
                 and p in good and o[1] >= 0.9 * good[p][1]}
    good = {e: o for e, o in good.items() if e not in explained}
    kept: dict[str, float] = {}
    for e in sorted(good, key=lambda e: (len(e.rstrip("*")), not e.endswith("*"), e)):
        word = e.rstrip("*")
        # a beginning that loses nothing in purity stands for its extensions
        if not any(good[s][0] >= good[e][0] - 0.7 for n in STEMS if n <= len(word) and (s := word[:n] + "*") in kept and s != e):
            kept[e] = good[e][0]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    lexicon = Lexicon(kept)
    lexicon.exceptions = EXCEPTIONS + _harmless(taught, lexicon)
    rows = scored(taught, "_text", lexicon, raw=True).select("_label", "total", "words").collect()
    if rows:
        f = np.array([(r.total, r.words) for r in rows])
        lexicon.scale = fit_scale(f, np.array([float(r["_label"] > 0.5) for r in rows]))
    return lexicon


def _harmless(taught: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases with a listed word that at least three harmless texts have and no toxic one."""
    bare = Lexicon(lexicon.weights, ())

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                rows = []
                for t, y in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                    words = fold(t or "").split()
                    near = {" ".join(words[j:j + 2]) for i, w in enumerate(words)
                            if w in bare.weights or any(w[:n] + "*" in bare.weights for n in STEMS) for j in (i - 1, i) if 0 <= j < len(words) - 1}
                    rows += [(p, y > 0.5) for p in near]
                if rows:
                    yield pa.RecordBatch.from_pydict({"phrase": pa.array([r[0] for r in rows]), "toxic": pa.array([int(r[1]) for r in rows], pa.int64())})

    if not lexicon.weights:
        return ()
    found = (taught.mapInArrow(phrases, "phrase string, toxic long").groupBy("phrase")
             .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).where("toxic = 0 and n >= 3")
             .orderBy(F.col("n").desc(), "phrase").limit(ENTRIES).collect())
    return tuple(r.phrase for r in found)


def scored(docs: DataFrame, text: str, lexicon: Lexicon, *, raw: bool = False) -> DataFrame:
    """All rows and columns with `score` in 0..1 (higher: more likely toxic), or with `raw` the total weight and the words.

    Whole texts are matched. Null and empty texts have no weight and get the score of harmless ones. Rows do not
    influence each other; columns named like the added ones are replaced.
    """
    added = ["total", "words"] if raw else ["score"]
    kept = [c for c in docs.columns if c not in added]
    base = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + "".join(f", {a} double" for a in added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.weights, lexicon.exceptions, lexicon.scale)
        for whole in batches:
            for batch in text_slices(whole, text):
                f = np.array([own.features(t or "") for t in batch.column(text).to_pylist()], float).reshape(-1, 2)
                values = [f[:, 0], f[:, 1]] if raw else [_logistic(_inputs(f), np.array(own.scale))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], [*kept, *added])

    return base.mapInArrow(work, schema)


def filtered(docs: DataFrame, text: str, lexicon: Lexicon, *, below: float) -> DataFrame:
    """The rows, all columns, that score less than `below`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.weights, lexicon.exceptions, lexicon.scale)
        for whole in batches:
            for batch in text_slices(whole, text):
                yield batch.filter(pa.array([own.score(t or "") < below for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
