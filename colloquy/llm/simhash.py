"""SimHash fingerprints and all links within a few bits, by one-wildcard variants of segments."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import WordIds, components, mixed, saved, text_slices, unused, utf8

#: Hashes whose bits are counted at once.
COUNTED = 1 << 15
#: Runs of one variant up to this size are compared in one go, longer ones by growing a tree, and
#: beyond DEFERRED they are first dealt to several tasks.
SMALL, DEFERRED = 8, 20_000


def fingerprint(words: list[bytes], n: int, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half the XXH64 of the n-word shingles."""
    if not words:
        return 0
    total = max(1, len(words) - n + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, COUNTED):
        part = words[at:at + COUNTED + n - 1]
        shingles = [b" ".join(part)] if total == 1 else map(b" ".join, zip(*(part[i:] for i in range(n))))
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
        ones += _ones(h)
    return _majority(ones, total)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, n: int = 3) -> DataFrame:
    """The rows without their text, with fp (long).

    A-Z are lower-cased, words are runs of other characters than ASCII blanks; a text without words, or null, has
    fingerprint 0. Whole texts count, a few at a time. Columns named like the added ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + ["fp long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                words = [t.lower().split() for t in utf8(batch, "_text")]
                out = {c: batch.column(c) for c in kept}
                fps = pa.array(np.array([fingerprint(w, n) for w in words], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_pydict(out | {"fp": fps})

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(work, schema)


def variant_keys(fp: Column, bits: int) -> Column:
    """The 64 keys of a fingerprint: for each bit, its segment with that bit left out.

    With `bits` // 2 + 1 segments, two fingerprints that differ in at most `bits` bits differ by at most one bit in
    some segment, so they share the key that leaves that bit out.
    """
    count = bits // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    keys = []
    for low, high in zip(edges, edges[1:]):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 64 else fp
        keys += [F.xxhash64(F.lit(bit), part.bitwiseAND(F.lit(~(1 << (bit - low))))) for bit in range(low, high)]
    return F.array(*keys)


def _tree(fp: np.ndarray, near, weight) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph of `near` pairs, lightest edges first (Prim's order)."""
    left = np.arange(len(fp))
    best = np.full(len(fp), np.inf)
    via = np.full(len(fp), -1)
    while len(left):
        i = int(np.argmin(best[left]))
        node, left = left[i], np.delete(left, i)
        if via[node] >= 0:
            yield int(via[node]), int(node)
        if len(left):
            hit = left[near(node, left)]
            w = weight(node, hit)
            better = w < best[hit]
            best[hit[better]], via[hit[better]] = w[better], node


def linked(columns: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """Row pairs (m x 2) that link all rows of equal key within `bits`, for rows sorted by key.

    In short runs every near pair; in longer ones a spanning forest, which joins what all pairs would join.
    """
    key, fp = columns["key"], columns["fp"].view(np.uint64)
    weight = lambda a, b: np.bitwise_count(fp[a] ^ fp[b]).astype(float)
    near = lambda a, b: np.bitwise_count(fp[a] ^ fp[b]) <= bits
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(cuts)
    pairs = []
    short = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        a = np.flatnonzero((key[:-step] == key[step:]) & short[:-step]) if len(key) > step else np.empty(0, int)
        pairs.append(np.stack([a, a + step], axis=1)[near(a, a + step)])
    for c in np.flatnonzero(sizes > SMALL):
        at = cuts[c]
        tree = _tree(fp[at:cuts[c + 1]], lambda a, b, at=at: near(a + at, b + at), lambda a, b, at=at: weight(a + at, b + at))
        if found := list(tree):
            pairs.append(np.array(found) + at)
    return np.concatenate(pairs)


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs (a, b) of ids that connect exactly what all pairs of rows of `prints` within `bits` bits connect.

    `prints`: id and fp, one row per thing to link. Rows are exploded to 64 keys,
    sorted by key, and compared inside each key. A key with very many rows is passed on and dealt anew by the bytes
    of its whole fingerprint (for `bits` < 8 two links agree in one byte at least), so that no one task compares it.
    """
    used = ["id", "fp"]
    out = "kind int, a long, b long"

    def work(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            late = None  # the key that is being passed on

            def emit(cols: dict) -> Iterator[pa.RecordBatch]:
                pairs = linked(cols, bits)
                ids = np.sort(cols["id"][pairs], axis=1)
                ids = np.unique(ids[ids[:, 0] != ids[:, 1]], axis=0)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(ids), np.int32)), "a": pa.array(ids[:, 0]), "b": pa.array(ids[:, 1])})

            def passed(cols: dict) -> Iterator[pa.RecordBatch]:
                n = len(cols["id"])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(n, np.int32)), "a": pa.array(cols["id"]), "b": pa.array(cols["key"])})

            for batch in batches:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["key", *used]})
                if sum(len(h["key"]) for h in held) < 65536 and batch.num_rows >= 5000:
                    continue
                cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                cut = int(np.searchsorted(cols["key"], cols["key"][-1])) if len(cols["key"]) else 0
                done = {c: v[:cut] for c, v in cols.items()}
                rest = {c: v[cut:] for c, v in cols.items()}
                if late is not None and cut:
                    first = int(np.searchsorted(done["key"], late, "right"))
                    yield from passed({c: v[:first] for c, v in done.items()})
                    done, late = {c: v[first:] for c, v in done.items()}, None
                if len(done["key"]):
                    yield from emit(done)
                if len(rest["key"]) and not last and (late == rest["key"][0] or len(rest["key"]) > DEFERRED):
                    late = rest["key"][0]
                    yield from passed(rest)
                    rest = {c: v[:0] for c, v in rest.items()}
                held = [rest]
            if held:
                cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                if late is not None:
                    first = int(np.searchsorted(cols["key"], late, "right"))
                    yield from passed({c: v[:first] for c, v in cols.items()})
                    cols = {c: v[first:] for c, v in cols.items()}
                if len(cols["key"]):
                    yield from emit(cols)
        return run

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda d: d.repartition(parts, "key").sortWithinPartitions("key")
    variants = prints.select(*used, F.explode(variant_keys(F.col("fp"), bits)).alias("key"))
    first = saved(dealt(variants).mapInArrow(work(last=False), out))
    edges = first.where("kind = 0").select("a", "b")
    if not first.where("kind = 1").isEmpty():
        again = first.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("old")).join(prints.select(*used), "id")
        octet = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("v")) for i in range(8)]))
        finer = again.withColumn("o", octet).select(*used, F.xxhash64("old", "o.i", "o.v").alias("key"))
        edges = edges.unionAll(dealt(finer).mapInArrow(work(last=True), out).select("a", "b"))
    return edges.distinct()


def simhash_groups(docs: DataFrame, doc_id: str, text: str, *, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest id reachable over links of at most `bits` bits.

    Rows of equal fingerprint are one node, so copies are never expanded into pairs. Null and empty texts have
    fingerprint 0 and link like any other; null ids take part but never name a component unless all of it is null.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    prints = saved(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(nodes.select(F.col("fp").alias("id"), "fp"), bits)
    roots = components(edges)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


#: Near-copies share this part of their distinct shingles of so many words.
SIMILAR, SHINGLE = 0.8, 5
#: Keys of a text and the minima that make one. Texts that share 0.8 of their shingles have no key in common in (1 - 0.8^4)^40
#: = 7e-10 of cases; texts that share a tenth have one in 1 of 250.
KEYS, MINIMA = 40, 4
#: Texts that a task compares with as many others.
BLOCK = 2000


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles of word ids, repeats included; fewer words are one shingle."""
    if not len(ids):
        return np.empty(0, np.uint64)
    n = min(n, len(ids))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        h = mixed(h + ids[i:len(ids) - n + 1 + i], i)
    return h


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def min_keys(h: np.ndarray) -> np.ndarray:
    """KEYS hashes, each of MINIMA least values of a set of hashes multiplied by fixed odd numbers; none of an empty set."""
    if not len(h):
        return np.empty(0, np.uint64)
    factors = mixed(np.arange(KEYS * MINIMA, dtype=np.uint64)) | np.uint64(1)
    least = np.min([np.multiply.outer(factors, h[i:i + 1024]).min(axis=1) for i in range(0, len(h), 1024)], axis=0).reshape(KEYS, MINIMA)
    keys = np.arange(KEYS, dtype=np.uint64)
    for i in range(MINIMA):
        keys = mixed(keys + least[:, i], i)
    return keys


def _per_text(docs: DataFrame, name: str, kind: str, of) -> DataFrame:
    """(doc_id, same, name) of (doc_id, same, text): what `of` makes of a text's shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out = [of(np.unique(shingle_hashes(ids_of.of(t.lower().split()), SHINGLE))) for t in utf8(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(out, pa.list_(pa.int64()) if kind == "array<long>" else pa.binary())],
                                                 ["doc_id", "same", name])

    return docs.select("doc_id", "same", "text").mapInArrow(work, f"doc_id long, same string, {name} {kind}")


def joined(band: np.ndarray, root: np.ndarray, side: np.ndarray, keys: np.ndarray, sets: list) -> list[tuple[int, int]]:
    """Pairs of similar rows of one run that join all rows which its similar pairs would join.

    Rows of one root are joined already; with two values of `side` only pairs across them count. A pair is compared in the
    run of the first key that both rows have, and not if rows found before join it. Rows whose keys are the most common come first.
    """
    common = [np.unique(k, return_inverse=True, return_counts=True) for k in keys.T]
    weight = sum(counts[at] for _, at, counts in common)
    order, group, out = np.argsort(-weight, kind="stable"), root.copy(), []
    across = len(np.unique(side)) > 1
    for n, i in enumerate(order):
        rest = order[n + 1:]
        rest = rest[(group[rest] != group[i]) & ((side[rest] != side[i]) | (not across))]
        for j in rest[np.argmax(keys[rest] == keys[i], axis=1) == band] if len(rest) else rest:
            if group[j] != group[i] and similarity(sets[i], sets[j]) >= SIMILAR:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _rest_of_runs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of similar texts of one run that have different roots: what the stars of `near_duplicates` have not compared.

    A run of more than BLOCK texts is dealt as pairs of blocks, each a group of its own.
    """
    spark = shared.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rooted = (shared.where("n > 2").join(roots.withColumnRenamed("node", "id"), "id", "left")
              .withColumn("root", F.coalesce("root", "id")))
    many = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    runs = (rooted.join(many, "key").withColumn("mine", F.pmod(F.xxhash64("id"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("id", "root", "mine", "key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("run")))
    rows = runs.join(nodes.select("id", "keys"), "id").join(sets.withColumnRenamed("doc_id", "id"), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pairs() -> pa.RecordBatch:
            own = {r["id"]: r for r in held}
            rows = list(own.values())
            keys = np.array([r["keys"] for r in rows])
            column = lambda c: np.array([r[c] for r in rows])
            found = joined(int(np.argmax(keys[0] == rows[0]["key"])), column("root"), column("mine"), keys, [np.frombuffer(r["hashes"], np.uint64) for r in rows])
            ids = column("id")[np.array(found, int).reshape(-1, 2)]
            return pa.RecordBatch.from_pydict({"a": pa.array(ids[:, 0]), "b": pa.array(ids[:, 1])})

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[-1]["run"] != r["run"]:
                    yield pairs()
                    held = []
                held.append(r)
        if held:
            yield pairs()

    return rows.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(work, "a long, b long")


def print_links(texts: DataFrame) -> DataFrame:
    """(a, b) of ids of `texts` (doc_id, text) whose fingerprints differ in at most three bits, a < b; equal ones as a star."""
    marked = saved(fingerprints(texts.select("doc_id", "text"), "text"))
    heads = marked.groupBy("fp").agg(F.min("doc_id").alias("id"))
    equal = marked.join(heads, "fp").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return equal.unionAll(links(heads.select("id", "fp"), 3)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, same, root) of documents that another one stands for: root is the smallest id of their group.

    Near-copies share at least 0.8 of their distinct five-word shingles, words lower-cased in A-Z. Equal texts (`same`
    is their MD5) are one node. First the links of the SimHash fingerprints are verified (`print_links`). What they leave
    apart is found by keys: texts that share one of 40 MinHash keys are candidates. Of each run of one key, all are
    compared with the text whose keys are the most common; pairs that this leaves apart are then compared one by one, so no
    candidate pair stays untested unless its texts are joined already. Similarity is that of
    the whole sets of 64-bit shingle hashes, whatever their size.
    Null texts are empty texts. Rows without id are never listed; rows of equal id and text are one document.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("same"), F.col(text).alias("text")).where("doc_id is not null")
    prints = saved(_per_text(texts, "keys", "array<long>", lambda h: min_keys(h).view(np.int64)))
    least = prints.groupBy("same").agg(F.min("doc_id").alias("least"))
    nodes = saved(prints.join(least, "same").where("doc_id = least").select(F.col("doc_id").alias("id"), "same", "keys").dropDuplicates(["id", "same"]))
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = saved(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    pairs = saved(shared.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    near = saved(print_links(texts.join(nodes.select(F.col("id").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi")))
    candidates = shared.select("id").unionAll(near.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    used = nodes.join(candidates, "id", "left_semi").select(F.col("id").alias("doc_id"), "same")
    sets = saved(_per_text(texts.join(used, ["doc_id", "same"], "left_semi"), "hashes", "binary", np.ndarray.tobytes).drop("same").dropDuplicates(["doc_id"]))
    side = lambda n: sets.select(F.col("doc_id").alias(n), F.col("hashes").alias("s" + n))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lambda x: np.frombuffer(x.as_py(), np.uint64)
        for b in batches:
            ok = [similarity(hashes(x), hashes(y)) >= SIMILAR for x, y in zip(b.column("sa"), b.column("sb"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    alike = lambda p: saved(p.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"))
    first = alike(near)
    joined_by = components(first)
    root = lambda n: joined_by.select(F.col("node").alias(n), F.col("root").alias("r" + n))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    verified = first.unionAll(alike(apart))
    rest = saved(_rest_of_runs(shared, components(verified), nodes, sets))
    roots = components(verified.unionAll(rest))
    named = least.join(roots.withColumnRenamed("node", "least"), "least", "left").select("same", F.coalesce("root", "least").alias("root"))
    return prints.select("doc_id", "same").join(named, "same").where("doc_id <> root").select("doc_id", "same", "root")


def without_near_duplicates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` that no other document stands for: of each group the one of the smallest id stays.

    Of rows of equal id and text one stays, any of them if their other columns differ. Rows without id all stay.
    """
    gone, same = unused(docs, "gone", "same")
    digest = F.md5(F.coalesce(text, F.lit("")))
    left = near_duplicates(docs, doc_id, text).select(F.col("doc_id").alias(gone), F.col("same").alias(same))
    repeated = (docs.select(F.col(doc_id).cast("long").alias(gone), digest.alias(same)).where(F.col(gone).isNotNull())
                .groupBy(gone, same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(gone, same))
    at = (F.col(doc_id).cast("long") == F.col(gone)) & (digest == F.col(same))
    once = docs.join(left.unionAll(repeated), at, "left_anti")
    again = docs.join(repeated.join(left, [gone, same], "left_anti"), at, "left_semi")
    return once.unionAll(again.withColumn(same, digest).dropDuplicates([doc_id, same]).drop(same))
