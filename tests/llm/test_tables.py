"""WARC, top-k, mixing, sharding, the two classifiers and the pipeline: round trips, plain versions, held-out accuracy."""
import base64
import gzip
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import mixing, quality, sharding, topk, toxicity, warc
from colloquy.llm.common import components, prefix_sums, table
from colloquy.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, digest string, kind string"


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a/ b\r\n", big), (1, None, big), (2, "u", big), (4, "v", "short"), (5, "v", "short"), (6, "w", None), (7, "x", ""), (None, "y", big),
            (8, "z", "WARC/1.1\r\n\r\n" * 20), (1, None, big)]
    pages = spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES).repartition(3)
    got = warc.read_archives(spark, warc.write_archives(pages, "page_id", "url", "html")).collect()
    assert {r.kind for r in got} == {"record"}
    want = Counter((f"urn:page:{'none' if i is None else i}", "revisit" if h == big and i != 1 else "response",
                    "urn:page:1" if h == big and i != 1 else None, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
                   for i, _, h in rows)
    assert Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == want
    assert all(bytes(r.payload) == big.encode() for r in got if r.record_id == "urn:page:1")
    empty = warc.write_archives(pages.limit(0), "page_id", "url", "html")
    assert warc.read_archives(spark, empty).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    records = [warc.record(f"urn:page:{i}", f"http://h/{i}", "response", f"payload {i} WARC/1.1".encode() * 30, 0, hashlib.sha256(
        f"payload {i} WARC/1.1".encode() * 30).hexdigest(), None) for i in range(8)]
    parts = [warc.member(r) if packed else r for r in records]
    whole = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    assert [r["record_id"] for r in warc.salvaged(whole)] == [f"urn:page:{i}" for i in range(8)]
    if packed:
        assert gzip.decompress(whole) == b"".join(records)
    broken = bytearray(whole)
    broken[ends[1] + len(parts[2]) // 2] ^= 0xFF  # record 2
    broken[ends[4]:ends[4] + 3] = b"???"  # the start of record 5
    broken = b"junk" + bytes(broken[:ends[6]]) + bytes(broken[ends[6]:ends[6] + 20])  # record 7 cut off
    got = list(warc.salvaged(broken))
    assert [r["record_id"] for r in got if r["kind"] == "record"] == [f"urn:page:{i}" for i in (0, 1, 3, 4, 6)]
    gaps = [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"]
    assert gaps == [(0, 4), (4 + ends[1], len(parts[2])), (4 + ends[4], len(parts[5])), (4 + ends[6], 20)]
    assert sum(n for _, n in gaps) + sum(r["length"] for r in got if r["kind"] == "record") == len(broken)
    assert list(warc.salvaged(b"")) == []
    assert [r["kind"] for r in warc.salvaged(b"no archive at all")] == ["gap"]


def foreign(i, body=b"some payload", digest=None, kind="response", head=b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n", block_digest=True, length=None):
    """A record as other writers make it: SHA-1 digests in base32, or none."""
    block = head + body
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:r:{i}>", f"Content-Length: {len(block) if length is None else length}",
             f"WARC-Payload-Digest: {digest or sha1(body)}"] + ([f"WARC-Block-Digest: {sha1(block)}"] if block_digest else [])
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def ids(data):
    return [r.get("record_id", "gap") for r in warc.salvaged(data)]


def test_foreign_records():
    wrong = "sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    data = b"".join([foreign(0), foreign(1, digest="blake3:abc"), foreign(2, digest="sha1:tooshort"), foreign(3, digest=wrong), foreign(4, digest="md5:" + hashlib.md5(b"some payload").hexdigest()),
                     foreign(5, kind="revisit", body=b"", head=b"HTTP/1.1 200 OK\r\nContent-Length: none\r\n\r\n"), foreign(6, kind="resource", head=b"")])
    assert ids(data) == ["urn:r:0", "urn:r:1", "urn:r:2", "gap", "urn:r:4", "urn:r:5", "urn:r:6"]
    got = {r["record_id"]: r for r in warc.salvaged(data) if r["kind"] == "record"}
    assert got["urn:r:0"]["payload"] == got["urn:r:6"]["payload"] == b"some payload" and got["urn:r:0"]["payload_digest"].startswith("sha1:")
    assert got["urn:r:5"]["payload_bytes"] is None and got["urn:r:5"]["payload"] is None
    for length in ("9" * 5000, "-1", "twelve", "\u0663", "999999"):
        assert ids(foreign(7, length=length) + foreign(8)) == ["gap", "urn:r:8"]


def test_salvage_inside_members():
    good, bad = [foreign(i) for i in range(5)], bytearray(foreign(9))
    bad[-8] ^= 1
    member = warc.member(good[0] + bytes(bad) + good[1])
    rows = list(warc.salvaged(member + warc.member(good[2])))
    assert [r.get("record_id", "gap") for r in rows] == ["urn:r:0", "gap", "urn:r:1", "urn:r:2"]
    assert {(r["offset"], r["length"]) for r in rows[:3]} == {(0, len(member))}
    assert [(r["inner_offset"], r["inner_length"]) for r in rows[:3]] == [
        (0, len(good[0])), (len(good[0]), len(bad)), (len(good[0]) + len(bad), len(good[1]))]
    # records before the damage come out, if a digest vouches for them; the member is a gap all the same
    noise = np.random.default_rng(1).bytes(300_000)
    long = warc.member(good[0] + foreign(8, block_digest=False) + good[1] + foreign(7, body=noise) + good[3])
    assert ids(long[:len(long) - 100_000] + warc.member(good[4])) == ["urn:r:0", "urn:r:1", "gap", "urn:r:4"]
    changed = long[:200_000] + b"\xff" * 9 + long[200_009:]  # in stored bytes: all of it comes out, only record 7 is another
    assert ids(changed + warc.member(good[4])) == ["urn:r:0", "urn:r:1", "urn:r:3", "gap", "urn:r:4"]
    spoilt = warc.member(good[0] + good[1])[:-6] + b"\0\0\0\0\0\0"  # all bytes are there, the CRC is wrong
    assert ids(spoilt) == ["urn:r:0", "urn:r:1", "gap"]
    assert [(r["kind"], r["inner_length"]) for r in warc.salvaged(warc.member(b"no record"))] == [("gap", 9)]


def test_salvage_reads_false_starts_once():
    spent = []
    for n in (1, 8):
        data = (warc.MAGIC + b"x" * 7 + b"WARC/1.0\r\n" + b"y" * 7) * (20_000 * n) + foreign(0)
        start = time.process_time()
        assert ids(data) == ["gap", "urn:r:0"]
        spent.append(time.process_time() - start)
    assert spent[1] < 24 * spent[0] + 0.5  # eight times the false starts; a square would be 64 times


def plain_top(rows, every, k):
    rows = sorted({(i, tuple(int(np.floor(256.0 * float(x))) for x in v)) for i, v in rows
                   if i is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    best = defaultdict(list)
    for q, x in rows:
        if q % every == 0:
            best[q] += [(-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q and len(y) == len(x)]
    return sorted((q, n + 1, c, -s) for q, found in best.items() for n, (s, c) in enumerate(sorted(found)[:k]))


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(240)]
    rows += [(300 + i, rows[5][1]) for i in range(20)] + [rows[0]]  # ties and a repeated row
    rows += [(400, None), (401, []), (402, [1.0, None] * 6), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (None, [1.0] * 12),
             (405, [2.0] * 5), (410, [3.0] * 5), (420, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    got = topk.exact_top_k(df, "vec_id", "embedding", every=10, k=5)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 10, 5)
    assert topk.exact_top_k(df.limit(0), "vec_id", "embedding", every=10, k=5).count() == 0


def test_bounds_hold_and_wide_scores_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 13)), rng.normal(size=(50, 13))
    for n in (1, 2, 8, 13, 20):
        assert (topk.segment_statistics(a, n) @ topk.segment_statistics(b, n).T >= a @ b.T - 1e-9).all()
    x = np.array([[1 << 40, 1], [1 << 40, 2], [-(1 << 40), 5]], np.int64)
    assert topk.best_of_block(x[:1], np.array([0]), x, np.array([0, 1, 2]), 1) == [(0, 1, min((1 << 80) + 2, 2 ** 63 - 1))]


DOCS = "doc_id long, text string, source string, n_chars long, size long, taken long"


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 200), rng.choice(["big", "big", "big", "é", "a", None]), 7) for i in range(200)]
    rows += [(500, None, "a", None), (501, "", "void", 0), (502, "one", "tiny", 3), (None, "null id", "a", 7), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], DOCS).repartition(5)
    got, pieces = mixing.mix(df, "doc_id", "text", "source", block=16)
    got = got.collect()
    assert sorted((r._id is None, r._id or 0, r.size) for r in got) == sorted((d is None, d or 0, len((t or "").split())) for d, t, _, _ in rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, share = {}, {}
    while True:  # deal, cap, deal the rest again
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        free = sum(weight[s] for s in names if s not in capped)
        share = {s: capped.get(s, left * weight[s] / free if free else 0) for s in names}
        over = [s for s in names if s not in capped and share[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r._source] and r.target == pytest.approx(share[r._source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r._source] += r.taken
    assert all(abs(taken[s] - share[s]) <= 0.5 + 1e-6 for s in names)
    slots = pieces.groupBy("slot").agg(F.countDistinct("src", "rank").alias("n"), F.sum("words").alias("w"), F.min("src").alias("src")).collect()
    assert all(r.n == 1 and r.w <= 16 for r in slots) and sum(r.w < 16 for r in slots) <= len(names)
    order = [r.src for r in sorted(slots, key=lambda r: r.slot)]
    for n in (50, 100, len(order)):  # every beginning of the schedule is near the weights
        seen = Counter(order[:n])
        for src, s in enumerate(names):
            assert abs(seen[src] - n * share[s] / sum(share.values())) < 6
    docs = mixing.mixed_documents(df, "doc_id", "text", "source", "n_chars", block=16)
    assert docs.columns == df.columns
    assert Counter({k: v for k, v in taken.items() if v}) == sum((Counter({r.source: len(r.text.split())}) for r in docs.collect()), Counter())
    none, _ = mixing.mix(df.limit(0), "doc_id", "text", "source")
    assert none.count() == 0 and mixing.mixed_documents(df.limit(0), "doc_id", "text", "source").count() == 0


def plain_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, *range(100, 900), None, 100, 100]
    df = spark.createDataFrame([(k, None if i % 50 == 0 else "té" * (i % 7), i, "x") for i, k in enumerate(keys)], "doc_id long, text string, slot int, shard string")
    got = sharding.shard(df.repartition(6), "doc_id", "text", 40).collect()
    again = sharding.shard(df.coalesce(1), "doc_id", "text", 40).collect()
    assert len(got) == len(keys) and Counter(map(str, got)) == Counter(map(str, again))
    slots = defaultdict(list)
    for r in got:
        assert r.shard == plain_jump(r.doc_id or 0, 40) and r.grown_shard == plain_jump(r.doc_id or 0, 41)
        assert r.grown_shard in (r.shard, 40)
        assert r["size"] == len((r.text or "").encode()) + 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(df.limit(0), "doc_id", "text", 3).count() == 0


CLASHING = ("_c1", "c1", "C2", "_v", "_o", "_i", "i", "_digest", "digest", "_size", "SIZE", "_taken", "_whole", "_rest", "_copy", "copy", "_text", "_n", "row", "a.b")


def with_clashes(spark, n):
    df = spark.createDataFrame([(i, f"some words of text {i} " * 3, "ab"[i % 2]) for i in range(n)], "doc_id long, text string, source string")
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in CLASHING})


def test_columns_of_any_name_are_kept(spark):
    df = with_clashes(spark, 40)
    want = {r.doc_id: tuple(r[c] for c in CLASHING) for r in df.collect()}
    mixed = mixing.mixed_documents(df, "doc_id", "text", "source", block=16)
    assert mixed.columns == df.columns
    rows = mixed.collect()
    assert rows and all(tuple(r[c] for c in CLASHING) == want[r.doc_id] for r in rows)
    own = [c for c in CLASHING if c.lower() != "size"]  # shard() adds a size of its own
    sharded = sharding.shard(df.drop("SIZE"), "doc_id", "text", 7)
    assert sharded.columns == [c for c in df.columns if c != "SIZE"] + ["size", "text_crc32", "shard", "grown_shard", "slot"]
    assert {r.doc_id: tuple(r[c] for c in own) for r in sharded.collect()} == {
        k: tuple(x for c, x in zip(CLASHING, v) if c != "SIZE") for k, v in want.items()}
    summed = prefix_sums(df.withColumn("hex", F.md5("text")), ["source"], "hex", ["doc_id"], F.lit(1), "before")
    assert {r.doc_id: tuple(r[c] for c in CLASHING) for r in summed.collect()} == want


def test_prefix_sums_and_components(spark):
    rng = random.Random(9)
    rows = [(f"{rng.randrange(1 << 20):05x}", i, "ab"[i % 2], rng.randrange(9)) for i in range(500)]
    got = prefix_sums(spark.createDataFrame(rows, "h string, i int, k string, v long"), ["k"], "h", ["i"], F.col("v"), "before").collect()
    for r in got:
        assert r.before == sum(v for h, i, k, v in rows if k == r.k and (h, i) < (r.h, r.i))
    edges = [(i, i + 1) for i in range(300) if i % 37] + [(1000, x) for x in range(2000, 2100)] + [(5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            assert roots[a] == roots[b]
    assert roots[1] == 1 and roots[36] == 1 and roots[38] == 38 and roots[2050] == 1000 and 5 in roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folding_and_lexicon():
    assert toxicity.fold("You 1D10T!! іdіоt, ｉｄｉｏｔ id​iot $cum m0r0n sc@m 100 that*** a$$$") == " you idiot idiot idiot idiot scum moron scam 100 that a "
    lex = toxicity.Lexicon({"idiot": 4.0, "clown": 3.0, "scum*": 5.0}, ("clown fish",), (-3.0, 1.0, 2.0))
    assert lex.features("an idiot, a clown") == (7.0, 4)
    assert lex.features("the clown fish idiotic scumbags") == (5.0, 5)
    assert lex.features("") == (0.0, 0) and lex.features("...") == (0.0, 0)
    assert lex.score("nice words") < 0.5 < lex.score("1d10t")
    assert lex.score("idiot " + "word " * 5000) < lex.score("idiot")


def auc(score, label):
    score, label = np.array(score), np.array(label)
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2


@pytest.mark.parametrize("name,label,cut,least", [("op8_toxicity", "toxic", 0.5, 0.8), ("op10_quality", "quality", 0.3, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, cut, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).collect()
    labels = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == table(spark, sf, "documents").count() and auc(*zip(*held)) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, op):
    docs = spark.createDataFrame([(1, "you idiot", 2), (2, None, 3), (3, "", 4), (None, "x" * 200_000, 5), (1, "you idiot", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id long, y int")
    for known in (labels, labels.limit(0), labels.where("y = 1")):
        got = op.scored(docs, "text", op.learn(docs, "doc_id", "text", known, "doc_id", "y")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert got[1].score == got[2].score
    assert op.scored(docs.limit(0), "text", op.learn(docs.limit(0), "doc_id", "text", labels, "doc_id", "y")).count() == 0


def test_chunks_cover_whole_texts():
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 496, 497, 5000):
        text = bytes(i % 255 + 1 for i in range(n))
        rows = quality.chunks(text)
        assert b"".join(r[:quality.STRIDE].tobytes() for r in rows[:-1]) + rows[-1].tobytes().rstrip(b"\0") == text
    net = quality.train([quality.chunks(b"good words here " * 20)] * 20 + [quality.chunks(b"$$$ ### !!! " * 25)] * 20, np.array([1.0] * 20 + [0.0] * 20))
    texts = [b"good words " * 3, b"### $$$ " * 9, b"", b"good words here " * 9000]
    s = net.scores(texts, net.pairs())
    assert s[0] > 0.5 > s[1] and s[3] > 0.5
    assert s == pytest.approx([net.scores([t], net.pairs())[0] for t in texts])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator says of its own input; run() against the stages."""
    docs, kept = table(spark, SF, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((name, docs, out))
        assert out.columns[:len(columns)] == columns
        docs = out
    ids = {name: (Counter(r.doc_id for r in a.collect()), Counter(r.doc_id for r in b.collect())) for name, a, b in kept}
    for name in ("toxicity", "near_duplicates", "benchmark_leaks"):
        assert not ids[name][1] - ids[name][0]
    lexicon = toxicity.learn(kept[0][1], "doc_id", "text", table(spark, SF, "labels").where(~toxicity.held_out(F.col("doc_id"))), "doc_id", "toxic")
    assert set(ids["toxicity"][1]) == {r.doc_id for r in kept[0][1].collect() if lexicon.score(r.text or "") < 0.5}
    bench = [tuple(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    gone = set(ids["benchmark_leaks"][0]) - set(ids["benchmark_leaks"][1])
    for r in kept[2][1].collect():
        w = r.text.split()
        if any(tuple(w[i:i + len(b)]) == b for b in bench for i in range(len(w) - len(b) + 1)):
            assert r.doc_id in gone
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert words(kept[3][2]) == pytest.approx(min(1.5, 2) * words(kept[3][1]), abs=20)
    assert {r.shard for r in docs.collect()} <= set(range(40)) and docs.count() == kept[4][1].count()
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == ids["shards"][1]
