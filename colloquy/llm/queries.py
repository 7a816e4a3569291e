"""The registered queries of the corpus operators, with SQL twins where SQL can say them."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import collocations, decontam, importance, licenses, maxent, mixing, quality, sharding, simhash, substring_dedup, topk, toxicity, warc
from colloquy.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return (warc.read_archives(spark, path, payloads=False).where("kind = 'record'")
            .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    number("refers_to").alias("refers_to")))


SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, bits=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=5)


SQL["op5_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL["op7_mix"] = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(
               regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(src % 3 + 1)::INTEGER] AS weight, 2.0::DOUBLE * source_size AS cap FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS lvl
      FROM w WINDOW o AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first(CASE WHEN cap > lvl * weight THEN lvl END IGNORE NULLS) OVER (ORDER BY cap / weight, src
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT *, CASE WHEN level IS NULL THEN cap ELSE level * weight END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY t.src ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(size, goal % source_size - start)) END::BIGINT AS taken
FROM p
"""


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (sharding.shard(docs, "doc_id", "text", 40)
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


# CRC-32 from its 256 remainders, and one row per jump
SQL["op9_shards"] = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, (strlen(text) + 16)::BIGINT AS size, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda p: ('0x' || h[p:p + 1])::BIGINT),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS text_crc32 FROM d, tab),
j AS (SELECT r, n, 0::BIGINT AS b, 0::BIGINT AS j, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k
  FROM c, (VALUES (40), (41)) t(n)
  UNION ALL SELECT r, n, j AS b, floor((j + 1) * (2147483648::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT AS j,
  (k * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j WHERE j < n),
s AS (SELECT r, max(b) FILTER (n = 40)::INTEGER AS shard, max(b) FILTER (n = 41)::INTEGER AS grown_shard FROM j GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id, 0)::VARCHAR), doc_id, text_crc32) - 1 AS slot, grown_shard
FROM c JOIN s USING (r)
"""


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", window=20)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op3_repeats"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS name FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY name ORDER BY doc_id, p) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n FROM words
         ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query
def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def taught_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows that may be learned from."""
    return table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, "doc_id", "text", taught_labels(spark, sf_dir), "doc_id", "toxic")
    return (toxicity.scored(docs, "text", lexicon)
            .select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.learn(docs, "doc_id", "text", taught_labels(spark, sf_dir), "doc_id", "quality")
    return (quality.scored(docs, "text", network)
            .select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is source/lang/doc_id, so that sources and languages are its directories."""
    name = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(name.alias("path"), "text")
    return (licenses.license_scan(docs, "path", "text")
            .withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long")))


_TEMPLATES = ", ".join(f"({i}, '{n}', '{t.lower()}')" for i, (n, t) in enumerate(licenses.TEMPLATES))
_CUED = lambda x: "(" + " OR ".join(f"contains({x}, '{c}')" for c in licenses.CUES) + ")"
SQL["op1_licenses"] = rf"""
WITH base AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id::VARCHAR) AS path, lower(text) AS text FROM documents),
cued AS (SELECT path, text FROM base WHERE {_CUED('text')}),
units AS (SELECT path, 0 AS unit, text AS segment FROM cued UNION ALL
  SELECT path, generate_subscripts(s, 1) AS unit, unnest(s) AS segment FROM (SELECT path, list_filter(
    string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: {_CUED('x')}) AS s FROM cued)),
tf AS (SELECT path, unit, term, count(*) AS n FROM (SELECT path, unit, unnest(regexp_extract_all(segment, '{licenses.TERM}')) AS term FROM units) GROUP BY ALL),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(text, '{licenses.TERM}')) AS term
       FROM (VALUES {_TEMPLATES}) t(template, license, text)) GROUP BY ALL),
units_n AS (SELECT count(*) AS units FROM (SELECT DISTINCT path, unit FROM tf WHERE unit > 0)),
df AS (SELECT term, count(*) AS df FROM tf WHERE unit > 0 GROUP BY term),
idf AS (SELECT term, ln((1.0 + units) / (1.0 + coalesce(df, 0))) + 1.0 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), units_n),
tv AS (SELECT template, license, term, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM tt JOIN idf USING (term)),
len AS (SELECT path, unit, sqrt(sum((n * coalesce(idf, ln(1.0 + units) + 1.0)) ** 2)) AS length FROM tf LEFT JOIN idf USING (term), units_n GROUP BY ALL),
dots AS (SELECT path, unit, template, license, sum(n * idf * w) AS dot FROM tf JOIN tv USING (term) GROUP BY ALL),
scored AS (SELECT *, round(dot / length, 6) AS score FROM dots JOIN len USING (path, unit)),
own AS (SELECT path, license, CASE WHEN unit = 0 THEN 'file' ELSE 'header' END AS origin, score FROM scored
        WHERE (unit = 0 AND score >= {licenses.FILE}) OR (unit > 0 AND score >= {licenses.HEADER})
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY unit > 0, score DESC, template) = 1),
given AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS folder, license, path FROM own WHERE origin = 'file'
          QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '(^|/)[^/]*$', '') ORDER BY score DESC, path) = 1),
homes AS (SELECT DISTINCT regexp_replace(path, '(^|/)[^/]*$', '') AS home FROM base),
inh AS (SELECT home, license, given.path FROM homes JOIN given ON folder = '' OR home = folder OR starts_with(home, folder || '/')
        QUALIFY row_number() OVER (PARTITION BY home ORDER BY length(folder) DESC) = 1)
SELECT base.doc_id, base.path, coalesce(own.license, inh.license) AS license,
       CASE WHEN own.license IS NOT NULL THEN own.origin WHEN inh.license IS NOT NULL THEN 'inherited' END AS origin, own.score,
       CASE WHEN own.license IS NOT NULL THEN base.path ELSE inh.path END AS licensed_by
FROM base LEFT JOIN own ON own.path = base.path LEFT JOIN inh ON inh.home = regexp_replace(base.path, '(^|/)[^/]*$', '')
"""


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# the CRC-32 of each distinct word, from its 256 remainders
SQL["op11_importance"] = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
sw AS (SELECT r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM low),
tw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
names AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM sw UNION SELECT word FROM tw)),
crc AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda p: ('0x' || h[p:p + 1])::BIGINT),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::BIGINT % 10000 AS bucket FROM names, tab),
s AS (SELECT bucket, count(*) AS s FROM sw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN crc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM sw) + 10000.0::DOUBLE AS big_s, (SELECT count(*) FROM tw) + 10000.0::DOUBLE AS big_t),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1.0::DOUBLE) * big_s / ((s + 1.0::DOUBLE) * big_t)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM sw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM low LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM d)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM d WHERE n_features >= 20) * 10 // 100 THEN place END::BIGINT AS rank FROM k
"""


@query
def op12_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return maxent.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", held_out)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), "lang", "text")


SQL["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS head, array_to_string(ws[i + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
cut AS (SELECT x.lang, x.phrase, a, i, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
        FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE sub.longer IS NULL OR 100 * sub.longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
