"""Splits, sampling, de-duplication and label joins over all documents."""
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import hashing as H, text as T
from colloquy.operators import sampling as O
from colloquy.plans.registry import query
from colloquy.plans.text_queries import sql_cue
from colloquy.sources import driver_tables as D

SEED = K.SPLIT_SEED


def examples(spark, sf):
    e = D.examples(spark, sf).withColumn("cue", T.cue_flag(F.col("text")))
    return e.withColumn("stratum", T.stratum(F.col("cue"), F.when(F.col("doc_id") % 3 != 0, "r")))


SQL_EX = f"""{D.SQL_EXAMPLES},
exs AS (SELECT *, {sql_cue('text')} AS cue, CASE WHEN {sql_cue('text')} THEN 'cue' ELSE 'plain' END || '/' ||
  CASE WHEN doc_id % 3 = 0 THEN 'opener' ELSE 'reply' END AS stratum, {D.sql_norm('text')} AS norm FROM ex)"""


def sh(*parts):
    return "sha256(" + " || ':' || ".join(parts) + ")"


@query("assign_split", f"WITH {D.SQL_EXAMPLES} SELECT id, split FROM ex")
def assign_split(spark, sf):
    return D.examples(spark, sf).select("id", "split")


@query("split_leaks", f"""WITH {D.SQL_EXAMPLES}, a AS (SELECT company AS grp, CASE WHEN doc_id % 17 = 0 THEN 'dev' ELSE split END AS s FROM ex)
SELECT grp AS company, CASE WHEN bool_or(s NOT IN ('train','calib','test')) THEN 'unknown_split' ELSE 'several_splits' END AS problem
FROM a GROUP BY 1 HAVING bool_or(s NOT IN ('train','calib','test')) OR count(DISTINCT s) > 1""")
def split_leaks(spark, sf):
    e = D.examples(spark, sf).withColumn("split", F.when(F.col("doc_id") % 17 == 0, "dev"
                                                         ).otherwise(F.col("split")))
    return O.split_leaks(e, "company")


# each document its own group here, so that exact copies do land in different splits
def own_group(spark, sf):
    return examples(spark, sf).withColumn("group", F.col("id")).withColumn(
        "split", H.assign_split(F.col("id"), SEED, K.SPLIT_FRACTIONS))


SQL_OWN = f"{SQL_EX}, own AS (SELECT * REPLACE ({D.split_sql('id')} AS split, id AS grp) FROM exs)"


@query("dedupe_against_train", f"""WITH {SQL_OWN} SELECT id, split FROM own o WHERE split = 'train'
 OR norm NOT IN (SELECT norm FROM own WHERE split = 'train')""")
def dedupe_against_train(spark, sf):
    return O.dedupe_against_train(own_group(spark, sf)).select("id", "split")


@query("dedupe_report", f"""WITH {SQL_OWN}, a AS (SELECT split, split <> 'train' AND norm IN
 (SELECT norm FROM own WHERE split = 'train') AS d FROM own), s AS (SELECT unnest(['train','calib','test']) AS split)
SELECT split, count(*) FILTER (NOT d) AS n_rows, count(*) FILTER (d) AS dropped FROM s LEFT JOIN a USING (split) GROUP BY 1""")
def dedupe_report(spark, sf):
    return O.dedupe_report(own_group(spark, sf))


SQL_POOL = f"""{SQL_OWN},
kept AS (SELECT * FROM exs WHERE split = 'train' AND norm NOT IN (SELECT norm FROM exs WHERE split = 'test')),
th AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {sh(f"'{SEED}'", "'pool-thread'", 'id')}) = 1)"""


@query("train_pool", f"""WITH {SQL_POOL} SELECT id, grp AS "group" FROM th ORDER BY {sh(f"'{SEED}'", "'pool-draw'", 'id')} LIMIT 20""")
def train_pool(spark, sf):
    e = examples(spark, sf)
    return O.train_pool(e, e.where("split = 'test'"), 20, SEED).select("id", "group")


@query("train_pool_report", f"""WITH {SQL_POOL} SELECT (SELECT count(*) FROM exs WHERE split = 'train') AS train_candidates,
 (SELECT count(*) FROM exs WHERE split = 'train') - (SELECT count(*) FROM kept) AS dropped,
 count(*) AS train_threads, least(20, count(*)) AS chosen FROM th""")
def train_pool_report(spark, sf):
    e = examples(spark, sf)
    return O.train_pool_report(e, e.where("split = 'test'"), 20)


@query("one_per_group", f"""WITH {D.SQL_EXAMPLES} SELECT id, grp AS "group" FROM ex
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {sh(f"'{SEED}'", "'one'", 'id')}) = 1""")
def one_per_group(spark, sf):
    e = D.examples(spark, sf).select("id", "group")
    return O.one_per_group(e, "group", SEED, "one")


@query("seeded_sample", f"SELECT l_orderkey, l_linenumber, id FROM (SELECT *, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR "
       f"|| '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS id FROM lineitem) ORDER BY {sh(f'{SEED!r}::VARCHAR', repr('draw'), 'id')}, id LIMIT 500")
def seeded_sample(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    return O.seeded_sample(li, 500, SEED, "draw")


# the four languages play the four strata
SQL_LANG = f"{D.SQL_EXAMPLES}, ls AS (SELECT id, label AS stratum, split FROM ex)"


@query("equal_strata_sample", f"""WITH {SQL_LANG}, p AS (SELECT * FROM ls WHERE stratum IN ('en','de','fr','es')
 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {sh(f"'{SEED}'", "'pick'", 'id')}) <= 5)
SELECT id, stratum, row_number() OVER (ORDER BY {sh(f"'{SEED}'", "'pick'", "'order'", 'id')}) AS display FROM p""")
def equal_strata_sample(spark, sf):
    e = D.examples(spark, sf).select("id", F.col("label").alias("stratum"))
    return O.equal_strata_sample(e, ("en", "de", "fr", "es"), 20, SEED, "pick")


def sql_quota(sizes: str, n: str) -> str:
    return f"""lr0 AS (SELECT *, sum(size) OVER (PARTITION BY split) AS t FROM {sizes}),
lr1 AS (SELECT split, stratum, size, {n} AS n, ({n} * size) // t AS q, ({n} * size) % t AS m FROM lr0),
lr AS (SELECT split, stratum, size, n, q + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY m DESC, stratum)
  <= n - sum(q) OVER (PARTITION BY split) THEN 1 ELSE 0 END AS quota FROM lr1)"""


SQL_QUOTA = f"""{SQL_LANG}, sz AS (SELECT split, stratum, count(*) AS size FROM ls WHERE split IN ('test','calib') GROUP BY 1, 2),
{sql_quota('sz', "CASE split WHEN 'test' THEN 17 ELSE 9 END")}"""


@query("largest_remainder", f"WITH {SQL_QUOTA} SELECT split, stratum, size::BIGINT AS size, n::BIGINT AS n, quota::BIGINT AS quota FROM lr")
def largest_remainder(spark, sf):
    e = D.examples(spark, sf).where("split <> 'train'").groupBy(
        "split", F.col("label").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return O.largest_remainder(e.withColumn("n", F.when(F.col("split") == "test", 17).otherwise(9
                                                        ).cast("bigint")))


@query("proportional_sample", f"""WITH {SQL_QUOTA}, p AS (SELECT ls.*, row_number() OVER (PARTITION BY split, stratum
  ORDER BY {sh("'20260928'", "'relabel'", 'split', 'stratum', 'id')}) AS r FROM ls)
SELECT id, split, stratum, row_number() OVER (ORDER BY {sh("'20260928'", "'relabel'", "'order'", 'id')}) AS display
FROM p JOIN lr USING (split, stratum) WHERE r <= quota""")
def proportional_sample(spark, sf):
    e = D.examples(spark, sf).select("id", "split", F.col("label").alias("stratum"))
    return O.proportional_sample(e, {"test": 17, "calib": 9}, K.RELABEL_SEED)


@query("guarded_train_sample", f"""WITH {D.SQL_EXAMPLES} SELECT id FROM ex WHERE split = 'train'
 ORDER BY {sh("'20260929'", "'train-hand'", 'id')} LIMIT 25""")
def guarded_train_sample(spark, sf):
    e = D.examples(spark, sf).select("id", "group", "split")
    return O.guarded_train_sample(e.where("split = 'train'"), e.where("split <> 'train'"), 25,
                                  K.TRAIN_SAMPLE_SEED).select("id")


@query("carve_dev", f"""WITH {D.SQL_EXAMPLES}, g AS (SELECT DISTINCT grp FROM ex),
k AS (SELECT grp, row_number() OVER (ORDER BY {sh(f"'{SEED}'", "'dev'", "'lang'", 'grp')}) AS r, count(*) OVER () AS n FROM g)
SELECT id, r <= greatest(1, round_even(n * 0.05::DOUBLE, 0)) AS dev FROM ex JOIN k USING (grp)""")
def carve_dev(spark, sf):
    e = D.examples(spark, sf).select("id", "group")
    return O.carve_dev(e, K.DEV_FRACTION, SEED, "lang").select("id", "dev")


QUOTAS = {"en": 100, "de": 250, "fr": 37, "es": 90}
SQL_Q = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items()) + ") q(task, quota)"


def _quotas(spark):
    return spark.createDataFrame(list(QUOTAS.items()), "task string, quota bigint")


@query("epoch_mixture", f"""WITH {D.SQL_EXAMPLES}, i AS (SELECT id, label AS task, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY {sh(f"'{SEED}'", "'mix'", "'3'", 'id')}) AS r FROM ex)
SELECT id, task, unnest(range((r > quota % n)::BIGINT, quota // n + 1)) AS copy FROM i JOIN {SQL_Q} USING (task)""")
def epoch_mixture(spark, sf):
    e = D.examples(spark, sf).select("id", F.col("label").alias("task"))
    return O.epoch_mixture(e, _quotas(spark), SEED, 3).select("id", "task", "copy")


@query("mixture_report", f"""SELECT task, quota::BIGINT AS n_rows, round(quota / count(*)::DOUBLE, 6) AS repeats
FROM documents JOIN {SQL_Q} ON task = lang GROUP BY task, quota""")
def mixture_report(spark, sf):
    e = D.examples(spark, sf).select("id", F.col("label").alias("task"))
    return O.mixture_report(e, _quotas(spark)).withColumn("repeats", F.round("repeats", 6))


@query("class_balanced_mixture", f"""WITH {D.SQL_EXAMPLES}, i AS (SELECT id, label AS task, doc_id % 3 AS label FROM ex),
c AS (SELECT task, label, count(*) AS n, row_number() OVER (PARTITION BY task ORDER BY label) - 1 AS i,
  count(*) OVER (PARTITION BY task) AS k FROM i GROUP BY 1, 2),
cq AS (SELECT task, label, n, quota // k + CASE WHEN i < quota % k THEN 1 ELSE 0 END AS quota FROM c JOIN {SQL_Q} USING (task)),
r AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY {sh(f"'{SEED}'", "'mix'", "'1'", 'id')}) AS r FROM i)
SELECT task, label, id, unnest(range((r > quota % n)::BIGINT, quota // n + 1)) AS copy FROM r JOIN cq USING (task, label)""")
def class_balanced_mixture(spark, sf):
    e = D.examples(spark, sf).select("id", F.col("label").alias("task"),
                                     (F.col("doc_id") % 3).alias("label"))
    return O.class_balanced_mixture(e, _quotas(spark), SEED, 1)


@query("even_subsample", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE r IN (SELECT round_even(i * ((SELECT count(*) FROM documents) - 1)::DOUBLE / 36.0, 0)::BIGINT
FROM range(37) t(i))""")
def even_subsample(spark, sf):
    return O.even_subsample(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 37)


@query("stride_subsample", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
 greatest(1, count(*) OVER (PARTITION BY lang) // 6) AS step FROM documents)
SELECT doc_id, lang AS decision FROM r WHERE r % step = 0 AND r // step < 6""")
def stride_subsample(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("decision"))
    return O.stride_subsample(d, "doc_id", 6)


@query("cap_rows", f"""WITH {D.SQL_EXAMPLES} SELECT id, label AS task FROM ex WHERE split = 'train'
 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sh(f"'{SEED}'", "'cap'", 'id')}) <= 40""")
def cap_rows(spark, sf):
    e = D.examples(spark, sf).where("split = 'train'").select("id", F.col("label").alias("task"))
    return O.cap_rows(e, 40, SEED)


# -- label records: hand labels from quality, machine labels from toxic --------------------------

SQL_LABELS = """
hand AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, greatest(8, length(doc_id::VARCHAR))::INTEGER, '0') AS id, doc_id * 10 AS "at", 'v1' AS guidelines, 'h1' AS labeller,
   CASE WHEN doc_id % 11 = 0 THEN 'skip' WHEN quality = 1 THEN 'true' ELSE 'false' END AS label FROM labels
 UNION ALL SELECT 'doc-' || lpad(doc_id::VARCHAR, greatest(8, length(doc_id::VARCHAR))::INTEGER, '0'), doc_id * 10 + 5, 'v1', 'h1',
   CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END FROM labels WHERE doc_id % 5 = 0),
machine AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, greatest(8, length(doc_id::VARCHAR))::INTEGER, '0') AS id, doc_id * 10 AS "at", 'm1' AS model,
   CASE WHEN doc_id % 7 = 0 THEN 'v2' ELSE 'v3' END AS prompt,
   CASE WHEN doc_id % 13 = 0 THEN 'unsure' WHEN toxic = 0 THEN 'y' ELSE 'n' END AS label FROM labels),
lh AS (SELECT * FROM hand QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC) = 1)"""


def _doc_id():
    return F.concat(F.lit("doc-"), T.padded(F.col("doc_id"), 8)).alias("id")


def hand_labels(spark, sf):
    lab = D.table(spark, sf, "labels")
    first = lab.select(_doc_id(), (F.col("doc_id") * 10).alias("at"), F.when(
        F.col("doc_id") % 11 == 0, "skip").when(F.col("quality") == 1, "true").otherwise("false"
                                                                                ).alias("label"))
    again = lab.where("doc_id % 5 = 0").select(_doc_id(), (F.col("doc_id") * 10 + 5).alias("at"), F.when(
        F.col("toxic") == 1, "true").otherwise("false").alias("label"))
    return first.unionByName(again).withColumn("guidelines", F.lit("v1")).withColumn(
        "labeller", F.lit("h1"))


def machine_labels(spark, sf):
    return D.table(spark, sf, "labels").select(
        _doc_id(), (F.col("doc_id") * 10).alias("at"), F.lit("m1").alias("model"),
        F.when(F.col("doc_id") % 7 == 0, "v2").otherwise("v3").alias("prompt"),
        F.when(F.col("doc_id") % 13 == 0, "unsure").when(F.col("toxic") == 0, "y").otherwise("n"
                                                                                  ).alias("label"))


@query("resume_todo", f"""WITH {D.SQL_EXAMPLES}, {SQL_LABELS} SELECT id FROM ex WHERE id NOT IN
 (SELECT id FROM machine WHERE model = 'm1' AND prompt = 'v3')""")
def resume_todo(spark, sf):
    return O.resume_todo(D.examples(spark, sf).select("id"), machine_labels(spark, sf), "m1", "v3")


@query("latest_label", f"WITH {SQL_LABELS} SELECT id, label, \"at\" FROM lh")
def latest_label(spark, sf):
    return O.latest_label(hand_labels(spark, sf)).select("id", "label", "at")


@query("labelled_rows", f"""WITH {SQL_EX}, {SQL_LABELS} SELECT id, lh.label, stratum AS kind, NOT cue AS hard, labeller
FROM exs JOIN lh USING (id) WHERE split = 'test' AND lh.label <> 'skip'""")
def labelled_rows(spark, sf):
    e = examples(spark, sf).drop("label")
    return O.labelled_rows(e, hand_labels(spark, sf), "test", "v1").select(
        "id", "label", "kind", "hard", "labeller")


@query("machine_rows", f"""WITH {SQL_EX}, {SQL_LABELS} SELECT id, CASE m.label WHEN 'y' THEN 'true' ELSE 'false' END AS label,
 'machine' AS source, stratum AS kind, NOT cue AS hard, prompt FROM exs JOIN machine m USING (id)
WHERE split = 'train' AND m.label <> 'unsure'""")
def machine_rows(spark, sf):
    e = examples(spark, sf).drop("label").where("split = 'train'")
    return O.machine_rows(e, machine_labels(spark, sf), "machine").select(
        "id", "label", "source", "kind", "hard", "prompt")


@query("min_label_gate", f"WITH {SQL_LABELS} SELECT count(*) AS n FROM lh")
def min_label_gate(spark, sf):
    rows = O.latest_label(hand_labels(spark, sf))
    return O.min_label_gate(rows, 10).agg(F.count(F.lit(1)).alias("n"))


@query("cached_answers", """WITH r AS (SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id::VARCHAR || '}') AS key FROM events),
c AS (SELECT DISTINCT key FROM r JOIN events USING (event_id) WHERE user_id % 3 <> 0)
SELECT event_id, r.key, c.key IS NOT NULL AS valid, CASE WHEN c.key IS NULL THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS p_first
FROM r LEFT JOIN c ON r.key = c.key""")
def cached_answers(spark, sf):
    e = D.table(spark, sf, "events")
    r = e.select("event_id", "user_id", O.request_key(F.col("event_type"), F.col("user_id")
                                                      ).alias("key"))
    cache = r.where("user_id % 3 <> 0").select("key").distinct().withColumn(
        "response", F.lit('{"false": 3, "true": 1}'))
    a = O.cached_answers(r, cache, ("false", "true"))
    return a.select("event_id", "key", "valid", F.get("probs", F.lit(0)).alias("p_first"))
