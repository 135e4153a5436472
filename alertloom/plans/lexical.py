"""Registered nearest-example queries: unlabeled documents take the labels of the closest labeled one."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom import fixtures as fx
from alertloom.operators import lexical as lx

_BM25 = """WITH tr AS (SELECT doc_id, quality, toxic, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents JOIN labels USING (doc_id)),
qu AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
tw AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM tr) GROUP BY ALL),
dl AS (SELECT doc_id, len(t) AS dl FROM tr), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT token, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tw, c GROUP BY token, n),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
post AS (SELECT token, doc_id, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tw JOIN dl USING (doc_id) JOIN idf USING (token), c),
qw AS (SELECT doc_id, token, count(*) AS qtf FROM (SELECT doc_id, unnest(t) AS token FROM qu) GROUP BY ALL),
sc AS (SELECT qw.doc_id, post.doc_id AS rep, round(sum(qtf * w), 9) AS score FROM qw JOIN post USING (token) GROUP BY ALL),
best AS (SELECT doc_id, max_by(rep, (score, -rep)) AS rep, max(score) AS score FROM sc GROUP BY 1 HAVING max(score) > 0),
near AS (SELECT qu.doc_id, coalesce(best.rep, (SELECT min(doc_id) FROM tr)) AS rep, coalesce(best.score, 0) AS score FROM qu LEFT JOIN best USING (doc_id))"""


def _nearest(spark, sf_dir):
    docs = fx.texts(spark, sf_dir, "documents").select("doc_id", "text")
    labels = fx.table(spark, sf_dir, "labels")
    train = docs.join(labels, "doc_id").withColumn("target", F.struct("quality", "toxic"))
    queries = docs.join(labels.select("doc_id"), "doc_id", "left_anti")
    return lx.nearest(queries, "doc_id", "text", train, "doc_id", "text", "doc_id", "target")


def j11_bm25_nearest(spark, sf_dir):
    found = _nearest(spark, sf_dir)
    return found.select("doc_id", "rep", F.round("score", 6).alias("score"), F.col("target.quality").alias("quality"), F.col("target.toxic").alias("toxic"))


def j11_nearest_outcomes(spark, sf_dir):
    """Page and choice calls on unlabeled documents, answered by the nearest labeled one; nothing teaches scores."""
    docs = fx.texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("state"))
    labels = fx.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "case_id")
    kinds = F.explode(F.array(F.struct(F.lit("choice").alias("kind"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("target")), F.struct(F.lit("noul").alias("kind"), F.col("toxic").cast("string").alias("target"))))
    train = docs.join(labels.withColumn("k", kinds).select("case_id", "k.kind", "k.target"), "case_id")
    options = F.array(F.lit("good"), F.lit("bad"))
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(k).alias("kind")) for t, k in fv.TASK_KIND.items()]))
    calls = docs.join(labels.select("case_id"), "case_id", "left_anti").withColumn("t", tasks).select("case_id", "state", "t.task", "t.kind", options.alias("options"))
    return lx.nearest_outcomes(calls, train).select("candidate", "case_id", "task", "status", "value_type", "value_page", "probability_source")


QUERIES = {"j11_bm25_nearest": j11_bm25_nearest, "j11_nearest_outcomes": j11_nearest_outcomes}
ORACLES = {
    "j11_nearest_outcomes": _BM25 + """, a AS (SELECT near.doc_id AS case_id, quality, toxic FROM near JOIN tr ON tr.doc_id = near.rep)
SELECT 'lexical' AS candidate, case_id, 'event_type' AS task, CASE WHEN quality = 1 THEN 'ok' ELSE 'schema_failure' END AS status, CASE WHEN quality = 1 THEN 'good' END AS value_type, NULL::BOOLEAN AS value_page, NULL AS probability_source FROM a
UNION ALL SELECT 'lexical', case_id, 'page_now', 'ok', NULL, toxic >= 0.5, 'hard_label_uncalibrated' FROM a UNION ALL SELECT 'lexical', case_id, 'priority', 'unsupported', NULL, NULL, NULL FROM a""",
    "j11_bm25_nearest": _BM25 + " SELECT near.doc_id, rep, round(score, 6) AS score, quality, toxic FROM near JOIN tr ON tr.doc_id = near.rep",
}
