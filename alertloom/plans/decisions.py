"""Registered decision queries: candidate differences, gates, verdicts and further measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom import fixtures as fx
from alertloom.operators import bootstrap as bs
from alertloom.operators import calibration as cal
from alertloom.operators import components as cc
from alertloom.operators import cohort_matrix as cm
from alertloom.operators import extensions as ex
from alertloom.operators import scorecard as sc
from alertloom.plans.datasets import _GROUPS
from alertloom.plans.metrics import W3, _COST, _matrix_sql, test_answers, val_answers

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ candidate differences
_VECTORS = """vec AS (
  SELECT candidate, case_id, pair_id, 'event_type_accuracy' AS metric, CASE WHEN et_value = gold_event_type THEN 1 ELSE 0 END AS value FROM g WHERE et_status = 'ok'
  UNION ALL SELECT candidate, case_id, pair_id, 'page_now_accuracy', CASE WHEN pg_value = gold_page_now THEN 1 ELSE 0 END FROM g WHERE pg_status = 'ok'
  UNION ALL SELECT candidate, case_id, pair_id, 'priority_accuracy', CASE WHEN pr_value = gold_priority THEN 1 ELSE 0 END FROM g WHERE pr_status = 'ok'
  UNION ALL SELECT candidate, case_id, pair_id, 'must_page_recall_strict', CASE WHEN pg_value THEN 1 ELSE 0 END FROM g WHERE gold_page_now
  UNION ALL SELECT candidate, case_id, pair_id, 'spoof_escalation_kept_strict', CASE WHEN pg_value THEN 1 ELSE 0 END FROM g WHERE gold_page_now AND cohort = 'B_prime')"""
_PAIRS = (
    W3 + ", " + _GROUPS + ", g AS (SELECT * FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL), " + _VECTORS
    + """, diffs AS (SELECT a.candidate AS a, b.candidate AS b, a.metric, a.case_id, gr.group_id AS cluster, a.value - b.value AS diff
  FROM vec a JOIN vec b ON a.metric = b.metric AND a.case_id = b.case_id AND a.candidate < b.candidate JOIN groups gr ON gr.comp = a.case_id // 40)"""
)
N_BOOT = 2000


def _vectors(spark, sf_dir):
    cases = fx.cases(spark, sf_dir)
    groups = cc.case_groups(cases, cc.group_components(cases)).where("split = 'test'").select("case_id", "cluster")
    v = cm.metric_vectors(test_answers(spark, sf_dir)).join(groups, "case_id")
    return v.select("candidate", F.col("candidate").alias("name"), "metric", "case_id", "cluster", "value")


@query("j6_candidate_pairs", _PAIRS + " SELECT a, b, metric, case_id, diff::DOUBLE AS diff FROM diffs")
def j6_candidate_pairs(spark, sf_dir):
    return bs.candidate_pairs(_vectors(spark, sf_dir)).select("a", "b", "metric", "case_id", "diff")


@query("u1_common_cases", _PAIRS + " SELECT metric, count(DISTINCT case_id) AS n_common FROM diffs GROUP BY 1")
def u1_common_cases(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    both = bs.candidate_pairs(v).select("metric", "case_id").distinct()
    return both.groupBy("metric").agg(F.count(F.lit(1)).alias("n_common"))


_CLUSTERS = """, cl AS (SELECT a, b, metric, cluster, sum(diff) AS s, count(*) AS n FROM diffs GROUP BY ALL),
sz AS (SELECT a, b, metric, count(*) AS n_clusters, sum(n) AS n, sum(s) AS s FROM cl GROUP BY ALL), """
_INDEXED = f"""idx AS (SELECT *, row_number() OVER (PARTITION BY a, b, metric ORDER BY cluster) - 1 AS idx FROM cl),
draw AS (SELECT a, b, metric, rep, ('0x' || substr(md5('42:' || rep || ':' || slot // 4), 8 * (slot % 4)::INT + 1, 8))::BIGINT % n_clusters AS idx
  FROM (SELECT sz.*, r AS rep, unnest(range(n_clusters)) AS slot FROM sz, range({N_BOOT}) rr(r) WHERE n_clusters >= 2)),
reps AS (SELECT a, b, metric, rep, sum(s)::DOUBLE / sum(n) AS mean FROM draw JOIN idx USING (a, b, metric, idx) GROUP BY ALL)"""
_WEIGHTED = f"""weight AS (SELECT cl.*, r AS rep, ('0x' || substr(md5('42:' || r || ':' || cluster), 1, 8))::BIGINT AS u FROM cl, range({N_BOOT}) rr(r)),
bound AS (SELECT k, floor(4294967296 * sum(exp(-1.0) / factorial(k::INT)) OVER (ORDER BY k))::BIGINT AS top FROM range(13) kk(k)),
reps AS (SELECT a, b, metric, rep, sum(w * s)::DOUBLE / sum(w * n) AS mean FROM (SELECT *, (SELECT count(*) FROM bound WHERE u >= top) AS w FROM weight)
  JOIN (SELECT a, b, metric FROM sz WHERE n_clusters >= 2) USING (a, b, metric) WHERE w > 0 GROUP BY ALL)"""
_INTERVALS = """, ci AS (SELECT a, b, metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM reps GROUP BY ALL)
SELECT a, b, metric, n::BIGINT AS n, n_clusters, round(s::DOUBLE / n, 6) AS diff, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
  CASE WHEN n_clusters < 2 THEN 'an interval needs two clusters or more' END AS na_reason FROM sz LEFT JOIN ci USING (a, b, metric)"""


@query("a19_cluster_bootstrap", _PAIRS + _CLUSTERS + _INDEXED + _INTERVALS)
def a19_cluster_bootstrap(spark, sf_dir):
    return bs.paired_bootstrap(_vectors(spark, sf_dir), seed=42, n_boot=N_BOOT)


@query("a19_weighted_bootstrap", _PAIRS + _CLUSTERS + _WEIGHTED + _INTERVALS)
def a19_weighted_bootstrap(spark, sf_dir):
    return bs.paired_bootstrap(_vectors(spark, sf_dir), seed=42, n_boot=N_BOOT, method="weighted")


# ------------------------------------------------------------------ scorecard
def _operational(spark, sf_dir):
    """Attested inputs per candidate, with the false-page rate measured on the test events."""
    a = test_answers(spark, sf_dir)
    fp = a.groupBy("candidate").agg((1000.0 * F.count_if(F.col("pg_value") & ~F.col("gold_page_now")) / F.count(F.lit(1))).alias("false_pages_per_1k"))
    first = F.col("candidate") == fx.CANDIDATES[0]
    return fp.select(
        "candidate", F.lit(True).alias("offline_verified"), F.when(first, True).alias("license_ok"), F.lit(20.0).alias("peak_memory_gb"),
        F.when(first, 30.0).otherwise(120.0).alias("baseline_other_gb"), F.lit(True).alias("memory_pressure_normal"), F.lit(False).alias("swap_grew"),
        "false_pages_per_1k", F.lit(True).alias("latency_hardware_is_target"),
    )


HARDWARE = "local test machine"


def _gates(spark, sf_dir):
    outcomes = fx.outcomes(spark, sf_dir).where(F.col("split") == "test")
    latency = cal.latency_summary(outcomes.where(F.col("status") == "ok"))
    return sc.gate_rows(test_answers(spark, sf_dir), outcomes, latency, _operational(spark, sf_dir), HARDWARE)


_TEST_OUT = ", tout AS (SELECT o.* FROM outcomes o JOIN cases c USING (case_id) WHERE c.split = 'test')"


@query(
    "a21_schema_valid_rate",
    fx.sql_with("cases", "outcomes").rstrip() + _TEST_OUT + """ SELECT candidate, count(*) FILTER (status = 'ok') AS num, count(*) FILTER (status <> 'unsupported') AS den,
  bool_or(status = 'unsupported') AS any_unsupported FROM tout GROUP BY 1""",
)
def a21_schema_valid_rate(spark, sf_dir):
    return sc.schema_valid(fx.outcomes(spark, sf_dir).where(F.col("split") == "test"))


_LOW, _HIGH = fx.sql_wilson("num", "den")
_GATE_SQL = (
    "WITH m AS (SELECT * FROM (" + _matrix_sql() + ")), ans AS (" + W3 + " SELECT * FROM answers WHERE split = 'test'), out AS ("
    + fx.sql_with("cases", "outcomes").rstrip() + _TEST_OUT + " SELECT * FROM tout), "
    + f"""lat AS (SELECT candidate, quantile_cont(latency_ms, 0.95) AS p95 FROM out WHERE status = 'ok' GROUP BY 1),
rates AS (SELECT candidate, 'schema_valid_rate_min' AS gate, count(*) FILTER (status = 'ok') AS num, count(*) FILTER (status <> 'unsupported') AS den, 0.995::DOUBLE AS threshold FROM out GROUP BY 1
  UNION ALL SELECT candidate, 'must_page_recall_min', sum(num), sum(den), 0.95 FROM m WHERE metric = 'must_page_recall_strict' AND cohort IN ('A', 'B_prime') GROUP BY 1
  UNION ALL SELECT candidate, 'spoof_escalation_kept_min', num, den, 0.95 FROM m WHERE metric = 'spoof_escalation_kept_strict' AND cohort = 'B_prime'),
bounded AS (SELECT *, {_LOW} AS lo, {_HIGH} AS hi FROM rates),
fp AS (SELECT candidate, 1000.0::DOUBLE * count(*) FILTER (pg_value AND NOT gold_page_now) / count(*) AS fp FROM ans GROUP BY 1),
gates AS (SELECT candidate, gate, CASE WHEN den = 0 THEN 'not_evaluated' WHEN lo >= threshold THEN 'pass' WHEN hi < threshold THEN 'fail' ELSE 'inconclusive' END AS status,
    CASE WHEN den > 0 THEN round(num::DOUBLE / den, 6) END AS measured, threshold FROM bounded
  UNION ALL SELECT candidate, 'false_pages_per_1k_max', CASE WHEN fp <= 20 THEN 'pass' ELSE 'fail' END, round(fp, 6), 20 FROM fp
  UNION ALL SELECT candidate, 'runs_offline_on_target', 'pass', NULL, 1 FROM fp
  UNION ALL SELECT candidate, 'license_ok_for_intended_use', CASE WHEN candidate = 'c0' THEN 'pass' ELSE 'not_evaluated' END, NULL, 1 FROM fp
  UNION ALL SELECT candidate, 'p95_ms_max', 'not_evaluated', round(p95, 6), NULL FROM lat
  UNION ALL SELECT candidate, 'peak_memory_gb', CASE WHEN candidate = 'c0' THEN 'pass' ELSE 'not_evaluated' END, 20, CASE WHEN candidate = 'c0' THEN 82 ELSE -8 END FROM fp
  UNION ALL SELECT candidate, 'supports_all_three_tasks', CASE WHEN bool_or(status = 'unsupported') THEN 'fail' ELSE 'pass' END, NULL, 1 FROM out GROUP BY 1)"""
)


@query("a22_gate_decision", _GATE_SQL + " SELECT candidate, gate, status, measured FROM gates WHERE gate IN ('schema_valid_rate_min', 'must_page_recall_min', 'spoof_escalation_kept_min')")
def a22_gate_decision(spark, sf_dir):
    g = _gates(spark, sf_dir)
    return g.where(F.col("gate").isin("schema_valid_rate_min", "must_page_recall_min", "spoof_escalation_kept_min")).select("candidate", "gate", "status", "measured")


@query("a23_scorecard_gates", _GATE_SQL + " SELECT * FROM gates")
def a23_scorecard_gates(spark, sf_dir):
    return _gates(spark, sf_dir)


_WEIGHTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in fv.WEIGHTS.items())
_PARTS = (
    _GATE_SQL + ", cw AS (" + _COST + """ SELECT candidate, round(1 - round(sum(cost) / sum(worst), 6), 6) AS score FROM cost WHERE cohort IN ('A', 'B') GROUP BY 1),
parts AS (SELECT f.candidate, w.c AS component, w.w AS weight, CASE w.c WHEN 'cost_weighted_error' THEN cw.score
    WHEN 'spoof_robustness' THEN (SELECT rate FROM m WHERE m.candidate = f.candidate AND metric = 'spoof_escalation_kept_strict' AND cohort = 'B_prime') END AS score
  FROM fp f JOIN cw USING (candidate), (VALUES """ + _WEIGHTS + ") w(c, w))"
)


@query("a23_scorecard_components", _PARTS + " SELECT * FROM parts")
def a23_scorecard_components(spark, sf_dir):
    return sc.components(test_answers(spark, sf_dir))


@query(
    "a24_verdict",
    _PARTS + """, v AS (SELECT candidate, count(*) FILTER (status = 'fail') AS gates_failed, count(*) FILTER (status IN ('inconclusive', 'not_evaluated')) AS gates_open FROM gates GROUP BY 1),
p AS (SELECT candidate, sum(weight) FILTER (score IS NOT NULL) AS covered, sum(weight * score) AS weighted FROM parts GROUP BY 1)
SELECT candidate, gates_failed, gates_open, round(covered, 6) AS weight_coverage, round(weighted / covered, 6) AS partial_score,
  CASE WHEN gates_failed > 0 THEN 'not recommended' ELSE 'insufficient evidence' END AS verdict FROM v JOIN p USING (candidate)""",
)
def a24_verdict(spark, sf_dir):
    return sc.verdicts(_gates(spark, sf_dir), sc.components(test_answers(spark, sf_dir)))


@query(
    "a25_v1_assess",
    fx.sql_with("cases", "outcomes") + """, r AS (SELECT o.candidate, c.case_id, CASE WHEN c.cohort IN ('A', 'B') THEN c.pair_id || ':' || o.task END AS pair_id, o.task, o.status, o.value_type = c.gold_event_type AS et, o.value_page = c.gold_page_now AS pg, o.raw_score,
    CASE c.gold_priority WHEN 'P1' THEN 87.5 WHEN 'P2' THEN 62.5 WHEN 'P3' THEN 37.5 ELSE 12.5 END::DOUBLE AS anchor, o.probability AS p, o.probability_source AS src, CASE WHEN c.gold_page_now THEN 1 ELSE 0 END AS y
  FROM cases c JOIN outcomes o ON o.case_id = c.case_id WHERE c.cohort <> 'D'),
b AS (SELECT candidate, least(floor(greatest(p, 1 - p) * 10)::INT, 9) AS bin, count(*) AS n, sum(greatest(p, 1 - p)) AS cs, count(*) FILTER (pg) AS rs FROM r WHERE task = 'page_now' AND src = 'model' GROUP BY 1, 2),
pr AS (SELECT candidate, pair_id, count(*) AS n, bool_and(coalesce(et, pg)) AS ok FROM r WHERE status = 'ok' AND task <> 'priority' AND pair_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT candidate, round(sum(abs(rs - cs)) / sum(n), 6) AS ece FROM b GROUP BY 1), q AS (SELECT candidate, round(avg(ok::INT), 6) AS pair_accuracy FROM pr WHERE n = 2 GROUP BY 1),
h AS (SELECT candidate, round(avg(et::INT) FILTER (task = 'event_type' AND status = 'ok'), 6) AS choice_accuracy, round(avg(abs(raw_score - anchor)) FILTER (task = 'priority' AND status = 'ok'), 6) AS score_mae,
  round(avg(pg::INT) FILTER (task = 'page_now' AND status = 'ok'), 6) AS noul_accuracy, round(avg(pow(p - y, 2)) FILTER (src = 'model'), 6) AS brier,
  round(avg((status = 'schema_failure')::INT), 6) AS schema_failure_rate, round(avg((status = 'exception')::INT), 6) AS exception_rate, round(avg((status = 'ok')::INT), 6) AS coverage FROM r GROUP BY 1)
SELECT * FROM h JOIN e USING (candidate) JOIN q USING (candidate)""",
)
def a25_v1_assess(spark, sf_dir):
    """Every question of every graded case, for every candidate; A and B of a pair pair up on each question."""
    c = fx.cases(spark, sf_dir).where(F.col("cohort") != "D").withColumn("task", F.explode(F.array(*[F.lit(t) for t in fv.TASKS])))
    kind = F.when(F.col("task") == "page_now", "noul").when(F.col("task") == "event_type", "choice").otherwise("score")
    anchor = F.try_element_at(F.create_map(*[x for k, v in fv.PRIORITY_ANCHOR.items() for x in (F.lit(k), F.lit(v))]), F.col("gold_priority"))
    named = lambda: F.concat_ws(":", F.col("case_id").cast("string"), "task").alias("id")
    pair = F.when(F.col("cohort").isin("A", "B"), F.concat_ws(":", F.col("pair_id").cast("string"), "task"))
    cases = c.select(named(), pair.alias("pair_id"), kind.alias("kind"), F.col("gold_event_type").alias("target_choice"), anchor.alias("target_score"), F.col("gold_page_now").alias("target_noul"))
    o = fx.outcomes(spark, sf_dir)
    results = o.select("candidate", named(), "status", F.col("value_type").alias("choice"), F.col("raw_score").alias("score"), F.col("probability").alias("noul_prob"), "probability_source")
    return sc.v1_assess(cases, results)


_CHAT_MET = "SELECT candidate, 'must_page_recall' AS metric, num, den FROM m WHERE cohort = 'A' AND metric = 'must_page_recall_strict' UNION ALL SELECT candidate, 'spoof_recall', num, den FROM m WHERE cohort = 'B_prime' AND metric = 'spoof_escalation_kept_strict' AND candidate = 'c0'"


@query(
    "a23_chat_gates",
    "WITH m AS (SELECT * FROM (" + _matrix_sql() + ")), met AS (" + _CHAT_MET + f""" UNION ALL SELECT 'c1', 'spoof_recall', NULL, NULL),
b AS (SELECT *, {_LOW} AS lo, {_HIGH} AS hi, CASE metric WHEN 'must_page_recall' THEN {fv.CHAT_MODULE['must_page_recall_min']} ELSE {fv.CHAT_MODULE['spoof_recall_min']} END::DOUBLE AS threshold FROM met)
SELECT candidate, 'chat_' || metric || '_min' AS gate, CASE WHEN coalesce(den, 0) = 0 THEN 'not_evaluated' WHEN lo >= threshold THEN 'pass' WHEN hi < threshold THEN 'fail' ELSE 'inconclusive' END AS status,
  CASE WHEN den > 0 THEN round(num::DOUBLE / den, 6) END AS measured, threshold FROM b""",
)
def a23_chat_gates(spark, sf_dir):
    """One candidate lacks a chat measure: its gate is open, not gone."""
    m = cm.cohort_matrix(test_answers(spark, sf_dir))
    must = m.where((F.col("cohort") == "A") & (F.col("metric") == "must_page_recall_strict")).select("candidate", F.lit("must_page_recall").alias("metric"), "num", "den")
    spoof = m.where((F.col("cohort") == "B_prime") & (F.col("metric") == "spoof_escalation_kept_strict") & (F.col("candidate") == "c0")).select("candidate", F.lit("spoof_recall").alias("metric"), "num", "den")
    return sc.chat_gates(m, must.unionByName(spoof))


@query(
    "a23_p95_gate",
    _GATE_SQL + " SELECT candidate, 'p95_ms_max' AS gate, CASE WHEN p95 <= 10.2 THEN 'pass' ELSE 'fail' END AS status, round(p95, 6) AS measured, 10.2::DOUBLE AS threshold FROM lat",
)
def a23_p95_gate(spark, sf_dir):
    """The latency gate with a budget and on the hardware it is meant for."""
    outcomes = fx.outcomes(spark, sf_dir).where(F.col("split") == "test")
    latency = cal.latency_summary(outcomes.where(F.col("status") == "ok"))
    gates = dict(fv.GATES) | {"p95_ms_max": 10.2, "target_hardware_substring": "test machine"}
    rows = sc.gate_rows(test_answers(spark, sf_dir), outcomes, latency, _operational(spark, sf_dir), HARDWARE, gates)
    return rows.where(F.col("gate") == "p95_ms_max")


# ------------------------------------------------------------------ further measures
_G = W3 + ", " + _GROUPS + ", g AS (SELECT *, CASE WHEN gold_page_now THEN 1 ELSE 0 END AS y, pg_value = gold_page_now AS hit FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL)"
_GV = _G + ", v AS (SELECT *, CASE WHEN gold_page_now THEN 1 ELSE 0 END AS y FROM answers WHERE split = 'val' AND gold_event_type IS NOT NULL AND pg_prob IS NOT NULL)"


@query("d1_confusion", _G + " SELECT candidate, gold_event_type AS gold, et_value AS predicted, count(*) AS n FROM g WHERE et_status = 'ok' GROUP BY ALL")
def d1_confusion(spark, sf_dir):
    return ex.confusion(test_answers(spark, sf_dir))


_CLS = _G + """, k AS (SELECT candidate, gold_event_type AS gold, et_value AS pred FROM g WHERE et_status = 'ok'),
cls AS (SELECT c.candidate, c.cls, (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND gold = cls AND pred = cls) AS tp,
    (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND gold = cls) AS support, (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND pred = cls) AS predicted
  FROM (SELECT DISTINCT candidate, gold AS cls FROM k UNION SELECT DISTINCT candidate, pred FROM k) c)"""


@query("d1_class_scores", _CLS + """ SELECT candidate, cls, support, CASE WHEN predicted > 0 THEN round(tp::DOUBLE / predicted, 6) END AS precision,
  CASE WHEN support > 0 THEN round(tp::DOUBLE / support, 6) END AS recall, round(2.0::DOUBLE * tp / (support + predicted), 6) AS f1 FROM cls""")
def d1_class_scores(spark, sf_dir):
    return ex.class_scores(ex.confusion(test_answers(spark, sf_dir)))


@query("d1_macro_f1", _CLS + " SELECT candidate, count(*) AS classes, round(avg(round(2.0::DOUBLE * tp / (support + predicted), 6)), 6) AS macro_f1 FROM cls WHERE support > 0 GROUP BY 1")
def d1_macro_f1(spark, sf_dir):
    return ex.macro_f1(ex.confusion(test_answers(spark, sf_dir)))


@query(
    "d3_leave_one_source_out",
    W3 + """, s AS (SELECT a.candidate, e.user_id % 20 AS source, (a.pg_value = a.gold_page_now)::INT AS r FROM answers a JOIN events e ON e.event_id = a.case_id
  WHERE a.split = 'test' AND a.gold_event_type IS NOT NULL AND a.pg_status = 'ok'),
p AS (SELECT candidate, source, count(*) AS n, sum(r) AS r FROM s GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY candidate) AS tn, sum(r) OVER (PARTITION BY candidate) AS tr FROM p)
SELECT candidate, source AS held_out, n, round(r::DOUBLE / n, 6) AS held_out_accuracy, round((tr - r)::DOUBLE / (tn - n), 6) AS other_accuracy,
  round((tr - r)::DOUBLE / (tn - n) - r::DOUBLE / n, 6) AS drop FROM t""",
)
def d3_leave_one_source_out(spark, sf_dir):
    src = fx.events(spark, sf_dir).select(F.col("event_id").alias("case_id"), (F.col("user_id") % 20).alias("source"))
    a = test_answers(spark, sf_dir).where(F.col("gold_event_type").isNotNull() & (F.col("pg_status") == "ok"))
    return ex.leave_one_source_out(a.join(src, "case_id").select("candidate", "source", (F.col("pg_value") == F.col("gold_page_now")).cast("int").alias("right")))


@query(
    "d5_risk_coverage",
    _G + """, c AS (SELECT candidate, greatest(pg_prob, 1 - pg_prob) AS conf, hit::INT AS hit FROM g WHERE pg_prob IS NOT NULL),
r AS (SELECT candidate, conf, count(*) OVER w AS kept, sum(hit) OVER w AS n_hit, count(*) OVER (PARTITION BY candidate) AS n FROM c WINDOW w AS (PARTITION BY candidate ORDER BY conf DESC)),
b AS (SELECT candidate, cov, min((kept, n_hit, conf)) AS x FROM r, (VALUES (0.5::DOUBLE), (0.8), (1.0)) v(cov) WHERE kept >= cov * n GROUP BY ALL)
SELECT candidate, cov AS coverage, x[1] AS kept, round(x[3], 6) AS confidence_cut, round(x[2]::DOUBLE / x[1], 6) AS accuracy FROM b""",
)
def d5_risk_coverage(spark, sf_dir):
    return ex.risk_coverage(test_answers(spark, sf_dir))


@query(
    "d6_ranking",
    _G + """, r AS (SELECT candidate, pg_prob AS p, y FROM g WHERE pg_prob IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY candidate ORDER BY p) + (count(*) OVER (PARTITION BY candidate, p) - 1) / 2.0::DOUBLE AS rk FROM r),
a AS (SELECT candidate, sum(y) AS positives, sum(1 - y) AS negatives, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auroc FROM k GROUP BY 1),
t AS (SELECT candidate, p, sum(y) AS pos, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS n FROM r GROUP BY candidate, p WINDOW w AS (PARTITION BY candidate ORDER BY p DESC)),
ap AS (SELECT candidate, sum(pos::DOUBLE * tp / n) / sum(pos) AS ap FROM t GROUP BY 1)
SELECT candidate, positives::BIGINT AS positives, negatives::BIGINT AS negatives, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM a JOIN ap USING (candidate)""",
)
def d6_ranking(spark, sf_dir):
    return ex.ranking(test_answers(spark, sf_dir))


@query(
    "d7_tuned_threshold",
    _GV + """, s AS (SELECT t.candidate, t.p AS threshold, (SELECT avg(((v.pg_prob >= t.p) = (v.y = 1))::INT) FROM v WHERE v.candidate = t.candidate) AS acc
  FROM (SELECT DISTINCT candidate, pg_prob AS p FROM v) t),
b AS (SELECT candidate, threshold, acc FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY round(acc, 12) DESC, threshold) AS r FROM s) WHERE r = 1)
SELECT candidate, round(threshold, 6) AS threshold, round(acc, 6) AS val_accuracy, count(*) AS n, round(avg(((pg_prob >= threshold) = (y = 1))::INT), 6) AS test_accuracy
FROM g JOIN b USING (candidate) WHERE pg_prob IS NOT NULL GROUP BY candidate, threshold, acc""",
)
def d7_tuned_threshold(spark, sf_dir):
    t = ex.tune_threshold(val_answers(spark, sf_dir))
    return ex.apply_threshold(test_answers(spark, sf_dir), t).withColumn("threshold", F.round("threshold", 6))


@query(
    "d8_decision_band",
    _GV + """, t AS (SELECT candidate, pg_prob AS p, sum(sum(y)) OVER d AS tp, sum(count(*)) OVER d AS above, sum(sum(y)) OVER u - sum(y) AS missed, sum(count(*)) OVER u - count(*) AS below
  FROM v GROUP BY candidate, pg_prob WINDOW d AS (PARTITION BY candidate ORDER BY pg_prob DESC), u AS (PARTITION BY candidate ORDER BY pg_prob))
SELECT candidate, round(min(p) FILTER ((above - tp)::DOUBLE / above <= 0.05), 6) AS high, round(max(p) FILTER (below > 0 AND missed::DOUBLE / below <= 0.05), 6) AS low FROM t GROUP BY 1""",
)
def d8_decision_band(spark, sf_dir):
    return ex.decision_band(val_answers(spark, sf_dir))


@query(
    "d9_probability_losses",
    _G + """, r AS (SELECT candidate, pg_prob AS p, y FROM g WHERE pg_prob IS NOT NULL), q AS (SELECT candidate, count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(y) AS rate,
    avg(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END) AS nll FROM r GROUP BY 1)
SELECT candidate, n, round(brier, 6) AS brier, round(rate * (1 - rate), 6) AS base_rate_brier, round(1 - brier / (rate * (1 - rate)), 6) AS skill, round(nll, 6) AS nll FROM q""",
)
def d9_probability_losses(spark, sf_dir):
    return ex.probability_losses(test_answers(spark, sf_dir))


_TWO = "WITH two AS (SELECT doc_id AS item, quality AS first, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS second FROM labels)"


def _two_labelers(spark, sf_dir):
    second = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("first"), second.alias("second"))


@query(
    "d10_labeler_agreement",
    _TWO + """, x AS (SELECT count(*) AS n, count(*) FILTER (first = second) AS agreed, avg(first) AS f, avg(second) AS s FROM two),
y AS (SELECT *, agreed::DOUBLE / n AS po, f * s + (1 - f) * (1 - s) AS pe FROM x) SELECT n, agreed, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM y""",
)
def d10_labeler_agreement(spark, sf_dir):
    return ex.labeler_agreement(_two_labelers(spark, sf_dir))


@query("d10_disagreements", _TWO + " SELECT item, first, second, 'needs_adjudication' AS label_status FROM two WHERE first <> second")
def d10_disagreements(spark, sf_dir):
    return ex.disagreements(_two_labelers(spark, sf_dir))


_D12_REPS = 200


@query(
    "d12_ablation_difference",
    _PAIRS + f""", ab AS (SELECT c.cohort AS scenario, metric, cluster, sum(diff) AS s, count(*) AS n FROM diffs JOIN cases c USING (case_id) GROUP BY ALL),
w AS (SELECT cluster, rep, (SELECT count(*) FROM (SELECT unnest([{", ".join(str(b) for b in bs.POISSON_BOUNDS)}]) AS b) WHERE b <= u) AS k FROM (
  SELECT cluster, rep, ('0x' || substr(md5('42:' || rep || ':' || cluster), 1, 8))::BIGINT AS u FROM (SELECT DISTINCT cluster FROM ab), range({_D12_REPS}) r(rep))),
reps AS (SELECT scenario, metric, rep, sum(k * s) / sum(k * n) AS mean FROM ab JOIN w USING (cluster) GROUP BY ALL HAVING sum(k * n) > 0),
ci AS (SELECT scenario, metric, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM reps GROUP BY ALL),
head AS (SELECT scenario, metric, sum(n)::BIGINT AS n, count(*) AS n_clusters, round(sum(s) / sum(n), 6) AS diff FROM ab GROUP BY ALL)
SELECT scenario, metric, n, n_clusters, diff, CASE WHEN n_clusters >= 2 THEN ci_low END AS ci_low, CASE WHEN n_clusters >= 2 THEN ci_high END AS ci_high FROM head LEFT JOIN ci USING (scenario, metric)""",
)
def d12_ablation_difference(spark, sf_dir):
    """Paired difference per scenario (here the cohort) with its interval, candidate against baseline."""
    pairs = bs.candidate_pairs(_vectors(spark, sf_dir))
    scenario = fx.cases(spark, sf_dir).where(F.col("split") == "test").select("case_id", F.col("cohort").alias("scenario"))
    out = bs.scenario_bootstrap(pairs.join(scenario, "case_id"), n_boot=_D12_REPS)
    return out.select("scenario", "metric", "n", "n_clusters", "diff", "ci_low", "ci_high")
