"""Registered metric queries: outcomes, cohort matrix, cost, calibration, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom import fixtures as fx
from alertloom.functions.stats import r6, temperature_scale
from alertloom.operators import answers as an
from alertloom.operators import calibration as cal
from alertloom.operators import cohort_matrix as cm
from alertloom.operators import costs

W3 = fx.sql_with("cases", "outcomes", "answers")


def test_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide answers of the measured split. Outcome facts carry the split too, so only that part is shuffled."""
    return split_answers(spark, sf_dir, "test")


def val_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_answers(spark, sf_dir, "val")


def split_answers(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    wanted = F.col("split") == split
    return an.build_answers(fx.cases(spark, sf_dir).where(wanted), fx.outcomes(spark, sf_dir).where(wanted), candidates=fx.CANDIDATES)


def all_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.build_answers(fx.cases(spark, sf_dir), fx.outcomes(spark, sf_dir), candidates=fx.CANDIDATES)


QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ joins and projections
@query(
    "j1_missing_outcomes",
    fx.sql_with("cases", "outcomes")
    + """SELECT k.candidate, c.case_id, k.task, coalesce(n, 0) AS n_outcomes
FROM cases c, (SELECT DISTINCT candidate, task FROM outcomes) k
LEFT JOIN (SELECT candidate, case_id, task, count(*) AS n FROM outcomes WHERE NOT (candidate = 'c1' AND case_id % 401 = 0) AND NOT (task = 'priority' AND case_id % 307 = 0) GROUP BY ALL) o
  ON o.candidate = k.candidate AND o.case_id = c.case_id AND o.task = k.task
WHERE coalesce(n, 0) <> 1""",
)
def j1_missing_outcomes(spark, sf_dir):
    """Planted: whole cases that one candidate lacks, and cases that lack one task."""
    lost = ((F.col("candidate") == "c1") & (F.col("case_id") % 401 == 0)) | ((F.col("task") == "priority") & (F.col("case_id") % 307 == 0))
    return an.missing_outcomes(fx.cases(spark, sf_dir), fx.outcomes(spark, sf_dir).where(~lost), fx.CANDIDATES)


@query(
    "j1_answers",
    W3 + """SELECT candidate, case_id, cohort, et_status, et_value, pg_status, pg_value, round(pg_prob, 6) AS pg_prob, pg_source,
  pr_status, pr_value FROM answers""",
)
def j1_answers(spark, sf_dir):
    return all_answers(spark, sf_dir).select(
        "candidate", "case_id", "cohort", "et_status", "et_value", "pg_status", "pg_value",
        r6(F.col("pg_prob")).alias("pg_prob"), "pg_source", "pr_status", "pr_value",
    )


@query(
    "p1_gold_long",
    fx.sql_with("cases")
    + """SELECT case_id, cohort, 'event_type' AS task, gold_event_type AS gold FROM cases
UNION ALL SELECT case_id, cohort, 'page_now', CAST(gold_page_now AS VARCHAR) FROM cases
UNION ALL SELECT case_id, cohort, 'priority', gold_priority FROM cases""",
)
def p1_gold_long(spark, sf_dir):
    return an.gold_long(fx.cases(spark, sf_dir))


@query(
    "j2_pair_outcomes",
    W3 + """SELECT c.candidate, c.case_id, c.parent_case_id, c.pair_relation,
  coalesce(p.gold_page_now IS NOT NULL AND c.pg_status = 'ok' AND p.pg_status = 'ok', false) AS complete,
  coalesce(p.gold_page_now IS NOT NULL AND c.pg_status = 'ok' AND p.pg_status = 'ok'
    AND c.pg_value = c.gold_page_now AND p.pg_value = p.gold_page_now, false) AS both_right
FROM answers c LEFT JOIN answers p ON p.candidate = c.candidate AND p.case_id = c.parent_case_id
WHERE c.cohort = 'B' AND c.split = 'test'""",
)
def j2_pair_outcomes(spark, sf_dir):
    return cm.pair_outcomes(test_answers(spark, sf_dir)).withColumn("both_right", F.coalesce("both_right", F.lit(False)))


@query(
    "p5_convert_outcome",
    fx.sql_with("outcomes")
    + """SELECT candidate, case_id, task, CASE task WHEN 'event_type' THEN value_type WHEN 'page_now' THEN CAST(probability >= 0.5 AS VARCHAR)
  ELSE CASE WHEN raw_score >= 75 THEN 'P1' WHEN raw_score >= 50 THEN 'P2' WHEN raw_score >= 25 THEN 'P3' ELSE 'P4' END END AS value
FROM outcomes WHERE status = 'ok'""",
)
def p5_convert_outcome(spark, sf_dir):
    from alertloom.operators.scoring import typed_value

    ok = fx.outcomes(spark, sf_dir).where(F.col("status") == "ok")
    return ok.select("candidate", "case_id", "task", typed_value("task", "value_type", "probability", "raw_score").alias("value"))


@query(
    "p4_level_from_score",
    fx.sql_with("outcomes")
    + """SELECT candidate, value_priority AS level, count(*) AS n, round(min(raw_score), 6) AS lowest, round(max(raw_score), 6) AS highest
FROM outcomes WHERE raw_score IS NOT NULL GROUP BY ALL""",
)
def p4_level_from_score(spark, sf_dir):
    from alertloom.functions.stats import level_from_score

    o = fx.outcomes(spark, sf_dir).where(F.col("raw_score").isNotNull())
    return o.groupBy("candidate", level_from_score(F.col("raw_score")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("raw_score")).alias("lowest"), r6(F.max("raw_score")).alias("highest")
    )


@query(
    "p6_level_gap",
    W3 + """SELECT candidate, abs(CAST(substr(pr_value, 2) AS INT) - CAST(substr(gold_priority, 2) AS INT)) AS gap, count(*) AS n
FROM answers WHERE pr_value IS NOT NULL AND gold_priority IS NOT NULL GROUP BY ALL""",
)
def p6_level_gap(spark, sf_dir):
    from alertloom.functions.stats import level_gap

    a = all_answers(spark, sf_dir).where(F.col("pr_value").isNotNull() & F.col("gold_priority").isNotNull())
    return a.groupBy("candidate", level_gap(F.col("pr_value"), F.col("gold_priority")).cast("bigint").alias("gap")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ cohort matrix
_STATUS_SUMS = ",\n".join(
    f"sum(CASE WHEN {p}_status = '{s}' THEN 1 ELSE 0 END) AS {p}_{s}" for p in ("et", "pg", "pr") for s in fv.STATUSES
)
_COUNTS = W3 + f""", test AS (SELECT *, gold_event_type IS NOT NULL AND cohort <> 'D' AS graded FROM answers WHERE split = 'test'),
opened AS (SELECT *, cohort AS grp FROM test UNION ALL SELECT *, 'pooled' FROM test WHERE cohort <> 'D'),
pair AS (SELECT c.candidate, c.pair_relation, c.pg_value = c.gold_page_now AND p.pg_value = p.gold_page_now AS good,
    coalesce(p.gold_page_now IS NOT NULL AND c.pg_status = 'ok' AND p.pg_status = 'ok', false) AS complete
  FROM test c LEFT JOIN test p ON p.candidate = c.candidate AND p.case_id = c.parent_case_id WHERE c.cohort = 'B'),
pairsum AS (SELECT candidate, count(*) FILTER (complete) AS pairs, count(*) FILTER (complete AND good) AS pairs_right,
    count(*) FILTER (complete AND pair_relation = 'label_flip') AS flips,
    count(*) FILTER (complete AND good AND pair_relation = 'label_flip') AS flips_right FROM pair GROUP BY 1),
counts AS (SELECT candidate, grp, count(*) AS n, count(*) FILTER (graded) AS n_graded,
    {_STATUS_SUMS},
    count(*) FILTER (graded AND et_status = 'ok') AS et_n, count(*) FILTER (graded AND et_value = gold_event_type) AS et_right,
    count(*) FILTER (graded AND pg_status = 'ok') AS pg_n, count(*) FILTER (graded AND pg_value = gold_page_now) AS pg_right,
    count(*) FILTER (graded AND pr_status = 'ok') AS pr_n, count(*) FILTER (graded AND pr_value = gold_priority) AS pr_right,
    count(*) FILTER (graded AND abs(substr(pr_value, 2)::INT - substr(gold_priority, 2)::INT) <= 1) AS within_one,
    sum(CASE WHEN graded THEN abs(substr(pr_value, 2)::INT - substr(gold_priority, 2)::INT) END) AS gap_sum,
    count(*) FILTER (graded AND gold_page_now) AS must, count(*) FILTER (graded AND gold_page_now AND pg_status = 'ok') AS must_n,
    count(*) FILTER (graded AND gold_page_now AND pg_value) AS paged,
    count(*) FILTER (graded AND NOT gold_page_now AND pg_status = 'ok') AS neg_n,
    count(*) FILTER (graded AND NOT gold_page_now AND pg_value) AS false_paged
  FROM opened GROUP BY ALL)"""


def _matrix_sql() -> str:
    calls = "3 * n"
    tot = {s: f"(et_{s} + pg_{s} + pr_{s})" for s in fv.STATUSES}
    att = f"({tot['ok']} + {tot['schema_failure']} + {tot['exception']})"
    gold = lambda r: f"CASE WHEN grp = 'D' THEN '{fv.NA_COHORT_D}' WHEN n_graded = 0 THEN '{fv.NA_UNGRADED}' ELSE '{r}' END"
    only = lambda g, r: f"CASE WHEN grp = '{g}' THEN '{r}' ELSE '{fv.NA_NOT_DEFINED}' END"
    cells = [
        ("coverage", tot["ok"], calls, f"'{fv.NA_NO_CALLS}'"),
        ("schema_failure_rate", tot["schema_failure"], att, f"'{fv.NA_NO_ATTEMPTS}'"),
        ("exception_rate", tot["exception"], att, f"'{fv.NA_NO_ATTEMPTS}'"),
        ("unsupported_rate", tot["unsupported"], calls, f"'{fv.NA_NO_CALLS}'"),
        ("event_type_accuracy", "et_right", "et_n", gold("event_type: no valid answers")),
        ("page_now_accuracy", "pg_right", "pg_n", gold("page_now: no valid answers")),
        ("priority_accuracy", "pr_right", "pr_n", gold("priority: no valid answers")),
        ("priority_within_one", "within_one", "pr_n", gold("nothing answered priority")),
        ("must_page_recall", "paged", "must_n", gold("no must-page case was answered")),
        ("must_page_recall_strict", "paged", "must", gold("cohort has no must-page case")),
        ("false_page_rate", "false_paged", "neg_n", gold("no quiet case was answered")),
        ("paired_inversion", "CASE WHEN grp = 'B' THEN pairs_right ELSE 0 END", "CASE WHEN grp = 'B' THEN pairs ELSE 0 END", only("B", "no pair has both answers")),
        ("paired_inversion_flip_only", "CASE WHEN grp = 'B' THEN flips_right ELSE 0 END", "CASE WHEN grp = 'B' THEN flips ELSE 0 END", only("B", "no flip pair has both answers")),
        ("spoof_escalation_kept", "CASE WHEN grp = 'B_prime' THEN paged ELSE 0 END", "CASE WHEN grp = 'B_prime' THEN must_n ELSE 0 END", only("B_prime", "no case of B'' was answered")),
        ("spoof_escalation_kept_strict", "CASE WHEN grp = 'B_prime' THEN paged ELSE 0 END", "CASE WHEN grp = 'B_prime' THEN must ELSE 0 END", only("B_prime", "no case of B'' must page")),
    ]
    low, high = fx.sql_wilson("num", "den")
    union = "\nUNION ALL ".join(
        f"SELECT candidate, grp AS cohort, '{m}' AS metric, ({n})::BIGINT AS num, ({d})::BIGINT AS den, {w} AS why FROM j" for m, n, d, w in cells
    )
    return (
        _COUNTS
        + f""", j AS (SELECT * FROM counts LEFT JOIN pairsum USING (candidate)),
cells AS ({union})
SELECT candidate, cohort, metric, num, den, CASE WHEN den > 0 THEN round(num::DOUBLE / den, 6) END AS rate,
  {low} AS ci_low, {high} AS ci_high, CASE WHEN den = 0 THEN why END AS na_reason FROM cells"""
    )


@query("a9_cohort_matrix", _matrix_sql())
def a9_cohort_matrix(spark, sf_dir):
    return cm.cohort_matrix(test_answers(spark, sf_dir))


def _metric_subset(name: str, metrics: tuple[str, ...]):
    wanted = ", ".join(f"'{m}'" for m in metrics)

    @query(name, f"SELECT * FROM ({_matrix_sql()}) WHERE metric IN ({wanted})")
    def run(spark, sf_dir):
        return cm.cohort_matrix(test_answers(spark, sf_dir)).where(F.col("metric").isin(*metrics))

    return run


_metric_subset("a2_coverage_rates", ("coverage", "schema_failure_rate", "exception_rate", "unsupported_rate"))
_metric_subset("a3_accuracy", ("event_type_accuracy", "page_now_accuracy", "priority_accuracy"))
_metric_subset("a5_must_page", ("must_page_recall", "must_page_recall_strict", "false_page_rate"))
_metric_subset("a6_paired_inversion", ("paired_inversion", "paired_inversion_flip_only"))
_metric_subset("a7_spoof_kept", ("spoof_escalation_kept", "spoof_escalation_kept_strict"))


@query(
    "a1_status_counts",
    _COUNTS + " " + " UNION ALL ".join(
        f"SELECT candidate, grp AS cohort, '{t}' AS task, " + ", ".join(f"{p}_{s}::BIGINT AS {s}" for s in fv.STATUSES) + ", n AS calls FROM counts"
        for t, p in (("event_type", "et"), ("page_now", "pg"), ("priority", "pr"))
    ),
)
def a1_status_counts(spark, sf_dir):
    return cm.status_counts(test_answers(spark, sf_dir))


@query(
    "a4_priority_ordinal",
    _COUNTS + f""" SELECT candidate, grp AS cohort, pr_n AS n, CASE WHEN pr_n > 0 THEN round(gap_sum::DOUBLE / pr_n, 6) END AS mean_gap,
  CASE WHEN pr_n > 0 THEN NULL WHEN grp = 'D' THEN '{fv.NA_COHORT_D}' WHEN n_graded = 0 THEN '{fv.NA_UNGRADED}' ELSE 'nothing answered priority' END AS na_reason
FROM counts""",
)
def a4_priority_ordinal(spark, sf_dir):
    return cm.priority_mae(test_answers(spark, sf_dir))


_D_LOW, _D_HIGH = fx.sql_wilson("num", "den")


@query(
    "a8_provisional_agreement",
    W3 + f""", labelled AS (SELECT a.*, e.event_type AS le, e.value >= 60 AS lp,
   CASE WHEN value >= 100 THEN 'P1' WHEN value >= 60 THEN 'P2' WHEN value >= 30 THEN 'P3' ELSE 'P4' END AS lr
  FROM answers a JOIN events e ON e.event_id = a.case_id WHERE a.cohort = 'D'),
x AS (SELECT candidate, 'event_type' AS metric, count(*) FILTER (et_value = le) AS num, count(*) FILTER (et_status = 'ok') AS den FROM labelled GROUP BY 1
  UNION ALL SELECT candidate, 'page_now', count(*) FILTER (pg_value = lp), count(*) FILTER (pg_status = 'ok') FROM labelled GROUP BY 1
  UNION ALL SELECT candidate, 'priority', count(*) FILTER (pr_value = lr), count(*) FILTER (pr_status = 'ok') FROM labelled GROUP BY 1)
SELECT candidate, metric, num, den, round(num::DOUBLE / den, 6) AS rate, {_D_LOW} AS ci_low, {_D_HIGH} AS ci_high, NULL::VARCHAR AS na_reason FROM x""",
)
def a8_provisional_agreement(spark, sf_dir):
    """Cohort D carrying provisional labels: the gold rule applied to D rows as labels under review."""
    ev = fx.events(spark, sf_dir)
    v = F.col("value")
    provisional = ev.where(F.col("event_id") % 5 == 4).select(
        F.col("event_id").alias("case_id"),
        F.col("event_type").alias("gold_event_type"),
        (v >= 60).alias("gold_page_now"),
        F.when(v >= 100, "P1").when(v >= 60, "P2").when(v >= 30, "P3").otherwise("P4").alias("gold_priority"),
    )
    cases = fx.cases(spark, sf_dir).where(F.col("cohort") == "D").drop("gold_event_type", "gold_page_now", "gold_priority").join(provisional, "case_id")
    return cm.provisional_agreement(an.build_answers(cases, fx.outcomes(spark, sf_dir)))


_ERRORS = W3 + """, err AS (SELECT candidate, case_id, cohort, pg_status AS status,
  CASE WHEN pg_status <> 'ok' THEN 'unanswered_must_page' WHEN NOT pg_value AND cohort IN ('B', 'B_prime') THEN 'improper_suppression'
    WHEN NOT pg_value THEN 'missed_must_page' END AS error_class
  FROM answers WHERE split = 'test' AND gold_page_now)"""


@query("a10_consequential_errors", _ERRORS + " SELECT * FROM err WHERE error_class IS NOT NULL")
def a10_consequential_errors(spark, sf_dir):
    return cm.consequential_errors(test_answers(spark, sf_dir))


@query(
    "a10_consequential_error_counts",
    _ERRORS + """ SELECT k.candidate, e.c AS error_class, count(err.case_id) AS n
FROM (SELECT DISTINCT candidate FROM answers) k, (VALUES ('missed_must_page'), ('improper_suppression'), ('unanswered_must_page')) e(c)
LEFT JOIN err ON err.candidate = k.candidate AND err.error_class = e.c GROUP BY ALL""",
)
def a10_consequential_error_counts(spark, sf_dir):
    return cm.consequential_error_counts(test_answers(spark, sf_dir))


# ------------------------------------------------------------------ cost
_COST = W3 + """, cost AS (SELECT candidate, case_id, cohort, 'event_type' AS task,
    CASE WHEN et_value = gold_event_type THEN 0.0 ELSE 3.0 END::DOUBLE AS cost, 3.0::DOUBLE AS worst, gold_event_type AS gold, et_value AS predicted, et_status AS status
  FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL
  UNION ALL SELECT candidate, case_id, cohort, 'page_now', CASE WHEN pg_value = gold_page_now THEN 0.0 WHEN gold_page_now THEN 50.0 ELSE 1.0 END,
    CASE WHEN gold_page_now THEN 50.0 ELSE 1.0 END, CAST(gold_page_now AS VARCHAR), CAST(pg_value AS VARCHAR), pg_status
  FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL
  UNION ALL SELECT candidate, case_id, cohort, 'priority',
    CASE abs(substr(pr_value, 2)::INT - substr(gold_priority, 2)::INT) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 5.0 END, 5.0, gold_priority, pr_value, pr_status
  FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL)"""


@query("a11_case_costs", _COST + " SELECT * FROM cost")
def a11_case_costs(spark, sf_dir):
    return costs.case_costs(test_answers(spark, sf_dir))


@query(
    "a11_cost_weighted",
    _COST + """ SELECT candidate, count(*) // 3 AS n_cases, sum(cost) FILTER (task = 'event_type') AS event_type_cost,
  sum(cost) FILTER (task = 'page_now') AS page_now_cost, sum(cost) FILTER (task = 'priority') AS priority_cost,
  sum(cost) AS total_cost, sum(worst) AS worst_possible_total, round(sum(cost) / (count(*) // 3), 6) AS mean_cost_per_case,
  round(sum(cost) / sum(worst), 6) AS normalized_error, NULL::VARCHAR AS na_reason
FROM cost WHERE cohort IN ('A', 'B') GROUP BY 1""",
)
def a11_cost_weighted(spark, sf_dir):
    return costs.cost_weighted(test_answers(spark, sf_dir))


@query(
    "a12_worst_failures",
    _COST + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY cost DESC, case_id, list_position(['event_type', 'page_now', 'priority'], task)) AS position
  FROM cost WHERE cost > 0)
SELECT candidate, case_id, cohort, task, cost, gold, predicted, status, position FROM ranked WHERE position <= 3""",
)
def a12_worst_failures(spark, sf_dir):
    return costs.worst_failures(test_answers(spark, sf_dir))


@query(
    "w6_first_errors",
    fx.sql_with("cases", "outcomes")
    + """SELECT candidate, case_id, task, status, substr(error, 1, 200) AS error, position FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY case_id, list_position(['event_type', 'page_now', 'priority'], task)) AS position
  FROM outcomes WHERE error IS NOT NULL) WHERE position <= 3""",
)
def w6_first_errors(spark, sf_dir):
    return an.failed_calls(fx.outcomes(spark, sf_dir))


# ------------------------------------------------------------------ calibration and latency
_PROB = W3 + """, prob AS (SELECT candidate, pg_prob AS p, CASE WHEN gold_page_now THEN 1 ELSE 0 END AS y,
    coalesce(pg_source, 'none') AS source, pg_source IN ('model', 'model_temperature_scaled') AND pg_prob IS NOT NULL AS eligible
  FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL AND pg_status = 'ok'),
bin AS (SELECT candidate, least(floor(greatest(p, 1 - p) * 10)::INT, 9) AS bin, count(*) AS n, sum(greatest(p, 1 - p)) AS cs,
    sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS rs
  FROM prob WHERE eligible GROUP BY ALL)"""


@query("a13_brier", _PROB + " SELECT candidate, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM prob WHERE eligible GROUP BY 1")
def a13_brier(spark, sf_dir):
    return cal.brier(cal.probability_rows(test_answers(spark, sf_dir)))


@query("a14_ece", _PROB + " SELECT candidate, sum(n)::BIGINT AS n, round(sum(n * abs(rs / n - cs / n)) / sum(n), 6) AS ece FROM bin GROUP BY 1")
def a14_ece(spark, sf_dir):
    return cal.ece(cal.probability_rows(test_answers(spark, sf_dir)))


@query(
    "a15_reliability_bins",
    _PROB + """ SELECT k.candidate, b AS bin, round(b / 10.0::DOUBLE, 6) AS low, round((b + 1) / 10.0::DOUBLE, 6) AS high, coalesce(n, 0) AS n,
  round(cs / n, 6) AS mean_confidence, round(rs::DOUBLE / n, 6) AS accuracy
FROM (SELECT DISTINCT candidate FROM prob) k, range(10) r(b) LEFT JOIN bin ON bin.candidate = k.candidate AND bin.bin = b""",
)
def a15_reliability_bins(spark, sf_dir):
    return cal.reliability_bins(cal.probability_rows(test_answers(spark, sf_dir)))


@query(
    "a16_calibration_summary",
    _PROB + """, s AS (SELECT candidate, count(*) FILTER (eligible) AS n, count(*) FILTER (NOT eligible) AS n_ineligible,
    string_agg(DISTINCT source, ',' ORDER BY source) AS probability_sources, avg(pow(p - y, 2)) FILTER (eligible) AS brier FROM prob GROUP BY 1),
e AS (SELECT candidate, sum(n * abs(rs / n - cs / n)) / sum(n) AS ece FROM bin GROUP BY 1),
g AS (SELECT candidate, count(*) FILTER (gold_event_type IS NOT NULL) AS n_graded FROM answers WHERE split = 'test' GROUP BY 1)
SELECT candidate, n, n_graded, n_ineligible, probability_sources, round(brier, 6) AS brier, round(ece, 6) AS ece, NULL::VARCHAR AS na_reason,
  CASE WHEN n < 300 THEN 'too few cases for a steady ECE' END AS warning
FROM s JOIN e USING (candidate) JOIN g USING (candidate)""",
)
def a16_calibration_summary(spark, sf_dir):
    return cal.calibration_summary(test_answers(spark, sf_dir))


@query(
    "d9_ece_by_bins",
    _PROB + """, o AS (SELECT candidate, bins, least(floor(greatest(p, 1 - p) * bins)::INT, bins - 1) AS b, count(*) AS n, sum(greatest(p, 1 - p)) AS cs,
    sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS rs FROM prob, (VALUES (5), (10), (15), (20)) v(bins) WHERE eligible GROUP BY ALL)
SELECT candidate, bins, round(sum(n * abs(rs / n - cs / n)) / sum(n), 6) AS ece FROM o GROUP BY ALL""",
)
def d9_ece_by_bins(spark, sf_dir):
    return cal.ece_by_bins(cal.probability_rows(test_answers(spark, sf_dir)))


@query(
    "a17_latency_summary",
    fx.sql_with("cases", "outcomes")
    + """, s AS (SELECT candidate, task AS scope, latency_ms FROM outcomes WHERE status = 'ok' UNION ALL SELECT candidate, 'all', latency_ms FROM outcomes WHERE status = 'ok')
SELECT candidate, scope, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM s GROUP BY ALL""",
)
def a17_latency_summary(spark, sf_dir):
    return cal.latency_summary(fx.outcomes(spark, sf_dir).where(F.col("status") == "ok"))


_FIT = W3 + """, v AS (SELECT candidate, greatest(1e-7, least(1 - 1e-7, pg_prob)) AS p, CASE WHEN gold_page_now THEN 1 ELSE 0 END AS y FROM answers
  WHERE split = 'val' AND gold_event_type IS NOT NULL AND pg_status = 'ok' AND pg_source = 'model'),
fit AS (SELECT candidate, i, 0.5::DOUBLE + i * 0.05::DOUBLE AS t, count(*) AS fit_n,
    avg(pow(1 / (1 + exp(-(ln(p / (1 - p)) / (0.5::DOUBLE + i * 0.05::DOUBLE)))) - y, 2)) AS brier FROM v, range(91) r(i) GROUP BY ALL),
best AS (SELECT candidate, t, fit_n, brier FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY round(brier, 12), i) AS rn FROM fit) WHERE rn = 1)"""


@query("a20_fit_temperature", _FIT + " SELECT candidate, round(t, 6) AS temperature, fit_n, round(brier, 6) AS brier FROM best")
def a20_fit_temperature(spark, sf_dir):
    return cal.fit_temperature(val_answers(spark, sf_dir))


@query(
    "a20_calibrated_brier",
    _FIT + """ SELECT a.candidate || '/calibrated' AS candidate, count(*) AS n,
  round(avg(pow(1 / (1 + exp(-(ln(greatest(1e-7, least(1 - 1e-7, pg_prob)) / (1 - greatest(1e-7, least(1 - 1e-7, pg_prob)))) / round(t, 6)))) - CASE WHEN gold_page_now THEN 1 ELSE 0 END, 2)), 6) AS brier
FROM answers a JOIN best USING (candidate) WHERE split = 'test' AND gold_event_type IS NOT NULL AND pg_source = 'model' GROUP BY ALL""",
)
def a20_calibrated_brier(spark, sf_dir):
    """Fit on validation, apply to test without scoring again, measure the calibrated arm."""
    t = cal.fit_temperature(val_answers(spark, sf_dir))
    arm = cal.calibrated_outcomes(fx.outcomes(spark, sf_dir).where(F.col("split") == "test"), t)
    cases = fx.cases(spark, sf_dir).where(F.col("split") == "test")
    return cal.brier(cal.probability_rows(an.build_answers(cases, arm)))


@query(
    "p17_temperature_scale",
    W3 + """SELECT candidate, case_id, round(1 / (1 + exp(-(ln(p / (1 - p)) / 1.5::DOUBLE))), 6) AS scaled FROM (
  SELECT candidate, case_id, greatest(1e-7, least(1 - 1e-7, pg_prob)) AS p FROM answers WHERE pg_source = 'model')""",
)
def p17_temperature_scale(spark, sf_dir):
    o = fx.outcomes(spark, sf_dir).where(F.col("probability_source") == "model")
    return o.select("candidate", "case_id", r6(temperature_scale(F.col("probability"), F.lit(1.5))).alias("scaled"))


@query(
    "a18_metric_vector",
    W3 + """, g AS (SELECT * FROM answers WHERE split = 'test' AND gold_event_type IS NOT NULL)
SELECT candidate, case_id, pair_id, 'event_type_accuracy' AS metric, CASE WHEN et_value = gold_event_type THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM g WHERE et_status = 'ok'
UNION ALL SELECT candidate, case_id, pair_id, 'page_now_accuracy', CASE WHEN pg_value = gold_page_now THEN 1.0 ELSE 0.0 END FROM g WHERE pg_status = 'ok'
UNION ALL SELECT candidate, case_id, pair_id, 'priority_accuracy', CASE WHEN pr_value = gold_priority THEN 1.0 ELSE 0.0 END FROM g WHERE pr_status = 'ok'
UNION ALL SELECT candidate, case_id, pair_id, 'must_page_recall_strict', CASE WHEN pg_value THEN 1.0 ELSE 0.0 END FROM g WHERE gold_page_now
UNION ALL SELECT candidate, case_id, pair_id, 'spoof_escalation_kept_strict', CASE WHEN pg_value THEN 1.0 ELSE 0.0 END FROM g WHERE gold_page_now AND cohort = 'B_prime'""",
)
def a18_metric_vector(spark, sf_dir):
    return cm.metric_vectors(test_answers(spark, sf_dir))


@query(
    "p16_wilson",
    fx.sql_with("cases")
    + "SELECT host, num, den, {} AS ci_low, {} AS ci_high FROM (SELECT host, count(*) FILTER (gold_page_now) AS num, count(gold_page_now) AS den FROM cases GROUP BY 1)".format(*fx.sql_wilson("num", "den")),
)
def p16_wilson(spark, sf_dir):
    from alertloom.functions.stats import wilson

    g = fx.cases(spark, sf_dir).groupBy("host").agg(F.count_if(F.col("gold_page_now")).alias("num"), F.count("gold_page_now").alias("den"))
    low, high = wilson(F.col("num"), F.col("den"))
    return g.select("host", "num", "den", r6(low).alias("ci_low"), r6(high).alias("ci_high"))


@query(
    "a33_dataset_summary",
    fx.sql_with("cases") + "SELECT split, CASE WHEN split = 'test' THEN cohort ELSE '-' END AS cohort, count(*) AS n FROM cases GROUP BY ALL",
)
def a33_dataset_summary(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return c.groupBy("split", F.when(F.col("split") == "test", F.col("cohort")).otherwise("-").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
