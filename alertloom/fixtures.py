"""Views that give the driver's tables the shapes the operators take.

Each view exists twice: as a DataFrame and as the SQL text the check engine runs. Both use only
arithmetic that is identical in the two engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.stats import level_from_score
from alertloom.operators.counterfactuals import to_nested
from alertloom.session import dealt, spread

CANDIDATES = ("c0", "c1")
ENTITY_COLUMNS = ("host",)  # the events table names no service


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for costly per-row work, spread over the cores when it is one small file."""
    return spread(table(spark, sf_dir, name))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def split_of(pair: Column) -> Column:
    return F.when(pair % 20 < 14, "train").when(pair % 20 < 17, "val").otherwise("test")


def shape_cases(ev: DataFrame) -> DataFrame:
    """Case columns from event rows (works on a batch or a streaming DataFrame)."""
    e = F.col("event_id")
    c = e % 5
    pair = F.expr("event_id div 5")
    ungraded = c == 4
    return ev.select(
        e.alias("case_id"),
        F.when(c == 0, "A").when(c == 1, "B").when(c == 2, "B_prime").when(c == 3, "C").otherwise("D").alias("cohort"),
        split_of(pair).alias("split"),
        pair.alias("pair_id"),
        F.when(c.isin(1, 2), e - c).alias("parent_case_id"),
        F.when((c == 1) & (pair % 2 == 0), "label_flip").when(c.isin(1, 2), "label_preserved").alias("pair_relation"),
        F.col("user_id").cast("string").alias("host"),
        F.col("event_type").alias("signal"),
        F.expr("event_id div 8").alias("template_family"),
        F.col("ts"),
        F.when(~ungraded, F.col("event_type")).alias("gold_event_type"),
        F.when(~ungraded, F.col("value") >= 60).alias("gold_page_now"),
        F.when(
            ~ungraded,
            F.when(F.col("value") >= 100, "P1").when(F.col("value") >= 60, "P2").when(F.col("value") >= 30, "P3").otherwise("P4"),
        ).alias("gold_priority"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_cases(events(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long outcome facts: one row per (candidate, case, task)."""
    e = F.col("event_id")
    k, t = F.col("k"), F.col("t")
    code = (e * 7 + t * 3 + k * 11) % 53
    status = F.when(code == 0, "schema_failure").when(code == 1, "exception").when(code == 2, "unsupported").otherwise("ok")
    ok = F.col("status") == "ok"
    page = F.least(
        F.lit(0.999), F.greatest(F.lit(0.001), F.col("value") / 120.0 + ((e + 5 * k) % 7 - 3).cast("double") * 0.05)
    )
    score = F.least(F.lit(100.0), F.col("value") * 0.75 + ((e % 3) * 10 * k).cast("double"))
    long = (
        events(spark, sf_dir)
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("status", status)
    )
    return long.select(
        F.concat(F.lit("c"), k.cast("string")).alias("candidate"),
        e.alias("case_id"),
        split_of(F.expr("event_id div 5")).alias("split"),
        F.when(t == 0, "event_type").when(t == 1, "page_now").otherwise("priority").alias("task"),
        "status",
        F.when(ok & (t == 0), F.when((e + k) % 7 == 0, "view").otherwise(F.col("event_type"))).alias("value_type"),
        F.when(ok & (t == 1), page >= fv.PAGE_THRESHOLD).alias("value_page"),
        F.when(ok & (t == 2), level_from_score(score)).alias("value_priority"),
        F.when(ok & (t == 1), page).alias("probability"),
        F.when(
            ok & (t == 1), F.when((k == 1) & (e % 11 == 0), "hard_label_uncalibrated").otherwise("model")
        ).alias("probability_source"),
        F.when(ok & (t == 2), score).alias("raw_score"),
        F.when(~ok, F.concat(F.col("status"), F.lit(" on case "), e.cast("string"))).alias("error"),
        (1 + ((e * 13 + t * 5 + k) % 97).cast("double") / 10.0).alias("latency_ms"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_evidence(events(spark, sf_dir))


def shape_evidence(ev: DataFrame) -> DataFrame:
    e, v, t = F.col("event_id"), F.col("value"), F.col("event_type")
    kind = (
        F.when(t == "error", "service_degradation")
        .when(t == "signup", "security_event")
        .when(t == "purchase", "data_protection")
        .when(t == "click", "routine_activity")
        .otherwise("telemetry")
    )
    impact = F.when(v >= 100, "high").when(v >= 60, "moderate").when(v >= 10, "low").otherwise("none")
    urgency = F.when((v < 10) | t.isin("click", "view"), "none").otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ("immediate", "same_day", "deferred", "none")]), (e % 4 + 1).cast("int"))
    )
    return ev.select(
        e.alias("case_id"),
        F.col("ts"),
        F.col("user_id").cast("string").alias("host"),
        F.lit(None).cast("string").alias("service"),
        t.alias("signal"),
        kind.alias("primary_type"),
        impact.alias("impact"),
        urgency.alias("urgency"),
        (e % 3 != 0).alias("actionable"),
        (e % 37 == 0).alias("compromise_evidence"),
        F.lit("act").alias("immediate_action"),
        F.when(e % 29 == 0, "missing_context").alias("provisional_reason"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups of at least 60 open a change window on their host: one expected signal each, with a bound.
    `change_order` is the order of first match."""
    e = F.col("event_id")
    signals = F.array(*[F.lit(x) for x in ("error", "purchase", "signup", "click", "view")])
    return (
        events(spark, sf_dir)
        .where((F.col("event_type") == "signup") & (F.col("value") >= 60))
        .select(
            e.cast("string").alias("change_id"),
            e.alias("change_order"),
            F.col("user_id").cast("string").alias("host"),
            (F.col("ts") - F.expr("interval 12 hours")).alias("start_ts"),
            (F.col("ts") + F.expr("interval 24 hours")).alias("end_ts"),
            F.when(F.col("value") >= 150, "proposed").otherwise("approved").alias("status"),
            F.element_at(signals, (e % 5 + 1).cast("int")).alias("signal"),
            F.element_at(F.array(F.lit("low"), F.lit("moderate"), F.lit("high")), (e % 3 + 1).cast("int")).alias("max_impact"),
        )
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return (
        events(spark, sf_dir)
        .where((F.col("event_type") == "error") & (F.col("value") >= 120))
        .select(
            e.cast("string").alias("incident_id"),
            e.alias("incident_order"),
            F.col("user_id").cast("string").alias("entity"),
            F.when(e % 5 == 0, "closed").otherwise("open").alias("status"),
            F.lit("service_degradation").alias("event_type"),
            F.lit("error").alias("failure_mode"),
            F.lit("moderate").alias("impact"),
            F.lit("same_day").alias("urgency"),
            F.lit("P3").alias("priority"),
            # active for opened < ts <= opened + 48 h, at microsecond grain
            (F.col("ts") + F.expr("interval 1 microsecond")).alias("start_ts"),
            (F.col("ts") + F.expr("interval 48 hours")).alias("end_ts"),
        )
    )


# ------------------------------------------------------------------ the same views as SQL text
_CASES = """cases AS (
  SELECT event_id AS case_id,
    CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B_prime' WHEN 3 THEN 'C' ELSE 'D' END AS cohort,
    CASE WHEN (event_id // 5) % 20 < 14 THEN 'train' WHEN (event_id // 5) % 20 < 17 THEN 'val' ELSE 'test' END AS split,
    event_id // 5 AS pair_id,
    CASE WHEN event_id % 5 IN (1, 2) THEN event_id - event_id % 5 END AS parent_case_id,
    CASE WHEN event_id % 5 = 1 AND (event_id // 5) % 2 = 0 THEN 'label_flip'
         WHEN event_id % 5 IN (1, 2) THEN 'label_preserved' END AS pair_relation,
    CAST(user_id AS VARCHAR) AS host, event_type AS signal, event_id // 8 AS template_family, ts,
    CASE WHEN event_id % 5 <> 4 THEN event_type END AS gold_event_type,
    CASE WHEN event_id % 5 <> 4 THEN value >= 60 END AS gold_page_now,
    CASE WHEN event_id % 5 <> 4 THEN
      CASE WHEN value >= 100 THEN 'P1' WHEN value >= 60 THEN 'P2' WHEN value >= 30 THEN 'P3' ELSE 'P4' END
    END AS gold_priority
  FROM events)"""

_OUTCOMES = """outcome_base AS (
  SELECT event_id, event_type, value, k, t,
    CASE (event_id * 7 + t * 3 + k * 11) % 53 WHEN 0 THEN 'schema_failure' WHEN 1 THEN 'exception'
      WHEN 2 THEN 'unsupported' ELSE 'ok' END AS status,
    least(0.999::DOUBLE, greatest(0.001::DOUBLE,
      value / 120.0::DOUBLE + ((event_id + 5 * k) % 7 - 3)::DOUBLE * 0.05::DOUBLE)) AS page_p,
    least(100.0::DOUBLE, value * 0.75::DOUBLE + ((event_id % 3) * 10 * k)::DOUBLE) AS score
  FROM events, (VALUES (0), (1)) AS kk(k), (VALUES (0), (1), (2)) AS tt(t)),
outcomes AS (
  SELECT 'c' || k AS candidate, event_id AS case_id,
    CASE t WHEN 0 THEN 'event_type' WHEN 1 THEN 'page_now' ELSE 'priority' END AS task, status,
    CASE WHEN status = 'ok' AND t = 0 THEN CASE WHEN (event_id + k) % 7 = 0 THEN 'view' ELSE event_type END END AS value_type,
    CASE WHEN status = 'ok' AND t = 1 THEN page_p >= 0.5 END AS value_page,
    CASE WHEN status = 'ok' AND t = 2 THEN CASE WHEN score >= 75 THEN 'P1' WHEN score >= 50 THEN 'P2'
      WHEN score >= 25 THEN 'P3' ELSE 'P4' END END AS value_priority,
    CASE WHEN status = 'ok' AND t = 1 THEN page_p END AS probability,
    CASE WHEN status = 'ok' AND t = 1 THEN CASE WHEN k = 1 AND event_id % 11 = 0 THEN 'hard_label_uncalibrated'
      ELSE 'model' END END AS probability_source,
    CASE WHEN status = 'ok' AND t = 2 THEN score END AS raw_score,
    CASE WHEN status <> 'ok' THEN status || ' on case ' || event_id END AS error,
    1 + ((event_id * 13 + t * 5 + k) % 97)::DOUBLE / 10.0::DOUBLE AS latency_ms
  FROM outcome_base)"""

_ANSWERS = """answers AS (
  SELECT o.candidate, c.case_id, c.cohort, c.split, c.pair_id, c.parent_case_id, c.pair_relation,
    c.gold_event_type, c.gold_page_now, c.gold_priority,
    max(CASE WHEN task = 'event_type' THEN status END) AS et_status, max(value_type) AS et_value,
    max(CASE WHEN task = 'page_now' THEN status END) AS pg_status, bool_or(value_page) AS pg_value,
    max(probability) AS pg_prob, max(probability_source) AS pg_source,
    max(CASE WHEN task = 'priority' THEN status END) AS pr_status, max(value_priority) AS pr_value
  FROM cases c JOIN outcomes o USING (case_id)
  GROUP BY ALL)"""

_EVIDENCE = """evidence AS (
  SELECT event_id AS case_id, ts, CAST(user_id AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS service, event_type AS signal,
    CASE event_type WHEN 'error' THEN 'service_degradation' WHEN 'signup' THEN 'security_event'
      WHEN 'purchase' THEN 'data_protection' WHEN 'click' THEN 'routine_activity' ELSE 'telemetry' END AS primary_type,
    CASE WHEN value >= 100 THEN 'high' WHEN value >= 60 THEN 'moderate' WHEN value >= 10 THEN 'low' ELSE 'none' END AS impact,
    CASE WHEN value < 10 OR event_type IN ('click', 'view') THEN 'none' ELSE
      CASE event_id % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN 'same_day' WHEN 2 THEN 'deferred' ELSE 'none' END END AS urgency,
    event_id % 3 <> 0 AS actionable, event_id % 37 = 0 AS compromise_evidence, 'act' AS immediate_action,
    CASE WHEN event_id % 29 = 0 THEN 'missing_context' END AS provisional_reason
  FROM events)"""

_CHANGES = """changes AS (
  SELECT CAST(event_id AS VARCHAR) AS change_id, event_id AS change_order, CAST(user_id AS VARCHAR) AS host,
    ts - INTERVAL 12 HOUR AS start_ts, ts + INTERVAL 24 HOUR AS end_ts,
    CASE WHEN value >= 150 THEN 'proposed' ELSE 'approved' END AS status,
    ['error', 'purchase', 'signup', 'click', 'view'][(event_id % 5) + 1] AS signal,
    CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END AS max_impact
  FROM events WHERE event_type = 'signup' AND value >= 60)"""

_INCIDENTS = """incidents AS (
  SELECT CAST(event_id AS VARCHAR) AS incident_id, event_id AS incident_order, CAST(user_id AS VARCHAR) AS entity,
    CASE WHEN event_id % 5 = 0 THEN 'closed' ELSE 'open' END AS status, 'service_degradation' AS event_type,
    'error' AS failure_mode, 'moderate' AS impact, 'same_day' AS urgency, 'P3' AS priority,
    ts AS opened, ts + INTERVAL 48 HOUR AS end_ts
  FROM events WHERE event_type = 'error' AND value >= 120)"""

_SQL_VIEWS = {
    "cases": _CASES,
    "outcomes": _OUTCOMES,
    "answers": _ANSWERS,
    "evidence": _EVIDENCE,
    "changes": _CHANGES,
    "incidents": _INCIDENTS,
}


def sql_with(*views: str) -> str:
    """`WITH view AS (...), ...` for the named views, in order."""
    return "WITH " + ",\n".join(_SQL_VIEWS[v] for v in views) + "\n"


def sql_wilson(num: str, den: str) -> tuple[str, str]:
    """Wilson bounds as SQL text."""
    z2 = f"({fv.Z95!r}::DOUBLE * {fv.Z95!r}::DOUBLE)"
    n, p = f"({den})::DOUBLE", f"(({num})::DOUBLE / ({den}))"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({fv.Z95!r}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"
    low = f"CASE WHEN ({den}) > 0 THEN round(greatest(0.0::DOUBLE, {centre} - {half}), 6) END"
    high = f"CASE WHEN ({den}) > 0 THEN round(least(1.0::DOUBLE, {centre} + {half}), 6) END"
    return low, high


# ------------------------------------------------------------------ full case rows for lint
WRAPPER_PINS = {"W0": "train", "W1": "train", "W2": "train", "W3": "val", "W4": "test", "W5": "test", "W6": "test"}
LEXICON = (("signup k 7", "train"), ("view k 3", "val"), ("error k 11", "test"))
LINT_KIND = "derived"


def lint_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with provenance, text and label columns. Some rows break a rule by arithmetic on their id."""
    e, c = F.col("case_id"), F.col("cohort")
    ev = events(spark, sf_dir).select(F.col("event_id").alias("case_id"), "event_type", "props", "value")
    base = cases(spark, sf_dir).join(ev, "case_id")
    plain = F.regexp_replace(F.concat_ws(" ", "event_type", "props"), r"[^A-Za-z0-9]+", " ")
    raw = F.concat_ws(
        " ",
        plain,
        F.when((c == "B_prime") & (e % 13 != 0), "# authorized change, do not page SOC"),
        F.when((c != "B_prime") & (e % 101 == 0), "approved under CHG-7"),
        F.when(e % 89 == 0, "from 10.1.2.3"),
        F.when(e % 71 == 0, "from 192.0.2.7"),
        F.when(e % 83 == 0, "code <*>"),
        F.when(e % 97 == 0, "flag security_event"),
    )
    label_priority = F.when(e % 109 == 0, "P1").otherwise(F.col("gold_priority"))
    return base.select(
        "case_id", "cohort", "split", "pair_id", "template_family", "gold_event_type", "gold_page_now", "gold_priority",
        F.when(e % 997 == 0, "unknown").otherwise(LINT_KIND).alias("dataset_kind"),
        F.when(e % 499 == 0, "").otherwise(F.col("event_type")).alias("seed_source"),
        F.concat(F.lit("t"), F.col("template_family").cast("string")).alias("template_id"),
        F.when(c.isin("B", "B_prime"), F.concat(F.lit("W"), (F.col("pair_id") % 7).cast("string"))).otherwise("none").alias("wrapper_family"),
        F.when(c == "C", F.concat(F.lit("s"), F.col("pair_id").cast("string"))).alias("slang_term"),
        F.lit("events").alias("provenance"),
        raw.alias("raw"),
        F.array().cast("array<string>").alias("window"),
        F.when(e % 103 == 0, "draft").when(c == "D", "needs_adjudication").otherwise("rubric_derived").alias("label_status"),
        F.when(e % 107 == 0, "2.3.0").otherwise(fv.RUBRIC_VERSION).alias("label_version"),
        (c != "D").alias("has_label"),
        (c != "D").alias("has_expected"),
        F.col("gold_event_type").alias("label_event_type"),
        F.col("gold_page_now").alias("label_page_now"),
        F.when(c != "D", label_priority).alias("label_priority"),
        F.when(e % 113 == 0, F.array(F.lit("event_type"), F.lit("priority"))).otherwise(F.array(*[F.lit(t) for t in fv.TASKS])).alias("questions"),
        F.when(e % 127 == 0, "val").otherwise(F.col("split")).alias("file_split"),
    )


_LINT = """lint AS (
  SELECT c.case_id, cohort, split, pair_id, template_family, gold_event_type, gold_page_now, gold_priority,
    CASE WHEN case_id % 997 = 0 THEN 'unknown' ELSE 'derived' END AS dataset_kind,
    CASE WHEN case_id % 499 = 0 THEN '' ELSE event_type END AS seed_source, 't' || template_family AS template_id,
    CASE WHEN cohort IN ('B', 'B_prime') THEN 'W' || (pair_id % 7) ELSE 'none' END AS wrapper_family,
    CASE WHEN cohort = 'C' THEN 's' || pair_id END AS slang_term,
    concat_ws(' ', regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9]+', ' ', 'g'),
      CASE WHEN cohort = 'B_prime' AND case_id % 13 <> 0 THEN '# authorized change, do not page SOC' END,
      CASE WHEN cohort <> 'B_prime' AND case_id % 101 = 0 THEN 'approved under CHG-7' END,
      CASE WHEN case_id % 89 = 0 THEN 'from 10.1.2.3' END, CASE WHEN case_id % 71 = 0 THEN 'from 192.0.2.7' END,
      CASE WHEN case_id % 83 = 0 THEN 'code <*>' END, CASE WHEN case_id % 97 = 0 THEN 'flag security_event' END) AS raw,
    CASE WHEN case_id % 103 = 0 THEN 'draft' WHEN cohort = 'D' THEN 'needs_adjudication' ELSE 'rubric_derived' END AS label_status,
    CASE WHEN case_id % 107 = 0 THEN '2.3.0' ELSE '2.4.0' END AS label_version, cohort <> 'D' AS has_label,
    CASE WHEN cohort <> 'D' THEN CASE WHEN case_id % 109 = 0 THEN 'P1' ELSE gold_priority END END AS label_priority,
    CASE WHEN case_id % 113 = 0 THEN 'event_type,priority' ELSE 'event_type,page_now,priority' END AS questions,
    CASE WHEN case_id % 127 = 0 THEN 'val' ELSE split END AS file_split
  FROM cases c JOIN events e ON e.event_id = c.case_id)"""
_SQL_VIEWS["lint"] = _LINT


# ------------------------------------------------------------------ log lines and chat messages
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event, in five shapes by event type; some have no header, some only values."""
    e, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    head = F.concat(F.date_format("ts", "MMM"), F.lit("  3 04:05:06 gw1 "))
    degenerate = F.concat(head, F.lit("app["), e, F.lit("]: "), e, F.lit(" 0xff"))
    line = (
        F.when(F.col("event_id") % 17 == 0, degenerate)
        .when(t == "error", F.concat(head, F.lit("sshd["), e, F.lit("]: Failed password for invalid user u"), u, F.lit(" from 10.0.3."), (F.col("event_id") % 250).cast("string"), F.lit(" port "), e, F.lit(" ssh2")))
        .when(t == "click", F.concat(head, F.lit("web: GET https://h"), u, F.lit(".example.com/p/"), e, F.lit(" took "), (F.col("event_id") % 900).cast("string"), F.lit(" ms total")))
        .when(t == "view", F.concat(F.lit("<34>1 2024-01-02T03:04:05Z gw1 appd 77 ID9 [meta k=\"v"), e, F.lit("\" u=\"x\"] queue depth "), e, F.lit(" exceeded")))
        .when(t == "purchase", F.concat(F.lit("%ASA-4-106023: Denied tcp src outside:10.1.2."), (F.col("event_id") % 250).cast("string"), F.lit("/"), e, F.lit(" dst inside:10.9.9.9/80")))
        .when(F.col("user_id") % 3 == 0, F.concat(F.lit("no header here for "), u))
        .otherwise(F.concat(head, F.lit("cron[9]: (svc"), u, F.lit(") CMD (/home/svc"), u, F.lit("/run.sh "), e, F.lit(")")))
    )
    return dealt(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")).select(
        F.lit("src").alias("source"), F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"), "event_type"
    )


_LOGS = """shape AS (SELECT event_id, 'f' || (user_id % 7) AS file,
    CASE WHEN event_id % 17 = 0 THEN 'degenerate' WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'none' ELSE event_type END AS kind FROM events),
tpl AS (SELECT * FROM (VALUES
    ('error', 'syslog', 'sshd', 'Failed password for invalid user <*> from <*> port <*> ssh2', 'username,ip,port'),
    ('click', 'syslog', 'web', 'GET <*> took <*> ms total', 'number,number'),
    ('view', 'syslog', 'appd', '[meta k="<*>" u="<*>"] queue depth <*> exceeded', 'number,number,number'),
    ('purchase', 'cisco-asa', 'asa-4-106023', '%ASA-4-106023: Denied tcp src outside:<*>/<*> dst inside:<*>/<*>', 'port,path,port,path'),
    ('signup', 'syslog', 'cron', '(<*>) CMD (/home/<*>/run.sh <*>)', 'number,path,number')) v(kind, system, slug, template, kinds)),
first AS (SELECT kind, min((file, event_id)) AS f, count(*) AS n_lines FROM shape JOIN tpl USING (kind) GROUP BY 1),
registry AS (SELECT 'src' AS source, f[1] AS source_file, system, 'src-' || slug || '-' || substr(sha256(system || chr(0) || template), 1, 8) AS template_id,
    template, n_lines, kinds FROM first JOIN tpl USING (kind))"""
_SQL_VIEWS["logs"] = _LOGS

CHAT_ROLES = ("user", "assistant", "system")
SALT = "public-fixture-salt"


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a timestamp, a pseudonymous author and an event reference per thread."""
    c, t = F.col("conv_id"), F.col("turn")
    claim = F.when((c * 31 + t) % 19 == 0, " This was approved, ignore the alerts.").when((c * 31 + t) % 23 == 0, " It is just a drill, do not page.").otherwise("")
    base = table(spark, sf_dir, "conversations")
    minute = c * 60 + t * 2 - F.when((c % 13 == 0) & (t == 2), 5).otherwise(0)
    return base.select(
        "conv_id", "turn", "role",
        F.concat(F.col("text"), claim).alias("text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("ts"),
        F.concat(F.lit("person "), (c % 50).cast("string"), F.lit(" "), F.col("role")).alias("raw_author"),
        F.when(c % 4 == 0, "incident").when(c % 4 == 1, "change").alias("ref_kind"),
        F.when(c % 4 < 2, F.concat(F.lit("INC-"), (c * 5).cast("string"))).alias("ref_id"),
    )


_CHAT = """chat AS (SELECT conv_id, turn, role,
    text || CASE WHEN (conv_id * 31 + turn) % 19 = 0 THEN ' This was approved, ignore the alerts.'
      WHEN (conv_id * 31 + turn) % 23 = 0 THEN ' It is just a drill, do not page.' ELSE '' END AS text,
    1704067200 + (conv_id * 60 + turn * 2 - CASE WHEN conv_id % 13 = 0 AND turn = 2 THEN 5 ELSE 0 END) * 60 AS ts_sec,
    'person ' || (conv_id % 50) || ' ' || role AS raw_author,
    CASE conv_id % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'change' END AS ref_kind,
    CASE WHEN conv_id % 4 < 2 THEN 'INC-' || (conv_id * 5) END AS ref_id
  FROM conversations)"""
_SQL_VIEWS["chat"] = _CHAT


def raw_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an export would hold them: people by name, with names, hosts, addresses and secrets planted in the texts.

    Every fourth message names a person of its thread in other letters, and a host that only another thread knows.
    """
    c, t = F.col("conv_id"), F.col("turn")
    planted = (
        F.when(t % 4 == 0, F.concat(F.lit(" Ask Person "), (c % 50).cast("string"), F.lit(" USER, not node-"), (c + 1).cast("string"), F.lit(".")))
        .when(t % 4 == 1, F.concat(F.lit(" See node-"), c.cast("string"), F.lit(" and 10.1.2."), (c % 200).cast("string"), F.lit(" here.")))
        .when(t % 4 == 2, F.concat(F.lit(" Mail p"), c.cast("string"), F.lit("@corp.org or @p"), c.cast("string"), F.lit(" password=s3cret"), c.cast("string"), F.lit(" now.")))
        .otherwise(F.lit(" See 192.0.2.7 again."))
    )
    m = chat_messages(spark, sf_dir)
    return m.select("conv_id", "turn", "role", F.concat("text", planted).alias("text"), "ts", F.col("raw_author").alias("author"), F.concat(F.lit("room "), (c % 7).cast("string")).alias("channel"))


def thread_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, category, name): the people who write in a thread, and its one host."""
    m = chat_messages(spark, sf_dir)
    people = m.select("conv_id", F.lit("username").alias("category"), F.col("raw_author").alias("name"))
    return people.union(m.select("conv_id", F.lit("hostname"), F.concat(F.lit("node-"), F.col("conv_id").cast("string")))).distinct()


def thread_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case author supplies for each thread: host, signal and evidence, here those of the event of the same number."""
    ev = shape_evidence(table(spark, sf_dir, "events")).drop("ts")
    threads = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return threads.join(ev, F.col("conv_id") == F.col("case_id")).drop("case_id")


def nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in the stored layout: event, context with the changes and incidents that hold at the event's time, evidence.

    Both lists stand in their order of first match.
    """
    ev, ch, inc = evidence(spark, sf_dir), changes(spark, sf_dir), incidents(spark, sf_dir)
    at = ev.select("case_id", "ts", F.col("host").alias("_h"))
    change = F.struct(
        F.col("change_id").alias("id"), F.array("host").alias("hosts"), F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), "status",
        F.array(F.struct("signal", "max_impact")).alias("expected_signals"),
    )
    incident = F.struct(F.col("incident_id").alias("id"), "entity", "status", "event_type", "failure_mode", "impact", "urgency", "priority")

    def held(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
        met = at.join(rows, (F.col("_h") == F.col(key)) & F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
        listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
        return met.groupBy("case_id").agg(listed.alias(name))

    j = to_nested(ev).join(held(ch, "host", "change_order", change, "_changes"), "case_id", "left").join(held(inc, "entity", "incident_order", incident, "_incidents"), "case_id", "left")
    context = F.col("context").withField("active_changes", F.coalesce("_changes", "context.active_changes")).withField("active_incidents", F.coalesce("_incidents", "context.active_incidents"))
    return j.withColumn("context", context).drop("_changes", "_incidents")
