"""Registered labeling queries: change windows, incidents, the rubric, counterfactual contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import fixtures as fx
from alertloom.operators import counterfactuals as cf
from alertloom.operators import rubric as rb
from alertloom.operators import threads as th

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_RANK = "list_position(['none', 'low', 'moderate', 'high'], {})"
_URANK = "list_position(['none', 'deferred', 'same_day', 'immediate'], {})"
_MATCHED = fx.sql_with("evidence", "changes", "incidents") + f""", chg AS (
  SELECT e.case_id, min_by(c.change_id, c.change_order) AS change_id FROM evidence e JOIN changes c
    ON c.host = e.host AND c.signal = e.signal AND c.status = 'approved' AND e.ts BETWEEN c.start_ts AND c.end_ts
    AND {_RANK.format('e.impact')} <= {_RANK.format('c.max_impact')} GROUP BY 1),
inc AS (
  SELECT e.case_id, min_by(i.incident_id, (CASE WHEN i.failure_mode = e.signal THEN 0 ELSE 1 END, i.incident_order)) AS incident_id
  FROM evidence e JOIN incidents i ON i.entity = e.host AND i.status = 'open' AND e.ts > i.opened AND e.ts <= i.end_ts GROUP BY 1)"""


@query("j3_change_window", _MATCHED + " SELECT case_id, change_id FROM evidence LEFT JOIN chg USING (case_id)")
def j3_change_window(spark, sf_dir):
    return rb.match_changes(fx.evidence(spark, sf_dir), fx.changes(spark, sf_dir)).select("case_id", "change_id")


@query("j4_incident_correlation", _MATCHED + " SELECT case_id, incident_id FROM evidence LEFT JOIN inc USING (case_id)")
def j4_incident_correlation(spark, sf_dir):
    return rb.match_incidents(fx.evidence(spark, sf_dir), fx.incidents(spark, sf_dir), fx.ENTITY_COLUMNS).select("case_id", F.col("incident.incident_id").alias("incident_id"))


_LABEL = _MATCHED + f""", base AS (
  SELECT e.*, chg.change_id, i.incident_id, i.event_type AS ity, i.failure_mode AS imode, i.impact AS iimp, i.urgency AS iurg, i.priority AS ipri,
    CASE primary_type WHEN 'service_degradation' THEN 'sre' WHEN 'security_event' THEN 'soc' WHEN 'data_protection' THEN 'privacy_dpo' END AS owner,
    CASE WHEN e.urgency = 'immediate' THEN CASE WHEN e.impact = 'high' THEN 'P1' ELSE 'P2' END WHEN e.urgency = 'same_day' THEN 'P3' ELSE 'P4' END AS own_priority,
    CASE e.urgency WHEN 'immediate' THEN CASE WHEN actionable THEN 'page_now' ELSE 'urgent_review' END WHEN 'same_day' THEN 'urgent_review'
      WHEN 'deferred' THEN 'scheduled_review' ELSE 'none' END AS own_note
  FROM evidence e LEFT JOIN chg USING (case_id) LEFT JOIN inc USING (case_id) LEFT JOIN incidents i USING (incident_id)),
d AS (SELECT *, change_id IS NOT NULL AND NOT compromise_evidence AS explained,
    CASE WHEN provisional_reason IS NOT NULL AND owner IS NULL THEN 'a provisional case needs a triage owner' END AS error FROM base),
d2 AS (SELECT *, incident_id IS NOT NULL AND NOT explained AS used,
    incident_id IS NOT NULL AND NOT explained AND ity = primary_type AND imode = signal
      AND {_RANK.format('impact')} <= {_RANK.format('iimp')} AND {_URANK.format('urgency')} <= {_URANK.format('iurg')} AS attaches FROM d),
d3 AS (SELECT *, CASE WHEN explained THEN 'explained_by_change' WHEN attaches THEN 'attached_to_incident' ELSE 'new' END AS handling,
    CASE WHEN explained OR attaches THEN 'none' ELSE own_note END AS notification, CASE WHEN attaches THEN ipri ELSE own_priority END AS priority FROM d2),
d4 AS (SELECT *, CASE WHEN notification = 'page_now' THEN CASE WHEN owner = 'privacy_dpo' THEN 'soc' ELSE owner END END AS page_target,
    CASE WHEN notification = 'scheduled_review' THEN 'scheduled' WHEN notification = 'none' AND priority = 'P4' THEN 'retained' ELSE 'respond' END AS response FROM d3),
label AS (SELECT case_id, error, CASE WHEN error IS NULL THEN primary_type END AS event_type, owner, CASE WHEN error IS NULL THEN priority END AS priority,
    CASE WHEN error IS NULL THEN notification END AS notification, CASE WHEN error IS NULL THEN notification = 'page_now' END AS page_now,
    CASE WHEN error IS NULL THEN page_target END AS page_target, CASE WHEN error IS NULL THEN response END AS response,
    CASE WHEN error IS NULL THEN CASE priority WHEN 'P1' THEN '15 minutes' WHEN 'P2' THEN '1 hour' WHEN 'P3' THEN 'end of business day'
      ELSE CASE WHEN response = 'scheduled' THEN 'next business day' END END END AS ack_target,
    CASE WHEN error IS NULL THEN handling END AS handling,
    CASE WHEN error IS NULL AND provisional_reason IS NOT NULL THEN coalesce(page_target, owner) END AS triage_owner,
    CASE WHEN error IS NULL AND provisional_reason IS NOT NULL THEN CASE priority WHEN 'P1' THEN '1 hour' WHEN 'P2' THEN '4 hours' WHEN 'P3' THEN 'end of business day'
      ELSE CASE WHEN response = 'scheduled' THEN '2 business days' END END END AS fact_finding_deadline,
    CASE WHEN error IS NULL AND page_target <> owner THEN '4 business hours' END AS owner_review_target,
    CASE WHEN error IS NULL THEN concat_ws('|',
      CASE WHEN change_id IS NOT NULL AND compromise_evidence THEN 'expected_activity_ignored=signs of compromise outweigh ' || change_id END,
      CASE WHEN explained THEN 'expected_activity=' || signal || ' is allowed by ' || change_id || '; nobody is notified' END,
      CASE WHEN attaches THEN 'related_incident=joins ' || incident_id || ' at its ' || ipri END,
      CASE WHEN used AND NOT attaches THEN 'related_incident_reassessed=' || incident_id || ': ' || CASE WHEN ity <> primary_type THEN 'another event type'
        WHEN imode <> signal THEN 'another failure mode' ELSE 'worse impact or urgency' END END,
      CASE WHEN provisional_reason IS NOT NULL THEN 'provisional=' || provisional_reason END,
      CASE WHEN page_target <> owner THEN 'page_routing=' || owner || ' works business hours; ' || page_target || ' checks at any hour' END) END AS rules
  FROM d4)"""


def labeled(spark, sf_dir):
    return rb.label_tables(fx.evidence(spark, sf_dir), fx.changes(spark, sf_dir), fx.incidents(spark, sf_dir), fx.ENTITY_COLUMNS)


def flat_label(df):
    rules = F.array_join(F.transform("label.applied_rules", lambda r: F.concat(r["rule"], F.lit("="), r["reason"])), "|")
    return df.select(
        "case_id", "error", "label.event_type", F.col("owner"), "label.priority", "label.notification", "label.page_now",
        "label.page_target", "label.response", "label.ack_target", "label.handling", "label.triage_owner",
        "label.fact_finding_deadline", "label.owner_review_target", rules.alias("rules"),
    )


@query("l1_rubric_label", _LABEL + " SELECT * FROM label")
def l1_rubric_label(spark, sf_dir):
    return flat_label(labeled(spark, sf_dir))


_THREAD_EVIDENCE = fx._CHAT + ", " + fx._EVIDENCE.replace("event_id AS case_id, ts,", "event_id AS case_id, make_timestamp(first_sec * 1000000) AS ts,").replace(
    "FROM events)", "FROM events JOIN (SELECT conv_id, min_by(ts_sec, turn) AS first_sec FROM chat GROUP BY 1) ON conv_id = event_id)")


@query("l2_thread_label", _LABEL.replace(fx._EVIDENCE, _THREAD_EVIDENCE) + " SELECT * FROM label")
def l2_thread_label(spark, sf_dir):
    """Every thread of the conversations, by evidence that is not in its text."""
    messages = fx.chat_messages(spark, sf_dir)
    labels = th.label_threads(messages, fx.thread_evidence(spark, sf_dir), fx.changes(spark, sf_dir), fx.incidents(spark, sf_dir), entity_columns=fx.ENTITY_COLUMNS)
    return flat_label(labels.withColumnRenamed("conv_id", "case_id"))


@query("l1_nested_context", _LABEL + " SELECT * FROM label")
def l1_nested_context(spark, sf_dir):
    """The nested form, changes and incidents being lists on the case: the same labels as by tables."""
    return flat_label(rb.label_nested(fx.nested_cases(spark, sf_dir)))


@query("d2_provisional_rate", _LABEL + """ SELECT event_type, count(*) AS n, count(*) FILTER (rules LIKE '%provisional=%') AS provisional,
  round((count(*) FILTER (rules LIKE '%provisional=%'))::DOUBLE / count(*), 6) AS rate FROM label WHERE error IS NULL GROUP BY 1""")
def d2_provisional_rate(spark, sf_dir):
    ok = labeled(spark, sf_dir).where(F.col("error").isNull())
    n, p = F.count(F.lit(1)), F.count_if(F.col("label.provisional"))
    return ok.groupBy(F.col("label.event_type").alias("event_type")).agg(n.alias("n"), p.alias("provisional"), F.round(p / n, 6).alias("rate"))


@query("v4_evidence_contract", _LABEL + " SELECT error, count(*) AS n FROM label WHERE error IS NOT NULL GROUP BY 1")
def v4_evidence_contract(spark, sf_dir):
    ev = fx.evidence(spark, sf_dir)
    checked = ev.withColumn("error", rb.evidence_error(set(ev.columns)))
    return checked.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


#: One break of each rule, as (rule, column, value); the first lines of the contract come first.
_BREAKS = (
    ("unknown event type", "primary_type", "'odd'"),
    ("unknown event type", "secondary_types", "array('telemetry', 'odd')"),
    ("unknown owner", "owner", "'nobody'"),
    ("unknown owner", "secondary_owners", "array(cast(null AS string))"),
    ("impact not on its scale", "impact", "'huge'"),
    ("urgency not on its scale", "urgency", "'soon'"),
    ("impact and urgency are not a valid combination", "impact", "'none'"),
    ("signal is required", "signal", "' '"),
    ("a response needs an owner", "primary_type", "'telemetry'"),
    ("unknown provisional reason", "provisional_reason", "'because'"),
    ("missing_context needs the missing facts", "provisional_reason", "'missing_context'"),
    ("a threatened critical asset needs impact of at least moderate", "threatens_critical", "true"),
)


@query("v4_each_rule", "SELECT event_id AS case_id, [" + ", ".join(f"'{b[0]}'" for b in _BREAKS) + f"][event_id % {len(_BREAKS) + 1}] AS error FROM events WHERE event_id % {len(_BREAKS) + 1} > 0")
def v4_each_rule(spark, sf_dir):
    """Sound evidence on every event, each rule of the contract broken on some of them."""
    good = fx.events(spark, sf_dir).selectExpr(
        "event_id AS case_id", "event_type AS signal", "'security_event' AS primary_type", "array('telemetry') AS secondary_types", "'soc' AS owner", "array('sre') AS secondary_owners", "'low' AS impact",
        "'same_day' AS urgency", "cast(null AS string) AS provisional_reason", "cast(array() AS array<string>) AS missing_context", "false AS threatens_critical", "'high' AS criticality",
    ).withColumn("k", F.col("case_id") % (len(_BREAKS) + 1))
    broken = good
    for k, (_, column, value) in enumerate(_BREAKS, 1):
        broken = broken.withColumn(column, F.when(F.col("k") == k, F.expr(value)).otherwise(F.col(column)))
    broken = broken.withColumn("owner", F.when(F.col("primary_type") != "telemetry", F.col("owner")))
    checked = broken.withColumn("error", rb.evidence_error(set(broken.columns)))
    return checked.where(F.col("error").isNotNull()).select("case_id", "error")


@query("j5_rubric_lookup", fx.sql_with("evidence") + """SELECT case_id, CASE WHEN impact = 'none' THEN CASE WHEN urgency = 'none' THEN 'P4' ELSE 'x' END
  WHEN urgency = 'immediate' THEN CASE WHEN impact = 'high' THEN 'P1' ELSE 'P2' END WHEN urgency = 'same_day' THEN 'P3' ELSE 'P4' END AS priority FROM evidence""")
def j5_rubric_lookup(spark, sf_dir):
    return fx.evidence(spark, sf_dir).select("case_id", rb._matrix(F.col("impact"), F.col("urgency")).alias("priority"))


# ------------------------------------------------------------------ counterfactual contexts
_PAGING = """, paging AS (SELECT e.* FROM evidence e WHERE urgency = 'immediate' AND actionable
    AND NOT (provisional_reason IS NOT NULL AND primary_type IN ('routine_activity', 'telemetry')))"""


@query(
    "l3_counterfactual_pairs",
    fx.sql_with("evidence") + _PAGING + """, v AS (SELECT case_id, k AS variant, compromise_evidence, k = 'covered' AND NOT compromise_evidence AS quiet, impact
  FROM paging, (VALUES ('covered'), ('wrong_host'), ('expired'), ('signal_not_expected'), ('beyond_bound'), ('unapproved')) t(k))
SELECT case_id, variant, CASE WHEN quiet THEN 'explained_by_change' ELSE 'new' END AS handling, NOT quiet AS page_now,
  CASE WHEN impact = 'high' THEN 'P1' ELSE 'P2' END AS priority, quiet = (variant = 'covered') AS as_expected FROM v""",
)
def l3_counterfactual_pairs(spark, sf_dir):
    return cf.change_variants(cf.paging_cases(fx.evidence(spark, sf_dir)))


@query(
    "l4_claim_injection",
    fx.sql_with("evidence") + _PAGING + """SELECT case_id, k AS variant, true AS label_kept, true AS carries_claim, true AS page_now
FROM paging, (VALUES ('no_record'), ('other_host'), ('expired'), ('unknown_principal')) t(k)""",
)
def l4_claim_injection(spark, sf_dir):
    return cf.claim_variants(cf.paging_cases(fx.evidence(spark, sf_dir)))
