"""Worked labels for the rubric, nested form, and agreement of the table form with brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertloom.operators import rubric as rb
from alertloom.operators import stabbing
from alertloom.operators.stabbing import interval_index, stab

CASE = (
    "case_id string, event struct<format:string,ts:timestamp,host:string,service:string,signal:string>, "
    "context struct<asset:struct<criticality:string>,active_changes:array<struct<id:string,hosts:array<string>,start:timestamp,end:timestamp,status:string,"
    "expected_signals:array<struct<signal:string,max_impact:string>>>>,active_incidents:array<struct<id:string,entity:string,status:string,event_type:string,"
    "failure_mode:string,impact:string,urgency:string,priority:string>>>, "
    "evidence struct<primary_type:string,signal:string,impact:string,urgency:string,actionable:boolean,owner:string,compromise_evidence:boolean,"
    "provisional_reason:string,immediate_action:string,missing_context:array<string>,threatens_critical:boolean>"
)


def at(h, m=0, s=0):
    return dt.datetime(2026, 10, 3, h, m, s)


WINDOW = ("CHG-1", ["db-7", "bastion-2"], at(2), at(3), "approved", [("db_failover", "moderate"), ("replication_lag", "low")])
OUTAGE = ("INC-1", "auth-proxy", "open", "service_degradation", "http_5xx", "high", "immediate", "P1")


def row(cid, ts, host, service, signal, kind, impact, urgency, changes=(), incidents=(), act=False, compromise=False, reason=None, action="act", owner=None, critical=False, crit="high"):
    missing = ["fact"] if reason == "missing_context" else []
    return (cid, ("f", ts, host, service, signal), ((crit,), list(changes), list(incidents)), (kind, signal, impact, urgency, act, owner, compromise, reason, action, missing, critical))


SEC, SVC, DATA = "security_event", "service_degradation", "data_protection"
# expected: owner, notification, page_now, priority, handling, rules, response, ack target, page target, fact-finding, triage owner
EXAMPLES = [
    (row("W1", at(4, 14, 7), "bastion-2", "sshd", "failed_login", SEC, "low", "none"), ("soc", "none", False, "P4", "new", [], "retained", None, None, None, None)),
    (row("W2", at(2, 14, 7), "bastion-2", "sshd", "failed_login", SEC, "low", "none", [WINDOW]), ("soc", "none", False, "P4", "new", [], "retained", None, None, None, None)),
    (row("W3", at(4, 20), "bastion-2", "sshd", "bruteforce_success", SEC, "moderate", "immediate", act=True, reason="missing_context", critical=True), ("soc", "page_now", True, "P2", "new", ["provisional"], "respond", "1 hour", "soc", "4 hours", "soc")),
    (row("W4", at(2, 21), "db-7", "postgres", "replication_lag", SVC, "low", "deferred", [WINDOW]), ("sre", "none", False, "P4", "explained_by_change", ["expected_activity"], "retained", None, None, None, None)),
    (row("W4b", at(2, 40), "db-7", "postgres", "replication_lag", SVC, "high", "immediate", [WINDOW], act=True, critical=True), ("sre", "page_now", True, "P1", "new", [], "respond", "15 minutes", "sre", None, None)),
    (row("W4c", at(3, 30), "db-7", "postgres", "replication_lag", SVC, "moderate", "immediate", [WINDOW], act=True), ("sre", "page_now", True, "P2", "new", [], "respond", "1 hour", "sre", None, None)),
    (row("W4d", at(3, 30), "db-7", "postgres", "replication_lag", SVC, "low", "same_day", [WINDOW]), ("sre", "urgent_review", False, "P3", "new", [], "respond", "end of business day", None, None, None)),
    (row("W5", at(2, 35), "db-7", "auditd", "privilege_change", SEC, "moderate", "immediate", [WINDOW], act=True, reason="missing_context", critical=True), ("soc", "page_now", True, "P2", "new", ["provisional"], "respond", "1 hour", "soc", "4 hours", "soc")),
    (row("W6", at(5, 2), "auth-proxy-1", "auth-proxy", "token_rejected", SEC, "low", "same_day", (), [OUTAGE]), ("soc", "urgent_review", False, "P3", "new", ["related_incident_reassessed"], "respond", "end of business day", None, None, None)),
    (row("W6b", at(5, 3), "auth-proxy-1", "auth-proxy", "token_accepted", SEC, "high", "immediate", (), [OUTAGE], act=True, compromise=True, critical=True), ("soc", "page_now", True, "P1", "new", ["related_incident_reassessed"], "respond", "15 minutes", "soc", None, None)),
    (row("W7", at(5, 4), "auth-proxy-1", "auth-proxy", "http_5xx", SVC, "high", "immediate", (), [OUTAGE], act=True), ("sre", "none", False, "P1", "attached_to_incident", ["related_incident"], "respond", "15 minutes", None, None, None)),
    (row("W9", at(9, 10), "etl-3", "export", "cross_border", DATA, "moderate", "immediate", act=True, reason="missing_context"), ("privacy_dpo", "page_now", True, "P2", "new", ["provisional", "page_routing"], "respond", "1 hour", "soc", "4 hours", "soc")),
    (row("W9b", at(9, 10), "etl-3", "export", "cross_border", DATA, "low", "deferred"), ("privacy_dpo", "scheduled_review", False, "P4", "new", [], "scheduled", "next business day", None, None, None)),
    # signs of compromise outweigh a matching window; both window ends are inclusive
    (row("X1", at(2, 21), "db-7", None, "replication_lag", SVC, "low", "deferred", [WINDOW], compromise=True), ("sre", "scheduled_review", False, "P4", "new", ["expected_activity_ignored"], "scheduled", "next business day", None, None, None)),
    (row("X2", at(3), "db-7", None, "replication_lag", SVC, "low", "deferred", [WINDOW]), ("sre", "none", False, "P4", "explained_by_change", ["expected_activity"], "retained", None, None, None, None)),
]


def test_worked_examples(spark):
    got = {r.case_id: r for r in rb.label_nested(spark.createDataFrame([e[0] for e in EXAMPLES], CASE)).collect()}
    for r, want in EXAMPLES:
        label = got[r[0]].label
        assert got[r[0]].error is None, (r[0], got[r[0]].error)
        have = (label.owner, label.notification, label.page_now, label.priority, label.handling, [x.rule for x in label.applied_rules], label.response,
                label.ack_target, label.page_target, label.fact_finding_deadline, label.triage_owner)
        assert have == want, r[0]
    assert got["W9"].label.owner_review_target == "4 business hours"


@pytest.mark.parametrize(
    "kwargs,error",
    [
        (dict(kind="odd"), "unknown event type"),
        (dict(impact="none", urgency="immediate"), "not a valid combination"),
        (dict(impact="huge"), "impact not on its scale"),
        (dict(signal=" "), "signal is required"),
        (dict(kind="telemetry", urgency="same_day"), "needs an owner"),
        (dict(reason="because"), "unknown provisional reason"),
        (dict(owner="nobody"), "unknown owner"),
        (dict(critical=True), "needs impact of at least moderate"),
        (dict(urgency="immediate", act=True, action=" "), "needs the responder's immediate action"),
        (dict(impact="low", urgency="same_day", kind=SVC, signal="http_5xx", incidents=[("I", "h", "open", SVC, "http_5xx", "high", "immediate", "P9")]), "needs a priority P1-P4"),
    ],
)
def test_contract_errors(spark, kwargs, error):
    base = dict(kind=SEC, impact="low", urgency="none", signal="s")
    base.update(kwargs)
    kind, impact, urgency, signal = (base.pop(k) for k in ("kind", "impact", "urgency", "signal"))
    r = rb.label_nested(spark.createDataFrame([row("E", at(1), "h", None, signal, kind, impact, urgency, **base)], CASE)).first()
    assert r.label is None and error in r.error


@pytest.mark.parametrize("limit,aim,step", [(64, 16, 12), (4, 1, 3)])
def test_interval_index_against_brute_force(spark, monkeypatch, limit, aim, step):
    """A hot key with many overlapping windows, some open for decades, others empty; points on and around their ends."""
    import random

    for name, value in (("LIMIT", limit), ("AIM", aim), ("STEP", step)):
        monkeypatch.setattr(stabbing, name, value)
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    ivs = []
    for i in range(150):
        a = start + dt.timedelta(minutes=rng.randrange(0, 600), microseconds=rng.choice([0, 1, 999_999]))
        ivs.append(("hot" if i % 3 else f"k{i % 5}", a, a + dt.timedelta(minutes=rng.randrange(0, 400)), i, f"w{i}"))
    ivs += [("hot", start + dt.timedelta(minutes=300, microseconds=i), start + dt.timedelta(minutes=300, microseconds=i + 3), -200 + i, f"burst{i}") for i in range(60)]
    ivs += [("hot", start + dt.timedelta(minutes=590), dt.datetime(2099, 1, 1), 900, "long"), ("k0", dt.datetime(1950, 3, 1), dt.datetime(1999, 1, 1), 901, "old"), ("k3", start, start, 902, "instant"), ("k3", start, start - dt.timedelta(days=1), 903, "never"), (None, start, dt.datetime(2099, 1, 1), 904, "no key"), ("k3", None, start, 905, "no start")]
    pts = [(1000 + i, "hot", start + dt.timedelta(minutes=300, microseconds=i)) for i in range(-2, 66)]
    for i in range(300):
        edge = rng.choice([v for v in ivs if v[1]])[rng.choice([1, 2])]
        pts.append((i, rng.choice(["hot", "k0", "k3", "unknown", None]), rng.choice([edge, edge + dt.timedelta(microseconds=1), edge - dt.timedelta(microseconds=1), edge + dt.timedelta(days=4000), None])))
    index = interval_index(spark.createDataFrame(ivs, "k string, s timestamp, e timestamp, o long, w string"), ["k"], "s", "e", "o", "w")
    assert index.cells.selectExpr("max(size(marks))").first()[0] <= limit + 1
    got = {r.i: r.win.w if r.win else None for r in stab(spark.createDataFrame(pts, "i long, k string, ts timestamp"), "ts", index).collect()}
    assert len(got) == 368
    for i, k, ts in pts:
        hits = [(o, w) for kk, s, e, o, w in ivs if k is not None and ts is not None and kk == k and s is not None and s <= ts <= e]
        assert got[i] == (min(hits)[1] if hits else None), (i, k, ts)


def test_keys_of_few_intervals_make_no_blocks(spark, monkeypatch):
    """Only the key of many intervals meets the aligned blocks; both kinds of key find the same winners."""
    made = []
    blocks = stabbing._blocks
    monkeypatch.setattr(stabbing, "_blocks", lambda ready, keys: made.append({r.k for r in ready.select("k").distinct().collect()}) or blocks(ready, keys))
    df = spark.range(400).selectExpr("if(id < 100, 'hot', concat('h', id div 4)) AS k", "timestamp_micros(1700000000000000 + id * 7000003) AS s", "timestamp'2039-01-01 00:00:00' AS e", "400 - id AS o", "cast(id AS string) AS w")
    at = df.select("k", F.col("s").alias("ts"), F.col("w").alias("i")).unionByName(df.selectExpr("k", "timestamp'2035-01-01 00:00:00' AS ts", "'later' AS i"))
    got = {(r.k, r.i): r.win.w for r in stab(at, "ts", interval_index(df, ["k"], "s", "e", "o", "w")).collect()}
    assert made == [{"hot"}]
    want = {(r.k, r.w): r.w for r in df.collect()}
    last = {}
    for (k, w) in want:
        last[k] = max(last.get(k, 0), int(w))
    assert got == want | {(k, "later"): str(w) for k, w in last.items()}
    interval_index(df.where("k <> 'hot'"), ["k"], "s", "e", "o", "w")
    assert len(made) == 1


def test_long_intervals_cost_tens_of_rows(spark):
    n = 200
    df = spark.range(n).selectExpr("'h' AS k", "timestamp_micros(1700000000000000 + id * 7000003) AS s", "timestamp'2099-01-01 00:00:00' AS e", "id AS o", "cast(id AS string) AS w")
    index = interval_index(df, ["k"], "s", "e", "o", "w")
    assert sum(c.count() for c in index.cuts) + index.cells.count() < 2 * n + 30
    assert stabbing._blocks(df.selectExpr("k", "unix_micros(s) AS s", "unix_micros(e) + 1 AS e", "struct(o, w) AS win"), ["k"]).count() < 110 * n
