"""Labels from evidence and trusted context: the rubric as columns.

Two forms of context are supported. In the table form changes and incidents are tables, looked up in
an index of their intervals; in the nested form they are arrays on the case row and no join is needed.
Event text plays no part in either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.stats import ordinal_rank
from alertloom.operators.stabbing import Index, interval_index, stab


def _lookup(mapping: Mapping, key: Column) -> Column:
    """A fixed dimension as a literal map: no join, no broadcast."""
    items = [x for k, v in mapping.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*items), key)


def impact_rank(col: Column) -> Column:
    return ordinal_rank(col, fv.IMPACT_LEVELS)


def urgency_rank(col: Column) -> Column:
    return ordinal_rank(col, fv.URGENCY_LEVELS)


# ------------------------------------------------------------------ context, table form
def change_index(changes: DataFrame) -> Index:
    """Approved changes by host, signal and every impact up to their bound."""
    approved = changes.where(F.col("status") == "approved").select(
        "host",
        "signal",
        F.explode(F.sequence(F.lit(1), impact_rank(F.col("max_impact")).cast("int"))).alias("impact_rank"),
        "start_ts", "end_ts", "change_order", "change_id",
    )
    return interval_index(approved, ["host", "signal", "impact_rank"], "start_ts", "end_ts", "change_order", "change_id")


def match_changes(cases: DataFrame, changes: DataFrame | Index) -> DataFrame:
    """Add `change_id`: the first approved change with this host and signal whose window holds the event
    (both ends inclusive) and whose bound is at least the assessed impact."""
    index = changes if isinstance(changes, Index) else change_index(changes)
    keys = {"host": F.col("host"), "signal": F.col("signal"), "impact_rank": impact_rank(F.col("impact")).cast("int")}
    return stab(cases, "ts", index, keys, "_change").withColumn("change_id", F.col("_change.w")).drop("_change")


_INCIDENT_FIELDS = ("incident_id", "event_type", "failure_mode", "impact", "urgency", "priority")
#: Stands for any failure mode in the index of incidents.
ANY_MODE = "any"
ONE_MODE = "one"


def incident_index(incidents: DataFrame) -> Index:
    """Open incidents by entity, each under its failure mode and under any."""
    packed = incidents.where(F.col("status") == "open").withColumn("incident", F.struct(*_INCIDENT_FIELDS))
    kinds = F.explode(F.array(F.struct(F.lit(ONE_MODE).alias("kind"), F.col("failure_mode").alias("mode")), F.struct(F.lit(ANY_MODE).alias("kind"), F.lit("").alias("mode"))))
    both = packed.withColumn("under", kinds).select("entity", "under.kind", "under.mode", "start_ts", "end_ts", "incident_order", "incident")
    return interval_index(both, ["entity", "kind", "mode"], "start_ts", "end_ts", "incident_order", "incident")


def match_incidents(cases: DataFrame, incidents: DataFrame | Index, entity_columns: Sequence[str] = ("host", "service")) -> DataFrame:
    """Add `incident`: the open incident on this host or service, same failure mode first, else the first.

    Each lookup meets at most one row of the index per event, by host and by service, with and without the
    failure mode. Name only the entity columns the cases have: each one is two lookups.
    """
    index = incidents if isinstance(incidents, Index) else incident_index(incidents)
    out = cases
    picks: dict[str, list[str]] = {ONE_MODE: [], ANY_MODE: []}
    for column in entity_columns:
        for kind, mode in ((ONE_MODE, F.col("signal")), (ANY_MODE, F.lit(""))):
            name = f"_{column}_{kind}"
            out = stab(out, "ts", index, {"entity": F.col(column), "kind": F.lit(kind), "mode": mode}, name)
            picks[kind].append(name)
    first = {kind: reduce(_earlier, [F.col(n) for n in names]) for kind, names in picks.items()}
    return out.withColumn("incident", F.coalesce(first[ONE_MODE], first[ANY_MODE])["w"]).drop(*picks[ONE_MODE], *picks[ANY_MODE])


def _earlier(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull() | (a["o"] <= b["o"]), a).otherwise(b)


# ------------------------------------------------------------------ context, nested form
def nested_change(event: str = "event", context: str = "context", impact: str = "impact") -> Column:
    """Id of the first matching change in `context.active_changes`, in array order."""
    ts = F.col(f"{event}.ts")
    rank = impact_rank(F.col(impact))

    def expected(s: Column) -> Column:
        return (s["signal"] == F.col(f"{event}.signal")) & (rank <= impact_rank(s["max_impact"]))

    def covers(c: Column) -> Column:
        return (
            (c["status"] == "approved")
            & F.array_contains(c["hosts"], F.col(f"{event}.host"))
            & (c["start"] <= ts)
            & (ts <= c["end"])
            & F.exists(c["expected_signals"], expected)
        )

    return F.get(F.filter(F.col(f"{context}.active_changes"), covers), F.lit(0))["id"]


def nested_incident(event: str = "event", context: str = "context") -> Column:
    """The open incident on the event's host or service, same failure mode first."""
    host, service = F.col(f"{event}.host"), F.col(f"{event}.service")
    open_here = F.filter(
        F.col(f"{context}.active_incidents"),
        lambda i: (i["status"] == "open") & ((i["entity"] == host) | F.coalesce(i["entity"] == service, F.lit(False))),
    )
    same = F.filter(open_here, lambda i: i["failure_mode"] == F.col(f"{event}.signal"))
    pick = F.coalesce(F.get(same, F.lit(0)), F.get(open_here, F.lit(0)))
    return F.when(
        pick.isNotNull(),
        F.struct(
            pick["id"].alias("incident_id"), pick["event_type"].alias("event_type"), pick["failure_mode"].alias("failure_mode"),
            pick["impact"].alias("impact"), pick["urgency"].alias("urgency"), pick["priority"].alias("priority"),
        ),
    )


def label_nested(cases: DataFrame) -> DataFrame:
    """Label rows holding event, context and evidence structs. Stateless, so it also runs on a stream."""
    held = set(cases.schema["evidence"].dataType.names)
    more = [f"evidence.{name}" for name in ("secondary_types", "secondary_owners") if name in held]
    ev = cases.select(
        "*",
        *more,
        nested_change(impact="evidence.impact").alias("change_id"),
        nested_incident().alias("incident"),
        F.col("event.signal").alias("signal"),
        F.col("event.ts").alias("ts"),
        F.col("event.host").alias("host"),
        "evidence.primary_type", "evidence.impact", "evidence.urgency", "evidence.actionable", "evidence.owner",
        "evidence.compromise_evidence", "evidence.provisional_reason", "evidence.immediate_action",
        "evidence.missing_context", "evidence.threatens_critical",
        F.col("context.asset.criticality").alias("criticality"),
    )
    return decide(ev)


# ------------------------------------------------------------------ evidence contract
def evidence_error(columns: set[str]) -> Column:
    """First broken evidence rule of a row, or NULL. Optional columns count as absent."""

    def opt(name: str, kind: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast(kind)

    def others(name: str) -> Column:
        return F.coalesce(opt(name, "array<string>"), F.array().cast("array<string>"))

    default_owner = _lookup(fv.DEFAULT_OWNER, F.col("primary_type"))
    owner = F.coalesce(opt("owner", "string"), default_owner)
    reason = opt("provisional_reason", "string")
    cell = _matrix(F.col("impact"), F.col("urgency"))
    missing = opt("missing_context", "array<string>")
    low_rank = impact_rank(F.col("impact")) < fv.IMPACT_LEVELS.index("moderate") + 1
    threatened = F.coalesce(opt("threatens_critical", "boolean"), F.lit(False))
    rules = (
        F.when(F.col("primary_type").isNull() | ~F.col("primary_type").isin(*fv.EVENT_TYPES), "unknown event type")
        .when(F.exists(others("secondary_types"), lambda t: F.coalesce(~t.isin(*fv.EVENT_TYPES), F.lit(True))), "unknown event type")
        .when(opt("owner", "string").isNotNull() & ~opt("owner", "string").isin(*fv.OWNER_COVERAGE), "unknown owner")
        .when(F.exists(others("secondary_owners"), lambda o: F.coalesce(~o.isin(*fv.OWNER_COVERAGE), F.lit(True))), "unknown owner")
        .when(impact_rank(F.col("impact")).isNull(), "impact not on its scale")
        .when(urgency_rank(F.col("urgency")).isNull(), "urgency not on its scale")
        .when(cell == "x", "impact and urgency are not a valid combination")
        .when(F.coalesce(F.trim("signal"), F.lit("")) == "", "signal is required")
        .when(owner.isNull() & (F.col("urgency") != "none"), "a response needs an owner")
        .when(reason.isNotNull() & ~reason.isin(*fv.PROVISIONAL_REASONS), "unknown provisional reason")
        .when(reason.isNotNull() & owner.isNull(), "a provisional case needs a triage owner")
    )
    if "missing_context" in columns:
        rules = rules.when((reason == "missing_context") & (F.coalesce(F.size(missing), F.lit(0)) < 1), "missing_context needs the missing facts")
    if "criticality" in columns:
        rules = rules.when(threatened & (F.col("criticality") == "high") & low_rank, "a threatened critical asset needs impact of at least moderate")
    return rules


def _matrix(impact: Column, urgency: Column) -> Column:
    cells = {f"{i}/{u}": p for i, row in fv.PRIORITY_MATRIX.items() for u, p in row.items()}
    return _lookup(cells, F.concat_ws("/", impact, urgency))


def _incident_error() -> Column:
    inc = F.col("incident")
    bad_level = impact_rank(F.coalesce(inc["impact"], F.lit("none"))).isNull() | urgency_rank(F.coalesce(inc["urgency"], F.lit("none"))).isNull()
    return F.when(
        F.col("incident_used"),
        F.when(bad_level, "incident level not on its scale").when(
            F.col("attaches") & ~F.coalesce(inc["priority"].isin(*fv.PRIORITIES), F.lit(False)), "incident needs a priority P1-P4 to attach to"
        ),
    )


# ------------------------------------------------------------------ decision
def decide(df: DataFrame) -> DataFrame:
    """Apply the rubric's decision order to rows that already carry `change_id` and `incident`.

    Rows that break the evidence contract keep their place, with `error` set and no label.
    """
    cols = set(df.columns)
    if "owner" not in cols:
        df = df.withColumn("owner", F.lit(None).cast("string"))

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in cols else F.array().cast("array<string>")

    df = df.withColumn("error", evidence_error(cols | {"owner"}))
    df = df.withColumn("owner", F.coalesce("owner", _lookup(fv.DEFAULT_OWNER, F.col("primary_type"))))
    df = df.withColumn("own_priority", _matrix(F.col("impact"), F.col("urgency")))
    rule = {f"{u}/{a}": n for u, row in fv.NOTIFICATION_RULE.items() for a, n in row.items()}
    act = F.when(F.coalesce(F.col("actionable"), F.lit(False)), "actionable").otherwise("not_actionable")
    df = df.withColumn("own_notification", _lookup(rule, F.concat_ws("/", F.col("urgency"), act)))

    compromised = F.coalesce(F.col("compromise_evidence"), F.lit(False))
    found = F.col("change_id").isNotNull()
    df = df.withColumn("explained", found & ~compromised)
    inc = F.col("incident")
    df = df.withColumn("incident_used", inc.isNotNull() & ~F.col("explained"))
    same_type = F.coalesce(inc["event_type"] == F.col("primary_type"), F.lit(False))
    same_mode = F.coalesce(inc["failure_mode"] == F.col("signal"), F.lit(False))
    not_worse = (impact_rank(F.col("impact")) <= impact_rank(F.coalesce(inc["impact"], F.lit("none")))) & (
        urgency_rank(F.col("urgency")) <= urgency_rank(F.coalesce(inc["urgency"], F.lit("none")))
    )
    df = df.withColumn("attaches", F.col("incident_used") & same_type & same_mode & F.coalesce(not_worse, F.lit(False)))
    df = df.withColumn("error", F.coalesce("error", _incident_error()))

    handling = F.when(F.col("explained"), "explained_by_change").when(F.col("attaches"), "attached_to_incident").otherwise("new")
    df = df.withColumn("handling", handling)
    df = df.withColumn("notification", F.when(F.col("handling") == "new", F.col("own_notification")).otherwise("none"))
    df = df.withColumn("priority", F.when(F.col("attaches"), inc["priority"]).otherwise(F.col("own_priority")))
    df = df.withColumn("page_now", F.col("notification") == "page_now")
    no_action = F.coalesce(F.trim("immediate_action"), F.lit("")) == ""
    df = df.withColumn("error", F.coalesce("error", F.when(F.col("page_now") & no_action, "a page needs the responder's immediate action")))

    always_on = _lookup(fv.OWNER_COVERAGE, F.col("owner")) == "24x7"
    target = F.when(F.col("page_now"), F.when(always_on, F.col("owner")).otherwise(_lookup(fv.VERIFIER_FOR, F.col("owner"))))
    df = df.withColumn("page_target", target)
    provisional = F.col("provisional_reason").isNotNull()
    response = (
        F.when(F.col("notification") == "scheduled_review", "scheduled")
        .when((F.col("notification") == "none") & (F.col("priority") == "P4"), "retained")
        .otherwise("respond")
    )
    df = df.withColumn("response", response)
    scheduled = (F.col("priority") == "P4") & (F.col("response") == "scheduled")
    ack = F.when(scheduled, fv.P4_SCHEDULED_CLOCK[0]).otherwise(_lookup({k: v[0] for k, v in fv.CLOCKS.items()}, F.col("priority")))
    fact = F.when(scheduled, fv.P4_SCHEDULED_CLOCK[1]).otherwise(_lookup({k: v[1] for k, v in fv.CLOCKS.items()}, F.col("priority")))
    rerouted = F.col("page_target").isNotNull() & (F.col("page_target") != F.col("owner"))

    why = F.when(~same_type, "another event type").when(~same_mode, "another failure mode").otherwise("worse impact or urgency")
    applied = F.array_compact(
        F.array(
            F.when(found & compromised, F.struct(F.lit("expected_activity_ignored").alias("rule"), F.concat(F.lit("signs of compromise outweigh "), F.col("change_id")).alias("reason"))),
            F.when(F.col("explained"), F.struct(F.lit("expected_activity").alias("rule"), F.concat(F.col("signal"), F.lit(" is allowed by "), F.col("change_id"), F.lit("; nobody is notified")).alias("reason"))),
            F.when(F.col("attaches"), F.struct(F.lit("related_incident").alias("rule"), F.concat(F.lit("joins "), inc["incident_id"], F.lit(" at its "), inc["priority"]).alias("reason"))),
            F.when(F.col("incident_used") & ~F.col("attaches"), F.struct(F.lit("related_incident_reassessed").alias("rule"), F.concat(inc["incident_id"], F.lit(": "), why).alias("reason"))),
            F.when(provisional, F.struct(F.lit("provisional").alias("rule"), F.col("provisional_reason").alias("reason"))),
            F.when(rerouted, F.struct(F.lit("page_routing").alias("rule"), F.concat(F.col("owner"), F.lit(" works business hours; "), F.col("page_target"), F.lit(" checks at any hour")).alias("reason"))),
        )
    )
    label = F.struct(
        F.col("primary_type").alias("event_type"),
        listed("secondary_types").alias("secondary_types"),
        "owner",
        listed("secondary_owners").alias("secondary_owners"),
        "impact", "urgency", "priority", "notification", "page_now", "page_target", "response",
        ack.alias("ack_target"),
        "handling",
        provisional.alias("provisional"),
        "provisional_reason",
        listed("missing_context").alias("missing_facts"),
        F.when(provisional, F.coalesce("page_target", "owner")).alias("triage_owner"),
        F.when(provisional, fact).alias("fact_finding_deadline"),
        F.when(rerouted, fv.OWNER_REVIEW_TARGET).alias("owner_review_target"),
        "immediate_action",
        applied.alias("applied_rules"),
        F.lit(fv.RUBRIC_VERSION).alias("rubric_version"),
    )
    out = df.withColumn("label", F.when(F.col("error").isNull(), label))
    return out.drop("own_priority", "own_notification", "explained", "incident_used", "attaches", "handling", "notification",
                    "priority", "page_now", "page_target", "response")


def label_tables(cases: DataFrame, changes: DataFrame | Index, incidents: DataFrame | Index, entity_columns: Sequence[str] = ("host", "service")) -> DataFrame:
    """Label cases, a table or a stream, against change and incident tables or the indexes of them."""
    return decide(match_incidents(match_changes(cases, changes), incidents, entity_columns))
