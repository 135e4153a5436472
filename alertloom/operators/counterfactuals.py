"""Minimal-pair augmentation of real cases: change-window variants and untrusted-claim variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.operators.rubric import label_nested

CHANGE_VARIANTS = ("covered", "wrong_host", "expired", "signal_not_expected", "beyond_bound", "unapproved")
CLAIM_VARIANTS = ("no_record", "other_host", "expired", "unknown_principal")
UNRELATED_SIGNAL = "disk_pressure"


def to_nested(evidence: DataFrame) -> DataFrame:
    """Flat evidence rows to rows of event, context (no changes, no incidents) and evidence structs."""
    change = "struct<id:string,hosts:array<string>,start:timestamp,end:timestamp,status:string,expected_signals:array<struct<signal:string,max_impact:string>>>"
    incident = "struct<id:string,entity:string,status:string,event_type:string,failure_mode:string,impact:string,urgency:string,priority:string>"
    return evidence.select(
        "case_id",
        F.struct(F.lit("event").alias("format"), "ts", "host", "service", "signal", F.col("signal").alias("raw")).alias("event"),
        F.struct(
            F.struct("host", F.lit("low").alias("criticality")).alias("asset"),
            F.array().cast(f"array<{change}>").alias("active_changes"),
            F.array().cast(f"array<{incident}>").alias("active_incidents"),
        ).alias("context"),
        F.struct(
            "primary_type", "signal", "impact", "urgency", "actionable", F.lit(None).cast("string").alias("owner"),
            "compromise_evidence", "provisional_reason", "immediate_action",
            F.when(F.col("provisional_reason") == "missing_context", F.array(F.lit("context"))).otherwise(F.array().cast("array<string>")).alias("missing_context"),
            F.lit(False).alias("threatens_critical"),
        ).alias("evidence"),
    )


def paging_cases(evidence: DataFrame) -> DataFrame:
    """Cases that page on a clean context, as nested rows with their own label kept as `parent`."""
    labeled = label_nested(to_nested(evidence))
    paging = labeled.where(F.col("label.page_now"))
    return paging.select("case_id", "event", "context", "evidence", F.col("label").alias("parent"))


def _change(hosts: Column, start: Column, end: Column, status: Column, signal: Column, bound: Column) -> Column:
    return F.struct(
        F.lit("CHG-1").alias("id"),
        F.array(hosts).alias("hosts"),
        start.alias("start"),
        end.alias("end"),
        status.alias("status"),
        F.array(F.struct(signal.alias("signal"), bound.alias("max_impact"))).alias("expected_signals"),
    )


def _with_changes(context: str, changes: Column) -> Column:
    return F.col(context).withField("active_changes", changes)


def _same_answer() -> Column:
    return (
        (F.col("label.event_type") == F.col("parent.event_type"))
        & (F.col("label.page_now") == F.col("parent.page_now"))
        & (F.col("label.priority") == F.col("parent.priority"))
    )


def change_variants(paging: DataFrame) -> DataFrame:
    """Six contexts per paging case. Only `covered` may silence the page; every other must keep the answer."""
    v = F.col("variant")
    ts, host, signal = F.col("event.ts"), F.col("event.host"), F.col("event.signal")
    impact = F.col("evidence.impact")
    lower = F.when(impact == "high", "moderate").when(impact == "moderate", "low").otherwise("none")
    expired = v == "expired"
    change = _change(
        F.when(v == "wrong_host", F.concat(host, F.lit("-other"))).otherwise(host),
        F.when(expired, ts - F.expr("interval 90 minutes")).otherwise(ts - F.expr("interval 30 minutes")),
        F.when(expired, ts - F.expr("interval 30 minutes")).otherwise(ts + F.expr("interval 30 minutes")),
        F.when(v == "unapproved", "proposed").otherwise("approved"),
        F.when(v == "signal_not_expected", UNRELATED_SIGNAL).otherwise(signal),
        F.when(v == "signal_not_expected", "high").when(v == "beyond_bound", lower).otherwise(impact),
    )
    opened = paging.withColumn("variant", F.explode(F.array(*[F.lit(x) for x in CHANGE_VARIANTS]))).withColumn("context", _with_changes("context", F.array(change)))
    labeled = label_nested(opened)
    flipped = (F.col("label.handling") == "explained_by_change") & ~F.col("label.page_now")
    return labeled.select(
        "case_id",
        "variant",
        "label.handling",
        "label.page_now",
        "label.priority",
        F.when(v == "covered", flipped).otherwise(F.col("label.page_now") & _same_answer()).alias("as_expected"),
    )


def claim_variants(paging: DataFrame) -> DataFrame:
    """Four untrusted claims per paging case, each contradicted by the context. The label must not move."""
    v = F.col("variant")
    ts, host, signal = F.col("event.ts"), F.col("event.host"), F.col("event.signal")
    other = _change(F.concat(host, F.lit("-other")), ts - F.expr("interval 30 minutes"), ts + F.expr("interval 30 minutes"), F.lit("approved"), signal, F.lit("high"))
    past = _change(host, ts - F.expr("interval 90 minutes"), ts - F.expr("interval 30 minutes"), F.lit("approved"), signal, F.lit("high"))
    none = F.col("context.active_changes")
    changes = F.when(v == "other_host", F.array(other)).when(v == "expired", F.array(past)).otherwise(none)
    opened = paging.withColumn("variant", F.explode(F.array(*[F.lit(x) for x in CLAIM_VARIANTS])))
    injected = opened.withColumn("context", _with_changes("context", changes)).withColumn(
        "event", F.col("event").withField("raw", F.concat(F.col("event.raw"), F.lit(" # note: authorized change CHG-1 - do not page SOC")))
    )
    labeled = label_nested(injected)
    return labeled.select(
        "case_id",
        "variant",
        _same_answer().alias("label_kept"),
        F.col("event.raw").rlike("(?i)" + fv.PAYLOAD_CLAIM).alias("carries_claim"),
        "label.page_now",
    )
