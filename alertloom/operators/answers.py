"""Outcome facts joined to cases: one wide row per (candidate, case)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom import fixed_values as fv

CASE_COLUMNS = (
    "case_id", "cohort", "split", "pair_id", "parent_case_id", "pair_relation",
    "gold_event_type", "gold_page_now", "gold_priority",
)


def is_graded() -> Column:
    return F.col("cohort").isin(*fv.GRADED_COHORTS) & F.col("gold_event_type").isNotNull()


def answered(prefix: str) -> Column:
    return F.col(f"{prefix}_status") == "ok"


def outcome_contract(outcomes: DataFrame) -> DataFrame:
    """Outcome rows whose status or task is not a declared one."""
    return outcomes.where(~F.col("status").isin(*fv.STATUSES) | ~F.col("task").isin(*fv.TASKS))


def missing_outcomes(cases: DataFrame, outcomes: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(candidate, case, task) triples without exactly one outcome, for the named candidates.

    Each case carries its expected keys, so the check is one equi-join on the key.
    """
    keys = [F.struct(F.lit(c).alias("candidate"), F.lit(t).alias("task")) for c in candidates for t in fv.TASKS]
    expected = cases.select("case_id", F.explode(F.array(*keys)).alias("k")).select("case_id", "k.*")
    seen = outcomes.groupBy("case_id", "candidate", "task").agg(F.count(F.lit(1)).alias("n"))
    return (
        expected.join(seen, ["case_id", "candidate", "task"], "left")
        .select("candidate", "case_id", "task", F.coalesce("n", F.lit(0)).alias("n_outcomes"))
        .where("n_outcomes <> 1")
    )


def build_answers(cases: DataFrame, outcomes: DataFrame, strict: bool = True, candidates: Sequence[str] | None = None) -> DataFrame:
    """Join on case_id and fold the three tasks into columns: one row per case and candidate.

    With `strict`, every case is expected to have exactly one outcome per task for every candidate; a gap or a repeat
    stops the job, it never becomes a NULL or a smaller denominator. `candidates` names those expected; without it they
    are the ones that occur in `outcomes`. The check is a filter over the folded rows, so no column pruning can take
    it out.
    """
    facts = outcomes.select(
        "case_id", "candidate", "task", "status", "value_type", "value_page", "value_priority",
        "probability", "probability_source", "raw_score",
    )
    if strict:
        names = sorted(candidates) if candidates is not None else sorted(r[0] for r in outcomes.select("candidate").distinct().collect())
        listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        expected = cases.select(*CASE_COLUMNS, F.explode(listed).alias("candidate"))
        joined = expected.join(facts, ["case_id", "candidate"], "left")
    else:
        joined = cases.select(*CASE_COLUMNS).join(facts, "case_id")

    def pick(task: str, col: str) -> Column:
        return F.max(F.when(F.col("task") == task, F.col(col)))

    wide = (
        joined.groupBy(*CASE_COLUMNS, "candidate")
        .agg(
            F.count("task").alias("n_outcomes"),
            F.count(F.when(F.col("task") == "event_type", 1)).alias("n_et"),
            F.count(F.when(F.col("task") == "page_now", 1)).alias("n_pg"),
            F.count(F.when(F.col("task") == "priority", 1)).alias("n_pr"),
            pick("event_type", "status").alias("et_status"),
            pick("event_type", "value_type").alias("et_value"),
            pick("page_now", "status").alias("pg_status"),
            pick("page_now", "value_page").alias("pg_value"),
            pick("page_now", "probability").alias("pg_prob"),
            pick("page_now", "probability_source").alias("pg_source"),
            pick("priority", "status").alias("pr_status"),
            pick("priority", "value_priority").alias("pr_value"),
            pick("priority", "raw_score").alias("pr_score"),
        )
    )
    if strict:
        whole = (F.col("n_et") == 1) & (F.col("n_pg") == 1) & (F.col("n_pr") == 1)
        gap = F.concat_ws(" ", F.lit("not exactly one outcome per task: candidate"), "candidate", F.lit("case"), F.col("case_id").cast("string"))
        wide = wide.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(gap).cast("boolean")))
    return wide.drop("n_outcomes", "n_et", "n_pg", "n_pr")


def gold_long(cases: DataFrame) -> DataFrame:
    """Gold per (case, task); NULL for an ungraded case."""
    return cases.select(
        "case_id",
        "cohort",
        F.expr(
            "stack(3, 'event_type', gold_event_type, 'page_now', cast(gold_page_now as string), "
            "'priority', gold_priority) as (task, gold)"
        ),
    )


def failed_calls(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """First errors per candidate in case, task order.

    `row_number() <= limit` is pruned per input partition before the shuffle, so a candidate that
    fails everywhere still sends only `limit` rows per task.
    """
    task_order = F.array_position(F.array(*[F.lit(t) for t in fv.TASKS]), F.col("task"))
    w = W.partitionBy("candidate").orderBy("case_id", task_order)
    return (
        outcomes.where(F.col("error").isNotNull())
        .select("candidate", "case_id", "task", "status", F.substring("error", 1, fv.ERROR_TEXT_CAP).alias("error"), F.row_number().over(w).alias("position"))
        .where(F.col("position") <= limit)
    )
