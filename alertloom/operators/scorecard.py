"""Gates, weighted score and verdict per candidate, from metric rows and attested inputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.stats import r6, ratio, wilson
from alertloom.operators.cohort_matrix import cohort_matrix
from alertloom.operators.costs import cost_weighted

OPERATIONAL = (
    "candidate string, offline_verified boolean, license_ok boolean, peak_memory_gb double, baseline_other_gb double, "
    "memory_pressure_normal boolean, swap_grew boolean, false_pages_per_1k double, latency_hardware_is_target boolean"
)


def schema_valid(outcomes: DataFrame) -> DataFrame:
    """(candidate, num, den) over attempted calls, and whether any task is unsupported."""
    ok = F.col("status") == "ok"
    attempted = F.col("status").isin("ok", "schema_failure", "exception")
    return outcomes.groupBy("candidate").agg(
        F.count_if(ok).alias("num"), F.count_if(attempted).alias("den"), F.bool_or(F.col("status") == "unsupported").alias("any_unsupported")
    )


def decide_min(num: Column, den: Column, threshold: float, rule: str = "wilson_bound") -> Column:
    """pass / fail / inconclusive / not_evaluated for a rate that must reach `threshold`."""
    if rule == "point":
        return F.when(den == 0, "not_evaluated").when(ratio(num, den) >= threshold, "pass").otherwise("fail")
    low, high = wilson(num, den)
    return F.when(den == 0, "not_evaluated").when(low >= threshold, "pass").when(high < threshold, "fail").otherwise("inconclusive")


def _attested(col: str) -> Column:
    return F.when(F.col(col).isNull(), "not_evaluated").when(F.col(col), "pass").otherwise("fail")


def memory_gate(gates: Mapping) -> tuple[Column, Column]:
    """(status, effective gate): min(cap, host - baseline - reserve)."""
    eff = F.least(F.lit(float(gates["peak_memory_gb_max"])), F.lit(float(gates["host_memory_gb"])) - F.col("baseline_other_gb") - float(gates["memory_reserve_gb"]))
    invalid = ~F.coalesce(F.col("memory_pressure_normal"), F.lit(False)) | F.coalesce(F.col("swap_grew"), F.lit(True))
    status = (
        F.when(F.col("peak_memory_gb").isNull() | F.col("baseline_other_gb").isNull() | invalid | (eff <= 0), "not_evaluated")
        .when(F.col("peak_memory_gb") <= eff, "pass")
        .otherwise("fail")
    )
    return status, eff


def gate_rows(
    answers: DataFrame, outcomes: DataFrame, latency: DataFrame, operational: DataFrame, hardware: str,
    gates: Mapping = fv.GATES, rule: str = "wilson_bound", matrix: DataFrame | None = None,
) -> DataFrame:
    """(candidate, gate, status, measured, threshold): one row per gate, all from per-candidate tables."""
    matrix = matrix if matrix is not None else cohort_matrix(answers)
    names = matrix.select("candidate").distinct()
    recall = (
        matrix.where((F.col("metric") == "must_page_recall_strict") & F.col("cohort").isin(*gates["must_page_gate_cohorts"]))
        .groupBy("candidate").agg(F.sum("num").alias("r_num"), F.sum("den").alias("r_den"))
    )
    kept = matrix.where((F.col("metric") == "spoof_escalation_kept_strict") & (F.col("cohort") == "B_prime")).select(
        "candidate", F.col("num").alias("k_num"), F.col("den").alias("k_den")
    )
    valid = schema_valid(outcomes).withColumnsRenamed({"num": "v_num", "den": "v_den"})
    lat = latency.where(F.col("scope") == "all").select("candidate", F.col("n").alias("l_n"), F.col("p95_ms").alias("l_p95"))
    d = names.join(recall, "candidate", "left").join(kept, "candidate", "left").join(valid, "candidate", "left").join(lat, "candidate", "left").join(operational, "candidate", "left")
    d = d.na.fill(0, ["r_num", "r_den", "k_num", "k_den", "v_num", "v_den", "l_n"])

    budget = gates["p95_ms_max"]
    on_target = bool(gates["target_hardware_substring"]) and gates["target_hardware_substring"] in hardware
    if budget is None or not on_target:
        p95 = F.lit("not_evaluated")
    else:
        p95 = (
            F.when((F.col("l_n") < gates["min_timing_samples"]) | ~F.coalesce(F.col("latency_hardware_is_target"), F.lit(True)), "not_evaluated")
            .when(F.col("l_p95") <= budget, "pass")
            .otherwise("fail")
        )
    fp_max = gates["false_pages_per_1k_max"]
    fp = F.lit("not_evaluated") if fp_max is None else (
        F.when(F.col("false_pages_per_1k").isNull(), "not_evaluated").when(F.col("false_pages_per_1k") <= fp_max, "pass").otherwise("fail")
    )
    mem, eff = memory_gate(gates)
    null = F.lit(None).cast("double")
    rows: list[tuple[str, Column, Column, Column]] = []
    if gates["runs_offline_on_target"]:
        rows.append(("runs_offline_on_target", _attested("offline_verified"), null, F.lit(1.0)))
    if gates["license_ok_for_intended_use"]:
        rows.append(("license_ok_for_intended_use", _attested("license_ok"), null, F.lit(1.0)))
    rows.append(("p95_ms_max", p95, F.col("l_p95"), F.lit(budget).cast("double")))
    rows.append(("peak_memory_gb", mem, F.col("peak_memory_gb"), eff))
    if gates["supports_all_three_tasks"]:
        rows.append(("supports_all_three_tasks", F.when(F.col("any_unsupported"), "fail").otherwise("pass"), null, F.lit(1.0)))
    for name, num, den, key in (
        ("schema_valid_rate_min", "v_num", "v_den", "schema_valid_rate_min"),
        ("must_page_recall_min", "r_num", "r_den", "must_page_recall_min"),
        ("spoof_escalation_kept_min", "k_num", "k_den", "spoof_escalation_kept_min"),
    ):
        rows.append((name, decide_min(F.col(num), F.col(den), gates[key], rule), ratio(F.col(num), F.col(den)), F.lit(float(gates[key]))))
    rows.append(("false_pages_per_1k_max", fp, F.col("false_pages_per_1k"), F.lit(fp_max).cast("double")))
    cells = [F.struct(F.lit(n).alias("gate"), s.alias("status"), r6(m).alias("measured"), r6(t).alias("threshold")) for n, s, m, t in rows]
    return d.select("candidate", F.explode(F.array(*cells)).alias("g")).select("candidate", "g.*")


def chat_gates(names: DataFrame, chat: DataFrame, module: Mapping = fv.CHAT_MODULE, rule: str = "wilson_bound", enabled: bool = True) -> DataFrame:
    """Gates of the chat module for every candidate of `names`, from (candidate, metric, num, den) rows.

    A candidate without a row for a metric is not evaluated; with the module off there are no gates.
    """
    limits = {"must_page_recall": module["must_page_recall_min"], "spoof_recall": module["spoof_recall_min"]}
    asked = names.select("candidate").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in limits])))
    limit = F.create_map(*[x for m, t in limits.items() for x in (F.lit(m), F.lit(float(t)))])
    j = asked.join(chat.select("candidate", "metric", "num", "den"), ["candidate", "metric"], "left")
    status = F.lit(None).cast("string")
    for m, t in limits.items():
        status = F.when(F.col("metric") == m, decide_min(F.coalesce("num", F.lit(0)), F.coalesce("den", F.lit(0)), t, rule)).otherwise(status)
    out = j.select("candidate", F.concat(F.lit("chat_"), "metric", F.lit("_min")).alias("gate"), status.alias("status"), r6(ratio(F.col("num"), F.col("den"))).alias("measured"), limit[F.col("metric")].alias("threshold"))
    return out if enabled else out.limit(0)


def components(answers: DataFrame, weights: Mapping[str, float] = fv.WEIGHTS, matrix: DataFrame | None = None) -> DataFrame:
    """(candidate, component, weight, score): score NULL where nothing measures it. Never renormalized."""
    matrix = matrix if matrix is not None else cohort_matrix(answers)
    cost = cost_weighted(answers).select("candidate", (1 - F.col("normalized_error")).alias("cost_score"))
    kept = matrix.where((F.col("metric") == "spoof_escalation_kept_strict") & (F.col("cohort") == "B_prime")).select("candidate", F.col("rate").alias("spoof_score"))
    known = {"cost_weighted_error": F.col("cost_score"), "spoof_robustness": F.col("spoof_score")}
    null = F.lit(None).cast("double")
    cells = [F.struct(F.lit(n).alias("component"), F.lit(w).alias("weight"), r6(known.get(n, null)).alias("score")) for n, w in weights.items()]
    return cost.join(kept, "candidate", "left").select("candidate", F.explode(F.array(*cells)).alias("c")).select("candidate", "c.*")


def verdicts(gates: DataFrame, parts: DataFrame, purpose: str = "measurement", min_coverage: float = fv.MIN_WEIGHT_COVERAGE) -> DataFrame:
    """recommended / not recommended / insufficient evidence, with counts that explain it."""
    g = gates.groupBy("candidate").agg(
        F.count_if(F.col("status") == "fail").alias("gates_failed"),
        F.count_if(F.col("status").isin("inconclusive", "not_evaluated")).alias("gates_open"),
    )
    scored = F.col("score").isNotNull()
    p = parts.groupBy("candidate").agg(
        F.sum(F.when(scored, F.col("weight")).otherwise(0.0)).alias("covered"), F.sum(F.col("weight") * F.col("score")).alias("weighted")
    )
    j = g.join(p, "candidate", "left").na.fill(0.0, ["covered"])
    short = F.col("covered") + 1e-12 < min_coverage
    verdict = (
        F.when(F.lit(purpose != "measurement"), "insufficient evidence")
        .when(F.col("gates_failed") > 0, "not recommended")
        .when((F.col("gates_open") > 0) | short, "insufficient evidence")
        .otherwise("recommended")
    )
    return j.select(
        "candidate", "gates_failed", "gates_open", r6(F.col("covered")).alias("weight_coverage"),
        r6(F.when(F.col("covered") > 0, F.col("weighted") / F.col("covered"))).alias("partial_score"), verdict.alias("verdict"),
    )


def v1_assess(cases: DataFrame, results: DataFrame) -> DataFrame:
    """First-generation summary of every candidate: one typed result per case.

    `cases`: id, pair_id, kind, target_choice, target_score, target_noul. `results`: candidate, id, status, choice,
    score, noul_prob, probability_source. A case without a result counts as not covered. Pairs count only when both
    members answered; a null pair is none.
    """
    from alertloom.functions.stats import confidence_bin

    names = [r["candidate"] for r in results.select("candidate").distinct().collect()]  # one row per candidate
    asked = cases.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in names]))) if names else cases.limit(0).withColumn("candidate", F.lit(""))
    j = asked.join(results, ["candidate", "id"], "left")
    ok = F.col("status") == "ok"
    kind = F.col("kind")
    right = (
        F.when(kind == "choice", F.col("choice") == F.col("target_choice"))
        .when(kind == "noul", (F.col("noul_prob") >= fv.PAGE_THRESHOLD) == F.col("target_noul"))
    )
    y = F.col("target_noul").cast("int")
    scored = F.coalesce(ok & (kind == "noul") & (F.col("probability_source") == "model"), F.lit(False))
    rows = j.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("right", right).withColumn("scored", scored)
    conf = F.greatest(F.col("noul_prob"), 1 - F.col("noul_prob"))
    head = rows.groupBy("candidate").agg(
        r6(F.avg(F.when(F.col("ok") & (kind == "choice"), F.col("right").cast("int")))).alias("choice_accuracy"),
        r6(F.avg(F.when(F.col("ok") & (kind == "score"), F.abs(F.col("score") - F.col("target_score"))))).alias("score_mae"),
        r6(F.avg(F.when(F.col("ok") & (kind == "noul"), F.col("right").cast("int")))).alias("noul_accuracy"),
        r6(F.avg(F.when(F.col("scored"), F.pow(F.col("noul_prob") - y, 2)))).alias("brier"),
        r6(F.avg((F.coalesce("status", F.lit("")) == "schema_failure").cast("int"))).alias("schema_failure_rate"),
        r6(F.avg((F.coalesce("status", F.lit("")) == "exception").cast("int"))).alias("exception_rate"),
        r6(F.avg(F.col("ok").cast("int"))).alias("coverage"),
    )
    bins = rows.where("scored").groupBy("candidate", confidence_bin(F.col("noul_prob"), 10).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("cs"), F.sum(F.col("right").cast("int")).alias("rs")
    )
    e = bins.groupBy("candidate").agg(r6(F.sum(F.abs(F.col("rs") - F.col("cs"))) / F.sum("n")).alias("ece"))
    pairs = (
        rows.where(F.col("ok") & (kind != "score") & F.col("pair_id").isNotNull()).groupBy("candidate", "pair_id")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and("right").alias("all_right")).where("n = 2")
        .groupBy("candidate").agg(r6(F.avg(F.col("all_right").cast("int"))).alias("pair_accuracy"))
    )
    return head.join(e, "candidate", "left").join(pairs, "candidate", "left")
