"""Calibration: Brier, ECE, reliability bins, temperature fitting, latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.stats import confidence_bin, r6, ratio, temperature_scale
from alertloom.operators.answers import answered, is_graded
from alertloom.operators.percentiles import exact_percentiles


def probability_rows(answers: DataFrame) -> DataFrame:
    """Graded, answered page calls: (candidate, p, y, eligible, source)."""
    return answers.where(is_graded() & answered("pg")).select(
        "candidate",
        F.col("pg_prob").alias("p"),
        F.col("gold_page_now").cast("int").alias("y"),
        (F.coalesce(F.col("pg_source").isin(*fv.CALIBRATABLE_SOURCES), F.lit(False)) & F.col("pg_prob").isNotNull()).alias("eligible"),
        F.coalesce(F.col("pg_source"), F.lit("none")).alias("source"),
    )


def brier(rows: DataFrame) -> DataFrame:
    e = rows.where("eligible")
    return e.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"))


def bin_counts(rows: DataFrame, bins: int) -> DataFrame:
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    return (
        rows.where("eligible")
        .groupBy("candidate", confidence_bin(F.col("p"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("conf_sum"), F.sum(right).alias("right_sum"))
    )


def reliability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Every bin, empty ones included."""
    counts = bin_counts(rows, bins)
    dims = rows.select("candidate").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = dims.join(counts, ["candidate", "bin"], "left").na.fill(0, ["n"])
    return full.select(
        "candidate",
        "bin",
        r6(F.col("bin") / bins).alias("low"),
        r6((F.col("bin") + 1) / bins).alias("high"),
        "n",
        r6(ratio(F.col("conf_sum"), F.col("n"))).alias("mean_confidence"),
        r6(ratio(F.col("right_sum"), F.col("n"))).alias("accuracy"),
    )


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("right_sum") / F.col("n") - F.col("conf_sum") / F.col("n")) * F.col("n")
    return bin_counts(rows, bins).groupBy("candidate").agg(F.sum("n").alias("n"), r6(F.sum(gap) / F.sum("n")).alias("ece"))


def ece_by_bins(rows: DataFrame, bin_choices: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """ECE under several bin counts in one pass over the probabilities."""
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    exploded = rows.where("eligible").withColumn("bins", F.explode(F.array(*[F.lit(b) for b in bin_choices])))
    bin_of = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)) * F.col("bins")), F.col("bins") - 1)
    per_bin = exploded.groupBy("candidate", "bins", bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("cs"), F.sum(right).alias("rs")
    )
    gap = F.abs(F.col("rs") / F.col("n") - F.col("cs") / F.col("n")) * F.col("n")
    return per_bin.groupBy("candidate", "bins").agg(r6(F.sum(gap) / F.sum("n")).alias("ece"))


def calibration_summary(answers: DataFrame, bins: int = 10) -> DataFrame:
    """Pooled Brier and ECE per candidate over eligible probabilities, with the reason when absent.

    One pass reduces the rows to (candidate, source, bin); everything else sums that small table.
    """
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    small = (
        probability_rows(answers)
        .groupBy("candidate", "source", "eligible", F.when(F.col("eligible"), confidence_bin(F.col("p"), bins)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"),
            F.sum(conf).alias("cs"),
            F.sum(right).alias("rs"),
        )
    )
    per_bin = small.where("eligible").groupBy("candidate", "bin").agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("cs").alias("cs"), F.sum("rs").alias("rs")
    )
    scored = per_bin.groupBy("candidate").agg(
        F.sum("n").alias("n"),
        F.sum("sq").alias("sq"),
        F.sum(F.abs(F.col("rs") / F.col("n") - F.col("cs") / F.col("n")) * F.col("n")).alias("gap"),
    )
    sources = small.groupBy("candidate").agg(
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("probability_sources"),
        F.sum(F.when(~F.col("eligible"), F.col("n")).otherwise(0)).alias("n_ineligible"),
    )
    graded = answers.groupBy("candidate").agg(F.count_if(is_graded()).alias("n_graded"))
    out = graded.join(sources, "candidate", "left").join(scored, "candidate", "left").na.fill(0, ["n", "n_ineligible"])
    return out.select(
        "candidate",
        "n",
        "n_graded",
        "n_ineligible",
        F.coalesce("probability_sources", F.lit("")).alias("probability_sources"),
        r6(ratio(F.col("sq"), F.col("n"))).alias("brier"),
        r6(ratio(F.col("gap"), F.col("n"))).alias("ece"),
        F.when(F.col("n") == 0, "no probability comes from a model").alias("na_reason"),
        F.when((F.col("n") > 0) & (F.col("n") < fv.CALIBRATION_WARN_BELOW), "too few cases for a steady ECE").alias("warning"),
    )


def fit_temperature(val_answers: DataFrame) -> DataFrame:
    """Grid temperature of least Brier per candidate, first on ties, from validation rows only.

    Equal (p, y) rows are counted once before the 91-point grid is opened.
    """
    rows = val_answers.where(
        is_graded() & answered("pg") & (F.col("pg_source") == "model") & F.col("pg_prob").isNotNull()
    ).select("candidate", F.col("pg_prob").alias("p"), F.col("gold_page_now").cast("int").alias("y"))
    counted = rows.groupBy("candidate", "p", "y").agg(F.count(F.lit(1)).alias("c"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(fv.TEMPERATURE_GRID)]))
    opened = counted.select("candidate", "p", "y", "c", grid.alias("g")).select("candidate", "p", "y", "c", "g.*")
    loss = F.pow(temperature_scale(F.col("p"), F.col("t")) - F.col("y"), 2) * F.col("c")
    per_t = opened.groupBy("candidate", "i", "t").agg(F.sum(loss).alias("loss"), F.sum("c").alias("fit_n"))
    # losses that agree to 1e-12 are ties, so summation order cannot move the choice
    best = F.min_by(F.struct("t", "loss", "fit_n"), F.struct(F.round(F.col("loss") / F.col("fit_n"), 12), F.col("i")))
    return per_t.groupBy("candidate").agg(best.alias("b")).select(
        "candidate", r6(F.col("b.t")).alias("temperature"), F.col("b.fit_n").alias("fit_n"), r6(F.col("b.loss") / F.col("b.fit_n")).alias("brier")
    )


def calibrated_outcomes(outcomes: DataFrame, temperatures: DataFrame, arm: str = "calibrated") -> DataFrame:
    """The calibrated arm: page probabilities from the model rescaled, everything else unchanged.

    A candidate without a fitted temperature has no calibrated arm (inner join on a tiny table).
    """
    hit = (F.col("task") == "page_now") & (F.col("status") == "ok") & (F.col("probability_source") == "model")
    t = temperatures.select("candidate", F.col("temperature").alias("t"))
    joined = outcomes.join(t, "candidate")
    return (
        joined.withColumn("probability", F.when(hit, temperature_scale(F.col("probability"), F.col("t"))).otherwise(F.col("probability")))
        .withColumn("probability_source", F.when(hit, F.lit("model_temperature_scaled")).otherwise(F.col("probability_source")))
        .withColumn("candidate", F.concat(F.col("candidate"), F.lit("/" + arm)))
        .drop("t")
    )


def latency_summary(samples: DataFrame) -> DataFrame:
    """n, p50 and p95 per candidate, overall and per task. `samples`: candidate, task, latency_ms."""
    counted = samples.groupBy("candidate", "task", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    opened = counted.select(
        "candidate", F.explode(F.array(F.col("task"), F.lit("all"))).alias("scope"), "latency_ms", "c"
    )
    p = exact_percentiles(opened, ["candidate", "scope"], "latency_ms", [0.5, 0.95], weight="c")
    return p.select("candidate", "scope", "n", r6(F.col("p_0")).alias("p50_ms"), r6(F.col("p_1")).alias("p95_ms"))
