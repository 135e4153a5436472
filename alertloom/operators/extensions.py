"""Further measures over answers: confusion, macro F1, ranking, risk-coverage, thresholds, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.stats import r6, ratio
from alertloom.operators.answers import answered, is_graded
from alertloom.operators.ordered_cells import in_cells


def confusion(answers: DataFrame) -> DataFrame:
    ok = answers.where(is_graded() & answered("et"))
    return ok.groupBy("candidate", F.col("gold_event_type").alias("gold"), F.col("et_value").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(conf: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, from the small confusion table."""
    sides = conf.select(
        "candidate", "n", (F.col("gold") == F.col("predicted")).alias("hit"),
        F.explode(F.array(F.struct(F.col("gold").alias("cls"), F.lit("g").alias("s")), F.struct(F.col("predicted").alias("cls"), F.lit("p").alias("s")))).alias("x"),
    ).select("candidate", "n", "hit", "x.*")
    c = sides.groupBy("candidate", "cls").agg(
        F.sum(F.when((F.col("s") == "g") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s") == "g", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    return c.select(
        "candidate", "cls", "support", r6(ratio(F.col("tp"), F.col("predicted"))).alias("precision"),
        r6(ratio(F.col("tp"), F.col("support"))).alias("recall"),
        r6(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    )


def macro_f1(conf: DataFrame) -> DataFrame:
    s = class_scores(conf).where("support > 0")
    return s.groupBy("candidate").agg(F.count(F.lit(1)).alias("classes"), r6(F.avg(F.coalesce("f1", F.lit(0.0)))).alias("macro_f1"))


def score_counts(answers: DataFrame) -> DataFrame:
    """(candidate, p, pos, neg): rows per distinct probability, the input of every threshold measure."""
    rows = answers.where(is_graded() & answered("pg") & F.col("pg_prob").isNotNull())
    return rows.groupBy("candidate", F.col("pg_prob").alias("p")).agg(
        F.count_if(F.col("gold_page_now")).alias("pos"), F.count_if(~F.col("gold_page_now")).alias("neg")
    )


def _cumulative(counts: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("candidate",), by: str = "p") -> DataFrame:
    """Running totals of `columns` over `by` descending (inclusive `_ge`, exclusive `_gt`) and grand totals.

    Probabilities fall into cells of bounded size that keep their order; totals run over cells and then inside
    one, so no candidate's distinct probabilities are ever sorted in a single task, however close they lie.
    """
    keys = list(keys)
    b = in_cells(counts, keys, by)
    per = b.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    above = W.partitionBy(*keys).orderBy(F.col("_cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offs = per.select(
        *keys, "_cell",
        *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}_off") for c in columns],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in columns],
    )
    inside = W.partitionBy(*keys, "_cell").orderBy(F.col(by).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    j = b.join(offs, [*keys, "_cell"])
    for c in columns:
        j = j.withColumn(f"{c}_ge", F.col(f"_{c}_off") + F.sum(c).over(inside)).withColumn(f"{c}_gt", F.col(f"{c}_ge") - F.col(c))
    return j.drop("_cell", *[f"_{c}_off" for c in columns])


def ranking(answers: DataFrame) -> DataFrame:
    """AUROC with ties at half, and average precision over distinct thresholds."""
    c = _cumulative(score_counts(answers), ["pos", "neg"])
    # a negative at p is beaten by every positive above it and tied with those at p
    wins = F.col("neg") * (F.col("pos_gt") + F.col("pos") / 2)
    gain = (F.col("pos") / F.col("pos_total")) * (F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge")))
    return c.groupBy("candidate").agg(
        F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"),
        r6(F.sum(wins) / (F.max("pos_total") * F.max("neg_total"))).alias("auroc"), r6(F.sum(gain)).alias("average_precision"),
    )


def risk_coverage(answers: DataFrame, coverages: Sequence[float] = (0.5, 0.8, 1.0)) -> DataFrame:
    """Accuracy when only the most confident share of calls is kept: the smallest confidence cut that
    reaches the coverage, ties kept together."""
    rows = answers.where(is_graded() & answered("pg") & F.col("pg_prob").isNotNull())
    right = (F.col("pg_value") == F.col("gold_page_now")).cast("int")
    counts = rows.groupBy("candidate", F.greatest(F.col("pg_prob"), 1 - F.col("pg_prob")).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))
    c = _cumulative(counts, ["n", "right"])
    opened = c.withColumn("coverage", F.explode(F.array(*[F.lit(float(x)) for x in coverages]))).where(F.col("n_ge") >= F.col("coverage") * F.col("n_total"))
    best = F.min_by(F.struct("n_ge", "right_ge", "p"), "n_ge")
    return opened.groupBy("candidate", "coverage").agg(best.alias("x")).select(
        "candidate", "coverage", F.col("x.n_ge").alias("kept"), r6(F.col("x.p")).alias("confidence_cut"), r6(F.col("x.right_ge") / F.col("x.n_ge")).alias("accuracy")
    )


def tune_threshold(val: DataFrame) -> DataFrame:
    """The validation threshold of most right answers, lowest on ties."""
    c = _cumulative(score_counts(val), ["pos", "neg"])
    right = F.col("pos_ge") + F.col("neg_total") - F.col("neg_ge")
    total = F.col("pos_total") + F.col("neg_total")
    scored = c.select("candidate", "p", right.alias("right"), total.alias("total"))
    best = F.max_by(F.struct("p", "right", "total"), F.struct(F.col("right"), -F.col("p")))
    return scored.groupBy("candidate").agg(best.alias("b")).select("candidate", F.col("b.p").alias("threshold"), r6(F.col("b.right") / F.col("b.total")).alias("val_accuracy"))


def apply_threshold(test: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = test.where(is_graded() & answered("pg") & F.col("pg_prob").isNotNull()).join(thresholds, "candidate")
    right = ((F.col("pg_prob") >= F.col("threshold")) == F.col("gold_page_now")).cast("int")
    return rows.groupBy("candidate", "threshold", "val_accuracy").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(right)).alias("test_accuracy"))


def decision_band(val: DataFrame, budget: float = 0.05) -> DataFrame:
    """Widest automatic bands whose error stays within the budget: allow below `low`, block at or above
    `high`, escalate between."""
    c = _cumulative(score_counts(val), ["pos", "neg"])
    block_err = F.col("neg_ge") / (F.col("pos_ge") + F.col("neg_ge"))
    missed, below = F.col("pos_total") - F.col("pos_ge"), F.col("pos_total") + F.col("neg_total") - F.col("pos_ge") - F.col("neg_ge")
    allow_err = F.when(below > 0, missed / below)
    return c.groupBy("candidate").agg(
        r6(F.min(F.when(block_err <= budget, F.col("p")))).alias("high"),
        r6(F.max(F.when(allow_err <= budget, F.col("p")))).alias("low"),
    )


def probability_losses(answers: DataFrame, floor: float = 1e-15) -> DataFrame:
    """Brier against the base-rate Brier, and log loss with floored zeros."""
    rows = answers.where(is_graded() & answered("pg") & F.col("pg_prob").isNotNull())
    y, p = F.col("gold_page_now").cast("int"), F.col("pg_prob")
    nll = -F.when(F.col("gold_page_now"), F.log(F.greatest(p, F.lit(floor)))).otherwise(F.log(F.greatest(1 - p, F.lit(floor))))
    g = rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(y).alias("rate"), F.avg(nll).alias("nll"))
    base = F.col("rate") * (1 - F.col("rate"))
    return g.select("candidate", "n", r6(F.col("brier")).alias("brier"), r6(base).alias("base_rate_brier"), r6(1 - F.col("brier") / base).alias("skill"), r6(F.col("nll")).alias("nll"))


def leave_one_source_out(rows: DataFrame, source: str = "source") -> DataFrame:
    """Accuracy on each held-out source against accuracy on all others, from one pass of counts.

    `rows`: candidate, source, right (0/1)."""
    per = rows.groupBy("candidate", source).agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("r"))
    whole = W.partitionBy("candidate")
    t = per.withColumn("tn", F.sum("n").over(whole)).withColumn("tr", F.sum("r").over(whole))
    held, rest = ratio(F.col("r"), F.col("n")), ratio(F.col("tr") - F.col("r"), F.col("tn") - F.col("n"))
    return t.select("candidate", F.col(source).alias("held_out"), "n", r6(held).alias("held_out_accuracy"), r6(rest).alias("other_accuracy"), r6(rest - held).alias("drop"))


def labeler_agreement(labels: DataFrame) -> DataFrame:
    """Raw agreement and Cohen's kappa of two labelers. `labels`: item, first, second.

    Rows reduce to (first, second) counts before anything else."""
    c = labels.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    total = W.partitionBy(F.lit(0))
    c = c.withColumn("t", F.sum("n").over(total)).withColumn("f", F.sum("n").over(W.partitionBy("first"))).withColumn("s", F.sum("n").over(W.partitionBy("second")))
    same = F.col("first") == F.col("second")
    # chance agreement needs the marginals of each shared value, whether or not a pair ever agreed on it
    firsts = c.groupBy(F.col("first").alias("v")).agg(F.max("f").alias("f"))
    seconds = c.groupBy(F.col("second").alias("v")).agg(F.max("s").alias("s"))
    chance = firsts.join(seconds, "v").agg(F.sum(F.col("f") * F.col("s")).alias("fs")).withColumn("one", F.lit(1))
    agg = c.agg(F.max("t").alias("n"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agreed")).withColumn("one", F.lit(1))
    j = agg.join(chance, "one")
    po, pe = F.col("agreed") / F.col("n"), F.coalesce("fs", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return j.select("n", "agreed", r6(po).alias("agreement"), r6((po - pe) / (1 - pe)).alias("kappa"))


def disagreements(labels: DataFrame) -> DataFrame:
    """Items for adjudication; they stay out of gold."""
    return labels.where(~F.col("first").eqNullSafe(F.col("second"))).select("item", "first", "second", F.lit("needs_adjudication").alias("label_status"))
