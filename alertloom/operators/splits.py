"""Stratified and family-wise splits, pool draws and label budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.operators.ranking import hashed_position, order_hash, with_group_offsets


def _holdout(n: Column) -> Column:
    return F.floor(n * fv.HOLDOUT_FRACTION + 0.5)


def _is_spaced(index: Column, n: Column, k: Column, offset: float) -> Column:
    """Whether `index` is floor((j + offset) * n / k) for some j in [0, k)."""
    guess = F.floor(index * k / n)
    hit = F.lit(False)
    for step in (-1, 0, 1):
        j = guess + step
        hit = hit | ((j >= 0) & (j < k) & (F.floor((j + offset) * n / k) == index))
    return F.when(k > 0, hit).otherwise(False)


def stratified_split(df: DataFrame, strata: Sequence[str], row_id: str, seed: int = 42) -> DataFrame:
    """70/15/15 with val and test spread evenly over the rows sorted by stratum. Adds index and split.

    k = int(0.15 n + 0.5) rows each, so n / k is at least 4: test positions (offset 0.25) and val
    positions (0.75) are at least two apart and never meet. Each row decides its own split from its
    index, so no position list exists anywhere.
    """
    ranked = with_group_offsets(hashed_position(df, strata, row_id, seed), strata)
    n = F.col("total")
    k = _holdout(n)
    split = (
        F.when(_is_spaced(F.col("index"), n, k, 0.25), "test")
        .when(_is_spaced(F.col("index"), n, k, 0.75), "val")
        .otherwise("train")
    )
    return ranked.withColumn("new_split", split).drop("position", "group_size", "total")


def family_pool_split(families: DataFrame, pool: str, family: str, seed: int = 42) -> DataFrame:
    """Whole families to one split per pool; at least one family each in test and val.

    A pool too small to leave a train family is an error on its rows.
    """
    ranked = hashed_position(families.select(pool, family).distinct(), [pool], family, seed)
    held = F.greatest(F.lit(1), _holdout(F.col("group_size")))
    pos = F.col("position")
    small = F.col("group_size") <= 2 * held
    split = F.when(pos < held, "test").when(pos < 2 * held, "val").otherwise("train")
    return ranked.select(pool, family, F.when(small, F.raise_error(F.lit("pool too small to fill every split")).cast("string")).otherwise(split).alias("split"))


def draw_round_robin(items: DataFrame, pool: str, item_id: str, members: DataFrame, member: str, seed: int = 42) -> DataFrame:
    """Assign pool members to items in turn: item i of a pool takes member i mod n."""
    m = hashed_position(members.select(pool, member).distinct(), [pool], member, seed).select(
        pool, member, F.col("position").alias("slot"), F.col("group_size").alias("_n")
    )
    sizes = m.groupBy(pool).agg(F.max("_n").alias("_n"))
    placed = hashed_position(items, [pool], item_id, seed).drop("group_size").join(sizes, pool)
    placed = placed.withColumn("slot", F.col("position") % F.col("_n")).drop("_n")
    return placed.join(m.drop("_n"), [pool, "slot"])


def pin_splits(cases: DataFrame, pair_splits: DataFrame, pins: dict[str, str]) -> DataFrame:
    """Children take their pair's split; a pinned wrapper family outside its split is flagged."""
    items = [x for k, v in pins.items() for x in (F.lit(k), F.lit(v))]
    pinned = F.try_element_at(F.create_map(*items), F.col("wrapper_family"))
    joined = cases.drop("split").join(pair_splits.select("pair_id", "split"), "pair_id", "left")
    return joined.withColumn("pinned_split", pinned).withColumn(
        "pin_broken", F.coalesce(F.col("pinned_split") != F.col("split"), F.lit(False))
    )


def grouped_shuffle(df: DataFrame, split: str, group: str, row_id: str, seed: int = 42) -> DataFrame:
    """Groups in seeded random order inside each split, members adjacent.

    A range sort on (split, hash of group, group, row id): the row id keeps a hot group divisible.
    """
    return df.withColumn("shuffle_key", order_hash(seed, group)).orderBy(split, "shuffle_key", group, row_id)


def label_budgets(df: DataFrame, row_id: str, budgets: Sequence[int] = (0, 25, 100, 350), seed: int = 42) -> DataFrame:
    """Nested training subsets: the first `budget` rows in seeded hash order, tagged per budget."""
    h = order_hash(seed, row_id)
    top = df.withColumn("_h", h).orderBy("_h", row_id).limit(max(budgets)).drop("_h")
    one = top.withColumn("_all", F.lit(0))
    ranked = hashed_position(one, ["_all"], row_id, seed).drop("_all", "group_size")
    return ranked.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("position < budget").drop("position")


def learning_curve(budgets: DataFrame, train: DataFrame, test: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], row_id: str, target: str) -> DataFrame:
    """Accuracy on `test` of models taught by nested subsets of `train`: budget, n_train, n_test, n_right, accuracy.

    `budgets` is that of `label_budgets`. `fit_predict` gets the rows of one budget and the test rows without `target`, and returns
    (row_id, predicted); a row it leaves out counts as wrong. There are as many calls as budgets; an empty budget has no model.
    """
    levels = sorted(r["budget"] for r in budgets.select("budget").distinct().collect())
    blind = test.drop(target)
    out = None
    for level in levels:
        own = train.join(budgets.where(F.col("budget") == level).select(row_id), row_id, "left_semi")
        predicted = fit_predict(own, blind).select(F.col(row_id), F.col("predicted"))
        right = (F.col("predicted") == F.col(target)) & F.col("predicted").isNotNull()
        score = test.join(predicted, row_id, "left").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(right).alias("n_right"))
        row = own.agg(F.count(F.lit(1)).alias("n_train")).withColumn("one", F.lit(1)).join(score.withColumn("one", F.lit(1)), "one").select(  # one row each
            F.lit(level).alias("budget"), "n_train", "n_test", "n_right", F.round(F.col("n_right") / F.col("n_test"), 6).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out
