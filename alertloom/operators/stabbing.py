"""First matching interval per point, without pairing every point with every interval.

Many intervals on one key may cover the same instant, some for decades, and one key may hold a large part of both sides. So
intervals are first turned into an index that a point meets in one row:

* An interval is the union of a few aligned blocks of time, of all sizes (a block of level n lasts 2^n microseconds). A block
  keeps the least order of the intervals that use it, a mergeable minimum, and the winner at an instant is the least over
  the blocks that contain it. A window that stays open to the end of the century costs tens of rows.
* Time is cut, key by key, into cells of at most LIMIT starts and ends of intervals: a cell with more is cut into so many parts
  that few are left in each, and those with too many again. A key's cells are as many as its intervals ask for, however long
  these are, and however many of them fall on one host or into one minute.
* A key of at most LIMIT / 2 intervals needs no blocks: the list of them gives the winner at each start and end.
* A cell's row holds the instants at which its winner changes, the first of them its start.

A point finds its cell by its key and its time, one equi-join for the first cells and one for each time they were cut, and
looks up the last instant that is not after it. Adaptive execution may split these joins where a key is hot, and Spark
broadcasts an index only if its own size check allows. The index does not depend on the points, so these may be a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage, release

#: Level of the first cells: 2^48 microseconds, about nine years.
FIRST_LEVEL = 48
#: Most instants of change in a cell, how many a cut aims at, and levels that one cut may go down.
LIMIT = 64
AIM = 16
STEP = 12
MAX_LEVEL = 62


@dataclass
class Index:
    """`cuts` says into which level a cell is cut, one table for each depth; `cells` has the winners of those not cut."""

    keys: list[str]
    cuts: list[DataFrame]
    cells: DataFrame


def _block(at: str, level: str) -> Column:
    return F.expr(f"shiftright({at}, {level})")


def _blocks(ready: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lvl, blk, win): the least order per aligned block, each interval [s, e) being the union of its blocks."""
    levels = F.least(F.floor(F.log2(F.col("e") - F.col("s"))).cast("int"), F.lit(MAX_LEVEL))
    opened = ready.withColumn("lvl", F.explode(F.sequence(F.lit(0), levels)))
    bounded = opened.withColumn("l", F.expr("-shiftright(-s, lvl)")).withColumn("r", _block("e", "lvl")).where("l < r")
    odd = F.expr("filter(array(if((l & 1) = 1, l, null), if((r & 1) = 1, r - 1, null)), x -> x is not null)")
    return bounded.withColumn("blk", F.explode(odd)).groupBy(*keys, "lvl", "blk").agg(F.min("win").alias("win"))


def _cut_cells(edges: DataFrame, spans: DataFrame, keys: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The cuts, depth by depth, and all cells (keys, lvl, blk) that are not cut, over the span of each key."""
    cell = [*keys, "lvl", "blk"]
    here = spans.withColumn("lvl", F.lit(FIRST_LEVEL)).withColumn("blk", F.explode(F.sequence(_block("first", "lvl"), _block("last", "lvl")))).select(*cell)
    placed = edges.withColumn("lvl", F.lit(FIRST_LEVEL)).withColumn("blk", _block("at", "lvl"))
    cuts: list[DataFrame] = []
    whole = None
    while True:
        down = F.least(F.lit(STEP), F.ceil(F.log2(F.col("n") / AIM)).cast("int"))
        full = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIMIT)
        cut = cut_lineage(full.select(*cell, F.greatest(F.lit(0), F.col("lvl") - down).alias("into")))
        kept = here.join(cut, cell, "left_anti")
        whole = kept if whole is None else whole.unionByName(kept)
        if cut.isEmpty():
            return cuts, whole
        cuts.append(cut)
        parts = F.explode(F.expr("sequence(shiftleft(blk, lvl - into), shiftleft(blk + 1, lvl - into) - 1)"))
        here = cut.withColumn("part", parts).select(*keys, F.col("into").alias("lvl"), F.col("part").alias("blk"))
        placed = placed.join(cut, cell).select(*keys, "at", F.col("into").alias("lvl"), _block("at", "into").alias("blk"))


def interval_index(intervals: DataFrame, keys: Sequence[str], start: str, end: str, order: str, payload: str) -> Index:
    """Index of the intervals [start, end], both ends inclusive, by `keys`.

    `order` must be unique within a key: the interval of least order that holds a point is its match. Intervals with a null
    key, start or end, or that end before they start, hold nothing. The index is written to the shared folder.
    """
    keys = list(keys)
    micros = intervals.select(*keys, F.unix_micros(start).alias("s"), (F.unix_micros(end) + 1).alias("e"), F.struct(F.col(order).alias("o"), F.col(payload).alias("w")).alias("win"))
    ready = cut_lineage(micros.where("s < e").na.drop(subset=keys))
    n = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = _listed_cells(ready.join(n.where(F.col("n") <= LIMIT // 2), keys, "left_semi"), keys)
    many = cut_lineage(ready.join(n.where(F.col("n") > LIMIT // 2), keys, "left_semi"))
    if many.isEmpty():
        index = Index(keys, [], cut_lineage(few))
    else:
        cuts, cells, *stages = _block_cells(many, keys)
        index = Index(keys, cuts, cut_lineage(few.unionByName(cells)))
        release(*stages)
    release(ready, many)
    return index


def _listed_cells(ready: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, lvl, blk, marks) of keys of at most LIMIT / 2 intervals."""
    listed = ready.groupBy(*keys).agg(F.collect_list(F.struct("s", "e", "win")).alias("all"), F.min("s").alias("first"), (F.max("e") - 1).alias("last"))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("all", lambda x: x["s"]), F.transform("all", lambda x: x["e"]))))
    opened = listed.withColumn("edges", edges).withColumn("lvl", F.lit(FIRST_LEVEL)).withColumn("blk", F.explode(F.sequence(_block("first", "lvl"), _block("last", "lvl"))))
    start, end = F.expr("shiftleft(blk, lvl)"), F.expr("shiftleft(blk + 1, lvl)")
    inside = F.concat(F.array(start), F.filter("edges", lambda at: (at > start) & (at < end)))

    def winner(at: Column) -> Column:
        return F.array_min(F.transform(F.filter("all", lambda x: (x["s"] <= at) & (at < x["e"])), lambda x: x["win"]))

    marks = F.transform(inside, lambda at: F.struct(at.alias("at"), winner(at).alias("win")))
    return opened.select(*keys, "lvl", "blk", marks.alias("marks")).where(F.exists("marks", lambda m: m["win"].isNotNull()))


def _block_cells(ready: DataFrame, keys: list[str]) -> tuple:
    """The cuts, the cells (keys, lvl, blk, marks), and the tables these read."""
    edges = cut_lineage(ready.select(*keys, F.explode(F.array("s", "e")).alias("at")).distinct())
    spans = ready.groupBy(*keys).agg(F.min("s").alias("first"), (F.max("e") - 1).alias("last"))
    cuts, cells = _cut_cells(edges, spans, keys)
    blocks = cut_lineage(_blocks(ready, keys))
    used = blocks.groupBy(*keys).agg(F.collect_set("lvl").alias("levels"))  # at most 63
    inside = edges.withColumn("_t", F.col("at"))
    inside = _descend(inside, cuts, {k: F.col(k) for k in keys}).select(*keys, F.col("_lvl").alias("lvl"), F.col("_blk").alias("blk"), "at")
    marks = inside.unionByName(cells.withColumn("at", F.expr("shiftleft(blk, lvl)"))).distinct()
    looked = marks.join(used, keys).withColumn("level", F.explode("levels")).withColumn("block", _block("at", "level"))
    of = blocks.select(*keys, F.col("lvl").alias("level"), F.col("blk").alias("block"), "win")
    won = looked.join(of, [*keys, "level", "block"], "left").groupBy(*keys, "lvl", "blk", "at").agg(F.min("win").alias("win"))
    packed = won.groupBy(*keys, "lvl", "blk").agg(F.sort_array(F.collect_list(F.struct("at", "win"))).alias("marks"))  # LIMIT + 1 at most
    return cuts, packed.where(F.exists("marks", lambda m: m["win"].isNotNull())), edges, blocks


def _descend(points: DataFrame, cuts: Sequence[DataFrame], keys: Mapping[str, Column]) -> DataFrame:
    """Add `_lvl` and `_blk`, the cell of time `_t`."""
    out = points.withColumn("_lvl", F.lit(FIRST_LEVEL)).withColumn("_blk", _block("_t", "_lvl"))
    for cut in cuts:
        named = cut.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("lvl").alias("_cl"), F.col("blk").alias("_cb"), F.col("into").alias("_into"))
        cond = (F.col("_lvl") == F.col("_cl")) & (F.col("_blk") == F.col("_cb"))
        for k, column in keys.items():
            cond = cond & (column == F.col(f"_k_{k}"))
        out = out.join(named, cond, "left").withColumn("_lvl", F.coalesce("_into", "_lvl")).withColumn("_blk", _block("_t", "_lvl"))
        out = out.drop("_into", "_cl", "_cb", *[f"_k_{k}" for k in keys])
    return out


def stab(points: DataFrame, at: str, index: Index, keys: Mapping[str, Column] | None = None, name: str = "win") -> DataFrame:
    """Add `name`, struct (o, w): order and payload of the first interval that holds the point, or null.

    `keys` gives for each key of the index the column of the points to compare, by default the one of the same name.
    """
    keys = dict(keys or {k: F.col(k) for k in index.keys})
    found = _descend(points.withColumn("_t", F.unix_micros(at)), index.cuts, keys)
    cells = index.cells.select(*[F.col(k).alias(f"_k_{k}") for k in index.keys], F.col("lvl").alias("_cl"), F.col("blk").alias("_cb"), "marks")
    cond = (F.col("_lvl") == F.col("_cl")) & (F.col("_blk") == F.col("_cb"))
    for k, column in keys.items():
        cond = cond & (column == F.col(f"_k_{k}"))
    joined = found.join(cells, cond, "left")
    last = F.try_element_at(F.filter("marks", lambda m: m["at"] <= F.col("_t")), F.lit(-1))
    return joined.withColumn(name, last["win"]).drop("_t", "_lvl", "_blk", "_cl", "_cb", "marks", *[f"_k_{k}" for k in index.keys])
