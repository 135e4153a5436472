"""Connected components over shared pair and template family, with stable group ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.session import cut_lineage, release

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each from a larger node to a smaller, form stars: no node points at two, or at one that points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1)))).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is pointed at the least node of the neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are pointed at the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the graph `edges(u, v)`; the root is the least node.

    Alternating large and small stars: neighbourhoods are only ever reduced to their minimum, which
    combines map-side, and the minimum is joined back, so a hub is never gathered. Each round is
    written to a table in the shared folder, and the rounds end once that table is all stars.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    cur = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds = 0
    while not _settled(cur):
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        last, cur = cur, cut_lineage(_small_star(_large_star(cur)))
        release(last)
        rounds += 1
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _node(cases: DataFrame, name: str) -> Column:
    """Whole numbers as they are, which are compared and dealt faster; anything else as text."""
    return F.col(name) if isinstance(cases.schema[name].dataType, T.IntegralType) else F.col(name).cast("string")


def group_components(cases: DataFrame) -> DataFrame:
    """(pair_id, group_id): pairs connected through a shared template family share a group.

    The id is "G-" and ten hex digits of sha256, taken in three levels at every size: over the sorted pair ids that share
    the first four hex digits of their md5, over those digests by the first two digits, and over the digests of these. So
    no component has to fit one task, and a component that grows changes its id only because its pairs change.

    A family ties its pairs to the least of them, so only pairs go through the rounds. Rows without a pair count for nothing;
    a pair without a family is tied to none.
    """
    named = cases.select(_node(cases, "pair_id").alias("pair"), _node(cases, "template_family").alias("family"))
    links = cut_lineage(named.where("pair IS NOT NULL").distinct())
    least = links.where("family IS NOT NULL").groupBy("family").agg(F.min("pair").alias("v"))
    alone = links.where("family IS NULL").select(F.col("pair").alias("u"), F.col("pair").alias("v"))
    edges = cut_lineage(links.join(least, "family").select(F.col("pair").alias("u"), "v").unionByName(alone))
    pairs = cut_lineage(component_roots(edges).select(F.col("node").cast("string").alias("pair_id"), "root"))
    release(links, edges)

    def digest(col: str):
        return F.sha2(F.array_join(F.sort_array(F.collect_list(col)), "|"), 256)

    leaf = pairs.groupBy("root", F.substring(F.md5("pair_id"), 1, 4).alias("p")).agg(digest("pair_id").alias("d"))
    mid = leaf.groupBy("root", F.substring("p", 1, 2).alias("p")).agg(digest("d").alias("d"))
    top = mid.groupBy("root").agg(digest("d").alias("d"))
    ids = top.select("root", F.concat(F.lit("G-"), F.substring("d", 1, 10)).alias("group_id"))
    return pairs.join(ids, "root").select("pair_id", "group_id")


def case_groups(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Group id per case, falling back to the pair id."""
    return cases.withColumn("_p", F.col("pair_id").cast("string")).join(
        groups.select(F.col("pair_id").alias("_p"), "group_id"), "_p", "left"
    ).withColumn("cluster", F.coalesce("group_id", "_p")).drop("_p", "group_id")
