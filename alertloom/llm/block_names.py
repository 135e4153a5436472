"""Exact dedup by naming: equal texts get one integer name, different texts different ones.

Each text, lower-cased in A-Z, is cut into blocks of a fixed number of characters. Sorting the blocks gives
each different block an integer. Adjacent names are then paired and the pairs sorted and named in turn, until one name
is left for each text. Two texts are equal when they have the same number of blocks and the same last name. No digest
decides anything: digests only deal rows out to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.llm.common import free_name, lower_ascii
from alertloom.session import cut_lineage, release

BLOCK_CHARS = 1024
#: Values are ranked inside this many buckets; the bucket is the upper part of a name.
BUCKETS = 1 << 16
RANK_BITS = 40
#: The values with most rows, so many at most and each with over HEAVY_ROWS, are named apart. Any other value has at most
#: 1 / HEAVY_VALUES of all rows, or HEAVY_ROWS.
HEAVY_VALUES = 2000
HEAVY_ROWS = 1000


def name_values(rows: DataFrame, value: str, deal_by: Column, buckets: int = BUCKETS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`rows` with `value` replaced by `name`: a long, equal exactly where the values are equal.

    Values are sorted inside hash buckets and numbered there. `deal_by` must be equal for equal values. Values with
    very many rows would make one bucket large; they are counted first, their distinct values (a bounded number) are
    numbered apart, and their rows get the number without being moved.
    """
    rest = [c for c in rows.columns if c != value]
    dealt = rows.withColumn("_deal", deal_by)
    counts = dealt.groupBy("_deal").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") > heavy_rows).orderBy(F.desc("n"), "_deal").limit(HEAVY_VALUES)
    heavy = [r["_deal"] for r in most.collect()]
    bucket = F.pmod("_deal", F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(value))
    light = dealt.where(~F.col("_deal").isin(heavy)) if heavy else dealt
    light = light.withColumn("_bucket", bucket).withColumn("_rank", rank)
    out = light.select(*rest, F.shiftleft("_bucket", RANK_BITS).bitwiseOR(F.col("_rank").cast("long")).alias("name"))
    if not heavy:
        return out
    hot = dealt.where(F.col("_deal").isin(heavy))
    few = hot.select(value).distinct().select(value, (-F.row_number().over(Window.orderBy(value))).cast("long").alias("name"))
    return out.unionByName(hot.join(F.broadcast(few), value).select(*rest, "name"))


def text_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, heavy_rows: int = HEAVY_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """One row per different (id, text): id, `copy_hash`, `n_rows`, `n_blocks`, `name` and `text_sha256`.

    (n_blocks, name) is the identity of the text. A null text counts as empty, an empty text has one empty block. Rows
    that repeat both id and text are counted in `n_rows`. `copy_hash` only tells different texts under one id apart.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blocks = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), lower_ascii(raw).alias("norm"))
    base = base.select("id", F.xxhash64("norm").alias("copy_hash"), F.sha2("norm", 256).alias("sha"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(blocks).alias("blocks"))
    cut = base.select("id", "copy_hash", F.size("blocks").alias("n_blocks"), "sha", F.posexplode("blocks").alias("pos", "block"))
    cut = cut.select("id", "copy_hash", "n_blocks", "pos", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "block")
    named = cut_lineage(name_values(cut, "block", F.xxhash64("block"), buckets, heavy_rows))
    texts = named.groupBy("id", "copy_hash", "n_blocks").agg(F.count("sha").alias("n_rows"), F.max("sha").alias("text_sha256"))
    level = named.withColumn("width", F.col("n_blocks")).select("id", "copy_hash", "width", "pos", "name").distinct()
    done = level.where("width = 1").select("id", "copy_hash", "name")
    stages: list[DataFrame] = []
    while True:
        half = F.shiftright("pos", 1)
        pair = [F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(0)).alias(c) for k, c in ((0, "left"), (1, "right"))]
        pairs = level.where("width > 1").groupBy("id", "copy_hash", F.shiftright(F.col("width") + 1, 1).alias("width"), half.alias("pos")).agg(*pair)
        pairs = cut_lineage(pairs.select("id", "copy_hash", "width", "pos", F.struct("left", "right").alias("pair")))
        if stages:
            release(stages.pop())
        if pairs.isEmpty():
            release(pairs)
            break
        level = cut_lineage(name_values(pairs, "pair", F.xxhash64("pair"), buckets, heavy_rows))
        release(pairs)
        stages.append(level)
        done = done.unionByName(cut_lineage(level.where("width = 1").select("id", "copy_hash", "name")))
    same = texts["id"].eqNullSafe(done["id"]) & (texts["copy_hash"] == done["copy_hash"])
    return texts.join(done, same).select(texts["id"].alias(id_col), texts["copy_hash"], "n_rows", "n_blocks", "name", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: the id, `keep_id`, `group_size`, `kept`, `text_sha256`, `copy_hash`, `n_rows`.

    Of equal texts the row with the largest id stays; of rows that repeat id and text, one. Null ids come before all
    others. An empty table gives an empty result. Other columns are not read.
    """
    names = cut_lineage(text_names(docs, id_col, text_col, **options))
    groups = names.groupBy("n_blocks", "name").agg(F.max(id_col).alias("keep_id"), F.sum("n_rows").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    # Only texts with copies meet their group again; those of a very large group do so by broadcast.
    many = groups.where("_texts > 1")
    limit = max(HEAVY_ROWS, names.count() / HEAVY_VALUES)
    large = many.where(F.col("_texts") > limit).select("n_blocks", "name", "keep_id", "group_size")
    rest = many.where(F.col("_texts") <= limit).select("n_blocks", "name", "keep_id", "group_size")
    key = ["n_blocks", "name"]
    found = names.join(F.broadcast(large), key, "left").withColumnsRenamed({"keep_id": "k1", "group_size": "g1"})
    hot = found.where(F.col("g1").isNotNull()).select(*names.columns, F.col("k1").alias("keep_id"), F.col("g1").alias("group_size"))
    cool = found.where(F.col("g1").isNull()).select(*names.columns).join(rest, key, "left").select(
        *names.columns, F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "n_rows").alias("group_size")
    )
    each = hot.unionByName(cool).select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("_copy"))
    kept = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return each.select(id_col, "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "copy_hash", "n_rows")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns."""
    kept = cut_lineage(exact_groups(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_id"), F.col("copy_hash").alias("_hash"), "n_rows"))
    mark = free_name(docs, "copy_hash")
    keyed = docs.withColumn(mark, F.xxhash64(lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))

    def meet(those: DataFrame) -> DataFrame:
        return keyed.join(those, keyed[id_col].eqNullSafe(those["_id"]) & (keyed[mark] == those["_hash"]), "left_semi")

    stay = meet(kept)
    repeated = kept.where("n_rows > 1")
    if not repeated.isEmpty():  # rows equal in id and text: one of them stays
        stay = meet(kept.where("n_rows = 1")).unionByName(meet(repeated).dropDuplicates([id_col, mark]))
    return stay.drop(mark)
