"""Near-duplicate groups: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Links are found by signature trees. Equal sets count as one. A set that is linked with another shares one of the few
shingles that come first in any fixed order (prefix filter); in the order from rare to frequent those are mostly shingles that
no other set has, so a set with enough such shingles has no link. The rest is put in neighbourhoods that no link leaves: the
connected groups over shared first shingles. Each is one tree; a very large one is cut by set size into trees that are
compared two by two. Shingles are 64-bit hashes; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from alertloom.llm import tokens
from alertloom.llm.shingles import mixed, shingle_sets
from alertloom.llm.signature_tree import OVER, UNDER, SignatureTree
from alertloom.operators.components import component_roots
from alertloom.session import cut_lineage, release

SHINGLE_WORDS = 5
#: Shingles are counted in this many hash buckets; the counts only order shingles from rare to frequent.
COUNT_BUCKETS = 1 << 20
COUNT_SLICE = 1 << 12
#: First shingles, and shingles in all, that one task sorts.
ENTRIES_PER_PART = 300_000
SHINGLES_PER_PART = 2_000_000
#: Bytes of a shingle's hash by which other sets with it are looked for; equal by chance only costs work.
SHORT_BYTES = 6
#: Bits of the filter that spares most texts the way to the join with the few wanted ids.
FILTER_BITS = 1 << 23
#: Sets in one tree. Larger neighbourhoods are cut.
TREE_SETS = 4096
#: Cuts of a large neighbourhood hold sizes within this ratio, so only neighbouring cuts can hold links.
SIZE_RATIO = 1.01 * OVER / UNDER


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _identity(found: np.ndarray) -> tuple[bytes, int]:
    """A 128-bit name of a set and a 64-bit number from it."""
    name = xxhash.xxh3_128_digest(found.tobytes())
    return name, int.from_bytes(name[:8], "little", signed=True)


def _batch(columns: list, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch of these columns, lists or arrays, in this schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of (id, n, name, node) per row of `docs`: the size and the names of its set."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("n", "integer").add("name", "binary").add("node", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), SHINGLE_WORDS)
                names = [_identity(s) for s in sets]
                yield _batch([part.column("id"), [len(s) for s in sets], [n for n, _ in names], [v for _, v in names]], arrow)
        tokens.give_back()

    return cut_lineage(_texts(docs, id_col, text_col).mapInArrow(run, schema))


def shared_counts(docs: DataFrame, shingles: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, shared): how many shingles of a set some other set has too; sets without any are left out."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, -(-shingles // SHINGLES_PER_PART), 1)
    dealt = T.StructType().add("part", "integer").add("short", "binary").add("nodes", "binary").add("at", "binary")
    packed = T.StructType().add("part", "integer").add("nodes", "binary").add("counts", "binary")
    counted = T.StructType().add("node", "long").add("shared", "long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                once = {_identity(s)[1]: s for s in shingle_sets(part.column("text"), SHINGLE_WORDS) if len(s)}
                if not once:
                    continue
                nodes = np.array(list(once), dtype=np.int64)
                found = np.concatenate(list(once.values()))
                owner = np.repeat(np.arange(len(once)), [len(s) for s in once.values()])
                place = ((found >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
                rows = []
                for p, i in _split(place):
                    used, local = np.unique(owner[i], return_inverse=True)
                    short = np.ascontiguousarray(mixed(found[i])).view(np.uint8).reshape(-1, 8)[:, :SHORT_BYTES]
                    rows.append((p, short.tobytes(), nodes[used].tobytes(), local.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes()))
                yield _batch(list(zip(*rows, strict=True)), to_arrow_schema(dealt))
        tokens.give_back()

    def count(group: pa.Table) -> pa.Table:
        tokens.give_back()  # of the group before
        tables = [np.frombuffer(x, np.int64) for x in group.column("nodes").to_pylist()]
        owners = [t[np.frombuffer(a, "<u2" if len(t) < 1 << 16 else "<u4")] for t, a in zip(tables, group.column("at").to_pylist(), strict=True)]
        flat = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(-1, SHORT_BYTES)
        wide = np.zeros((len(flat), 8), dtype=np.uint8)
        wide[:, :SHORT_BYTES] = flat
        short, node = wide.view("<u8").reshape(-1), np.concatenate(owners)
        order = np.lexsort((node, short))
        short, node = short[order], node[order]
        new = np.append(True, (short[1:] != short[:-1]) | (node[1:] != node[:-1]))
        short, node = short[new], node[new]
        with_next = short[1:] == short[:-1]
        several = np.append(with_next, False) | np.append(False, with_next)
        found, n = np.unique(node[several], return_counts=True)
        place = ((mixed(found.view(np.uint64)) >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
        rows = [(p, found[i].tobytes(), n[i].astype("<i8").tobytes()) for p, i in _split(place)]
        return pa.Table.from_batches([_batch([[r[k] for r in rows] for k in range(3)], to_arrow_schema(packed))])

    def add(group: pa.Table) -> pa.Table:
        nodes, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("nodes", "counts"))
        found, at = np.unique(nodes, return_inverse=True)
        return pa.Table.from_batches([_batch([found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)], to_arrow_schema(counted))])

    by_shingle = _texts(docs, id_col, text_col).mapInArrow(deal, dealt).groupBy("part").applyInArrow(count, packed)
    return by_shingle.groupBy("part").applyInArrow(add, counted)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions that go to each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(order))
    for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        yield int(part[order[begin]]), order[begin:end]


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the rows of `docs` whose id is in `ids`.

    A bitmap of a fixed size, made from the ids, lets most other texts be left out before the exact join.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.floor(bit / 32).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in words.toLocalIterator():  # at most FILTER_BITS / 32 rows
        bitmap[row["w"]] = row["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    slim = _texts(docs, id_col, text_col)
    marked = slim.withColumn("bit", bit)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(["id", "text"])

    return marked.mapInArrow(look, slim.schema).join(ids, "id", "left_semi")


def shingle_counts(texts: DataFrame) -> DataFrame:
    """(slice, counts): in how many of the (id, text) rows shingles of a bucket are."""
    schema = T.StructType().add("slice", "integer").add("counts", T.ArrayType(T.LongType(), False))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                if sets := shingle_sets(part.column("text"), SHINGLE_WORDS):
                    counts += np.bincount((np.concatenate(sets) % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS)
        filled = np.flatnonzero(counts.reshape(-1, COUNT_SLICE).any(axis=1))
        yield _batch([filled, list(counts.reshape(-1, COUNT_SLICE)[filled])], arrow)
        tokens.give_back()

    return texts.mapInArrow(run, schema)


def bucket_counts(slices: DataFrame) -> np.ndarray:
    """The counts of all buckets: a fixed number of integers, whatever the size of the corpus."""
    schema = T.StructType().add("slice", "integer").add("counts", T.ArrayType(T.LongType(), False))
    arrow = to_arrow_schema(schema)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in group.column("counts").to_pylist()], axis=0)
        return pa.Table.from_batches([_batch([[group.column("slice")[0].as_py()], [total]], arrow)])

    out = np.zeros(COUNT_BUCKETS, dtype=np.int64)
    for row in slices.groupBy("slice").applyInArrow(add, schema).toLocalIterator():
        out[row["slice"] * COUNT_SLICE : (row["slice"] + 1) * COUNT_SLICE] = row["counts"]
    return out


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, from rare to frequent, one of which every linked set has among its own first ones."""
    n = len(found)
    length = n - -(-UNDER * n // OVER) + 1
    rank = np.lexsort((found, counts[(found % np.uint64(COUNT_BUCKETS)).astype(np.int64)]))
    return found[rank[:length]]


def shared_first(texts: DataFrame, counts: np.ndarray, entries: int, rows: int) -> DataFrame:
    """Edges (u, v) between nodes that share a first shingle: each node and the least one with the same shingle.

    First shingles are dealt by hash. Those in frequent buckets are spread further by node; the least nodes of the
    spread parts meet again in a second step.
    """
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES_PER_PART))
    frequent = max(1000, rows // 100)
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    dealt = T.StructType().add("part", "integer").add("shingles", "binary").add("nodes", "binary")
    edge = T.StructType().add("u", "long").add("v", "long").add("spread", "boolean")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text"), SHINGLE_WORDS) if len(s)]
                heads = [prefix(s, table) for s in sets]
                if not heads:
                    continue
                shingles = np.concatenate(heads)
                nodes = np.repeat(np.array([_identity(s)[1] for s in sets], dtype=np.int64), [len(h) for h in heads])
                wide = table[(shingles % np.uint64(COUNT_BUCKETS)).astype(np.int64)] > frequent
                place = mixed(shingles) + np.where(wide, mixed(nodes.view(np.uint64)), np.uint64(0))
                place = ((place >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
                rows_out = [(p, shingles[i].tobytes(), nodes[i].tobytes()) for p, i in _split(place)]
                yield _batch(list(zip(*rows_out, strict=True)), to_arrow_schema(dealt))
        tokens.give_back()

    def meet(group: pa.Table) -> pa.Table:
        tokens.give_back()
        shingles = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()])
        nodes = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("nodes").to_pylist()])
        order = np.lexsort((nodes, shingles))
        shingles, nodes = shingles[order], nodes[order]
        new = np.append(True, shingles[1:] != shingles[:-1])
        least = nodes[new][np.cumsum(new) - 1]
        other = least != nodes
        edges = np.unique(np.stack([nodes[other], least[other]], axis=1), axis=0)
        wide = new & (shared.value[(shingles % np.uint64(COUNT_BUCKETS)).astype(np.int64)] > frequent)
        u = np.concatenate([edges[:, 0], shingles[wide].view(np.int64)])
        v = np.concatenate([edges[:, 1], nodes[wide]])
        return pa.Table.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) >= len(edges))], names=edge.names)

    found = cut_lineage(texts.mapInArrow(first, dealt).groupBy("part").applyInArrow(meet, edge))
    spread = found.where("spread").select(F.col("u").alias("shingle"), F.col("v").alias("node"))
    least = spread.groupBy("shingle").agg(F.min("node").alias("least"))
    joined = spread.join(least, "shingle").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return found.where("NOT spread").select("u", "v").unionByName(joined).distinct()


def tree_links(sets: DataFrame) -> DataFrame:
    """(id, root): for each set linked with another one in its tree, the least id of its group there.

    `sets` has tree, id, name, shingles. A tree gets each different set once.
    """
    schema = T.StructType([T.StructField(c, sets.schema["id"].dataType) for c in ("id", "root")])
    arrow = to_arrow_schema(schema)

    def link(group: pa.Table) -> pa.Table:
        once: dict[bytes, tuple[int, bytes]] = {}
        for i, name, found in zip(*(group.column(c).to_pylist() for c in ("id", "name", "shingles")), strict=True):
            once[name] = min(once.get(name, (i, found)), (i, found))
        ids = [i for i, _ in once.values()]
        groups = SignatureTree([np.frombuffer(s, np.uint64) for _, s in once.values()]).groups().tolist()
        root: dict[int, int] = {}
        for i, g in zip(ids, groups, strict=True):
            root[g] = min(root.get(g, i), i)
        rows = [(i, root[g]) for i, g in zip(ids, groups, strict=True) if root[g] != i]
        return pa.Table.from_batches([_batch([[r[k] for r in rows] for k in (0, 1)], arrow)])

    return sets.groupBy("tree").applyInArrow(link, schema)


def trees(members: DataFrame, tree_sets: int = TREE_SETS) -> DataFrame:
    """`members` (root, id, n, ...) with `tree`; those of a neighbourhood over `tree_sets` once for each tree they are in.

    A large neighbourhood is cut by set size in bands of ratio 1.25 and each band by hash into cuts of bounded size; there
    is a tree for every two cuts of the same or neighbouring bands.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_RATIO))).cast("int")
    banded = members.withColumn("band", band)
    per_band = banded.groupBy("root", "band").agg(F.count(F.lit(1)).alias("c"))
    per_root = per_band.groupBy("root").agg(F.sum("c").alias("all"))
    large = cut_lineage(per_root.where(F.col("all") > tree_sets).select("root"))
    if large.isEmpty():
        return members.withColumn("tree", F.col("root").cast("string"))
    small = members.join(large, "root", "left_anti").withColumn("tree", F.col("root").cast("string"))
    half = max(1, tree_sets // 2)
    cuts = per_band.join(large, "root", "left_semi").select("root", "band", F.ceil(F.col("c") / half).cast("int").alias("cuts"))
    widths = cuts.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "cuts"))).alias("widths"))  # one entry per size band
    spread = banded.join(widths, "root")
    own = F.pmod(F.xxhash64("name"), F.col("widths")[F.col("band")]).cast("int")
    spread = spread.withColumn("cut", own)
    n_of = lambda b: F.coalesce(F.try_element_at("widths", b), F.lit(0))

    def with_band(other, own_first: bool):
        lists = F.when(n_of(other) > 0, F.sequence(F.lit(0), n_of(other) - 1)).otherwise(F.array().cast("array<int>"))
        here, there = F.concat_ws("/", F.col("band"), F.col("cut")), lambda k: F.concat_ws("/", other, k)
        return F.transform(lists, lambda k: F.concat_ws("|", here, there(k)) if own_first else F.concat_ws("|", there(k), here))

    same = F.transform(F.sequence(F.lit(0), n_of(F.col("band")) - 1), lambda k: F.concat_ws("|", F.concat_ws("/", F.col("band"), F.least(k, F.col("cut"))), F.concat_ws("/", F.col("band"), F.greatest(k, F.col("cut")))))
    keys = F.concat(same, with_band(F.col("band") + 1, True), with_band(F.col("band") - 1, False))
    cut = spread.withColumn("tree", F.explode(F.transform(keys, lambda k: F.concat_ws("#", F.col("root"), k))))
    return small.unionByName(cut.select(*small.columns))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_sets: int = TREE_SETS) -> DataFrame:
    """One row per row of `docs`: id, `n_shingles`, `component_id` (the least id reachable by links, itself included).

    Null and blank texts have no shingles and are linked with nothing. Equal sets are linked. Rows with the same id
    are one document; those with a null id are linked with nothing and get a null component. Other columns are not read. An empty table gives an empty result.
    """
    described = describe(docs, id_col, text_col)
    named = described.where("n > 0 AND id IS NOT NULL")
    distinct = cut_lineage(named.groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("node").alias("node")))
    shingles = described.agg(F.sum("n")).first()[0] or 0
    first_ones = F.col("n") - F.ceil(F.lit(UNDER) * F.col("n") / OVER) + 1
    shared = shared_counts(docs, shingles, id_col, text_col)
    # a set all of whose first shingles are its own has no link
    open_sets = cut_lineage(distinct.join(shared, "node").where(F.col("n") - F.col("shared") < first_ones).select("name", "id", "n", "node"))
    few = cut_lineage(with_ids(docs, open_sets.select("id").distinct(), id_col, text_col))
    sums = open_sets.agg(F.count(F.lit(1)).alias("rows"), F.sum(first_ones).alias("entries")).first()
    edges = shared_first(few, bucket_counts(shingle_counts(few)), int(sums["entries"] or 0), int(sums["rows"]))
    areas = cut_lineage(component_roots(edges))
    members = cut_lineage(open_sets.join(areas, "node").select("root", "id", "n", "name"))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("name", "binary").add("shingles", "binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                found = shingle_sets(part.column("text"), SHINGLE_WORDS)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_identity(s)[0] for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=schema.names)
        tokens.give_back()

    full = few.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(sets, schema)
    placed = trees(members, tree_sets).join(full, ["id", "name"])
    links = cut_lineage(tree_links(placed.select("tree", "id", "name", "shingles")))
    roots = component_roots(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    heads = cut_lineage(distinct.select("name", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("name", F.coalesce("root", "id").alias("component")))
    rest = described.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = named.join(heads, "name").select("id", "n", "component").unionByName(rest)
    release(distinct, open_sets, few, members, areas)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is that of their component, and all rows linked with nothing."""
    found = similar_groups(docs, id_col, text_col)
    gone = cut_lineage(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
