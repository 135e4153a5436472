"""Phrase collocations from weighted acyclic automata.

Each task builds automata of the n-grams of its shards of text, sorted, with their counts (phrase_automata). A bounded sample
of their paths gives bounds of about equal ranges; every shard is cut at them, and one task per range takes the union of what
the shards have of it, equal paths added up. The weight of a phrase is the sum over the range of paths that begin with it,
so a range gives all phrases within it, and parts of those that begin its first and last path, which are added up with
those of its neighbours. A candidate's weight, and those of its left and right parts, are then read from these weights.
Bounds are whole paths, so a word or pair that begins a third of all paths is spread over as many ranges as any others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.llm import phrase_automata as automata
from alertloom.llm import tokens
from alertloom.llm.common import cut_packed
from alertloom.session import cut_lineage, release

#: Longest phrase, least count of a candidate, and phrases that each language returns.
LONGEST = 3
LEAST = 10
TOP = 2000
#: A candidate goes if a longer one that holds it has so many hundredths of its count.
COVERED = 50
#: Text bytes of a shard, paths of a range, paths sampled from each shard, and in all; there are at most half as many ranges.
SHARD_BYTES = 4 << 20
RANGE_PATHS = 1_000_000
MARKS = 64
SAMPLED = 1 << 20
#: Ranges that one pass cuts into, paths gathered before they are added up, and candidates ranked in one task.
RANGES_AT_ONCE = 128
GATHERED = 2_000_000
RANKED = 100_000
FAN_IN = 16


def shards(docs: DataFrame, longest: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, words, paths, marks, packed): the automaton of each language in each shard of text; marks are evenly spaced paths."""
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    schema = T.StructType().add("lang", "string").add("words", "long").add("paths", "long").add("marks", T.ArrayType(T.BinaryType())).add("packed", "binary")

    def made(texts: list[pa.Array], langs: list[str]) -> pa.RecordBatch:
        found = automata.text_paths(pa.concat_arrays(texts), langs, longest)
        rows = []
        for lang, paths in found.items():
            step = max(1, -(-len(paths) // MARKS))
            marks = [b" ".join(paths.key(k)) for k in range(step // 2, len(paths), step)]
            rows.append((lang, int(paths.weights.sum()), len(paths), marks, automata.pack(paths)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            for chunk in tokens.chunks(batch, "text"):
                bytes_in = tokens.text_bytes(chunk.column("text"))[1][-1]
                if texts and size + bytes_in > SHARD_BYTES:
                    yield made(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(chunk.column("text").cast(pa.large_string()))
                langs += chunk.column("lang").to_pylist()
                size += int(bytes_in)
        if texts:
            yield made(texts, langs)
        tokens.give_back()

    return slim.mapInArrow(build, schema)


def range_bounds(stored: DataFrame, range_paths: int) -> list[tuple[str, list[bytes]]]:
    """Paths, in order, between which lie about `range_paths` paths each; at most half of SAMPLED."""
    total, most = stored.agg(F.sum("paths"), F.sum(F.size("marks"))).first()
    ranges = min(-(-(total or 0) // range_paths), SAMPLED // 2)
    if ranges < 2:
        return []
    marks = stored.select("lang", (F.col("paths") / F.size("marks")).alias("stands_for"), F.explode("marks").alias("mark"))
    if most > SAMPLED:
        marks = marks.orderBy(F.xxhash64("lang", "mark", "stands_for")).limit(SAMPLED)
    sample = sorted(((r["lang"].encode(), bytes(r["mark"]).split(b" "), r["stands_for"]) for r in marks.collect()), key=lambda x: x[:2])  # at most SAMPLED
    share, gone, out = sum(x[2] for x in sample) / ranges, 0.0, []
    for lang, mark, stands_for in sample:
        if gone >= share * (len(out) + 1) and (not out or out[-1] != (lang.decode(), mark)):
            out.append((lang.decode(), mark))
        gone += stands_for
    return out


def phrase_counts(stored: DataFrame, bounds: list[tuple[str, list[bytes]]], least: int) -> DataFrame:
    """(lang, phrase, size, f) of all phrases that occur `least` times or more, from the shards' automata.

    Shards are cut into RANGES_AT_ONCE wide ranges at most; what they have of one is united into runs of about GATHERED paths,
    and these are cut into narrower ranges, until a range is as wide as the bounds say. So neither the pieces of a shard nor
    those that meet in a task become more with the input, only the passes do, by its logarithm.
    """
    dealt = T.StructType().add("range", "integer").add("lang", "string").add("run", "integer").add("packed", "binary")
    starts = [(lang.encode(), mark) for lang, mark in bounds]
    total = stored.agg(F.sum("paths")).first()[0] or 0
    width = 1
    while (len(starts) + 1) / width > RANGES_AT_ONCE:
        width *= RANGES_AT_ONCE
    rows = stored.select(F.lit(0).alias("range"), "lang", "packed")
    used = []
    while True:
        each = rows.mapInArrow(_cutter(starts[width - 1 :: width], dealt, max(1, int(total * width / (len(starts) + 1) / GATHERED)) if width > 1 else 1), dealt)
        if width == 1:
            break
        rows = cut_packed(each.groupBy("range", "lang", "run").applyInArrow(_united, dealt))
        used.append(rows)
        width //= RANGES_AT_ONCE
    counted = T.StructType().add("lang", "string").add("phrase", "string").add("size", "integer").add("f", "long")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = automata.union(list(_runs(batches)))
        phrases, sizes, weights = automata.phrase_weights(paths, least)
        names = pa.array([key[1].as_py()] * len(phrases), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(weights, pa.int64())], names=counted.names)
        tokens.give_back()

    found = each.groupBy("range", "lang").applyInArrow(add, counted).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    out = cut_lineage(found.where(F.col("f") >= least))
    release(*used)
    return out


def _cutter(starts: list[tuple[bytes, list[bytes]]], dealt: T.StructType, runs: int):
    """Cuts automata at `starts`; each piece gets the number of its range and one of `runs` runs of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, packed in zip(batch.column("lang"), batch.column("packed"), strict=True):
                paths = automata.unpack(packed.as_py())
                name = lang.as_py().encode()
                low, high = bisect_left(starts, (name, [])), bisect_left(starts, (name + b"\x00", []))
                if high - low > 2 and len(paths):  # only bounds within what this one has
                    low, high = max(low, bisect_left(starts, (name, paths.key(0)))), min(high, bisect_left(starts, (name, paths.key(len(paths) - 1))) + 1)
                at = [0, *automata.cut_points(paths, [mark for _, mark in starts[low:high]]), len(paths)]
                rows = [(low + k, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
                for first in range(0, len(rows), 64):
                    some = rows[first : first + 64]
                    columns = [pa.array([r[0] for r in some], pa.int32()), pa.array([lang.as_py()] * len(some)), pa.array([zlib.crc32(packed.as_py()) % runs] * len(some), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([automata.pack(automata.part(paths, a, b)) for _, a, b in some], pa.binary())], names=dealt.names)
        tokens.give_back()

    return cut


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[automata.Paths]:
    """Unions of a group's automata, each of about GATHERED paths."""
    pending, size = [], 0
    for batch in batches:
        for packed in batch.column("packed"):
            pending.append(automata.unpack(packed.as_py()))
            size += len(pending[-1])
            if size > GATHERED:
                pending = [automata.union(pending)]
                if 2 * len(pending[0]) > GATHERED:  # little was equal
                    yield pending.pop()
                size = sum(map(len, pending))
    if pending:
        yield automata.union(pending)


def _united(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()]), pa.array([key[2].as_py()], pa.int32()), pa.array([automata.pack(run)], pa.binary())], names=["range", "lang", "run", "packed"])
    tokens.give_back()


def words_of(phrase: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(counts: DataFrame, totals: DataFrame, covered: int, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one covers, by their weakest cut.

    Every part of a candidate occurs as often as it at least, so all are among the counts.
    """
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", words_of(F.col("phrase"), F.lit(1), F.col("cut"))).withColumn("right", words_of(F.col("phrase"), F.col("cut") + 1, F.col("size")))
    left = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("lang").alias("_r"), F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, (cuts["lang"] == left["_l"]) & (cuts["left"] == left["left"])).select(*(cuts[c] for c in ("lang", "phrase", "a", "cut", "right")), "l")
    cuts = cuts.join(right, (cuts["lang"] == right["_r"]) & (cuts["right"] == right["right"])).select("lang", "phrase", "a", "cut", "l", "r")
    cuts = cuts.selectExpr("lang", "phrase", "a", "cut", "l", "r", "(cast(1000000 * cast(a AS decimal(16,0)) * a AS decimal(38,0)) div (cast(l AS decimal(19,0)) * r)) AS score")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("w"))
    inner = candidates.where("size > 2")
    for_each = [F.struct(words_of(F.col("phrase"), F.lit(at), F.lit(size)).alias("inner")) for size in range(2, longest) for at in range(1, longest - size + 2)]
    kept = weakest.select("lang", "phrase", "w.*")
    if for_each:
        parts = inner.select("lang", "a", "size", F.explode(F.array(*for_each)).alias("of"), "phrase").select("lang", F.col("of.inner").alias("inner"), F.col("a").alias("longer"), F.col("phrase").alias("whole"))
        # Runs past the end of a shorter phrase come out as fewer words, which its other runs cover, or as the phrase itself.
        most = parts.where("inner <> whole").groupBy("lang", "inner").agg(F.max("longer").alias("longer"))
        both = kept.join(most, (kept["lang"] == most["lang"]) & (kept["phrase"] == most["inner"]), "left").select(*(kept[c] for c in kept.columns), "longer")
        kept = both.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_of_each(rows: DataFrame, count: int, top: int) -> DataFrame:
    """The first `top` rows of each language, with their rank. Hash buckets of a language are ranked first, then FAN_IN of them together."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    buckets = -(-count // RANKED)
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(max(1, buckets))))
    while buckets > 1:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
        buckets = -(-buckets // FAN_IN)
        out = out.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("bucket")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, range_paths: int = RANGE_PATHS) -> DataFrame:
    """Each language's best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`; null and empty texts have no words. Repeated rows count as often as they occur. Equal scores and
    counts are ordered by the phrase, so ranks have no ties. Counts are exact; scores are worked out in 38 digits. Other columns are
    not read. Without candidates the result is empty.
    """
    stored = cut_packed(shards(docs, longest, lang_col, text_col))
    totals = stored.groupBy("lang").agg(F.sum("words").alias("n"))
    counts = phrase_counts(stored, range_bounds(stored, range_paths), least)
    found = cut_lineage(scored(counts, totals, covered, longest))
    release(stored, counts)
    return best_of_each(found, found.count(), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
