"""Nearest labeled example by BM25, exact, through blocks of texts that meet block by block.

Every query is scored against every labeled text, which is quadratic in time by nature; nothing else is:

* texts with the same bag of words are scored once, on both sides; on the labeled side only the first
  of the copies can win a tie, while word statistics still count every copy;
* texts are put in order by the strongest of their words that a good part of all texts has, so that those
  of one subject or language are neighbours, and packed into blocks of bounded size, a row each. The two tables of
  blocks are all that is written. Their pairs are read from there, never shuffled, so disk grows with the texts;
* a block is kept word by word, as bytes, so that it goes to Python as it is and two blocks meet without sorting;
* a pair of blocks meets in one step of a task, and only the best text of each query leaves it, if no block before it had a better
  one. Words that many texts of both sides have are a matrix product, in single precision where weights allow; all others go
  through their postings. Texts whose sum may be the best within the error of the product are summed again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.text import tokens
from alertloom.operators.scoring import to_outcomes
from alertloom.session import cut_lineage, release

DIGITS = 9
TASK_ROWS = 1_000_000  # query words per block, on average
SHARD_ROWS = 1_000_000  # postings per block, on average
BLOCK_TEXTS = 4_096  # most texts in a block
BLOCKS = 4  # blocks of a side per task, on average, where there are enough
ROWS = 512  # queries of a block in one matrix product
CELLS = 100_000  # sums of queries and texts kept at once, so that they stay in a core's cache
COMMON = 200  # a word orders its texts if one in so many of them has it, or more
DENSE = 500  # a word goes into the product if one in so many pairs of texts shares it, or more
MOST_DENSE = 2_048
GATHERED = 500_000  # postings looked up at once
EPS = 2.0**-23


def _bag(text: Column) -> Column:
    """A digest of the sorted words. Equal bags score equally against anything."""
    return F.sha2(F.array_join(F.sort_array(tokens(text)), " "), 256)


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf) with one row per distinct word of a text."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def representatives(train: DataFrame, row_id: str, text: str, order: str, target: str) -> DataFrame:
    """(rep, order, target, dl, copies): the first text of each bag of words."""
    rows = train.select(F.col(row_id).alias("rid"), F.col(text).alias("text"), F.col(order).alias("order"), F.col(target).alias("target"))
    bags = rows.select("rid", "order", "target", _bag(F.col("text")).alias("bag"), F.size(tokens(F.col("text"))).alias("dl"))
    reps = bags.groupBy("bag").agg(F.min(F.struct("order", "rid", "target", "dl")).alias("m"), F.count(F.lit(1)).alias("copies"))
    return cut_lineage(reps.select(F.col("m.rid").alias("rep"), F.col("m.order").alias("order"), F.col("m.target").alias("target"), F.col("m.dl").alias("dl"), "copies"))


def build_index(train: DataFrame, row_id: str, text: str, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, vocabulary) of the labeled texts.

    postings: tid, rep, order, w, df. vocabulary: token, tid, df. `tid` numbers the words; it is fixed by
    writing the vocabulary before anything uses it.
    """
    kept = train.select(F.col(row_id).alias("rep"), F.col(text).alias("text")).join(reps.select("rep"), "rep", "left_semi")
    words = cut_lineage(_words(kept, "rep", "text").join(reps.select("rep", "order", "copies", "dl"), "rep"))

    counted = words.groupBy("token").agg(F.sum("copies").alias("df"))
    numbered = cut_lineage(counted.withColumn("tid", F.monotonically_increasing_id()))
    corpus = reps.agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("dl")) / F.sum("copies")).alias("avgdl")).withColumn("one", F.lit(1))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # the corpus-wide numbers are one row each
    idf = numbered.withColumn("one", F.lit(1)).join(F.broadcast(corpus), "one").withColumn("idf", raw)
    mean = idf.agg(F.avg("idf").alias("mean_idf")).withColumn("one", F.lit(1))
    idf = idf.join(F.broadcast(mean), "one").select(
        "token", "tid", "df", "avgdl", F.when(F.col("idf") < 0, fv.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf")
    )
    k1, b = fv.BM25_K1, fv.BM25_B
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    postings = cut_lineage(words.join(idf, "token").select("tid", "rep", "order", (F.col("idf") * part).alias("w"), "df"))
    release(words)
    return postings, numbered


BLOCK = "part int, texts int, names binary, starts binary, rows binary, weights binary"
#: What the bytes of a block are.
TYPES = {"names": np.int64, "starts": np.int32, "rows": np.int32, "weights": np.float64}


def _turned(starts: np.ndarray, names: np.ndarray, at: np.ndarray, weights: np.ndarray) -> dict:
    """A block word by word, from one text by text, where the words of text number i are names[at[starts[i]:starts[i + 1]]].

    Word number k, names[k], is in the texts rows[starts[k]:starts[k + 1]], in order.
    """
    texts = len(starts) - 1
    row = np.repeat(np.arange(texts, dtype=np.int32), np.diff(starts))
    by_word = np.argsort(at, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(names)))])
    return {"texts": texts, "names": names, "starts": begins, "rows": row[by_word], "weights": weights[by_word]}


def _blocks(words: DataFrame, key: str, order: str, weight: str, n: int, size: int) -> DataFrame:
    """Rows of BLOCK, keys and orders of at most BLOCK_TEXTS texts and about `size` words, from words (key, order, tid, df, weight).

    `n` counts all labeled texts. A range of subjects goes into a block.
    """
    kind = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    subject = F.max(F.when(F.col("df") * COMMON >= n, F.struct(weight, "tid")))
    texts = cut_lineage(words.groupBy(key).agg(
        F.min(order).alias("_order"), F.coalesce(subject["tid"], F.lit(-1)).alias("subject"),
        F.collect_list("tid").alias("tids"), F.collect_list(F.col(weight).cast("double")).alias("ws"),
    ))
    sizes = texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.size("tids")), F.lit(0)).alias("words")).first()
    parts = max(1, math.ceil(sizes["words"] / size), math.ceil(sizes["texts"] / BLOCK_TEXTS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        texts = width = 0

        def packed_block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("_order").combine_chunks()
            tids, ws = rows["tids"].combine_chunks(), rows["ws"].combine_chunks()
            lengths = pc.list_value_length(tids).to_numpy()
            names, at = np.unique(tids.flatten().to_numpy(), return_inverse=True)
            block = _turned(np.concatenate([[0], np.cumsum(lengths)]), names, at, ws.flatten().to_numpy())
            values = (pa.array([part], pa.int32()), pa.array([block["texts"]], pa.int32()), *(pa.array([block[f].astype(t).tobytes()], pa.binary()) for f, t in TYPES.items()))
            lists = [rows["_key"].combine_chunks(), rows["_order"].combine_chunks()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([*values, *lists], names=["part", "texts", *TYPES, "keys", "orders"])

        for batch in batches:
            lengths = pc.list_value_length(batch["tids"]).to_numpy(zero_copy_only=False)
            first = 0
            for i, length in enumerate(lengths):
                if texts and (texts >= BLOCK_TEXTS or width + length > 2 * size):
                    held.append(batch.slice(first, i - first))
                    yield packed_block()
                    held, first, texts, width = [], i, 0, 0
                texts, width = texts + 1, width + length
            held.append(batch.slice(first))
        if texts:
            yield packed_block()

    sorted_texts = texts.repartitionByRange(parts, "subject", F.xxhash64(key)).select(F.col(key).alias("_key"), "_order", "tids", "ws")
    packed = cut_lineage(sorted_texts.mapInArrow(pack, f"{BLOCK}, keys array<{kind[key]}>, orders array<{kind[order]}>"))
    release(texts)
    return packed


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    """Blocks in so many tasks, an equal number in each."""
    return blocks.repartitionById(tasks, F.col("part") % tasks)


def _best_of(q: dict, d: dict) -> tuple[np.ndarray, np.ndarray]:
    """`_meet` of two blocks given text by text (see `_turned`)."""
    q, d = _turned(**q), _turned(**d)
    return _meet(q, d, np.zeros(q["texts"]))


def _meet(q: dict, d: dict, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, score) of the best text of block `d` for every query of block `q`, the first of equals; score 0 where no text scores
    more than 0 and as much as `floor`, which has a score for each query."""
    nq, nd = q["texts"], d["texts"]
    # the words of both sides: how many texts have each, and where its postings begin
    place = np.minimum(np.searchsorted(d["names"], q["names"]), len(d["names"]) - 1)
    known = np.flatnonzero(d["names"][place] == q["names"])
    (q_n, q_at), (d_n, d_at) = ((np.diff(x["starts"]).astype(np.int64)[k], x["starts"][k].astype(np.int64)) for x, k in ((q, known), (d, place[known])))
    shared = q_n * d_n.astype(np.float64)
    # the words of the product
    dense = shared * DENSE >= float(nq) * nd
    if dense.sum() > MOST_DENSE:
        dense = np.zeros(len(known), bool)
        dense[np.argsort(-shared, kind="stable")[:MOST_DENSE]] = True
    wide, rare = np.flatnonzero(dense), np.flatnonzero(~dense)
    c = len(wide)
    sides = []
    for x, n, at in ((q, q_n[wide], q_at[wide]), (d, d_n[wide], d_at[wide])):
        pos = _ranges(at, n)
        sides.append((np.repeat(np.arange(c), n), x["rows"][pos], x["weights"][pos], x["texts"]))
    single = np.float32 if all(x["weights"].min(initial=0) >= 0 for x in (q, d)) else np.float64
    q_side, d_side = (_matrix(column, row, weight, c, n, single) for column, row, weight, n in sides)
    # the postings of all other words, query by query
    pos = _ranges(q_at[rare], q_n[rare])
    row = q["rows"][pos]
    by_row = np.argsort(row.astype(np.min_scalar_type(nq)), kind="stable")
    row, q_weight, word = row[by_row], q["weights"][pos][by_row], np.repeat(rare, q_n[rare])[by_row]
    length, at = d_n[word], d_at[word]
    bounds = np.searchsorted(row, np.arange(nq + 1))
    space = np.empty((ROWS, nd), single)
    found = []
    # a product for many queries, then a few of them at a time
    for start in range(0, nq, ROWS):
        end = min(start + ROWS, nq)
        product = np.matmul(q_side[:, start:end].T, d_side, out=space[: end - start])
        for first in range(start, end, max(1, CELLS // nd)):
            m = min(max(1, CELLS // nd), end - first)
            span = slice(bounds[first], bounds[first + m])
            rest = _sums(row[span] - first, q_weight[span], length[span], at[span], d, m)
            near = product[first - start : first - start + m]
            np.add(near, rest, out=near, casting="same_kind")
            # a sum of c terms of one sign and the rest is off by c + 4 roundings at most
            most = near.max(axis=1).astype(np.float64)
            slack = (c + 4) * EPS * np.abs(most) if single is np.float32 else np.full(m, 1e-9) + 1e-12 * np.abs(most)
            # a text that shares nothing is never the best one
            bar = np.maximum(most - 2 * slack, floor[first : first + m] - slack) - 10.0**-DIGITS
            some = np.flatnonzero((most > 0) & (most >= bar))
            i, j = np.nonzero(near[some] >= bar[some, None])  # compared in double precision
            found.append((some[i] + first, j, rest[some[i], j]))
    i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    # candidates once more in double precision, from the rows of the product that they need
    (q_rows, a), (d_rows, b) = (np.unique(x, return_inverse=True) for x in (i, j))
    q_full, d_full = (_rows(*side, c, rows) for side, rows in zip(sides, (q_rows, d_rows), strict=True))
    for s in range(0, len(i), ROWS):
        exact[s : s + ROWS] += np.einsum("ij,ij->i", q_full[a[s : s + ROWS]], d_full[b[s : s + ROWS]])
    exact = np.round(exact, DIGITS)
    top = np.full(nq, -np.inf)
    np.maximum.at(top, i, exact)
    won = (exact == top[i]) & (exact >= floor[i])
    # candidates stand in order of query and text, so the first of a query is the first of equals
    of, at = np.unique(i[won], return_index=True)
    best, score = np.zeros(nq, np.int64), np.zeros(nq)
    best[of], score[of] = j[won][at], top[of]
    return best, score


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions at[0], at[0] + 1 and so on, n[0] of them, then n[1] from at[1]."""
    return np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)


def _matrix(column: np.ndarray, row: np.ndarray, weight: np.ndarray, c: int, n: int, kind: type) -> np.ndarray:
    """(c, n) matrix of the weights of words (`column`) in texts (`row`)."""
    out = np.zeros(c * n, kind)
    out[column * n + row] = weight
    return out.reshape(c, n)


def _rows(column: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, c: int, wanted: np.ndarray) -> np.ndarray:
    """The weights of the texts `wanted`, of n texts, in double precision, a row for each text."""
    number = np.full(n, -1)
    number[wanted] = np.arange(len(wanted))
    into = number[row]
    kept = into >= 0
    return _matrix(into[kept], column[kept], weight[kept], len(wanted), c, np.float64)


def _sums(row: np.ndarray, weight: np.ndarray, length: np.ndarray, at: np.ndarray, d: dict, m: int) -> np.ndarray:
    """(m, texts of d) sums of m queries: a posting (row, weight) meets those of its word in `d`, `length` of them from `at`."""
    nd = d["texts"]
    upto = np.cumsum(length)
    total = np.zeros(m * nd)
    cuts = [0, *np.searchsorted(upto, np.arange(GATHERED, upto[-1], GATHERED)).tolist(), len(row)] if len(row) else []
    for lo, hi in pairwise(cuts):
        if lo == hi:
            continue
        n = length[lo:hi]
        # positions of all postings of these words, word after word
        pos = _ranges(at[lo:hi], n)
        cell = np.repeat(row[lo:hi] * np.int64(nd), n) + d["rows"][pos]
        sums = np.bincount(cell, np.repeat(weight[lo:hi], n) * d["weights"][pos], m * nd)
        total = total + sums if lo else sums
    return total.reshape(m, nd)


def _score(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(bag, rep, order, score): the best text of blocks of `index` for each query, where one scores; of the blocks that a task
    meets one after the other, those that are no better than one before are left out."""
    kind = {f.name: f.dataType for f in index.schema.fields}
    bag = queries.schema["keys"].dataType.elementType.simpleString()
    schema = f"bag {bag}, rep {kind['keys'].elementType.simpleString()}, `order` {kind['orders'].elementType.simpleString()}, score double"
    fields = ("texts", *TYPES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = None, np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = ({f: np.frombuffer(batch[f"{side}_{f}"][i].as_buffer(), t) for f, t in TYPES.items()} | {"texts": batch[f"{side}_texts"][i].as_py()} for side in "qd")
                keys = batch["q_keys"][i].values
                if asked is None or not keys.equals(asked):
                    asked, floor = keys, np.zeros(q["texts"])
                best, found = _meet(q, d, floor)
                floor = np.maximum(floor, found)
                hit = np.flatnonzero(found > 0)
                text = pa.array(best[hit])
                columns = [keys.take(pa.array(hit)), batch["d_keys"][i].values.take(text), batch["d_orders"][i].values.take(text), pa.array(found[hit])]
                yield pa.RecordBatch.from_arrays(columns, names=["bag", "rep", "order", "score"])

    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq, nd = queries.count(), index.count()
    left = _dealt(queries, max(1, min(nq, max(cores, math.ceil(nq / BLOCKS))))).select(*[F.col(f).alias(f"q_{f}") for f in (*fields, "keys")])
    right = _dealt(index, max(1, math.ceil(nd / BLOCKS))).select(*[F.col(f).alias(f"d_{f}") for f in (*fields, "keys", "orders")])
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(score, schema)


def _search(queries: DataFrame, query_id: str, query_text: str, train: DataFrame, row_id: str, text: str, reps: DataFrame) -> DataFrame:
    """(query_id, rep, score): the best labeled text, lowest order on ties."""
    postings, vocabulary = build_index(train, row_id, text, reps)
    n = reps.agg(F.sum("copies")).first()[0] or 0
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_text).alias("text"))
    digests = cut_lineage(q.select("qid", _bag(F.col("text")).alias("digest")))
    # a bag goes by the first query that has it
    first = digests.groupBy("digest").agg(F.min("qid").alias("bag"))
    bags = cut_lineage(digests.join(first, "digest").select("qid", "bag"))
    release(digests)
    index = _blocks(postings, "rep", "order", "w", n, SHARD_ROWS)
    release(postings)
    once = q.join(bags.where("qid = bag").select("qid"), "qid", "left_semi").withColumnRenamed("qid", "bag")
    words = _words(once, "bag", "text").withColumnRenamed("tf", "qtf")
    qwords = words.join(vocabulary, "token").select("bag", "tid", "qtf", "df", F.col("bag").alias("order"))
    asked = _blocks(qwords, "bag", "order", "qtf", n, TASK_ROWS)

    with one_row_at_a_time(queries.sparkSession):
        scored = _score(asked, index)
        best = scored.groupBy("bag").agg(F.max_by(F.struct("rep", "score"), F.struct(F.col("score"), -F.col("order"))).alias("b"))
        hit = cut_lineage(best.where(F.col("b.score") > 0).select("bag", F.col("b.rep").alias("rep"), F.col("b.score").alias("score")))
    release(asked, index, vocabulary)

    fallback = reps.agg(F.min_by("rep", "order").alias("first_rep")).withColumn("one", F.lit(1))
    out = bags.join(hit, "bag", "left").withColumn("one", F.lit(1)).join(F.broadcast(fallback), "one")
    return out.select(F.col("qid").alias(query_id), F.coalesce("rep", "first_rep").alias("rep"), F.coalesce("score", F.lit(0.0)).alias("score"))


@contextmanager
def one_row_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand Python one row in a batch, for rows that hold whole blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def nearest(queries: DataFrame, query_id: str, query_text: str, train: DataFrame, row_id: str, text: str, order: str, target: str) -> DataFrame:
    """(query_id, rep, score, target): the best labeled text, lowest order on ties. A query that scores
    nothing takes the first labeled text, as its score ties with every other at zero.

    One index serves one task kind; call it per kind.
    """
    reps = representatives(train, row_id, text, order, target)
    found = _search(queries, query_id, query_text, train, row_id, text, reps)
    return found.join(reps.select("rep", "target"), "rep").select(query_id, "rep", "score", "target")


def as_page_outcome(found: DataFrame, query_id: str) -> DataFrame:
    """The copied label as a page outcome: a hard 0/1, marked as not calibrated."""
    return found.select(
        F.col(query_id), F.col("target").cast("double").alias("probability"), F.lit("hard_label_uncalibrated").alias("probability_source")
    )


def _alike(rows: DataFrame, kinds: Sequence[str]) -> dict[str, int]:
    """A number for each kind. Kinds have the same number if they have the same rows (case_id, state), equally often."""
    counts = F.array(*[F.count_if(F.col("kind") == k) for k in kinds])
    seen = rows.groupBy("case_id", F.sha2("state", 256)).agg(counts.alias("n")).select("n")
    # a flag for each two of a few kinds, true where their counts are the same on every row
    pairs = [(i, j) for i in range(len(kinds)) for j in range(i)]
    flags = seen.agg(*[F.bool_and(F.col("n")[i] == F.col("n")[j]).alias(f"{i}_{j}") for i, j in pairs]).first() if pairs else {}
    number = list(range(len(kinds)))
    for i, j in pairs:
        if flags[f"{i}_{j}"]:
            number[i] = min(number[i], number[j])
    return dict(zip(kinds, number, strict=True))


def nearest_outcomes(calls: DataFrame, train: DataFrame, candidate: str = "lexical") -> DataFrame:
    """Outcome facts of the nearest example of each task kind, as a control that copies labels.

    `calls`: case_id, task, kind, state, options. `train`: case_id, kind, state, target (text), an order being that of case_id.
    Each kind has an index of its own examples only; kinds whose examples are the same texts, and asked about the same ones, are
    searched once. A kind without examples is `unsupported`; a choice that is not among the call's
    options breaks the contract. Probabilities are the copied label and marked as not calibrated.
    """
    kinds = sorted(r["kind"] for r in calls.select("kind").distinct().collect())  # three at most
    known = {r["kind"] for r in train.select("kind").distinct().collect()}
    both = [k for k in kinds if k in known]
    asked_alike, taught_alike = (_alike(rows, both) if len(both) > 1 else dict.fromkeys(both, 0) for rows in (calls, train))
    searched: dict[tuple[int, int], DataFrame] = {}
    out = None
    for kind in kinds:
        asked = calls.where(F.col("kind") == kind)
        head = asked.select(F.lit(candidate).alias("candidate"), "case_id", "task", "options")
        if kind in known:
            examples = train.where(F.col("kind") == kind)
            reps = representatives(examples, "case_id", "state", "case_id", "target")
            group = asked_alike[kind], taught_alike[kind]
            if group not in searched:
                searched[group] = _search(asked, "case_id", "state", examples, "case_id", "state", reps)
            j = head.join(searched[group].join(reps.select("rep", "target"), "rep").select("case_id", "target"), "case_id")
            raw = j.select(
                "candidate", "case_id", "task", "options", F.lit("ok").alias("status"), F.when(F.lit(kind == "choice"), F.col("target")).alias("choice"),
                F.lit(None).cast("map<string,double>").alias("choice_probs"), F.when(F.lit(kind == "score"), F.col("target").try_cast("double")).alias("score"),
                F.when(F.lit(kind == "noul"), F.col("target").try_cast("double")).alias("prob"), F.lit("hard_label_uncalibrated").alias("probability_source"), F.lit(None).cast("string").alias("error"),
            )
            part = to_outcomes(raw)
        else:
            part = head.select("candidate", "case_id", "task", F.lit("unsupported").alias("status"), F.lit("no examples of this kind").alias("error"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
