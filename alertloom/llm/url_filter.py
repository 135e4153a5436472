"""URL filters by a sorted array of digests.

The list of hosts and paths is dealt out by digest. Each task memory-maps its part as one sorted array of 64-bit xxhash
keys, looks up its share of the candidate keys by vectorised binary search, and compares the stored strings of hits, so
that a collision never counts. Candidates are the ends of a URL's host joined with the beginnings of its path, and each
different one is looked up once, however many pages it comes from.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.common import lower_ascii, url_host, url_path
from alertloom.session import cut_lineage

#: List entries in one task's array.
ENTRIES_PER_PART = 500_000

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A small default list: sites of these names under each public ending reserved for examples.
BLOCKED_SITES = ("casino-win", "cheap-pills", "free-bets", "adult-x", "spam-farm", "ads-track")
BLOCKED = tuple(f"{site}.example.{end}/" for site in BLOCKED_SITES for end in ("com", "net", "org"))


def entries(spark: SparkSession, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """(entry, verdict, is_rule): rules decide first, by length; the list of blocked places decides the rest."""
    rows = [(e, v, True) for e, v in rules] + [(e, "block", False) for e in blocked]
    return spark.createDataFrame(rows, "entry string, verdict string, is_rule boolean")


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every end of the host at a label, joined with every beginning of the path of a length that the list has."""
    labels = F.split(host, "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.array(*[F.lit(n) for n in path_lengths])
    starts = F.transform(F.filter(known, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s)))))


def search_sorted(digests: np.ndarray, strings: list[str], probe_digests: np.ndarray, probe_strings: list[str]) -> tuple[list[int], list[int]]:
    """(probe, entry) positions whose strings are equal: binary search on the mapped digests, then a look at the strings."""
    order = np.argsort(digests, kind="stable")
    found_probe: list[int] = []
    found_entry: list[int] = []
    if not len(digests) or not len(probe_digests):
        return found_probe, found_entry
    with tempfile.TemporaryFile() as file:
        digests[order].tofile(file)
        file.flush()
        keys = np.memmap(file, dtype=np.int64, mode="r", shape=len(digests))
        at = np.searchsorted(keys, probe_digests)
        left = np.arange(len(probe_digests))
        while len(left):  # as often as the longest run of equal digests
            left = left[(at[left] < len(keys))]
            left = left[keys[at[left]] == probe_digests[left]]
            for p in left.tolist():
                if strings[order[at[p]]] == probe_strings[p]:
                    found_probe.append(p)
                    found_entry.append(int(order[at[p]]))
            at[left] += 1
        del keys
    return found_probe, found_entry


def lookup(keys: DataFrame, listed: DataFrame, parts: int) -> DataFrame:
    """(key, verdict, is_rule) for each different key that the list holds, once per entry equal to it."""
    schema = T.StructType().add("key", "string").add("verdict", "string").add("is_rule", "boolean")
    dealt = lambda df, c: df.withColumn("digest", F.xxhash64(c)).withColumn("part", F.pmod(F.shiftright("digest", 20), F.lit(parts)).cast("int"))

    def probe(listed_part: pa.Table, keys_part: pa.Table) -> pa.Table:
        wanted = keys_part.column("key").to_pylist()
        p, e = search_sorted(listed_part.column("digest").to_numpy(), listed_part.column("entry").to_pylist(), keys_part.column("digest").to_numpy(), wanted)
        rows = listed_part.take(pa.array(e, pa.int64()))
        return pa.Table.from_arrays([pa.array([wanted[i] for i in p], pa.string()), rows.column("verdict"), rows.column("is_rule")], names=schema.names)

    left, right = dealt(listed, "entry"), dealt(keys.select("key").distinct(), "key")
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(probe, schema)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict.

    An entry is a host and the beginning of a path. It fits its host and all subdomains. Of the rules that fit, the longest
    decides, and of equal ones a block. Without a rule, a URL is blocked if any other entry fits, else allowed. A URL
    without `://`, or null, has empty host and path and is allowed. Repeated rows are judged alike. Other columns are not read.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    places = slim.where("host <> ''").distinct()
    tidy = listed.select(F.concat(lower_ascii(F.regexp_extract("entry", "(?s)^([^/]*)", 1)), F.regexp_extract("entry", "(?s)^[^/]*(.*)$", 1)).alias("entry"), "verdict", "is_rule").distinct()
    lengths = tidy.select((F.length("entry") - F.length(F.regexp_extract("entry", "(?s)^([^/]*)", 1))).alias("n")).groupBy("n").count()
    path_lengths = sorted(r["n"] for r in lengths.collect())  # at most the longest path in the list
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed.count() // ENTRIES_PER_PART))
    keys = places.select("host", "path", F.explode(candidate_keys(F.col("host"), F.col("path"), path_lengths)).alias("key"))
    hits = cut_lineage(lookup(keys, tidy, parts))
    met = keys.join(hits, "key")
    best = F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), (F.col("verdict") == "block").alias("block"), F.col("key").alias("key"), F.col("verdict").alias("verdict"))))
    judged = met.groupBy("host", "path").agg(best.alias("rule"), F.max((~F.col("is_rule")).cast("int")).alias("listed"))
    found = slim.join(judged, ["host", "path"], "left")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("listed") == 1, F.lit("block")), F.lit("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("rule.key").alias("rule"), verdict.alias("verdict"))
