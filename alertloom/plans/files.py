"""Registered source and sink queries: data derived from the tables is written and read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertloom import fixtures as fx
from alertloom.operators import counterfactuals as cf
from alertloom.operators import lint as li
from alertloom.operators import rubric as rb
from alertloom.operators import templates as tp
from alertloom.operators import threads as th
from alertloom.plans.labeling import _LABEL, flat_label
from alertloom.plans.metrics import _matrix_sql, test_answers
from alertloom.plans.texts import whole_threads, extracted
from alertloom.session import cut_lineage, work_path
from alertloom.sources import fingerprint as fp
from alertloom.sources import readers as rd
from alertloom.sources import writers as wr

#: Files that one task writes, on average.
FILES_PER_TASK = 1000

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _stored_cases(spark, sf_dir):
    """Case rows in the stored layout, from events: event, context, evidence, label, expected."""
    gold = fx.cases(spark, sf_dir).select("case_id", "cohort", "split", "pair_id", "template_family", "gold_event_type", "gold_page_now", "gold_priority")
    iso = F.date_format("event.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    nested = cf.to_nested(fx.evidence(spark, sf_dir)).withColumn("event", F.col("event").withField("ts", iso))
    j = nested.join(gold, "case_id")
    graded = F.col("cohort") != "D"
    return j.select(
        F.col("case_id").cast("string").alias("case_id"), "cohort", "split", F.col("pair_id").cast("string").alias("pair_id"),
        F.col("template_family").cast("string").alias("template_family"), "event", "context", "evidence",
        F.array(F.lit("event_type"), F.lit("page_now"), F.lit("priority")).alias("questions"),
        F.when(graded, F.struct(F.col("gold_event_type").alias("choice"), F.col("gold_page_now").alias("noul"), F.col("gold_priority").alias("score"))).alias("expected"),
    )


def _written(spark, sf_dir) -> str:
    path = work_path(spark, "cases")
    wr.write_splits(_stored_cases(spark, sf_dir), path)
    return path


@query("s1_read_cases", fx.sql_with("cases") + "SELECT CAST(case_id AS VARCHAR) AS case_id, cohort, split, gold_event_type, gold_page_now, gold_priority FROM cases WHERE split IN ('val', 'test')")
def s1_read_cases(spark, sf_dir):
    c = rd.flatten_case(rd.read_cases(spark, _written(spark, sf_dir), ("val", "test")))
    return c.select("case_id", "cohort", "split", "gold_event_type", "gold_page_now", "gold_priority")


@query("s6_write_splits", fx.sql_with("cases") + "SELECT split, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id FROM cases GROUP BY 1")
def s6_write_splits(spark, sf_dir):
    c = rd.read_cases(spark, _written(spark, sf_dir), ("train", "val", "test"))
    i = F.col("case_id").cast("bigint")
    return c.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("first_id"), F.max(i).alias("last_id"))


@query("s6_split_order", fx.sql_with("cases") + "SELECT split, count(*) AS n, 0::BIGINT AS out_of_order, 0::BIGINT AS files_that_overlap FROM cases GROUP BY 1")
def s6_split_order(spark, sf_dir):
    """Rows as they stand in their files: none before its predecessor, and no file that reaches into the next."""
    path = _written(spark, sf_dir)
    lines = spark.read.text(path).select("split", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    key = F.struct(F.get_json_object("value", "$.cohort").alias("cohort"), F.get_json_object("value", "$.case_id").alias("case_id"))
    rows = cut_lineage(lines.select("split", "file", "block", "at", key.alias("key")))
    inside = rows.withColumn("before", F.lag("key").over(Window.partitionBy("split", "file", "block").orderBy("at")))
    files = inside.groupBy("split", "file", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key") < F.col("before")).alias("wrong"), F.min("key").alias("low"), F.max("key").alias("high"))
    nexts = files.withColumn("last", F.max("high").over(Window.partitionBy("split").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)))  # one row per file
    return nexts.groupBy("split").agg(F.sum("n").alias("n"), F.sum("wrong").alias("out_of_order"), F.count_if(F.col("low") < F.col("last")).alias("files_that_overlap"))


@query("v5_context_contract", "SELECT CAST(event_id AS VARCHAR) AS case_id, 'event is missing ts' AS error FROM events WHERE event_id % 59 = 0")
def v5_context_contract(spark, sf_dir):
    """Stored cases whose event time lost its offset."""
    broken = F.when(F.col("case_id").cast("bigint") % 59 == 0, F.regexp_replace("event.ts", "Z$", "")).otherwise(F.col("event.ts"))
    path = work_path(spark, "cases")
    wr.write_splits(_stored_cases(spark, sf_dir).withColumn("event", F.col("event").withField("ts", broken)), path)
    return rd.context_errors(rd.read_cases(spark, path, ("train", "val", "test")))


_BARE = _LABEL.replace("JOIN changes c", "JOIN (SELECT * FROM changes WHERE false) c").replace("JOIN incidents i ON i.entity", "JOIN (SELECT * FROM incidents WHERE false) i ON i.entity")


@query("l1_label_stored_cases", _BARE + " SELECT * REPLACE (CAST(case_id AS VARCHAR) AS case_id) FROM label")
def l1_label_stored_cases(spark, sf_dir):
    """The nested form of the rubric over the case files of all splits."""
    cases = rd.read_cases(spark, _written(spark, sf_dir), ("train", "val", "test"))
    return flat_label(rb.label_nested(cases))


@query(
    "s2_read_templates",
    fx.sql_with("logs") + "SELECT template_id, template, system FROM registry UNION ALL SELECT 'authored-' || item_id, text, 'authored' FROM benchmark",
)
def s2_read_templates(spark, sf_dir):
    """A mined registry written and read back, united with an authored table (also U3)."""
    path = work_path(spark, "registry")
    wr.write_registry(tp.registry(extracted(spark, sf_dir)), path)
    mined = rd.read_templates_jsonl(spark, path, required_source="src")
    authored = fx.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("authored-"), F.col("item_id").cast("string")).alias("template_id"), F.col("text").alias("template"), F.lit("authored").alias("system"), F.lit("authored").alias("source")
    )
    return rd.union_registries(mined.drop("_bad"), authored).select("template_id", "template", "system")


@query("s3_read_template_csv", "SELECT 'E' || item_id AS template_id, text AS template FROM benchmark")
def s3_read_template_csv(spark, sf_dir):
    path = work_path(spark, "csv")
    t = fx.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("E"), F.col("item_id").cast("string")).alias("EventId"), F.col("text").alias("EventTemplate"))
    t.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return rd.read_template_csv(spark, path)


@query("s4_read_log_lines", fx.sql_with("logs") + "SELECT kind <> 'none' AS parsed, count(*) AS n FROM shape GROUP BY 1")
def s4_read_log_lines(spark, sf_dir):
    path = work_path(spark, "logs")
    fx.log_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    lines = tp.syslog_lines(rd.read_log_lines(spark, path, "src"))
    return lines.groupBy(F.col("system").isNotNull().alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


def _thread_rows(spark, sf_dir):
    t = whole_threads(spark, sf_dir)
    iso = F.transform(
        "messages",
        lambda m: F.struct(F.date_format(m["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), m["role"].alias("role"), m["author"].alias("author"), m["text"].alias("text")),
    )
    dropped = F.when(F.col("conv_id") % 17 == 0, -1).otherwise(0)  # planted: counters that do not add up
    return t.select(
        F.concat(F.lit("thread-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("thread_id"), F.lit("channel-1").alias("channel"),
        F.when(F.col("conv_id") % 11 == 0, "hallway").otherwise("team_channel").alias("channel_kind"), F.lit("real_deidentified").alias("dataset_kind"),
        F.size("messages").alias("original_message_count"), dropped.alias("truncated_messages"), iso.alias("messages"),
    )


@query(
    "s5_read_threads",
    f"""WITH t AS (SELECT DISTINCT conv_id, 'thread-' || conv_id || '-' || (turn // {th.PART_TURNS})::INT AS thread_id FROM conversations)
SELECT thread_id, 'unknown channel_kind' AS error FROM t WHERE conv_id % 11 = 0
UNION ALL SELECT thread_id, 'kept and truncated messages do not add up to original_message_count' FROM t WHERE conv_id % 17 = 0
UNION ALL SELECT thread_id, 'a truncation counter is negative' FROM t WHERE conv_id % 17 = 0""",
)
def s5_read_threads(spark, sf_dir):
    path = work_path(spark, "threads")
    _thread_rows(spark, sf_dir).write.json(path)
    return rd.thread_errors(rd.read_threads(spark, path))


@query("u2_key_difference", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE '' END AS missing, CASE WHEN page_id % 3 = 0 THEN 'email' ELSE '' END AS unexpected
FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0""")
def u2_key_difference(spark, sf_dir):
    """Key sets of JSON objects built from pages, some without `html`, some with an undeclared `email`."""
    p = F.col("page_id")
    obj = F.to_json(F.struct("page_id", "url", F.when(p % 2 != 0, F.col("html")).alias("html"), F.when(p % 3 == 0, F.lit("a")).alias("email")))
    rows = fx.table(spark, sf_dir, "pages").select("page_id", F.json_object_keys(obj).alias("keys"))
    d = rd.key_difference(rows, "keys", ("page_id", "url", "html"))
    return d.select("page_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@query("u5_distinct_terms", "SELECT lower(role) AS term, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def u5_distinct_terms(spark, sf_dir):
    return rd.distinct_terms(fx.table(spark, sf_dir, "conversations").select(F.lower("role").alias("term")))[1]


def _digest_sql(columns, table, by=""):
    text = " || ".join(f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, 'n')" for c in columns)
    sums = ", ".join(f"sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT::HUGEINT)" for k in range(fp.LANES))
    group = f"{by}, " if by else ""
    return f"SELECT {group}count(*) AS rows, sha256(concat_ws(',', {sums})) AS digest FROM (SELECT {group}sha256({text}) AS d FROM {table})" + (f" GROUP BY {by}" if by else "")


_LINE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "round(l_quantity * 100)::BIGINT", "round(l_extendedprice * 100)::BIGINT", "round(l_discount * 100)::BIGINT",
    "round(l_tax * 100)::BIGINT", "l_returnflag", "l_linestatus", "epoch(l_shipdate)::BIGINT",
)


@query("s8_fingerprint", _digest_sql(_LINE, "lineitem"))
def s8_fingerprint(spark, sf_dir):
    """Every column counts; amounts go in as hundredths and times as seconds, which read the same everywhere."""
    cents = {c: F.round(F.col(c) * 100).cast("bigint") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    rows = fx.table(spark, sf_dir, "lineitem").withColumns(cents | {"l_shipdate": F.unix_timestamp("l_shipdate")})
    return fp.set_digest(rows, *rows.columns)


@query("s8_table_fingerprint", _digest_sql(("doc_id", "quality", "toxic"), "labels"))
def s8_table_fingerprint(spark, sf_dir):
    return fp.table_fingerprint(fx.table(spark, sf_dir, "labels"))


@query("s8_set_digest_by", _digest_sql(("doc_id", "text", "lang", "n_chars"), "documents", "source"))
def s8_set_digest_by(spark, sf_dir):
    """A digest of each source's documents, whole texts included."""
    return fp.set_digest(fx.table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "n_chars", by="source")


@query(
    "s8_file_sha256",
    "SELECT page_id, sha256(coalesce(html, '') || chr(10)) AS sha256, strlen(coalesce(html, ''))::BIGINT + 1 AS bytes FROM pages",
)
def s8_file_sha256(spark, sf_dir):
    """A file for every page, each hashed as it is on disk."""
    path = work_path(spark, "hashed")
    pages = fx.table(spark, sf_dir, "pages").select("html", "page_id")
    # a file costs far more than its bytes, so pages are dealt by number; rows of one page share its file
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pages.count() / FILES_PER_TASK))
    wr.write_texts(pages.repartition(tasks, "page_id"), path, "page_id", "html")
    files = fp.file_fingerprints(spark, path).where(~F.col("file").rlike("^[._]"))
    return files.select(F.regexp_extract("path", "page_id=(\\d+)/", 1).cast("bigint").alias("page_id"), "sha256", "bytes")


def _dataset(spark, sf_dir, tampered=False):
    path = work_path(spark, "cases")
    stored = _stored_cases(spark, sf_dir)
    if tampered:
        stored = stored.withColumn("event", F.col("event").withField("raw", F.when(F.col("case_id").cast("bigint") % 91 == 0, "see 10.9.8.7").otherwise(F.col("event.raw"))))
    wr.write_splits(stored, path)
    cases = rd.read_cases(spark, path, ("train", "val", "test"))
    return cases, fp.manifest_of(spark, cases, path)


@query(
    "s9_verify_manifest",
    """SELECT 'train' AS split, 'sha256 does not match manifest' AS problem UNION ALL SELECT 'val', 'bytes does not match manifest' UNION ALL SELECT 'test', 'cases does not match manifest'
UNION ALL SELECT 'extra', 'listed in manifest but missing'""",
)
def s9_verify_manifest(spark, sf_dir):
    """A manifest with other hashes, sizes and counts of cases for the files of one split each, and a file that is not there."""
    cases, manifest = _dataset(spark, sf_dir)
    of = F.regexp_extract("file", "split=(\\w+)/", 1)
    wrong = manifest.withColumn("sha256", F.when(of == "train", F.sha2("sha256", 256)).otherwise(F.col("sha256"))).withColumn("bytes", F.col("bytes") + (of == "val").cast("int"))
    wrong = wrong.withColumn("cases", F.col("cases") + (of == "test").cast("int"))
    extra = manifest.limit(1).withColumn("file", F.lit("split=extra/part-0.json"))
    found = fp.verify_dataset(wrong.unionByName(extra), manifest, li.string_rules(cases))
    return found.select(of.alias("split"), "problem").distinct()


@query("s9_clean_then_lint", "SELECT 'foreign_ip: ' || event_id || ': 10.9.8.7' AS problem FROM events WHERE event_id % 91 = 0")
def s9_clean_then_lint(spark, sf_dir):
    """Files that agree with their manifest, so the lint is run on what they hold."""
    cases, manifest = _dataset(spark, sf_dir, tampered=True)
    return fp.verify_dataset(manifest, manifest, li.string_rules(cases)).select("problem")


@query("s10_write_report_tables", _matrix_sql())
def s10_write_report_tables(spark, sf_dir):
    from alertloom.operators.cohort_matrix import cohort_matrix

    path = work_path(spark, "report")
    m = cohort_matrix(test_answers(spark, sf_dir))
    wr.write_report_tables({"cohort_matrix": m}, path, "parquet")
    return spark.read.schema(m.schema).parquet(f"{path}/cohort_matrix")
