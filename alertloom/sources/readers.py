"""Readers with declared schemas. Bad records are kept in a quarantine column, never dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom import schemas
from alertloom.operators.threads import parse_ts


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def quarantined(df: DataFrame) -> DataFrame:
    """Records that did not parse. The reader refuses a query on the quarantine column alone, so the
    filter also reads the first data column, with a test it always passes."""
    other = F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("")) != "\x00"
    return df.where(F.col("_bad").isNotNull() & other)


def read_cases(spark: SparkSession, directory: str, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """Case rows of the requested splits; other split folders are not listed. Timestamps need an offset."""
    unknown = [s for s in splits if s not in fv.SPLITS]
    if unknown:
        raise ValueError(f"unknown splits {unknown}")
    reader = spark.read.schema(schemas.CASE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("basePath", directory)
    df = reader.json([f"{directory}/split={s}" for s in splits])
    typed_changes = F.transform(
        "context.active_changes",
        lambda c: c.withField("start", parse_ts(c["start"])).withField("end", parse_ts(c["end"])),
    )
    return df.withColumn("event", F.col("event").withField("ts", parse_ts(F.col("event.ts")))).withColumn(
        "context", F.col("context").withField("active_changes", typed_changes)
    )


def flatten_case(cases: DataFrame) -> DataFrame:
    """The columns the metric and lint operators use, from nested case rows."""
    return cases.select(
        "*",
        F.col("expected.choice").alias("gold_event_type"),
        F.col("expected.noul").alias("gold_page_now"),
        F.col("expected.score").alias("gold_priority"),
        F.col("label.event_type").alias("label_event_type"),
        F.col("label.page_now").alias("label_page_now"),
        F.col("label.priority").alias("label_priority"),
        F.col("label").isNotNull().alias("has_label"),
        F.col("expected").isNotNull().alias("has_expected"),
        F.col("label.rubric_version").alias("label_version"),
    )


def context_errors(cases: DataFrame) -> DataFrame:
    """(case_id, error): missing event or context parts, times without an offset, windows that end before they start."""
    e, c = F.col("event"), F.col("context")
    bad_time = F.exists(F.coalesce(c["active_changes"], F.array()), lambda x: x["start"].isNull() | x["end"].isNull())
    backwards = F.exists(F.coalesce(c["active_changes"], F.array()), lambda x: F.coalesce(x["start"] > x["end"], F.lit(False)))
    shape = F.exists(
        F.coalesce(c["active_changes"], F.array()),
        lambda x: F.exists(F.coalesce(x["expected_signals"], F.array()), lambda s: s["signal"].isNull() | s["max_impact"].isNull()),
    )
    checks = [
        F.when(e[k].isNull(), F.lit(f"event is missing {k}")) for k in ("format", "ts", "host", "signal")
    ] + [
        F.when(c[k].isNull(), F.lit(f"context is missing {k}")) for k in ("asset", "active_changes", "active_incidents")
    ] + [
        F.when(bad_time, "change time is missing or has no offset"),
        F.when(backwards, "change ends before it starts"),
        F.when(shape, "expected_signals entries need signal and max_impact"),
    ]
    return cases.select("case_id", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def read_cases_v1(spark: SparkSession, path: str) -> DataFrame:
    """First-generation cases; the target union becomes three typed columns by kind."""
    df = _json(spark, path, schemas.CASE_V1)
    k = F.col("kind")
    return df.select(
        "*",
        F.when(k == "choice", F.col("target")).alias("target_choice"),
        F.when(k == "score", F.expr("try_cast(target AS double)")).alias("target_score"),
        F.when(k == "noul", F.expr("try_cast(target AS boolean)")).alias("target_noul"),
    )


def read_templates_jsonl(spark: SparkSession, path: str, required_source: str | None = None) -> DataFrame:
    """Template registry rows. A record without id, text or source stops the read; so does a missing source."""
    df = _json(spark, path, schemas.TEMPLATE)
    missing = F.col("template_id").isNull() | F.col("template").isNull() | F.col("source").isNull()
    stop = F.raise_error(F.lit("registry record without template_id, template or source")).cast("string")
    df = df.withColumn("template_id", F.when(missing, stop).otherwise(F.col("template_id")))
    if required_source is not None and not df.where(F.col("source") == required_source).take(1):
        raise ValueError(f"registry has no template of source {required_source!r}")
    return df


def read_template_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted template CSV with columns EventId and EventTemplate; an empty id stops the read."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = [c.strip() for c in df.columns]
    if not {"EventId", "EventTemplate"} <= set(names):
        raise ValueError(f"template CSV needs EventId and EventTemplate, got {names}")
    df = df.toDF(*names)
    event_id = F.trim(F.coalesce("EventId", F.lit("")))
    stop = F.raise_error(F.lit("empty EventId in a template CSV")).cast("string")
    return df.select(F.when(event_id == "", stop).otherwise(event_id).alias("template_id"), F.trim("EventTemplate").alias("template"))


def read_log_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Text lines with their file; `line_no` orders lines inside a file.

    A text file is split over tasks by byte range, so the order key is the position inside the scan:
    the start of the block, then the order within it.
    """
    df = spark.read.text(path).select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"),
    )
    # within one block the sequence grows by one per line and stays far below 2^33
    return df.select("source", "file", F.struct("_start", "_seq").alias("line_no"), "line").where(F.trim("line") != "")


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.THREAD)


def thread_errors(threads: DataFrame) -> DataFrame:
    """(thread_id, error): closed vocabularies, derived keys and counters that do not add up."""
    c = F.col
    kept = F.size("messages")
    checks = [
        F.when(F.coalesce(c("thread_id"), F.lit("")) == "", "thread_id is empty"),
        F.when(F.coalesce(c("channel"), F.lit("")) == "", "channel is empty"),
        F.when(~F.coalesce(c("channel_kind").isin(*fv.CHANNEL_KINDS), F.lit(False)), "unknown channel_kind"),
        F.when(~F.coalesce(c("dataset_kind").isin(*fv.DATASET_KINDS), F.lit(False)), "unknown dataset_kind"),
        F.when(c("trust").isNotNull() & (c("trust") != "untrusted_user_text"), "trust must be untrusted_user_text"),
        F.when(c("synthetic").isNotNull() & (c("synthetic") != (c("dataset_kind") == "synthetic")), "synthetic contradicts dataset_kind"),
        F.when(F.coalesce(kept, F.lit(0)) < 1, "a thread needs at least one message"),
        F.when((F.coalesce("truncated_messages", F.lit(0)) < 0) | (F.coalesce("truncated_chars_messages", F.lit(0)) < 0), "a truncation counter is negative"),
        F.when(c("original_message_count").isNotNull() & (c("original_message_count") != kept + F.coalesce("truncated_messages", F.lit(0))), "kept and truncated messages do not add up to original_message_count"),
        F.when(c("_bad").isNotNull(), "record does not parse"),
    ]
    return threads.select("thread_id", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def key_difference(rows: DataFrame, keys: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Rows whose key set (an array column) lacks a required key or has an undeclared one."""
    need = F.array(*[F.lit(k) for k in required])
    allowed = F.array(*[F.lit(k) for k in (*required, *optional)])
    out = rows.withColumn("missing", F.array_sort(F.array_except(need, F.col(keys)))).withColumn(
        "unexpected", F.array_sort(F.array_except(F.col(keys), allowed))
    )
    return out.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def union_registries(*registries: DataFrame) -> DataFrame:
    """Template sources side by side; columns one of them lacks become NULL."""
    out = registries[0]
    for r in registries[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def distinct_terms(lexicon: DataFrame, term: str = "term") -> tuple[DataFrame, DataFrame]:
    """(unique terms, terms listed more than once)."""
    counts = lexicon.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(term), counts.where("n > 1")
