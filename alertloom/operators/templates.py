"""Log lines to templates: header split, normalization, first-wins dedup, per-file counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions import text as tx
from alertloom.operators.barrier import computed_once


def normalize(df: DataFrame, column: str, out: str = "template") -> DataFrame:
    """Apply every replacement step as its own column, so the text is read once per step."""
    df = df.withColumn(out, F.col(column))
    for step in tx.normalize_steps():
        df = df.withColumn(out, step(F.col(out)))
    return computed_once(df, out)


def syslog_lines(lines: DataFrame) -> DataFrame:
    """Adds system, slug, body (NULL when unparsed) to rows holding `line`; blank lines are dropped."""
    kept = lines.where(F.trim("line") != "")
    return computed_once(kept.withColumn("_p", tx.split_syslog(F.col("line"))), "_p").select(
        "*", F.col("_p.system").alias("system"), F.col("_p.slug").alias("slug"), F.col("_p.body").alias("body")
    ).drop("_p")


# name -> line extractor; a source names the one its files use
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"syslog_lines": syslog_lines}


def extract(lines: DataFrame, extractor: str = "syslog_lines") -> DataFrame:
    """Lines (source, file, line_no, line) with parsed header, template and an informative flag."""
    parsed = EXTRACTORS[extractor](lines)
    return normalize(parsed, "body").withColumn("informative", tx.is_informative(F.col("template")))


def first_templates(extracted: DataFrame) -> DataFrame:
    """One row per (source, template): the first line in (file, line) order decides system and slug.

    A minimum per template combines map-side, so a template on a third of all lines costs one row per
    map task.
    """
    first = F.min(F.struct("file", "line_no", "system", "slug")).alias("f")
    g = extracted.where("informative").groupBy("source", "template").agg(first, F.count(F.lit(1)).alias("n_lines"))
    return g.select(
        "source",
        F.col("f.file").alias("source_file"),
        F.col("f.system").alias("system"),
        tx.template_id(F.col("source"), F.col("f.slug"), F.col("f.system"), F.col("template")).alias("template_id"),
        "template",
        "n_lines",
    )


def registry(extracted: DataFrame) -> DataFrame:
    """Template rows with placeholder kinds. A surviving address is an error, never a row."""
    # without the barrier a filter on the kinds would go below the grouping, to every line
    t = computed_once(first_templates(extracted), "template")
    safe = F.when(tx.holds_address(F.col("template")), F.raise_error(F.lit("a template still holds an address")).cast("string")).otherwise(F.col("template"))
    kinds = tx.placeholder_kinds(F.col("template"))
    return t.withColumn("template", safe).withColumn("placeholder_kinds", kinds).withColumn("num_placeholders", F.size("placeholder_kinds"))


def file_counters(extracted: DataFrame) -> DataFrame:
    """Per file: lines seen, unparsed, degenerate, templates kept (first in the source), duplicates.

    A file whose lines gave no template at all is marked `empty`: its extractor no longer fits.
    """
    parsed = F.col("system").isNotNull()
    per_file = extracted.groupBy("source", "file").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~parsed).alias("skipped_unparsed"),
        F.count_if(parsed & ~F.col("informative")).alias("skipped_degenerate"),
        F.count_if(F.col("informative")).alias("informative"),
    )
    kept = first_templates(extracted).groupBy("source", F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("templates"))
    j = per_file.join(kept, ["source", "file"], "left").na.fill(0, ["templates"])
    return j.select(
        "source", "file", "seen", "skipped_unparsed", "skipped_degenerate", "templates",
        (F.col("informative") - F.col("templates")).alias("duplicates"),
        (F.col("informative") == 0).alias("empty"),
    )


def placeholder_histogram(registry_rows: DataFrame) -> DataFrame:
    return registry_rows.select(F.explode("placeholder_kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(registry_rows: DataFrame) -> DataFrame:
    """Template ids that two different templates share."""
    return registry_rows.groupBy("template_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def address_violations(templates: DataFrame) -> DataFrame:
    """Templates that hold any address, private and documentation ones included."""
    return templates.where(tx.holds_address(F.col("template")))


def substitute_tokens(df: DataFrame, text: str, values: dict[str, str], out: str = "filled") -> DataFrame:
    """Replace {name} by a column's value per row; any {name} left over is an error."""
    df = df.withColumn(out, F.col(text))
    for name, column in values.items():
        df = df.withColumn(out, F.replace(F.col(out), F.lit("{" + name + "}"), F.col(column).cast("string")))
    left = F.col(out).rlike(r"\{[a-z_]+\}")
    return df.withColumn(out, F.when(left, F.raise_error(F.concat(F.lit("unresolved token in "), F.col(out))).cast("string")).otherwise(F.col(out)))
