"""Columns and helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import work_path

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_packed(df: DataFrame) -> DataFrame:
    """`cut_lineage` for rows that are compressed already.

    Compressing pages of large binary values once more takes buffers outside the heap that only its collection frees.
    """
    path = work_path(df.sparkSession, "packed")
    df.write.option("compression", "uncompressed").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def find_package(spark: SparkSession) -> None:
    """Python workers started from here on find this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def let(value: Column, body) -> Column:
    """`body` over a value that is worked out once.

    Inside a higher-order function an outer expression is evaluated for every element; a lambda variable
    is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All words of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null stays null."""
    plain = F.length(text) == F.octet_length(text)  # ASCII only: the quick way says the same
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 over the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_place(url: Column) -> Column:
    """What follows the host, query included, up to `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
