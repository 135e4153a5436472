"""Keep costly computed columns from being copied into filters.

Catalyst pushes a filter below a projection by inlining what the filter refers to. For a chain of text
rewrites that means running the chain once for the filter and again for the column, and every step
that reads its input twice doubles it. A generator is a boundary no filter on its output can cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    rest = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[F.col(c).alias(c) for c in columns]))
    out = df.select(*rest, F.explode_outer(packed).alias("_once"))
    return out.select(*[F.col(c) if c in rest else F.col(f"_once.{c}").alias(c) for c in df.columns])
