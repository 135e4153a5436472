"""Token files: Parquet tables of token lists, in order of document id, with row groups and pages of set sizes.

Ids are dictionary encoded where a page's dictionary pays, else delta packed; positions and lengths are delta packed.
Page indexes are written, so a reader can fetch metadata alone, or the tokens of a range of ids, without the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.llm import tokens
from alertloom.session import cut_lineage

#: Text bytes that go to one file, bytes of a row group and of a page, and rows of a page.
FILE_BYTES = 64 << 20
GROUP_BYTES = 16 << 20
PAGE_BYTES = 1 << 18
PAGE_ROWS = 1024


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of every text to `path`: id, start_in_file, n_tokens, ids; files and rows in ascending order of id.

    A null text counts as empty and has the end token alone. Rows with the same id are ordered by a hash of their texts.
    Null ids come first. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    tie = F.xxhash64("text")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("start_in_file", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType(), False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                ids, bounds = tokens.encode_texts(part.column("text"), vocabulary, end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bounds[:-1] + before, pa.int64()), pa.array(np.diff(bounds), pa.int64()), lists], names=schema.names)
                before += int(bounds[-1])

    ordered = slim.repartitionByRange(files, "id", tie).sortWithinPartitions("id", tie)
    options = {
        "parquet.block.size": group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd",
    }
    ordered.mapInArrow(encode, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Read token files back: id, `start` (ids of all documents before it), `n_tokens` and, on demand, `ids`.

    Without ids only the positions are fetched from the files.
    """
    rows = spark.read.parquet(path).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), "^part-(\\d+)", 1).cast("long"))
    totals = rows.groupBy("_file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    firsts = cut_lineage(totals.select(F.col("_file").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before")))
    out = rows.join(firsts, F.col("_file") == F.col("_of"))
    more = ["ids"] if with_ids else []
    return out.select(F.col("id").alias(id_col), (F.col("_before") + F.col("start_in_file")).alias("start"), "n_tokens", *more)


def checksums(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`read` with `ids_crc32` in place of the ids."""
    schema = T.StructType([read.schema[id_col], *(read.schema[c] for c in ("start", "n_tokens"))]).add("ids_crc32", "long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()  # workers are used again, and may hold those of the stage that wrote
        for batch in batches:
            lists = batch.column("ids")
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [tokens.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=schema.names)

    return read.select(id_col, "start", "n_tokens", "ids").mapInArrow(sums, schema)
