"""Running a streaming DataFrame to the end of what is available, into the shared folder.

Checkpoints and sinks live in the folder every executor reaches. Nothing is collected: an append stream
writes files, an updating one writes a row per key and batch, and the last batch of a key wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import work_path


def read_event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None, path: str | None = None) -> DataFrame:
    """The events table as a stream. `path` names another folder of the same schema."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # the glob takes the table both as one file and as a folder of files
    df = reader.parquet(path or f"{sf_dir}/events.parquet*")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, label: str, open_rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write an append stream to files and read it back with its own schema.

    An append stream gives out a window only once the watermark has passed it. For a stream that has ended, `open_rows` makes
    of the state the stopped query left in its checkpoint the rows it still owes.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, label), work_path(spark, label + "-state")
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(out)
    if open_rows is None:
        return closed
    left = open_rows(spark.read.format("statestore").load(state))
    return closed.unionByName(left.select(*[F.col(f.name).cast(f.dataType) for f in stream.schema]))


@contextmanager
def stores_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which user-defined state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_update(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Write the changed rows of every batch and keep each key's last version."""
    spark = stream.sparkSession
    out = work_path(spark, label)
    values = [c for c in stream.columns if c not in keys]

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(sink)
        .option("checkpointLocation", work_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    last = F.max_by(F.struct(*values), "batch").alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, "v.*")


def run_arrivals(spark: SparkSession, schema, arrivals: Sequence[str], build, keys: Sequence[str], label: str) -> DataFrame:
    """Run one updating query over folders that arrive one after the other.

    Every arrival is a restart of the same query on its checkpoint with one more folder listed, so state
    and watermark carry over as they would between runs of a scheduled job.
    """
    inbox, out, state = work_path(spark, label + "-inbox"), work_path(spark, label), work_path(spark, label + "-state")
    for path in arrivals:
        spark.read.schema(schema).parquet(path).write.mode("append").parquet(inbox)
        stream = build(spark.readStream.schema(schema).parquet(inbox))

        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
