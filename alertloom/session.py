"""Session helpers: a local session for tests and bench, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "alertloom") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's `spark.checkpoint.dir`.

    Only a local master may do without one (tests); then a local folder stands in. Any other master
    raises, as executors would write files that nobody else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="alertloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    A lost executor costs no recomputation, and unlike a checkpointed RDD the table keeps its size for
    join choices and lets later steps read only the columns they use. `release` drops the table.
    """
    path = work_path(df.sparkSession, "stage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release(*stages: DataFrame) -> None:
    """Drop tables written by `cut_lineage` once nothing reads them any more."""
    for stage in stages:
        jvm = stage.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(stage.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input that arrives in few partitions; a large input is left as it is.

    Looks at the planned partition count only. Costly text work on one small file would otherwise run
    in one task, while a large table already has more partitions than cores and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of `dealt` that make a task.
DEALT_ROWS = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows with much work ahead, dealt evenly: a task for each core, and no task much over DEALT_ROWS.

    However few the files and row groups they came in, whose number `spread` takes for that of the tasks. Rows that are equal
    go together; counting reads no column.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS))
    return df.repartition(tasks, *df.columns)
