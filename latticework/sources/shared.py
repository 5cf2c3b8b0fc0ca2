"""Tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a stored file. Spark deals files to tasks by bytes, 32 files at most with its own settings (4 MB for opening one, of 128 MB), and what
#: is stored here is many times larger in memory than on disk: so a task reads at most 32 times as many rows, however many there are.
ROWS_PER_FILE = 25_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own if all tasks run on this machine, as in
    tests; on a cluster that is an error, as the executors would each write to a disk of their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex[:12]}")
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder, in a part for each value of `by`, and read them again. No file has more than ROWS_PER_FILE rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("maxRecordsPerFile", ROWS_PER_FILE)
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
