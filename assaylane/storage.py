"""Cutting of lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Where none is set, a local master (tests) gets a temporary one; on a cluster that is an error, for
    executors would each write to their own disk and readers would miss what others wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="assaylane-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Lineage ends there, so that lost executors cost a reread, not a recomputation,
    and the reader knows the size of what it joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames that :func:`cut` returned, once nothing that is still to run reads them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
