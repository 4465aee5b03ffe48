"""Cutting lineage with data that every executor can read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`.

    Only a single-machine session without that setting, as in tests, gets a
    temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _tidy(spark: SparkSession) -> None:
    """Asks the driver's collectors to look for frames that nothing needs, whose shuffle files Spark then removes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder and read from there.

    The files of one step are gone before the next one writes its own.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    done = frame.checkpoint()
    del frame
    _tidy(spark)
    return done


def written(frame: DataFrame) -> DataFrame:
    """The frame, written as a Parquet table below the shared checkpoint folder and read again."""
    spark, schema = frame.sparkSession, frame.schema
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    frame.write.parquet(path)
    del frame
    _tidy(spark)
    return spark.read.schema(schema).parquet(path)
