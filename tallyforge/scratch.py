"""The scratch folder that driver and executors share."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session has one folder of its own and a cluster is an error, as its executors would not see it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _local_folder(context.applicationId)
    return named if "://" in named else f"file://{named}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # its buffers are freed with the file
    del df
    # shuffle files go when the driver's JVM collects their owners; long chains of steps would else pile them up
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
