"""What the corpus operators share: tables, the shared scratch folder, batches of Arrow rows."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.scratch import saved, scratch_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a Python worker handles at a time, and of an Arrow batch that it is sent.
BATCH_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send Arrow batches of at most BATCH_BYTES, so that memory follows neither rows nor texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (as long) and the text (null: empty); any other columns are left behind."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM collect what finished jobs leave, a moment after they have been reported, so that their shuffle files go before the next large shuffle."""
    time.sleep(0.5)
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)


def unused(name: str, df: DataFrame) -> str:
    """name, or name with underscores, as no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes of text, one row at least, so that memory does not follow the batch."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


#: Bytes of input (as stored) for each bucket that a task gathers whole; buckets of a shuffle partition at least and at most.
BUCKET_BYTES = 2 << 20
BUCKETS = (1, 1024)


def bucketed(rows: DataFrame) -> tuple[int, int]:
    """(buckets, shuffle partitions) for rows: buckets follow the bytes that Spark expects of rows, so that what a task holds at a time, one bucket, follows neither the input nor the number of partitions."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least, most = BUCKETS
    return min(max(least * partitions, -(-size // BUCKET_BYTES)), most * partitions), partitions


def by_bucket(rows: DataFrame, partitions: int) -> DataFrame:
    """rows dealt by their column bucket, the rows of a bucket one after another."""
    return rows.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")


def utf8_bytes(column: pa.Array) -> tuple:
    """(bytes, offsets) of a string column without nulls; the bytes of row i are bytes[offsets[i]:offsets[i + 1]]."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets - low
