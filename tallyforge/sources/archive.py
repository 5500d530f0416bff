"""The archive of photograph readings: Parquet files by a hash of the lot, of which a store rewrites only those that it touches.

A numbered manifest names the files that count for every bucket; the last one counts. A store writes new files for the
buckets of its lots, then a manifest that differs in those buckets alone, under a name that no one else can take. A store
that breaks off before that leaves files that no manifest names, and the last generation as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.sequences import upsert
from tallyforge.scratch import saved

KEY = ["lot", "model", "version", "url"]
SCHEMA = "lot string, model string, version int, url string, position int, generation long, summary string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BUCKETS = 64
DEALT = ("bucket", "file")


class ReadingArchive:
    """Readings below one folder; buckets is fixed by the first store."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self._manifest()[1] or {"buckets": buckets})["buckets"]

    def _manifest(self) -> tuple[int, dict | None]:
        """(number, content) of the last manifest; (0, None) without any."""
        folder = self._fs_path(f"{self.folder}/manifest")
        if not self._fs.exists(folder):
            return 0, None
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, None
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest/{max(numbers)}").collect()
        return max(numbers), json.loads(rows[0][0])

    def _commit(self, number: int, files: dict[str, str]) -> None:
        """Makes files (bucket -> folder) the next manifest; an error if another store has been faster."""
        target = self._fs_path(f"{self.folder}/manifest/{number}")
        started = self._fs_path(f"{self.folder}/manifest/{uuid.uuid4().hex}.started")
        out = self._fs.create(started, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "files": files}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(started, target):
            self._fs.delete(started, False)
            raise RuntimeError(f"another store has written generation {number}; store again")

    def _bucket(self, lot: Column) -> Column:
        return F.pmod(F.xxhash64(lot), F.lit(self.buckets)).cast("int")

    def _files(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of some buckets or of all."""
        files = (self._manifest()[1] or {"files": {}})["files"]
        paths = [path for bucket, path in files.items() if buckets is None or int(bucket) in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], SCHEMA)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with their bucket and file: a bucket is several files where it is large, as a lot's readings may be many."""
        return rows.select(*NAMES, self._bucket(F.col("lot")).alias("bucket"), F.pmod(F.xxhash64("url"), F.lit(16)).alias("file"))

    def _rewrite(self, dealt: DataFrame, touched: list[int]) -> None:
        """Rows (_placed) that are dealt by bucket and file become all that the touched buckets hold."""
        number, last = self._manifest()
        name = f"data/{uuid.uuid4().hex}"
        dealt.select(*NAMES, "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        folder = self._fs_path(f"{self.folder}/{name}")
        written = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(folder) if s.isDirectory()}
        files = {b: p for b, p in (last or {"files": {}})["files"].items() if int(b) not in touched}
        self._commit(number + 1, files | {b: f"{name}/bucket={b}" for b in written if b.isdigit()})

    def _touched(self, lots: DataFrame) -> list[int]:
        return [r.bucket for r in lots.select(self._bucket(F.col("lot")).alias("bucket")).distinct().collect()]  # BUCKETS rows at most

    def read(self, model: str | None = None, version: int = 1) -> DataFrame:
        """All readings of a version, of one model if named."""
        rows = self._files().where(F.col("version") == version)
        return rows if model is None else rows.where(F.col("model") == model)

    def store(self, readings: DataFrame, written: bool = False) -> None:
        """Enters readings; of a key the newest generation stays. written: they come from files, and may be read twice."""
        new = readings.select(*NAMES) if written else saved(readings.select(*NAMES), "readings")
        touched = self._touched(new)
        if touched:
            # dealt as they are written, so that finding the newest and writing take one shuffle
            self._rewrite(upsert(self._placed(self._files(touched)), self._placed(new), [*DEALT, *KEY], "generation", DEALT), touched)

    def forget(self, lots: DataFrame | None = None) -> None:
        """Drops the readings of some lots (lot), of every version, or of all."""
        if lots is None:
            self._commit(self._manifest()[0] + 1, {})
            return
        gone = saved(lots.select("lot").distinct(), "forgotten")
        touched = self._touched(gone)
        if touched:
            self._rewrite(self._placed(self._files(touched).join(gone, "lot", "left_anti")).repartition(*DEALT), touched)

    def stored_lots(self) -> int:
        return self.read().select("lot").distinct().count()

    def matched(self, photos: DataFrame, model: str) -> DataFrame:
        """photos (lot, position, url) with the summary stored for their address, at their present position; null where none is."""
        stored = self.read(model).select("lot", "url", "summary")
        return photos.join(stored, ["lot", "url"], "left")
