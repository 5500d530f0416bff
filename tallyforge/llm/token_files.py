"""Token-id files: independent zstandard frames, an index frame and a trailing seek table with a checksum per frame.

A file (shard) holds consecutive documents in ascending id order:

* data frames: each an ordinary zstandard frame of about FRAME_IDS token ids of whole documents, little-endian, 16 bits
  an id where the vocabulary allows and 32 otherwise;
* an index, in a skippable frame: width of an id, number of documents, then id, number of ids and frame of each;
* a seek table in the public seekable format: a skippable frame of (compressed size, size, XXH64) for each data frame,
  the number of frames, a descriptor byte and a magic number. Any zstandard reader can still read the whole file.

A reader seeks to the trailing table, then to the index, and decompresses only frames of documents asked for.

A document of no ids keeps its place with length 0; repeated ids are ordered by text; a null id comes first. The last
stage writes through Arrow's file systems, so any URI that they know will do for the folder.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import id_text, slices

#: Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 15
NO_ID = -(1 << 63)  # stands for a null document id
MANIFEST = "path string, shard int, n_docs long, n_ids long, first_id long"
DOCUMENTS = "doc_id long, position long, n_tokens long, ids_crc32 long"


def _checksum(data: bytes) -> int:
    """The low 32 bits of XXH64, as the public format has it."""
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one file; memory holds one frame and the index of the documents."""

    def __init__(self, sink, width: int, level: int = 3):
        import zstandard

        self.sink, self.width, self.pack = sink, width, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.frames: list[int] = []
        self.seek: list[tuple[int, int, int]] = []
        self.open: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.frames.append(len(self.seek))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            data = np.concatenate(self.open).astype(f"<u{self.width}").tobytes()
            packed = self.pack.compress(data)
            self.sink.write(packed)
            self.seek.append((len(packed), len(data), _checksum(data)))
            self.open, self.held = [], 0

    def close(self) -> None:
        self._close_frame()
        index = struct.pack("<IQ", self.width, len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array(self.frames, "<u4").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), HAS_CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Reads documents of one file, a frame at a time; a wrong checksum is an error."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        start = end - 9 - 12 * frames
        source.seek(start)
        self.seek = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.seek[:, 0])))
        source.seek(int(self.at[-1]) + 8)
        self.width, n = struct.unpack("<IQ", source.read(12))
        rest = source.read(16 * n)
        self.ids = np.frombuffer(rest[: 8 * n], "<i8")
        self.sizes = np.frombuffer(rest[8 * n : 12 * n], "<u4").astype(np.int64)
        self.frames = np.frombuffer(rest[12 * n :], "<u4").astype(np.int64)

    def frame(self, k: int) -> np.ndarray:
        self.source.seek(int(self.at[k]))
        data = self.unpack.decompress(self.source.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if len(data) != self.seek[k, 1] or _checksum(data) != self.seek[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place in the file, id, token ids) of all documents, or of those wanted; other frames stay unread."""
        rows = np.arange(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)))
        for k in np.unique(self.frames[rows]):
            mine = np.flatnonzero(self.frames == k) if wanted is not None else np.arange(*np.searchsorted(self.frames, [k, k + 1]))
            ends = np.cumsum(self.sizes[mine])
            data = self.frame(int(k))
            for i, end in zip(mine.tolist(), ends.tolist(), strict=True):
                if wanted is None or int(self.ids[i]) in wanted:
                    yield i, int(self.ids[i]), data[end - int(self.sizes[i]) : end]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Encodes docs (doc_id, text) and writes one file for each range of ids; returns the manifest (MANIFEST).

    The texts are dealt by ranges of (id, text hash) and sorted inside each range before they are encoded, so encoding
    happens once, every task writes one file under a name of its own, and a task that is run again replaces its file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tallyforge.llm.tokens import encoder

        coder, shard = encoder(tokenizer), TaskContext.get().partitionId()
        top = max(coder.vocabulary - 1, end_id or 0)
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name, sink = f"{path}/ids-{shard:06d}.zst", None
        draft = f"{path}/.{shard:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        first = None
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        for batch in slices(batches, "text"):
            if sink is None:
                sink = system.open_output_stream(draft)
                out = ShardWriter(sink, 2 if top < 1 << 16 else 4)
                first = batch.column("doc_id")[0].as_py()
            ids, at = coder.encode(batch.column("text"))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                out.add(doc, np.concatenate((ids[at[i] : at[i + 1]], tail)))
            n_docs += batch.num_rows
            n_ids += len(ids) + len(tail) * batch.num_rows
        if sink is not None:
            out.close()
            sink.close()
            system.move(draft, name)
            row = {"path": [f"{folder}/ids-{shard:06d}.zst"], "shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids], "first_id": [first]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64())]))

    spread = id_text(docs).withColumn("tie", F.xxhash64("text"))
    ranged = spread.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return ranged.mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, shard, position, n_tokens and the CRC-32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, shard in zip(batch.column("path").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                system, path = _file_system(uri)
                with system.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for at, doc, ids in ShardReader(source).documents():
                        rows.append((None if doc == NO_ID else doc, shard, at, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return manifest.select("path", "shard").mapInArrow(read, "doc_id long, shard int, position long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, shard, at, n, crc = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(shard, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
        names=["doc_id", "shard", "position", "n_tokens", "ids_crc32"],
    )


def placed(spark: SparkSession, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """documents with start, the ids of all documents before each: sums inside a file plus the totals of the files before.

    The manifest has one small row a file, so its running total may be taken in one task.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = manifest.select("shard", before.alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return documents.withColumn("inside", inside).join(totals, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
