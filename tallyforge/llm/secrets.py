"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text). The ledger holds which blobs have
been scanned under which version of the rules; an update scans only blobs that it does not hold under the current
version, each once however many paths share it, and findings are joined back to all paths. Only digests are shuffled to
find what is unseen; a text moves once, and only to meet its digest.

A null text is an empty one and has no findings; repeated rows and paths with the same text each get the blob's
findings; spans count code points, end exclusive. Very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, small_batches, utf8_bytes

#: Kind, pattern, group whose length counts, least length; base kinds first. A match that is too short is dropped, not looked into.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ("jwt", re.compile("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"), 0, 0),
    ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
)
#: Goes up with every change of RULES or suspects(), so that old blobs are scanned again.
RULES_VERSION = 2
#: Lower-case bytes of which each match but those of hex holds one.
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"akia", b"eyj", b"-----begin ")
HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdef")] = True
SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All findings of one text by start, then kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows of a batch that may hold a finding: one of WORDS, or a run of 24 hexadecimal digits, which ends with its row."""
    at: list[int] = []
    low = raw.tobytes().lower()
    for word in WORDS:
        i = low.find(word)
        while i >= 0:
            at.append(i)
            i = low.find(word, i + 1)
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = HEX[raw]
    edges = np.flatnonzero(np.diff(flags))
    inside = offsets[(offsets > 0) & (offsets < len(raw))]
    cuts = np.unique(inside[HEX[raw[inside - 1]] & HEX[raw[inside]]])  # rows that begin within a run
    first, end = np.sort(np.concatenate((edges[::2], cuts))), np.sort(np.concatenate((edges[1::2], cuts)))
    at += first[end - first >= 24].tolist()
    return np.unique(np.searchsorted(offsets, np.array(at, dtype=np.int64), side="right") - 1)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Rows (blob, spans) of the blobs (blob, text) that have findings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("blob", pa.binary()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in slices(batches, "text"):
            rows = []
            for i in suspects(*utf8_bytes(batch.column("text"))).tolist():
                if spans := spans_of(batch.column("text")[i].as_py()):
                    rows.append({"blob": batch.column("blob")[i].as_py(), "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return small_batches(blobs).select("blob", "text").mapInArrow(scan, f"blob binary, spans {SPANS}")


class BlobLedger:
    """Scanned blobs and their findings, in two Parquet tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self._table("scanned", "blob binary, rules int")

    def findings(self) -> DataFrame:
        return self._table("findings", f"blob binary, spans {SPANS}, rules int").where(F.col("rules") == RULES_VERSION).drop("rules")

    def update(self, versions: DataFrame) -> DataFrame:
        """Scans what the ledger has not seen of versions (path, text); returns (path, blob).

        Findings are written before the blobs are entered as scanned, and replace none: an update that broke off between
        the two scans its blobs again, and findings_of() takes one row a blob.
        """
        addressed = versions.select("path", "text", address(F.col("text")).alias("blob"))
        fresh = addressed.groupBy("blob").agg(F.min("path").alias("path"))
        known = self.scanned().where(F.col("rules") == RULES_VERSION).select("blob")
        unseen = fresh.join(known, "blob", "left_anti")
        # one row of each unseen blob carries its text; the digests are the smaller side, so they are hashed and texts stream by
        same = F.col("t.path").eqNullSafe(F.col("u.path")) & (F.col("t.blob") == F.col("u.blob"))
        blobs = addressed.alias("t").join(unseen.alias("u").hint("shuffle_hash"), same).select("t.blob", "t.text")
        scan_blobs(blobs).withColumn("rules", F.lit(RULES_VERSION)).write.mode("append").parquet(f"{self.folder}/findings")
        return addressed.select("path", "blob")

    def enter(self, paths: DataFrame) -> None:
        """Marks all blobs of paths (path, blob) as scanned under the current rules."""
        known = self.scanned().where(F.col("rules") == RULES_VERSION).select("blob")
        rows = paths.select("blob").distinct().join(known, "blob", "left_anti")
        rows.withColumn("rules", F.lit(RULES_VERSION)).write.mode("append").parquet(f"{self.folder}/scanned")

    def unique_findings(self) -> DataFrame:
        """One row for each blob with findings, also after repeated rows or an update that broke off."""
        findings = self.findings()
        return findings if findings.groupBy("blob").count().where("count > 1").isEmpty() else findings.dropDuplicates(["blob"])

    def findings_of(self, paths: DataFrame) -> DataFrame:
        """paths (path, blob, any more) with spans; a blob that many paths share is joined as a skewed key."""
        return paths.join(self.unique_findings(), "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))


def address(text: Column) -> Column:
    """A text's content address."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each row."""
    base = _of("spans", *BASE_KINDS)
    counts = [F.size(_of("spans", kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by the mask."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def without_secrets(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """docs, with its own columns, its secrets masked; n_chars, if there, is that of the new text."""
    ledger.enter(ledger.update(docs.select(F.col("doc_id").alias("path"), "text")))
    joined = docs.alias("d").join(ledger.unique_findings().alias("f").hint("shuffle_hash"), address(F.col("d.text")) == F.col("f.blob"), "left")
    text, spans = F.col("d.text"), F.col("f.spans")
    masked = F.when(spans.isNull(), text).otherwise(redacted(text, spans))
    changed = {"text": masked}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(spans.isNull(), F.col("d.n_chars")).otherwise(F.length(masked)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
