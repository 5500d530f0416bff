import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.scratch import shared_dir
from tallyforge.streaming import scan_events

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", [scan_events.first_events, scan_events.event_counts])
def test_results_and_state_lie_in_the_shared_folder(spark, query, monkeypatch):
    shared = shared_dir(spark)
    seen = []
    scratch = scan_events.scratch_path
    monkeypatch.setattr(scan_events, "scratch_path", lambda *a: seen.append(scratch(*a)) or seen[-1])
    files = query(spark, SF).inputFiles()
    assert files and all(f.replace("file:///", "file:/").startswith(shared.replace("file:///", "file:/")) for f in files)
    checkpoint = spark._jvm.org.apache.hadoop.fs.Path(f"{seen[0]}/checkpoint/state")
    assert checkpoint.getFileSystem(spark._jsc.hadoopConfiguration()).exists(checkpoint)


def test_streams_over_several_files_and_none(spark, tmp_path):
    schema = pq.read_schema(f"{SF}/events.parquet")
    events = pq.read_table(f"{SF}/events.parquet").slice(0, 300)
    pq.write_table(events.slice(0, 0), tmp_path / "events.parquet")
    assert scan_events.first_events(spark, str(tmp_path)).count() == 0
    assert scan_events.event_counts(spark, str(tmp_path)).count() == 0
    for k in range(3):
        pq.write_table(pa.Table.from_batches(events.slice(100 * k, 100).to_batches(), schema), tmp_path / f"events.parquet.{k}")
    rows = events.to_pylist()
    pairs = sorted((r["user_id"], r["event_type"]) for r in scan_events.first_events(spark, str(tmp_path)).collect())
    assert pairs == sorted({(r["user_id"], r["event_type"]) for r in rows})
    counts = {r.event_type: r.n for r in scan_events.event_counts(spark, str(tmp_path)).collect()}
    assert counts == {t: sum(r["event_type"] == t for r in rows) for t in {r["event_type"] for r in rows}}


def test_first_rows_by_watermark_take_times_without_a_zone(spark):
    stream = scan_events.first_seen(scan_events.events(spark, SF).select("ts", "user_id"), ["user_id"])
    got = scan_events.drained(stream, "append")
    assert sorted(r.user_id for r in got.collect()) == sorted({r["user_id"] for r in pq.read_table(f"{SF}/events.parquet").to_pylist()})
