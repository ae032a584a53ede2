"""What of a capture run must not grow faster than its input: contents that are dealt out, memory of Python workers, work on a character."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from tarnlake.operators import capture, ledger, scanning
from tarnlake.sources import files


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_capture_joins_contents_once(spark, tmp_path):
    sources = spark.createDataFrame([("/a", "paste", "s", b"x")], "source_path string, role string, session_uuid string, content binary")
    store = capture.Store(spark, str(tmp_path), buckets=2)
    assert _plan(capture.planned(sources, store.ledger())).count("Join ") == 1
    capture.capture(store, sources, "1")
    assert "content" not in spark.read.parquet(f"{tmp_path}/scanned/run=1").columns
    held = store.contents(None, "role", "redacted")
    assert _plan(held).count("Join ") == 1 and [(r.role, r.redacted, bytes(r.content)) for r in held.collect()] == [("paste", False, b"x")]


def test_verification_joins_hashes_only(spark):
    stored = files.encoded(spark.createDataFrame([("/a", b"x")], "path string, content binary"))
    facts = stored.withColumn("stored_sha256", F.sha2("content", 256)).withColumn("content_sha256", F.sha2(F.lit(b"x"), 256))
    out = ledger.stored_ok(facts, files.decoded(stored))
    join = _plan(out).split("Join ")[1]
    assert out.first().ok and all("sha2" in line for line in join.splitlines() if "+- Project" in line or ":- Project" in line)


def test_workers_hold_a_part_of_a_batch(monkeypatch):
    monkeypatch.setattr(files, "MOST_HELD", 100)
    contents = [os.urandom(60), None, b"", os.urandom(300), b"y"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d", "e"]), pa.array(contents, pa.binary())], ["path", "content"])
    parts = list(files._encode(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [1, 3, 1]
    back = list(files._frames(iter(parts)))
    assert [x for b in back for x in b.column(1).to_pylist()] == contents and [x for b in back for x in b.column(0).to_pylist()] == ["a", "b", "c", "d", "e"]


def test_kept_letters_are_looked_up_beyond_ascii_only(spark):
    chars = [chr(c) for c in [*range(1, 0x3200), *range(0x4DF0, 0x4E10), *range(0x9FF0, 0xA010), 0xFF21, 0xFFFD, 0x1D400, 0x1F600]]
    df = spark.createDataFrame([(f"{c}", f"a{c}b") for c in chars], "c string, text string")
    old = rf"[^\x20-\x7E\n\t\r{scanning._KEPT}]"
    assert df.where((F.col("text").rlike(old) != F.col("text").rlike(scanning._OTHER)) | (F.col("c").rlike(old) != F.col("c").rlike(scanning._OTHER))).count() == 0
    assert scanning._OTHER.startswith(r"[^\x20-\x7E\n\t\r](")
