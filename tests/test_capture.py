"""Capture runs: what they store and record, and that a run that stops anywhere has added nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import archive, capture, scanning

SCHEMA = "source_path string, role string, session_uuid string, content binary"
KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
LINE = b'{"type":"summary","summary":"s"}\n'


def sha(b):
    return hashlib.sha256(b).hexdigest()


def _sources(spark, second=False):
    more = LINE * 2 + b'{"type":"summary",' if second else b""
    rows = [
        ("/t", "transcript", "s1", LINE + more), ("/open", "transcript", "s1", LINE + b'{"half'), ("/broken", "transcript", "s2", b'{"half\n'), ("/key", "tool-result", "s2", f"a {KEY} b".encode()), ("/same", "paste", None, "é".encode()),
        ("/none", None, None, None), ("/grown", "paste", None, b"pwd=hunter22 x" + (b" more" if second else b"")), ("/utf", "snapshot", None, b"\xff\xfe\x00"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _state(store):
    rows = {r.source_path: (r.source_bytes, r.source_sha256, r.content_sha256, r.redacted, r.quarantined, len(r.frames)) for r in store.ledger().collect()}
    contents = {r.source_path: bytes(r.content) for r in store.contents().collect()}
    assert rows.keys() == contents.keys() and all(sha(contents[p]) == rows[p][2] for p in rows)
    return rows, contents


def test_two_runs(spark, tmp_path):
    store = capture.Store(spark, str(tmp_path), buckets=4)
    first = capture.capture(store, _sources(spark), "2024-01-01T00:00:00")
    assert first.counts == {"skipped": 0, "scanned": 8, "redacted": 4, "flagged": 0, "needing_quarantine": 3, "written": 8, "bytes_stored": first.counts["bytes_stored"], "refused": 0}
    rows, contents = _state(store)
    assert contents["/t"] == contents["/open"] == LINE and rows["/open"][:2] == (len(LINE), sha(LINE))
    assert contents["/key"].decode() == f"a ‹REDACTED:aws-key:{scanning.tag(KEY)}› b" and rows["/key"][3:5] == (True, True)
    assert contents["/broken"].startswith("‹QUARANTINED:malformed-jsonl:".encode()) and contents["/utf"].startswith("‹QUARANTINED:utf16-decode-failed:".encode())
    assert contents["/grown"].decode().startswith("‹REDACTED:password-assignment:") and rows["/grown"][3:5] == (True, False)
    assert contents["/none"] == b"" and rows["/same"][3:] == (False, False, 1)
    kept = spark.read.parquet(f"{tmp_path}/originals/run=1").collect()
    assert {r.source_path: bytes(r.content) for r in kept} == {"/key": f"a {KEY} b".encode(), "/broken": b'{"half\n', "/utf": b"\xff\xfe\x00"}
    second = capture.capture(store, _sources(spark, second=True), "2024-01-02T00:00:00")
    assert (second.counts["skipped"], second.counts["written"], second.counts["refused"]) == (6, 2, 0)
    rows, contents = _state(store)
    assert contents["/t"] == LINE * 3 and rows["/t"][0] == len(LINE * 3) and rows["/t"][5] == 2
    assert contents["/grown"].endswith(b" x more") and rows["/grown"][5] == 1
    frames = {r.source_path: [(f.run, f.src_offset, f.src_len) for f in r.frames] for r in store.ledger().collect()}
    assert frames["/t"] == [(1, 0, len(LINE)), (2, len(LINE), 2 * len(LINE))] and frames["/grown"][0][0] == 2
    # what another version named is still there
    assert {r.source_path: bytes(r.content) for r in store.contents(1).collect()}["/t"] == LINE


@pytest.mark.parametrize("step", ["scanned", "originals", "frames", "ledger"])
def test_a_run_that_stops_adds_nothing(spark, tmp_path, step):
    store = capture.Store(spark, str(tmp_path), buckets=2)
    capture.capture(store, _sources(spark), "1")
    before = _state(store)

    def stop(at):
        if at == step:
            raise OSError(at)

    with pytest.raises(OSError, match=step):
        capture.capture(store, _sources(spark, second=True), "2", after=stop)
    assert _state(store) == before
    capture.capture(store, _sources(spark, second=True), "2")
    assert _state(store)[1]["/t"] == LINE * 3


def test_without_its_original_nothing_is_stored(spark, tmp_path):
    store = capture.Store(spark, str(tmp_path), buckets=2)
    lose = lambda df, path: df.where("source_path <> '/key'").withColumn("content", F.when(F.col("source_path") == "/utf", F.lit(b"torn")).otherwise(F.col("content"))).write.mode("overwrite").parquet(path)
    run = capture.capture(store, _sources(spark), "1", write_originals=lose)
    assert run.counts["refused"] == 2 and not {"/key", "/utf"} & _state(store)[0].keys() and "/broken" in _state(store)[0]
    again = capture.capture(store, _sources(spark), "2")
    assert (again.counts["written"], again.counts["skipped"]) == (2, 6) and {"/key", "/utf"} <= _state(store)[0].keys()


def test_rescan(spark, tmp_path):
    """What was stored without a scan is redacted where it lies; a second run finds nothing more."""
    store = capture.Store(spark, str(tmp_path), buckets=4)
    capture.capture(store, _sources(spark), "1", scan=False)
    rows, contents = _state(store)
    assert contents["/key"].decode() == f"a {KEY} b" and not any(r[3] or r[4] for r in rows.values()) and contents["/broken"] == b'{"half\n'

    def stop(at):
        if at == "ledger":
            raise OSError(at)

    with pytest.raises(OSError, match="ledger"):
        capture.rescan(store, "2", after=stop)
    assert _state(store) == (rows, contents)
    run = capture.rescan(store, "2")
    assert {k: run.counts[k] for k in ("changed", "unstable", "needing_quarantine", "written", "refused")} == {"changed": 4, "unstable": 0, "needing_quarantine": 3, "written": 4, "refused": 0}
    now, after = _state(store)
    assert after["/key"].decode() == f"a ‹REDACTED:aws-key:{scanning.tag(KEY)}› b" and now["/key"][3:] == (True, True, 1) and now["/key"][:2] == rows["/key"][:2]
    assert after["/broken"].startswith("‹QUARANTINED:malformed-jsonl:".encode()) and now["/grown"][3:5] == (True, False) and now["/same"] == rows["/same"]
    kept = {r.source_path: bytes(r.content) for r in spark.read.parquet(f"{tmp_path}/originals/run=2").collect()}
    assert kept == {"/key": contents["/key"], "/broken": contents["/broken"], "/utf": contents["/utf"]}
    third = capture.rescan(store, "3")
    assert third.counts["changed"] == 0 and _state(store) == (now, after)
    s = capture.status(store.ledger()).first()
    assert (s.artifacts, s.sessions, s.redacted, s.quarantined) == (8, 2, 4, 3) and s.stored_bytes == sum(f.bytes for r in store.ledger().collect() for f in r.frames)
    # a growing file that was rescanned is captured whole again, as its stored beginning is another
    capture.capture(store, _sources(spark, second=True), "4")
    assert _state(store)[1]["/t"] == LINE * 3


def test_gates_of_a_scan(spark):
    hidden = "AK\\u0049A" + KEY[4:]
    rows = [
        (1, "transcript", b"\xff"), (2, "transcript", b"\xfe\xff\xd8\x00"), (3, "paste", b"a\0b\0c\0d\0"), (4, "transcript", LINE + b"no json\n"), (5, "transcript", b'{"a": "' + hidden.encode() + b'"}\n'), (6, "paste", hidden.encode()),
        (7, "paste", b"\xef\xbb\xbfplain"), (8, "paste", "‹REDACTED:x:0› ‹QUARANTINED:y:1›".encode()), (9, "transcript", b" \n\r\n"), (10, "paste", None), (11, None, b"not json"), (12, "history", b"not json"), (13, "paste", KEY.encode("utf-16")),
    ]
    df = spark.createDataFrame(rows, "id long, role string, content binary").withColumn("text", F.lit("clash"))
    out = archive.scan_artifacts(df)
    got = {r.id: r for r in out.collect()}
    assert {i: r.why for i, r in got.items()} == {1: "non-utf8", 2: "utf16-decode-failed", 3: "utf16-ambiguous", 4: "malformed-jsonl", 5: "escape-hidden-secret", 6: "escape-hidden-secret", 12: "malformed-jsonl", **dict.fromkeys([7, 8, 9, 10, 11, 13])}
    assert [got[i].scanned for i in (1, 4, 5, 7)] == [False, False, False, True] and bytes(got[7].redacted) == b"plain" and got[7].text == "clash"
    tag = sha(rows[3][2])[:8]
    assert bytes(got[4].redacted).decode() == f"‹QUARANTINED:malformed-jsonl:{tag}›\n" and [tuple(f) for f in got[4].findings] == [("malformed-jsonl", "high", tag, "quarantine", 0, len(rows[3][2]))]
    assert [tuple(f) for f in got[8].findings] == [("preinjected-placeholder", "low", "00000000", "flag", 0, 0)] and got[8].flagged == 1 and got[8].was_redacted and not got[8].needs_quarantine
    assert bytes(got[8].redacted).decode() == "<REDACTED:x:0› <QUARANTINED:y:1›" and got[13].needs_quarantine and got[13].redacted_count == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan
    trusted = {r.id: r for r in archive.scan_artifacts(df, trust_tags=True).collect()}
    assert bytes(trusted[8].redacted).decode().startswith("‹REDACTED:x:0›") and trusted[8].findings == []
    off = archive.scan_artifacts(df, scan=False).collect()
    assert all(r.scanned and not r.was_redacted and r.why is None for r in off) and {r.id: r.redacted and bytes(r.redacted) for r in off}[1] == b"\xff"
    every = {r.id: r.needs_quarantine for r in archive.scan_artifacts(spark.createDataFrame([(1, "paste", b"pwd=hunter22"), (2, "paste", b"calm")], "id long, role string, content binary"), quarantine_all=True).collect()}
    assert every == {1: True, 2: False}
