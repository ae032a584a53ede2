"""The index against a search without one, its upkeep, and gates and merges on awkward rows."""

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import archive, ledger, postings, scanning, search, transcripts
from tarnlake.sources import tables as t
from tarnlake.sources import versions

SF = "/root/testdata/sf0.001"


def test_index_and_plain_search_agree(spark, tmp_path):
    e = t.entries(spark, SF)
    index = postings.Index(spark, str(tmp_path / "a")).build(e)
    for text in ("the", "the of", "of:the and", "étion role:user", "no-such-word", "!!", ""):
        q = search.parse(text)
        assert index.bm25(q).collect() == search.bm25(e, q).collect()
    changed = e.where("artifact_id % 3 = 0").withColumn("text", F.lit("Dőrch čas"))
    synced = index.sync(changed, e.where("artifact_id % 3 = 1"))
    now = e.where("artifact_id % 3 = 2").unionByName(changed)
    for text in ("the of", "dorch", "cas", "dorch:cas"):
        assert synced.bm25(search.parse(text)).collect() == search.bm25(now, search.parse(text)).collect()
    other = postings.Index(spark, str(tmp_path / "a"), tokenizer=postings.TRIGRAMS)
    for refused in (lambda: other.sync(changed.limit(0), changed.limit(0)), lambda: other.bm25(search.parse("the"))):
        with pytest.raises(ValueError, match="another tokenizer"):
            refused()
    again = other.sync(changed.limit(0), changed.limit(0), reindex=True)
    assert again.table("totals").first()["tokenizer"] == postings.TRIGRAMS and again.table("documents").count() == synced.table("documents").count()
    back = postings.Index(spark, str(tmp_path / "a"), tokenizer=postings.TOKENIZER).sync(changed.limit(0), changed.limit(0), reindex=True)
    assert back.table("postings").count() == synced.table("postings").count()


def test_versions_stay_and_buckets_are_kept(spark, tmp_path):
    e = t.entries(spark, SF)
    first = postings.Index(spark, str(tmp_path), per_bucket=4).build(e)
    n = first.table("documents").count()
    changed = e.where("artifact_id = 9").limit(1).withColumn("text", F.lit("Dőrch"))
    second = first.sync(changed, e.where("artifact_id = 10"))
    assert second.touched(1) == [2] and first.table("documents").count() == n and [r.entry_uuid for r in second.bm25(search.parse("dorch")).collect()] == [changed.first().entry_uuid]
    assert second.table("documents").where("artifact_id in (9, 10)").count() == 1
    with pytest.raises(versions.Conflict):
        first.sync(changed, changed)
    assert postings.Index(spark, str(tmp_path)).version == 2 and second.sync(e.where("false"), e.where("artifact_id between 8 and 11")).touched(2) == [2]


def test_trigrams(spark, tmp_path):
    rows = [("a", 1, "s", "設計レビュー 思兼課長の索引方針について"), ("b", 1, "s", "ABCabcABC"), ("c", 2, "s", "ab"), ("d", 2, None, None), ("e", 3, "s", "x😀y😀z"), ("f", 3, "s", "bca abd"), ("g", 4, "s", "")]
    e = spark.createDataFrame(rows, "entry_uuid string, artifact_id long, session_uuid string, text string")
    index = postings.Index(spark, str(tmp_path), tokenizer=postings.TRIGRAMS).build(e)
    found = lambda term: [r.entry_uuid for r in index.bm25(search.Query(phrases=[term])).collect()]
    assert found("思兼課") == ["a"] and found("思兼課長の索引方針") == ["a"] and found("思兼") == [] and found("思課長") == []
    assert found("cab") == ["b"] and found("BCABCA") == ["b"] and found("abcabcabcabc") == [] and found("y😀z") == ["e"] and found("ab") == [] and found("abc abd") == []
    for term in ("abca", "BCA", "abd"):
        assert sorted(found(term)) == sorted(r[0] for r in rows if r[3] and term.lower() in r[3].lower())
    plan = index.bm25(search.Query(phrases=["思兼課長"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "text#" not in plan


def test_folding_covers_latin_letters(spark):
    got = spark.createDataFrame([("Dőr ČAS Ǻngström ệ naïve",)], "text string").select(search.normal(F.col("text"))).first()[0]
    assert got == " dor cas angstrom e naive " and search.folded_phrase("Dőr-ČAS") == "dor cas"


def test_hidden_secrets():
    key = "IOSFODNN7EXAMPLE"
    for text in ("AK\bIA" + key, "AK\x7fIA" + key, "\U0001d400\U0001d40a\U0001d408\U0001d400" + key, "AK\\ud800IA" + key, "AK\\u0049A" + key, "AK\\\\u0049A".replace("\\\\", "\\") + key, "AK​IA" + key, "ＡＫＩＡ" + key):
        assert scanning.hides(text), text
    assert not scanning.hides("AK" + "IA" + key) and not scanning.hides("nothing\bhere")
    assert not scanning.hides("AK\bIA" + key, ["^AK" + "IA"]) and not scanning.hides("AK\bIA" + key, [scanning.tag("AK" + "IA" + key)])
    assert scanning.hides('{"a": [{"AK\\u0049A' + key + '": 1}]}\nno json', lines=True) and scanning.hides('["AK\\/x", "AK\\u200bIA' + key + '"]', lines=True)
    assert not scanning.hides('{"a": "AK' + "IA" + key + '"}', lines=True)


def test_hidden_secrets_reach_python_only_if_they_can_hide(spark):
    rows = [(1, "AK\x7fIA" + "IOSFODNN7EXAMPLE"), (2, "plain"), (3, None), (4, "")]
    got = {r.id: r.hidden for r in scanning.hidden_secrets(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_upsert_gives_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, path string, sha string")
    new = spark.createDataFrame([(7, "a", "n1", 1), (8, "a", "n2", 2), (9, "c", "n3", 1)], "id long, path string, sha string, run int")
    got = sorted(tuple(r) for r in ledger.upsert(old, new, "path", latest="run", keep=("id",)).select("id", "path", "sha").collect())
    assert got == [(1, "a", "n2"), (2, "b", "y"), (9, "c", "n3")]
    assert ledger.upsert(old, old.unionByName(old), "path").count() == 2


def test_lines_of_white_space_are_blank(spark):
    values = transcripts.parsed(transcripts.lines(spark.createDataFrame([(1, "\t\n\r\n  \n{\"a\": 1}\nx\n")], "artifact int, content string")))
    assert [r.malformed for r in values.orderBy("seq").collect()] == [False, False, False, False, True]


def test_outcomes(spark):
    rows = [(1, "plain", None), (2, "AK" + "IAIOSFODNN7EXAMPLE", None), (3, "password=hunter22", None), (4, "bytes", "non-utf8"), (5, "‹REDACTED:x:0› y", None), (6, None, None)]
    texts = spark.createDataFrame(rows, "id long, text string, why string")
    got = {r.id: r for r in archive.outcomes(texts).collect()}
    assert [got[i].needs_quarantine for i in range(1, 7)] == [False, True, False, True, False, False]
    assert [got[i].was_redacted for i in range(1, 7)] == [False, True, True, True, True, False]
    assert got[4].redacted.startswith("‹QUARANTINED:non-utf8:") and got[4].findings[0].span_len == 5 and not got[4].scanned
    assert got[5].redacted == "<REDACTED:x:0› y" and got[5].flagged == 1 and got[6].redacted == ""
    assert {r.id for r in archive.originals(texts, archive.outcomes(texts, quarantine_all=True)).collect()} == {2, 3, 4}
    off = archive.outcomes(texts, scan=False).collect()
    assert all(r.scanned for r in off) and not any(r.was_redacted or r.needs_quarantine for r in off)
    assert archive.targets("mcp, scratch,mcp") == ["mcp", "scratch"]
    with pytest.raises(ValueError):
        archive.targets("everything")
