"""What of an index must not grow faster than its input: folders of a version, tokens that are dealt out."""

import os

from pyspark.sql import functions as F

from tarnlake.operators import postings, search


def test_folders_of_a_version_are_bounded_and_hold_no_old_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FOLDERS", 3)
    e = spark.range(20).select(F.concat(F.lit("e"), "id").alias("entry_uuid"), F.col("id").alias("artifact_id"), F.lit("s").alias("session_uuid"), F.concat(F.lit("old word"), "id").alias("text"))
    first = postings.Index(spark, str(tmp_path), per_bucket=2).build(e)
    for name in ("documents", "postings"):
        assert len([f for f in os.listdir(tmp_path / name / "version=1") if f.startswith("bucket=")]) == 3
    changed = e.where("artifact_id in (4, 11)").withColumn("text", F.lit("new"))
    second = first.sync(changed, e.where("artifact_id = 7"))
    assert second.touched(1) == [2, 3, 5] and not os.listdir(tmp_path / "aside")
    ids = lambda index, word: sorted(r.entry_uuid for r in index.bm25(search.parse(word)).collect())
    assert ids(second, "new") == ["e11", "e4"] and len(ids(second, "old")) == 17 and ids(second, "word7") == ids(second, "word4") == [] and ids(second, "word5") == ["e5"]
    assert second.table("documents").count() == 19 and len(ids(first, "old")) == 20
    third = second.sync(e.where("artifact_id = 4"), e.where("artifact_id in (0, 1)"))
    assert third.touched(2) == [0, 2] and len(ids(third, "old")) == 16 and third.table("totals").first()["n"] == third.table("documents").count() == 17


def test_tokens_are_put_together_in_their_row(spark):
    rows = [("a", 1, "s", "x y x"), ("a", 1, "s", "x z y"), ("b", 1, None, ""), ("c", None, "s", None)]
    docs = postings.documents(spark.createDataFrame(rows, "entry_uuid string, artifact_id long, session_uuid string, text string"))
    found = postings.postings(docs)
    tokens = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.entry_uuid, r.tf, r.places) for r in found.collect()) == [("x", "a", 3, [0, 0, 2]), ("y", "a", 2, [1, 2]), ("z", "a", 1, [1])]
    # one row an entry is dealt out, none a token; and none at all where the rows are dealt out already
    assert "hashpartitioning(term" not in tokens and tokens.count("Exchange hashpartitioning") == 1
    dealt = postings.postings(docs.withColumn("b", F.length("entry_uuid")).repartition(3, "b"), kept=("b",))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
