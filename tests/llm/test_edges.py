"""Every operator and stage on a table of awkward rows, and on an empty one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row long, __cls long, fp string, size string, __text string, u int, h long"
LONG = "the quick brown fox and a lazy dog of the house ran in the rain for " * 3000
GOOD = "The river of the north is wide and it was known to all that it runs by the old mill, with a bridge that the people of the town built for the mill in a summer of long days."


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rows = [
        (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, GOOD + " Call +1 (555) 555-0100 or x@example.com.", None, "b"), (3, None, "en", None), (4, "", "en", "b"), (5, LONG, "en", "a"),
        (None, GOOD.replace("river", "stream"), "en", "b"), (None, None, None, None), (6, " \t\n\x0b\x0c\r ", "en", ""), (7, "x" * 300_000, "en", "c"), (8, "one", "en", "c"), (8, "two é 😀", "fr", "c"), (9, "a\0b " * 20, "en", "c"),
        (10, "Released under the MIT License.", "en", "c"), (11, "token = 'abcdefgh12345678'", "en", "c"),
    ]
    wide = [(*r, None if r[1] is None else len(r[1]), 1, 2, "f", "s", "t", 3, 4) for r in rows]
    d = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>bold"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<div>" * 2000 + "deep"), (6, "u", "<article>" + "<p>A paragraph of the text, and so on.</p>" * 3000), (7, "u", "<" * 5000), (8, "u", "<script>never closed <p>x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{d}/labels.parquet")
    items = [(1, "The mill with a bridge that the people of the town built for the mill."), (2, "Lazy DOG"), (2, "one"), (None, "two"), (3, None), (4, " - "), (5, "the quick brown fox and a lazy dog of the house ran in the rain for " * 3)]
    spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit("clash")).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_awkward(spark, awkward, name):
    table = "pages" if name.startswith("op9") else "documents"
    n = spark.read.parquet(f"{awkward}/{table}.parquet").count()
    rows = QUERIES[name](spark, awkward).collect()
    if name.startswith("op7"):
        by = {}
        for r in rows:
            by[r.doc_id] = by.get(r.doc_id, 0) + r.length
        assert by[3] == by[4] == by[6] == 1 and by[1] % 2 == 0 and len(rows) >= n
    elif name.startswith("op11"):
        assert len(rows) == 600 * 4 and {r.part for r in rows} == {"", "a", "b", "c"}
        assert sum(r.kept + r.removed for r in rows if r.step == 1 and r.filter_order == "ABCDE") == n
    else:
        assert len(rows) == n


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.collect() == [] and len(df.columns) > 3


def test_stages_awkward(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    seen = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, awkward)
        assert out.columns == docs.columns
        seen[name] = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect()), key=lambda x: (x[0], x[1] or ""))
    assert [i for i, _ in seen["quality_rules"]] == [-1, 1, 1, 2]
    # of rows without words one stays, of the near copies the one with the least id, of a repeated row one
    assert [i for i, _ in seen["simhash_dedup"]] == [1, 3, 5, 7, 8, 8, 9, 10, 11]
    assert any("[PHONE]" in (t or "") and "[EMAIL]" in t for _, t in seen["pii_crf"])
    assert any(r is None for _, r in seen["pii_crf"])


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_pipeline_runs(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
