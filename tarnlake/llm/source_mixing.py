"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is r times its size has floor(r) whole copies of every document taken for certain. What is
left of the target is drawn without replacement: a document of inclusion probability p (its source's rest of r)
and uniform u ranks by the odds u/(1-u) over the odds p/(1-p), and the smallest ranks are taken up to the fixed
size, here a number of words. Ranks are mapped to [0, 1) and counted in bins: whole bins are taken from sums
of the bins, and only the one bin in which the size is reached is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.shared import neutral, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of a bin, about.
BIN = 5000
#: Times the edge bin is gone through for documents that fit into what is left of the size.
PASSES = 6
SEED = "mix-1"


def _uniform(key: Column) -> Column:
    """Uniform in (0, 1) by the document's id alone, so reruns agree."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(key.cast("string"), F.lit("-")))), 1, 13)
    return (F.conv(digest, 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) of each source, from (source, size) rows.

    Sources by code point, null last, weigh `weights` in turn; a target stops at `most` times its source's size
    and the excess is shared anew among the others by weight. The share per weight at which it ends is found from
    running sums over the sources in the order in which they reach their limit.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = (
        sums.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * most)
    )
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("light", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("share", (F.col("all_size") - F.col("full")).cast("double") / (F.col("all_weight") - F.col("light")))
        .withColumn("level", F.min(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "at", "share"))).over(every).getField("share"))
    )
    target = F.least(F.col("limit").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return w.select("source", "source_size", "n_docs", target.alias("target"))


def _planned(sized: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sized rows with their source's certain copies, remaining words, and their own rank and bin."""
    s = sources.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return (
        sized.join(s, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        .withColumn("certain", F.floor(ratio))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("words_left", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("odds", F.when(F.col("p") > 0, odds).otherwise(F.lit(0.0)))
        .withColumn("rank", F.col("odds") / (1 + F.col("odds")))
        .withColumn("bin", F.floor(F.col("rank") * F.ceil(F.col("n_docs") / F.lit(BIN))))
        .drop("odds")
    )


def _drawn(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source the bin in which its size is reached and the words before it; and that bin's rows with `extra`, 1 if drawn.

    Drawn are the first in order that fit together, then, PASSES - 1 times, of the others those that fit into what is left.
    """
    bins = planned.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("words_left").alias("words_left"))
    run = Window.partitionBy("source").orderBy("bin")
    edge = (
        bins.withColumn("upto", F.sum("words").over(run))
        .where("upto > words_left")
        .groupBy(F.col("source").alias("of"))
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
        .select("of", F.col("x.bin").alias("edge"), F.col("x.before").alias("before"))
    )
    own = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    last = planned.where("p > 0").join(edge, F.col("source").eqNullSafe(F.col("of")), "inner").where("bin = edge")
    drawn = last.withColumn("gap", F.col("words_left") - F.col("before")).withColumn("extra", F.lit(0))
    for _ in range(PASSES):
        may = F.when((F.col("extra") == 0) & (F.col("size") <= F.col("gap")), F.col("size"))
        drawn = drawn.withColumn("now", F.when(may.isNotNull() & (F.sum(may).over(own) <= F.col("gap")), 1).otherwise(0))
        took = F.sum(F.col("now") * F.col("size")).over(Window.partitionBy("source"))
        drawn = drawn.withColumn("gap", F.col("gap") - took).withColumn("extra", F.col("extra") + F.col("now"))
    # at last the smallest document left that brings the size nearer although it goes beyond
    over = F.when((F.col("extra") == 0) & (F.col("size") < 2 * F.col("gap")), F.col("size"))
    smallest = Window.partitionBy("source").orderBy(over.asc_nulls_last(), "rank", "doc_id")
    drawn = drawn.withColumn("last", F.when(over.isNotNull() & (F.row_number().over(smallest) == 1), 1).otherwise(0))
    return edge, drawn.withColumn("extra", F.col("extra") + F.col("last"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u, __text): the words of each text (null: none) the id's uniform number, and a hash of the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _uniform(F.col("doc_id")).alias("u"),
        F.xxhash64("text").alias("__text"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, __text, size, source_size, target, copies, taken) of every row of docs.

    A null text has no words, a null source is a source of its own (last), a null doc_id ranks like a fixed id;
    repeated rows are ranked one by one; rows without words have copies but take no words. Sources of no words
    have target zero. An empty table gives an empty table. Other columns are ignored.
    """
    sized = stage(sized_documents(docs), "sizes")
    planned = _planned(sized, source_targets(sized, weights, most), most)
    edge, drawn = _drawn(planned)
    rest = planned.join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
    extra = F.when((F.col("p") > 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), 1).otherwise(0)
    keep = ["doc_id", "source", "__text", "size", "source_size", "target", "certain"]
    others = rest.where("not coalesce(p > 0 and bin = edge, false)").withColumn("extra", extra)
    out = others.select(*keep, "extra").unionByName(drawn.select(*keep, "extra"))
    copies = F.col("certain") + F.col("extra")
    return out.select("doc_id", "source", "__text", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once, or up to MAX_COPIES times), with the columns of docs.

    Rows equal in doc_id, source and text share their copies. Texts move once.
    """
    d = neutral(docs, "doc_id", "source", "text")
    plan = mix_sources(d).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__text").alias("__t")).agg(F.sum("copies").alias("__n")).where("__n > 0")
    marked = d.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & F.col("__text").eqNullSafe(F.col("__t"))
    once = marked.join(plan, same).dropDuplicates(["__d", "__s", "__t"])
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*d.columns).toDF(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def _oracle() -> str:
    passes = ""
    for k in range(PASSES):
        passes += f""",
 m{k} AS (SELECT *, CASE WHEN extra = 0 AND size <= gap THEN size END AS may FROM p{k}),
 n{k} AS (SELECT *, CASE WHEN may IS NOT NULL AND sum(may) OVER (PARTITION BY source ORDER BY rank, doc_id, size) <= gap THEN 1 ELSE 0 END AS now FROM m{k}),
 p{k + 1} AS (SELECT * EXCLUDE (may, now, gap, extra), gap - sum(now * size) OVER (PARTITION BY source) AS gap, extra + now AS extra FROM n{k})"""
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
   (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
 a AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
 b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM a),
 c AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((pos - 1) % {len(WEIGHTS)}) + 1]::BIGINT AS weight, source_size * {MAX_COPIES} AS most FROM b),
 e AS (SELECT *, coalesce(sum(most) OVER o, 0)::DOUBLE AS full_, coalesce(sum(weight) OVER o, 0)::DOUBLE AS light, sum(source_size) OVER ()::DOUBLE AS all_size, sum(weight) OVER ()::DOUBLE AS all_weight
   FROM c WINDOW o AS (ORDER BY most::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, (all_size - full_) / (all_weight - light) AS share FROM e),
 g AS (SELECT arg_min(share, most::DOUBLE / weight + pos * 1e-9) AS level FROM f WHERE share * weight <= most),
 t AS (SELECT source, source_size, n_docs, least(most::DOUBLE, coalesce(level, 0) * weight) AS target FROM f, g),
 r AS (SELECT d.*, source_size, n_docs, target, CASE WHEN source_size > 0 THEN least(target / source_size, {MAX_COPIES}.0::DOUBLE) ELSE 0.0::DOUBLE END AS ratio FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, floor(ratio)::BIGINT AS certain, ratio - floor(ratio) AS p FROM r),
 o AS (SELECT *, target - certain * source_size AS words_left, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0.0 END AS odds FROM q),
 k AS (SELECT * EXCLUDE (odds), odds / (1 + odds) AS rank, floor(odds / (1 + odds) * ceil(n_docs / {BIN}.0::DOUBLE))::BIGINT AS bin FROM o),
 s AS (SELECT source, bin, sum(size) AS words, any_value(words_left) AS words_left FROM k WHERE p > 0 GROUP BY source, bin),
 v AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bin) AS upto FROM s),
 x AS (SELECT source, min(bin) AS edge, arg_min(upto - words, bin) AS before FROM v WHERE upto > words_left GROUP BY source),
 y AS (SELECT k.*, edge, before FROM k LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source),
 p0 AS (SELECT *, (words_left - before)::DOUBLE AS gap, 0 AS extra FROM y WHERE p > 0 AND bin = edge){passes},
 o1 AS (SELECT *, CASE WHEN extra = 0 AND size < 2 * gap THEN size END AS over_ FROM p{PASSES}),
 o2 AS (SELECT *, CASE WHEN over_ IS NOT NULL AND row_number() OVER (PARTITION BY source ORDER BY over_ NULLS LAST, rank, doc_id) = 1 THEN 1 ELSE 0 END AS last_ FROM o1),
 z AS (SELECT doc_id, size, source_size, target, certain, extra + last_ AS extra FROM o2 UNION ALL
   SELECT doc_id, size, source_size, target, certain, CASE WHEN p > 0 AND (edge IS NULL OR bin < edge) THEN 1 ELSE 0 END FROM y WHERE NOT coalesce(p > 0 AND bin = edge, false))
SELECT doc_id, size, source_size, target, ((certain + extra) * size)::BIGINT AS taken FROM z"""


ORACLE_SQL = _oracle()
