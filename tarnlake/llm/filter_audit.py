"""Which filter removes what in which order: counts on the edges of the lattice of applied filters, read along every order.

Five filters have 32 subsets and 80 edges (filters already applied, next filter). A document is reduced to the set of
filters that it fails, so documents become counts of (part, failed set), these become counts of the 80 edges, and the 600
steps of the 120 orders are looked up on the edges: an order is a path through the lattice. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.shared import raw, stage
from tarnlake.llm.words import pieces

FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Percent of the words that have to be distinct, and of the characters that may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
_capitals, _marks = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of UTF-8 that continue a character.
_continuing = bytes(range(0x80, 0xC0))


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = 0, set()
    for p in pieces(text):
        w = p.split()
        n += len(w)
        distinct.update(w)
    lost = lambda drop: len(text) - len(text.translate(None, drop))
    size = len(text) - lost(_continuing)
    return (n < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * n) << 1 | (100 * lost(_capitals) > MOST_CAPITALS * size) << 2 | (lost(_marks) > 0) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in raw(b.column(2))]
        masks, digests = pa.array([failed(t) for t in texts], pa.int32()), pa.array([sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], ["doc_id", "part", "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail.

    Filter E, a copy of a text of a smaller doc_id, needs no join of copies: documents of the same text are counted by part,
    with the smallest id and how often it stands there; all of a text but those at its smallest id are copies. Groups of
    copies are added up before they are shuffled. Null texts are empty, null parts the empty string. A null doc_id has no
    labels and is no smaller than another id, but larger than all: it is a copy if any id has its text. Rows of one doc_id
    and text are no copies of each other. Of several labels of a doc_id any 1 counts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    judged = stage(rows.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary"), "judged")
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # rows without an id have no labels: they would all meet at one task of the join
    named = judged.where("doc_id is not null").join(known, F.col("doc_id") == F.col("of"), "left").drop("of")
    nameless = judged.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    x = named.unionByName(nameless).select("doc_id", "part", "mask", "digest", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = x.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # null ids last: a struct's first field orders them
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "n")).alias("least")
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), least)
    first = by_text.groupBy("digest").agg(F.min(F.struct("least.last", "least.id")).alias("first"))
    y = by_text.join(first.withColumnRenamed("digest", "text"), F.col("digest") == F.col("text"))
    own = F.when(F.struct("least.last", "least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0)).cast("long")
    split = y.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))).alias("c"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), of("good"), of("toxic"))


def _edge_table(spark: SparkSession) -> DataFrame:
    """The 80 edges: (applied, next, weight), sets and the next filter as bits, and in how many orders the edge lies."""
    k = len(FILTERS)
    rows = [(s, f, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    return spark.createDataFrame(rows, "applied int, next int, weight long")


def _step_table(spark: SparkSession) -> DataFrame:
    """The 600 steps: (filter_order, step, applied, next)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def edges(counted: DataFrame) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of all 80 edges of every part, zeros included, and `shapley` of their filter.

    counted is what cells() gives: at most 32 rows a part, each of which adds to every edge.
    """
    spark = counted.sparkSession
    c = counted.join(F.broadcast(_edge_table(spark)))
    bit = F.expr("shiftleft(1, next)")
    here, before = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda cond, c="n": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    out = c.groupBy("part", "applied", "next", "weight").agg(
        total(~before & ~here).alias("kept"), total(~before & here).alias("removed"), total(before & here).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        total(~before & here, "good").alias("good_lost"), total(~before & here, "toxic").alias("toxic_lost"),
    )
    whole = out.groupBy(F.col("part").alias("p"), F.col("next").alias("f")).agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    return out.drop("weight").join(whole, (F.col("part") == F.col("p")) & (F.col("next") == F.col("f"))).drop("p", "f")


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: part, filter_order, step and the counts; 600 rows of every part. An empty table has no part and gives no row."""
    # the edges of a part are few, and read twice: the documents behind them are not counted twice
    e = edges(stage(cells(docs, labels), "cells"))
    path = e.join(F.broadcast(_step_table(docs.sparkSession)), ["applied", "next"])
    return path.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _oracle() -> str:
    perms = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    fails = ", ".join(f"{f.lower()}_" for f in FILTERS)
    at = "CASE substr(filter_order, {0}, 1) " + " ".join(f"WHEN '{f}' THEN {f.lower()}_" for f in FILTERS) + " END"
    now = at.format("step")
    before = "(" + " OR ".join(f"(step > {k} AND {at.format(k)})" for k in range(1, 5)) + ")"
    n_fails = " + ".join(f"{f.lower()}_::INT" for f in FILTERS)
    return rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < {LEAST_WORDS} AS a_, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b_,
   100 * len(regexp_extract_all(text, '[A-Z]')) > {MOST_CAPITALS} * length(text) AS c_, regexp_matches(text, '[#$%&*|]') AS d_, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), min(t.doc_id) OVER (PARTITION BY text) IS NOT NULL) AS e_
   FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
 g AS (SELECT part, {fails}, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 o AS (SELECT * FROM (VALUES {perms}) v(filter_order), (SELECT unnest(range(1, 6))::INT AS step)),
 x AS (SELECT part, filter_order, step, n, good, toxic, {now} AS here, {before} AS gone, {n_fails} AS n_fails FROM g, o),
 s AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM s"""


ORACLE_SQL = _oracle()
