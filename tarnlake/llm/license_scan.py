"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

A block is a run of BLOCK words of a whole text, whatever its lines; blocks overlap by half, so that a wording of up to half a
block lies whole in one. Block and template are sets of pairs of neighbouring words, which keeps scattered words from adding up
to a wording. A template is contained if at least THRESHOLD of its pairs are in the block, among them those that tell it from
its relatives; of related templates in a block the one with most pairs there counts.

Pairs are ordered by their number of occurrences in the whole corpus, rarest first. If |T| is a template's size and need =
ceil(THRESHOLD * |T|), the first |T| - need + 1 pairs of the template (its prefix) hold one that the block shares: only blocks
with a prefix pair are looked at. They must have more than `need` words (length filter), and from the place of a shared
prefix pair in both ordered sets the overlap still possible must reach `need` (positional filter). What is left is verified.
Only DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import stage

THRESHOLD = 0.8
#: Runs of other characters than word characters; a lower-cased text has words between them.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BLOCK, STRIDE = 64, 32
#: Wordings that grant a license, their labels, and the pairs of words that tell some from their relatives.
TEMPLATES = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", []),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general"]),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["gnu lesser"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["gnu affero"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", []),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", []),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public"]),
    ("cc-by", "Licensed under CC BY 4.0", ["by 4"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["by nc"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["attribution 4"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial"]),
]


def _pairs(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


SETS = [_pairs(t) for _, t, _ in TEMPLATES]
VOCABULARY = sorted({p for s in SETS for p in s})
WORDS = sorted({w for p in VOCABULARY for w in p.split()})
#: Of each template the others with half of its pairs or more.
RIVALS = [[j for j, other in enumerate(SETS) if j != k and 2 * len(set(own) & set(other)) >= len(own)] for k, own in enumerate(SETS)]


def _words(text: Column) -> Column:
    """The words of a lower-cased text, one space between them. lower() differs from A-Z alone only in letters outside ASCII."""
    return F.trim(F.regexp_replace(F.lower(text), GAP, " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(docs: DataFrame) -> DataFrame:
    """Phrases by place: a text is split at them, and words are counted in the first and last piece."""
    phrase = f" (?:{'|'.join(PHRASES)})(?= )"
    b = docs.select(F.col("doc_id"), F.xxhash64("text").alias("__text"), _words(F.coalesce("text", F.lit(""))).alias("norm"))
    b = b.withColumn("padded", F.when(F.contains("norm", F.lit("license")), F.concat(F.lit(" "), "norm", F.lit(" "))))
    b = b.withColumn("pieces", F.split("padded", phrase, -1)).withColumn("n_words", F.when(F.col("norm") == "", F.lit(0)).otherwise(_spaces(F.col("norm")) + 1).cast("long"))
    found = F.size("pieces") > 1
    final = F.element_at(F.regexp_extract_all("padded", F.lit(f"({phrase})"), F.lit(1)), -1)
    labels = F.array_compact(F.array(*[F.when(F.contains("padded", F.lit(f" {p} ")), F.lit(x)) for p, x in PHRASES.items()]))
    return b.select(
        "doc_id", "__text", "n_words",
        F.when(found, F.size("pieces") - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(found, _spaces(F.get("pieces", F.lit(0)))).alias("first_word"),
        F.when(found, F.col("n_words") - (_spaces(F.element_at("pieces", -1)) - 1) - _spaces(final)).alias("last_word"),
        F.when(found, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )


def template_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, n_words, i, pair): the pairs of words of whole texts that a template has, and their places."""
    seen = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.split(_words(F.coalesce("text", F.lit(""))), " ").alias("words"))
    word = lambda i: F.get("words", i)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0))), lambda i: word(i).isin(WORDS) & word(i + 1).isin(WORDS))
    pairs = F.filter(F.transform(at, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", word(i), word(i + 1)).alias("pair"))), lambda x: x["pair"].isin(VOCABULARY))
    return seen.select("doc_id", "__text", F.size("words").alias("n_words"), F.explode(pairs).alias("x")).select("doc_id", "__text", "n_words", "x.i", "x.pair")


def pair_order(marks: DataFrame) -> list[str]:
    """The templates' pairs by their number of occurrences in all texts, rarest first; as many rows as VOCABULARY has, at most."""
    counts = {r["pair"]: r["n"] for r in marks.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    return sorted(VOCABULARY, key=lambda p: (counts.get(p, 0), p))


def contained_templates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, __text, found, score): of each text with a block that contains a template, the labels and the largest containment."""
    marks = stage(template_pairs(docs), "pairs")
    order = pair_order(marks)
    place = {p: i + 1 for i, p in enumerate(order)}
    rows, prefix = [], set()
    for k, s in enumerate(SETS):
        ranks = sorted(place[p] for p in s)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            rows.append((r, k, TEMPLATES[k][0], i, need, ranks, [place[p] for p in TEMPLATES[k][2]], RIVALS[k]))
            prefix.add(r)
    table = docs.sparkSession.createDataFrame(rows, "t_rank int, template int, label string, t_at int, need int, t_ranks array<int>, telling array<int>, rivals array<int>")
    own = F.floor(F.col("i") / STRIDE).cast("int")
    # the block that begins before the last STRIDE words also holds the pair, unless the pair goes over its end
    places = F.when((own > 0) & (F.col("i") % STRIDE < STRIDE - 1), F.array(own, own - 1)).otherwise(F.array(own))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("pair")).cast("int")
    block = marks.select("doc_id", "__text", "n_words", F.explode(places).alias("block"), rank.alias("rank")).groupBy("doc_id", "__text", "n_words", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    block = block.where(F.exists("ranks", lambda r: r.isin(sorted(prefix)))).withColumn("length", F.least(F.lit(BLOCK), F.col("n_words") - F.col("block") * STRIDE))
    hit = block.select("*", F.posexplode("ranks").alias("b_at", "rank")).join(F.broadcast(table), F.col("rank") == F.col("t_rank"))
    possible = 1 + F.least(F.size("t_ranks") - F.col("t_at") - 1, F.size("ranks") - F.col("b_at") - 1)
    hit = hit.where((F.col("length") > F.col("need")) & (F.col("t_at") + possible >= F.col("need")))
    hit = hit.withColumn("shared", F.size(F.array_intersect("ranks", "t_ranks"))).where((F.col("shared") >= F.col("need")) & (F.size(F.array_except("telling", "ranks")) == 0))
    told = hit.groupBy("doc_id", "__text", "block").agg(F.collect_set(F.struct("template", "label", "shared", "rivals", (F.col("shared") / F.size("t_ranks")).alias("share"))).alias("hits"))
    best = F.filter("hits", lambda h: ~F.exists("hits", lambda g: (g["shared"] > h["shared"]) & F.array_contains(h["rivals"], g["template"])))
    each = told.select("doc_id", "__text", F.explode(best).alias("h"))
    return each.groupBy("doc_id", "__text").agg(F.collect_set("h.label").alias("found"), F.max("h.share").alias("score"))


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    A null text is empty: no words, no place, empty labels, score 0. Repeated rows get equal results each; rows of
    one id with other texts are told apart by the text. An empty table gives an empty table. Other columns are
    ignored. A text of fewer than BLOCK words is one block.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    hits = contained_templates(docs).withColumnsRenamed({"doc_id": "d", "__text": "t"})
    both = _base(docs).join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("__text").eqNullSafe(F.col("t")), "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        listed("base").alias("base_labels"), listed(every).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


op4 = license_labels


def _oracle() -> str:
    rows = zip(range(len(SETS)), TEMPLATES, SETS, RIVALS, strict=True)
    lists = " UNION ALL ".join(f"SELECT {k} AS template, '{x}' AS label, {s!r} AS t, {must!r}::VARCHAR[] AS telling, {rivals!r}::INT[] AS rivals" for k, (x, _, must), s, rivals in rows)
    phrases = " UNION ALL ".join(f"SELECT '{x}' AS label, {p.split()!r} AS t" for p, x in PHRASES.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 w AS (SELECT r, doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words, text FROM d),
 p AS ({phrases}),
 i AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE contains(text, 'license')),
 b AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS base FROM i, p WHERE words[i:i + len(t) - 1] = t GROUP BY r),
 t AS ({lists}),
 l AS (SELECT r, words, unnest(range(0, greatest(1, (len(words) + {STRIDE - 1}) // {STRIDE}))) AS block FROM w),
 o AS (SELECT r, block, list_distinct(list_transform(range(block * {STRIDE} + 1, least(block * {STRIDE} + {BLOCK}, len(words))), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM l),
 m AS (SELECT r, block, template, label, rivals, len(list_intersect(pairs, t)) AS shared, len(t) AS n FROM o, t WHERE list_has_all(pairs, telling)),
 k AS (SELECT * FROM m WHERE shared >= ceil({THRESHOLD} * n - 1e-9)),
 h AS (SELECT r, list(DISTINCT label) AS found, max(shared / n) AS score FROM k WHERE NOT EXISTS (SELECT 1 FROM k g WHERE g.r = k.r AND g.block = k.block AND g.shared > k.shared AND list_contains(k.rivals, g.template)) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN h USING (r)"""


ORACLE_SQL = _oracle()
