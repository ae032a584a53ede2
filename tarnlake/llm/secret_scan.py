"""Secret scans: fixed patterns, and a battery of randomness tests on every token that could encode a key.

A token is a maximal run of 20 or more key characters with a letter and a digit. Its encoding is inferred (hex,
base32, or the base64 family), its characters become numbers of that alphabet, and three tests measure how far they
are from drawn at random: chi-squared for a uniform alphabet, runs of one sort of character (upper case, lower case, digits
and the rest; for the one-case encodings numbers below and above the middle), and serial correlation. Each gives a standard
normal deviate for random tokens and a large one for readable ones; their joint deviate is the token's score.

What is controlled is the share of readable tokens among the reported ones. The null hypothesis is that a token is a
readable identifier: scores of readable tokens of each encoding and length class, made by rule, give its mean and spread,
and a token's p-value is the chance of a readable one to look at least as random. In each length class the
Benjamini-Hochberg step-up procedure at rate Q decides which tokens are reported. Places come from splitting a text at a
pattern and summing lengths over a window of its own pieces. Only DataFrame operations; documents are read for matches once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.shared import stage

#: The base patterns; matches are kept if the group has so many characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
KINDS = ["assign", "access", "hex"]
#: A run of key characters with a digit and a letter; it is tried at the start of a run only.
TOKEN = r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})"
Q = 0.05
#: Lower ends of the length classes.
CLASSES = (20, 24, 32, 40, 48, 64, 96, 128)
#: Parts of readable identifiers, and readable tokens made of them for each encoding and length class.
PARTS = [
    "user", "name", "version", "the", "readable", "identifier", "config", "path", "index", "file", "value", "request", "response", "handler", "session", "data", "test", "result", "key", "public", "order", "date", "time", "count",
    "list", "node", "tree", "cache", "buffer", "stream", "worker", "queue", "event", "2024", "01", "7", "123", "v2", "api", "http", "en", "release", "final", "backup", "report", "of", "tion", "ing", "ent", "er",
]
HEX_PARTS = ["00", "000", "0000", "ff", "dead", "beef", "cafe", "face", "added", "1234", "2024", "0101", "12", "facade", "decade", "beaded", "1000", "feed", "5555", "99"]
READABLE = 1500
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _normal_tail(z: Column) -> Column:
    """P(Z > z): for z over 3 by the first terms of its asymptotic series (never below the true value's scale), else by a logistic of an odd cubic, off by 2e-4 at most."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    far = F.exp(-z * z / 2) / (z * (2 * 3.141592653589793) ** 0.5) * (1 - 1 / (z * z) + 3 / (z * z * z * z))
    return F.when(z > 3, far).otherwise(1 / (1 + F.exp(z * 1.5976 + z * z * z * 0.070565992)))


def battery(tokens: DataFrame) -> DataFrame:
    """(…, encoding, score): tokens (a column `value`) with their inferred encoding and how random they look: about standard normal for random ones, far below for readable ones."""
    bare = F.rtrim("value", F.lit("="))
    t = tokens.withColumn(
        "encoding",
        F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"),
    )
    alphabet = F.when(F.col("encoding") == "hex", "0123456789abcdef").when(F.col("encoding") == "base32", BASE64[:26] + "234567").otherwise(BASE64)
    text = F.when(F.col("encoding") == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    t = t.withColumn("__alphabet", alphabet).withColumn("__v", F.transform(F.split(text, ""), lambda c: F.instr(F.col("__alphabet"), c) - 1))
    t = t.withColumn("__k", F.length("__alphabet").cast("double")).withColumn("__n", F.size("__v").cast("double"))
    n, k = F.col("__n"), F.col("__k")
    sort = lambda v: F.when(k == 64, F.when(v < 26, 0).when(v < 52, 1).otherwise(2)).otherwise(F.when(v < k / 2, 0).otherwise(1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    t = (
        t.withColumn("__squares", total(F.transform(F.sequence(F.lit(0), F.length("__alphabet") - 1), lambda j: F.pow(F.size(F.filter("__v", lambda v: v == j)), F.lit(2.0)))))
        .withColumn("__mean", total(F.transform("__v", lambda v: v.cast("double"))) / n)
        .withColumn("__sorts", F.transform("__v", sort))
        .withColumn("__changes", F.size(F.filter("__sorts", lambda v, i: (i > 0) & (v != F.get("__sorts", i - 1)))).cast("double"))
        .withColumn("__var", total(F.transform("__v", lambda v: F.pow(v - F.col("__mean"), F.lit(2.0)))))
        .withColumn("__cov", total(F.transform("__v", lambda v, i: F.when(i > 0, (v - F.col("__mean")) * (F.get("__v", i - 1) - F.col("__mean"))).otherwise(0.0))))
    )
    chi = (k / n * F.col("__squares") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    # of two neighbours drawn at random, this is the chance to be of different sorts
    change = F.when(k == 64, 1 - (26.0**2 + 26.0**2 + 12.0**2) / 64.0**2).otherwise(0.5)
    runs = ((n - 1) * change - F.col("__changes")) / F.sqrt((n - 1) * change * (1 - change))
    serial = F.when(F.col("__var") > 0, (F.col("__cov") / F.col("__var") + 1 / n) * F.sqrt(n)).otherwise(12.0)
    # one-sided: too few different characters, too few runs, neighbours alike
    joint = -(chi + runs + F.greatest(serial, F.lit(-1.0))) / 3.0**0.5
    return t.withColumn("score", joint).drop(*[f"__{x}" for x in ("alphabet", "v", "k", "n", "squares", "mean", "sorts", "changes", "var", "cov")])


def length_class(value: Column) -> Column:
    size = F.length(F.rtrim(value, F.lit("=")))
    return reduce(lambda c, lo: F.when(size >= lo, lo).otherwise(c), CLASSES[1:], F.lit(CLASSES[0]))


def readable_tokens(spark: SparkSession) -> DataFrame:
    """(value): READABLE tokens of each length class and encoding, made by rule: parts of identifiers in snake case, camel case, with dashes, or one after another."""
    rows = spark.range(0, READABLE * len(CLASSES) * 3, numPartitions=4)
    form, i = F.col("id") % 3, F.col("id") % len(CLASSES)
    pick = lambda parts, j: F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.xxhash64(F.col("id"), j), F.lit(len(parts))) + 1).cast("int"))
    ends = [*CLASSES[1:], 160]
    size = F.element_at(F.array(*map(F.lit, CLASSES)), (i + 1).cast("int"))
    size = size + F.pmod(F.xxhash64("id", F.lit("size")), F.element_at(F.array(*map(F.lit, ends)), (i + 1).cast("int")) - size).cast("int")
    places = F.sequence(F.lit(1), F.lit(90))
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(4))
    words = F.transform(places, lambda j: pick(PARTS, j))
    base64 = F.when(style == 0, F.array_join(words, "_")).when(style == 1, F.array_join(words, "-")).when(style == 2, F.array_join(F.transform(words, F.initcap), "")).otherwise(F.array_join(words, ""))
    base32 = F.translate(F.upper(F.array_join(words, "")), "01789", "")
    value = F.when(form == 0, F.array_join(F.transform(places, lambda j: pick(HEX_PARTS, j)), "")).when(form == 1, base32).otherwise(base64)
    return rows.select(F.substr(value, F.lit(1), size).alias("value"))


def readable_scores(spark: SparkSession) -> DataFrame:
    """(of_encoding, of_class, mean, spread): of readable tokens; at most three rows a length class."""
    scored = battery(readable_tokens(spark)).withColumn("class", length_class(F.col("value")))
    return scored.groupBy(F.col("encoding").alias("of_encoding"), F.col("class").alias("of_class")).agg(F.avg("score").alias("mean"), F.stddev("score").alias("spread"))


def tested(tokens: DataFrame) -> DataFrame:
    """(…, class, encoding, p): the chance of a readable token of the encoding and length class to look at least as random."""
    scored = battery(tokens).withColumn("class", length_class(F.col("value")))
    near = scored.join(F.broadcast(readable_scores(tokens.sparkSession)), (F.col("encoding") == F.col("of_encoding")) & (F.col("class") == F.col("of_class")), "left")
    return near.withColumn("p", F.coalesce(_normal_tail((F.col("score") - F.col("mean")) / F.col("spread")), F.lit(1.0))).drop("of_encoding", "of_class", "mean", "spread", "score")


def discoveries(p_values: DataFrame, q: float = Q) -> DataFrame:
    """(of, limit): per length class the largest step that Benjamini-Hochberg rejects at rate q; classes without one are absent.

    p-values are rounded up to hundredths of their decimal logarithm and counted, so that the order statistics
    come from a small table of counts whatever the number of tokens.
    """
    counts = p_values.groupBy("class", "step").agg(F.count("*").alias("n"))
    own = Window.partitionBy("class")
    upto = F.sum("n").over(own.orderBy("step"))
    ranked = counts.withColumn("bound", F.lit(q) * upto / F.sum("n").over(own)).where(F.pow(F.lit(10.0), F.col("step") / 100) <= F.col("bound"))
    return ranked.groupBy(F.col("class").alias("of")).agg(F.max("step").alias("limit"))


#: Kind, pattern, group that is measured, its least length; in the order of the kinds.
SOUGHT = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 1, 16), ("hex", HEX, 1, 32), ("random", TOKEN, 1, CLASSES[0])]


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, no, kind, start, end, value) of each match of each pattern whose group is long enough; one pass over the texts."""
    text = F.col("text")
    per_kind = []
    for no, (kind, pattern, group, least) in enumerate(SOUGHT):
        pieces = F.arrays_zip(
            F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
        )
        short = F.transform(pieces, lambda x: F.struct(F.length(x["gaps"]).alias("gap"), F.length(x["all"]).alias("length"), x["part"].alias("value")))
        per_kind.append(F.when(text.rlike(pattern), F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), short.alias("pieces"))))
    got = docs.select("doc_id", "__text", F.explode(F.array_compact(F.array(*per_kind))).alias("k"))
    got = got.select("doc_id", "__text", "k.no", "k.kind", "k.least", F.posexplode("k.pieces").alias("at", "x")).where("x.length is not null").select("doc_id", "__text", "no", "kind", "least", "at", "x.*")
    got = got.dropDuplicates(["doc_id", "__text", "no", "at"])
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("doc_id", "__text", "no").orderBy("at"))
    got = got.withColumn("end", end).where(F.length("value") >= F.col("least"))
    return got.select("doc_id", "__text", "no", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, no, kind, start, end): base spans, and `random` ones that no base span overlaps; __text is the text's hash."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("__text"), F.coalesce("text", F.lit("")).alias("text"))
    found = stage(_found(docs), "matches")
    p_values = tested(found.where("no = 3")).withColumn("step", F.greatest(F.ceil(F.log10(F.greatest("p", F.lit(1e-300))) * 100), F.lit(-30000)).cast("int"))
    secret = p_values.join(discoveries(p_values), F.col("class") == F.col("of")).where("step <= limit")
    spans = found.where("no < 3").drop("value").unionByName(secret.select("doc_id", "__text", "no", "kind", "start", "end"))
    own = Window.partitionBy("doc_id", "__text")
    before = F.max(F.when(F.col("no") < 3, F.col("end"))).over(own.orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("no") < 3, F.col("start"))).over(own.orderBy(F.desc("start"), F.desc("no")).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return spans.where((F.col("no") < 3) | clear).drop("before", "after")


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans; of every row of docs.

    A null or empty text has no span (the hash is that of an empty string). Repeated rows get equal results each,
    rows of one id with other texts are told apart by the text; an empty table gives an empty table; other
    columns are ignored.
    """
    spans = secret_spans(docs)
    item = F.struct("start", "no", F.concat_ws(":", "kind", "start", "end").alias("said"))
    per = spans.groupBy(F.col("doc_id").alias("d"), F.col("__text").alias("t")).agg(
        F.sort_array(F.collect_list(item)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("__text"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("__text").eqNullSafe(F.col("t")), "left")
    said = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["said"]), ","), F.lit(""))
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter("all", lambda x: x["no"] < 3)), 256).alias("base_sha256"), said(F.col("all")).alias("spans"),
    )
