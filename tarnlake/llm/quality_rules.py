"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Per text it measures lengths, symbols, stop words, repeated lines and repeated five-word windows; each row of
RULES bounds one ratio of these. Everything stays in the row: no shuffle, no user functions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import neutral

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
ENDS = ".,;:!?"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on was with as be by this are at from "
    "de la le et les en des un du une que est pour qui dans au sur par pas avec "
    "der die und den von zu das mit sich auf für ist im nicht dem eine ein als "
    "el y los se del las por con no una para su es al lo"
).split()
#: (measure, least, most): a document is kept if every measure lies within its bounds; None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("repeat_share", None, 0.20),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.30),
    ("stop_word_share", 0.04, None),
    ("dup_line_share", None, 0.40),
    ("echo_share", None, 0.30),
    ("upper_share", None, 0.50),
]




def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns __words, __n_words and so on added; internal, all names start with two underscores."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = docs.withColumn("__words", F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)))
    w = w.withColumn("__hash", F.transform("__words", lambda x: F.xxhash64(x)))
    n = F.size("__words")
    at = lambda i, k: F.get("__hash", i + k)
    w = w.withColumn(
        "__windows",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    )
    # only texts in which a window comes twice pay for the order of all their windows
    w = w.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda k, x: F.coalesce(F.get("__sorted", k)["h"] == x["h"], F.lit(False))
    w = w.withColumn("__twice", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    w = w.withColumn("__lines", lines)
    return w.select(
        *docs.columns,
        n.cast("long").alias("__n_words"),
        F.coalesce(F.length(F.array_join("__words", "")), F.lit(0)).cast("long").alias("__word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("__n_symbols"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        F.when(F.col("__twice").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate("__twice", start, step, lambda a: a["n"])).alias("__n_repeat_words"),
        F.size(F.filter("__words", lambda x: F.rtrim(F.lower(x), F.lit(ENDS)).isin(STOP_WORDS))).cast("long").alias("__n_stop"),
        F.size(F.filter("__hash", lambda h, i: F.get("__hash", i - 1) == h)).cast("long").alias("__n_echo"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("__n_upper"),
    )


def _measure(name: str) -> Column:
    c = {k: F.col(f"__{k}") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_echo", "n_upper")}
    of = lambda x, y: F.when(c[y] > 0, c[x] / c[y]).otherwise(F.lit(0.0))
    return {
        "n_words": c["n_words"],
        "repeat_share": of("n_repeat_words", "n_words"),
        "mean_word_chars": of("word_chars", "n_words"),
        "symbols_per_word": of("n_symbols", "n_words"),
        # one more than counted, so that a short text is not judged by its luck
        "stop_word_share": F.when(c["n_words"] > 0, (c["n_stop"] + 1) / c["n_words"]).otherwise(F.lit(0.0)),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "echo_share": of("n_echo", "n_words"),
        "upper_share": of("n_upper", "word_chars"),
    }[name]


def verdict(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True where every rule holds: the threshold table as one expression."""
    broken = [_measure(k) < F.lit(lo) for k, lo, _ in rules if lo is not None] + [_measure(k) > F.lit(hi) for k, _, hi in rules if hi is not None]
    return ~reduce(or_, broken)


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 20)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    A null or empty text has no words and goes; null ids and repeated rows are judged by their texts alone;
    an empty table gives an empty table.
    """
    # a projection with a row number isn't one that filters are pushed below, where they would hold the measures many times over
    d = neutral(docs, "text")
    judged = measures(d).select(*d.columns, (~base_failed() & verdict()).alias("__kept"), F.monotonically_increasing_id().alias("__row"))
    return judged.where(F.col("__kept") & (F.col("__row") >= 0)).select(*d.columns).toDF(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, the five counts, base_failed, kept; of every row, a null text having no words."""
    m = measures(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.select("doc_id", *[F.col(f"__{k}").alias(k) for k in names], base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    share = {
        "n_words": "n_words", "repeat_share": "n_repeat_words / nullif(n_words, 0)", "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbols_per_word": "n_symbols / nullif(n_words, 0)",
        "stop_word_share": "(n_stop + 1) / nullif(n_words, 0)", "dup_line_share": "n_dup_lines / nullif(n_lines, 0)", "echo_share": "n_echo / nullif(n_words, 0)", "upper_share": "n_upper / nullif(word_chars, 0)",
    }
    bounds = [f"coalesce({share[k]}, 0) >= {lo}" for k, lo, _ in RULES if lo is not None] + [f"coalesce({share[k]}, 0) <= {hi}" for k, _, hi in RULES if hi is not None]
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
 i AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
 g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS n FROM i),
 c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM g WHERE n > 1) GROUP BY r),
 m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(lines) AS n_lines,
   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
   len(list_filter(words, lambda x: rtrim(lower(x), '{ENDS}') IN ({stop}))) AS n_stop, len(list_filter(words, lambda x, i: i > 1 AND words[i - 1] = x)) AS n_echo, len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM w LEFT JOIN c USING (r)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM b"""


ORACLE_SQL = _oracle()
