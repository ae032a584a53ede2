"""Faceted and ranked search over entries."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.steps import step

#: Search fields and the entry columns they name.
FACETS = {"project": "project_slug", "session": "session_uuid", "agent": "agent", "role": "role", "tool": "tool_name", "branch": "git_branch", "cwd": "cwd"}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class Query:
    """A parsed query: phrases that must all occur, facet values, and a half-open range of timestamps."""

    phrases: list[str] = field(default_factory=list)
    facets: dict[str, str] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None


def parse(text: str, *, on: str | None = None, since: str | None = None, until: str | None = None, **facets: str) -> Query:
    """field:value words become facets or bounds (a named argument wins, an empty value is dropped); all other words are phrases.

    `on` takes a whole day and overrides both bounds; a malformed day raises ValueError.
    """
    q = Query(facets={k: v for k, v in facets.items() if v})
    bounds = {"since": since, "until": until}
    for word in text.split():
        name, colon, value = word.partition(":")
        if colon and (name in FACETS or name in bounds):
            if value and name in FACETS:
                q.facets.setdefault(name, value)
            elif value and bounds[name] is None:
                bounds[name] = value
        else:
            q.phrases.append(word)
    if on:
        day = date.fromisoformat(on)
        bounds = {"since": day.isoformat(), "until": (day + timedelta(days=1)).isoformat()}
    q.since, q.until = bounds["since"], bounds["until"]
    return q


def matching(entries: DataFrame, q: Query) -> DataFrame:
    """Entries that pass the facets and bounds. Absent ones add no condition; a null never passes one; timestamps compare as text."""
    holds = [F.col(FACETS[k]) == v for k, v in q.facets.items()]
    if q.since:
        holds.append(F.col("timestamp") >= q.since)
    if q.until:
        holds.append(F.col("timestamp") < q.until)
    return entries.where(reduce(and_, holds)) if holds else entries


def recent(entries: DataFrame, q: Query, limit: int = 20) -> DataFrame:
    """Newest first, nulls last, ties by entry_uuid: what a query without phrases returns. The limit is the feature."""
    hit = matching(entries, q).select("entry_uuid", "session_uuid", "role", "timestamp", F.substring("text", 1, 200).alias("snippet"), F.lit(0.0).alias("rank"))
    return hit.orderBy(F.desc_nulls_last("timestamp"), "entry_uuid").limit(limit)


def _folded_letters() -> tuple[str, str]:
    """Lower-case letters that are a plain Latin letter with marks by their decomposition, and those plain letters."""
    found = {}
    for c in map(chr, range(0xC0, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and "a" <= first <= "z" and all(unicodedata.category(m) == "Mn" for m in marks):
            found[c] = first
    return "".join(found), "".join(found.values())


FOLD = _folded_letters()


def normal(text: Column) -> Column:
    """Lower-cased, accents folded, tokens of letters and digits with one space around each."""
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), *FOLD)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


def folded_phrase(phrase: str) -> str:
    """A phrase as normal() would have it, without the outer spaces."""
    folded = "".join(c for c in phrase.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(*FOLD))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded).split())


def ranked(hit: DataFrame, phrases: int, limit: int | None = None) -> DataFrame:
    """(entry_uuid, session_uuid, rank) of hits with dl, n, avgdl and each phrase's tf and df, best (least) rank first."""
    score = F.lit(0.0)
    for i in range(phrases):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        t = F.col(f"tf{i}")
        score = score + F.when(idf > 0, idf).otherwise(LEAST_IDF) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = hit.select("entry_uuid", "session_uuid", F.round(-score, 9).alias("rank")).orderBy("rank", "entry_uuid")
    return out.limit(limit) if limit else out


def bm25(entries: DataFrame, q: Query, limit: int | None = None) -> DataFrame:
    """(entry_uuid, session_uuid, rank) of entries with every phrase, best (least) rank first; for entries that no index holds.

    A phrase is consecutive tokens; one without tokens is ignored, and only such phrases match nothing. Corpus
    sizes are of all entries, not of those that pass the facets, and come in one pre-aggregated row.
    """
    phrases = [p for p in map(folded_phrase, q.phrases) if p]
    if not phrases:
        return entries.where("false").select("entry_uuid", "session_uuid", F.lit(0.0).alias("rank"))
    tokens = normal(F.col("text"))
    size = F.when(F.length(tokens) <= 2, 0).otherwise(F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit(""))) - 1)
    # a token's spaces are shared by neighbours, so occurrences are counted with the space after left in place
    tf = [F.regexp_count(tokens, F.lit(f" {p}(?= )")).cast("double").alias(f"tf{i}") for i, p in enumerate(phrases)]
    e = entries.select("*", size.cast("double").alias("dl"), *tf)
    stats = e.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    hit = matching(e, q).where(reduce(and_, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])).join(F.broadcast(stats))
    return ranked(hit, len(phrases), limit)


def contains_trigrams(entries: DataFrame, term: str) -> DataFrame:
    """Entries that contain a term of three or more characters, whatever its case; a shorter one matches nothing."""
    return entries.where(F.contains(F.lower("text"), F.lit(term.lower())) & F.lit(len(term) >= 3)).select("entry_uuid", "session_uuid")


#: A token as it stands in a text: what normal() makes one token of.
TOKEN = r"\p{Mn}*[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"


def snippet(entries: DataFrame, phrases: str | list[str], context: int = 12) -> DataFrame:
    """(entry_uuid, snippet) of entries with any of the phrases: the best window of so many tokens (1 to 64), hits in brackets.

    Of windows that begin with a hit the one with the most different phrases counts, then the one with the most hits, then the
    first; hits count if they end within it. It is then moved to have them in its middle, as far as the text goes. The text stands
    as it is; where it is cut, there is an ellipsis, and hits that overlap share their brackets. One row's expressions do it all:
    a window looks at no more hits than it has room for, so the time is linear in a text's hits.
    """
    words = [w for w in (folded_phrase(p).split() for p in ([phrases] if isinstance(phrases, str) else phrases)) if w]
    size = min(64, max(1, context))
    if not words:
        return entries.where("false").select("entry_uuid", F.lit("").alias("snippet"))
    folded = lambda t: F.translate(F.regexp_replace(F.lower(t), r"\p{Mn}", ""), *FOLD)
    x = step(entries.select("entry_uuid", F.coalesce("text", F.lit("")).alias("text")), ["entry_uuid"], tok=F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), gap=F.split("text", TOKEN, -1))
    x = step(x, ["entry_uuid", "tok", "gap"], norm=F.transform("tok", folded), n=F.size("tok"))
    found = []
    for no, w in enumerate(words):
        same = " AND ".join(f"get(norm, i + {k}) = '{t}'" for k, t in enumerate(w))
        found.append(f"CASE WHEN n >= {len(w)} THEN transform(filter(sequence(0, n - {len(w)}), i -> {same}), i -> named_struct('at', i, 'size', {len(w)}, 'no', {no})) ELSE array() END")
    x = step(x, ["entry_uuid", "tok", "gap", "n"], hits=F.expr(f"array_sort(concat({', '.join(found)}))")).where("size(hits) > 0")
    within = f"filter(slice(hits, k + 1, {size * len(words)}), x -> x.at + x.size <= h.at + {size})"
    score = "size(array_distinct(transform(w, x -> x.no))) * 999 + size(w)"
    last = f"coalesce(array_max(transform(w, x -> x.at + x.size)), h.at + {size})"
    windows = f"transform(hits, (h, k) -> transform(array({within}), w -> named_struct('score', {score}, 'back', -h.at, 'last', {last}))[0])"
    x = step(x, ["entry_uuid", "tok", "gap", "n", "hits"], best=F.expr(f"array_max({windows})"))
    x = step(x, ["entry_uuid", "tok", "gap", "n", "hits"], start=F.expr(f"greatest(0, least(-best.back - cast(floor(({size} - (best.last + best.back)) / 2) AS int), n - {size}))"))
    x = step(x, ["entry_uuid", "tok", "gap", "n", "start"], upto=F.expr(f"least(start + {size}, n)"), inside=F.expr(f"filter(hits, x -> x.at >= start AND x.at + x.size <= least(start + {size}, n))"))
    covered = "exists(inside, x -> x.at <= i AND i < x.at + x.size)"
    opens = f"CASE WHEN {covered} AND NOT exists(inside, x -> x.at < i AND i < x.at + x.size) THEN '[' ELSE '' END"
    closes = f"CASE WHEN {covered} AND NOT exists(inside, x -> x.at <= i AND i + 1 < x.at + x.size) THEN ']' ELSE '' END"
    shown = f"array_join(transform(sequence(start, upto - 1), i -> concat(CASE WHEN i > start THEN get(gap, i) ELSE '' END, {opens}, get(tok, i), {closes})), '')"
    ends = "CASE WHEN start > 0 THEN '… ' ELSE get(gap, 0) END", "CASE WHEN upto < n THEN ' …' ELSE get(gap, n) END"
    return x.select("entry_uuid", F.expr(f"concat({ends[0]}, {shown}, {ends[1]})").alias("snippet"))


def thread(entries: DataFrame, session: str, *, agents: bool = False, grep: str | None = None) -> DataFrame:
    """A session's entries with their order: by timestamp (null as empty), number and id; main agent only unless asked."""
    e = entries.where(F.col("session_uuid") == session)
    e = e if agents else e.where(F.col("agent") == "main")
    e = e if grep is None else e.where(F.contains("text", F.lit(grep)))
    return e.select("entry_uuid", "parent_uuid", "role", "agent", "tool_name", "timestamp", "seq", "text").orderBy(F.coalesce("timestamp", F.lit("")), "seq", "entry_uuid")
