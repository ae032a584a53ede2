"""The search index: postings of terms with their places, sizes of entries, and corpus sizes, as tables that are built once and kept in step.

postings: term, entry_uuid, artifact_id, session_uuid, dl, tf, places (sorted); documents: an entry's columns and its number of
tokens; totals: number of entries and of tokens, and the tokenizer. All belong to buckets of PER_BUCKET artifacts of neighbouring
numbers. A sync rewrites the buckets of the artifacts it touches, and a version file switches to them (sources/versions.py). What
a version writes lies in FOLDERS folders at most, however many buckets it has, so files grow in number with the data only; of a
folder, rows of buckets that a later version has written are passed over. Postings are sorted by term within a file, so a query
reads the row groups of its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.functions.steps import step
from tarnlake.operators import search
from tarnlake.sources.versions import Versions

#: Artifacts of a bucket.
PER_BUCKET = 1000
#: Folders of a version, each with the buckets of one remainder.
FOLDERS = 128
#: About so many tokens become postings in one task, and go into one file.
PER_FILE = 250_000
TOKENIZER = "unicode-letters-digits-folded-1"
#: Tokens of every three characters in a row, letters made small: a phrase is any part of a text, of three characters or more.
TRIGRAMS = "trigrams-lower-1"


def bucket(artifact: str, per_bucket: int = PER_BUCKET) -> Column:
    """The bucket of an artifact's number; -1 without one."""
    return F.coalesce(F.floor(F.col(artifact) / per_bucket), F.lit(-1)).cast("long")


def _tokens(text: Column, tokenizer: str) -> Column:
    """The tokens of a text, in order; of trigrams, two nulls follow them."""
    if tokenizer == TRIGRAMS:
        c = F.regexp_extract_all(F.lower(text), F.lit(r"(?s)."), F.lit(0))
        joined = lambda a, k: F.zip_with(a, F.slice(c, F.lit(k), F.size(c)), lambda x, y: F.concat(x, y))
        return joined(joined(c, 2), 3)
    return F.filter(F.split(search.normal(text), " "), lambda w: w != "")


def documents(entries: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """entries with `dl`, the number of tokens of each."""
    if tokenizer == TRIGRAMS:
        size = F.greatest(F.length(F.lower("text")) - 2, F.lit(0))
    else:
        tokens = search.normal(F.col("text"))
        size = F.when(F.length(tokens) <= 2, 0).otherwise(F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit(""))) - 1)
    return entries.withColumn("dl", F.coalesce(size, F.lit(0)).cast("long"))


def postings(docs: DataFrame, tokenizer: str = TOKENIZER, kept: Sequence[str] = ()) -> DataFrame:
    """(term, entry_uuid, artifact_id, session_uuid, dl, tf, places) of every token of documents() of entries, with columns to keep.

    Tokens are put together within their entry's row: sorted, and cut where the term changes. So only texts are dealt out, and
    not even these where the kept columns deal them out already.
    """
    of = [*kept, "entry_uuid", "artifact_id", "session_uuid", "dl"]
    x = docs.groupBy(*of).agg(F.collect_list("text").alias("texts"))
    places = F.flatten(F.transform("texts", lambda text: F.transform(_tokens(text, tokenizer), lambda w, i: F.struct(w.alias("term"), i.alias("at")))))
    # pairs that run beyond the last character end in null, and so are no tokens
    x = step(x, of, __s=F.sort_array(F.filter(places, lambda p: p["term"].isNotNull()))).where(F.size("__s") > 0)
    term = lambda i: F.get("__s", i)["term"]
    x = step(x, [*of, "__s"], __from=F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (term(i) != term(i - 1))))
    ends = F.concat(F.slice("__from", F.lit(2), F.size("__from")), F.array(F.size("__s")))
    runs = F.zip_with("__from", ends, lambda i, j: F.struct(term(i).alias("term"), (j - i).cast("long").alias("tf"), F.transform(F.slice("__s", i + 1, j - i), lambda p: p["at"]).alias("places")))
    return x.select(*of, F.inline(runs)).select(*kept, "term", *of[len(kept) :], "tf", "places")


def terms_of(phrase: str, tokenizer: str = TOKENIZER) -> dict[int, str]:
    """The tokens that tell a phrase, by their places from its start. Of trigrams every third one and the last: these hold all of its characters; under three characters there is none."""
    if tokenizer != TRIGRAMS:
        return dict(enumerate(search.folded_phrase(phrase).split()))
    low = phrase.lower()
    last = len(low) - 3
    return {k: low[k : k + 3] for k in sorted({*range(0, last, 3), last})} if last >= 0 else {}


def _occurrences(phrase: dict[int, str]) -> Column:
    """How often the tokens of a phrase stand at their places one from another, from the map `at` of places."""
    earlier = lambda term, k: F.transform(F.coalesce(F.try_element_at("at", F.lit(term)), F.array().cast("array<int>")), lambda x: x - F.lit(k))
    # places where the phrase may begin, by each of its tokens: sets, so linear in the places
    return F.size(reduce(F.array_intersect, [F.array_distinct(earlier(t, k)) for k, t in phrase.items()])).cast("double")


class Index:
    """A version of the index below a folder that driver and executors share; the last one unless a number is given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, per_bucket: int = PER_BUCKET, tokenizer: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._all = Versions(spark, self.path)
        self.version = self._all.latest() if version is None else version
        self._held = self._all.read(self.version)
        self.per_bucket = self._held["about"].get("per_bucket", per_bucket)
        self.built_by = self._held["about"].get("tokenizer")
        # another tokenizer than asked for is taken over by a rebuild only
        self.tokenizer = tokenizer or (TRIGRAMS if self.built_by == TRIGRAMS else TOKENIZER)

        self._tables: dict[str, DataFrame] = {}

    def _total(self, what: str) -> int:
        return sum(b[what] for b in self._held["buckets"].values())

    def table(self, name: str) -> DataFrame:
        """A table of this version. Its files are listed once, as a version never changes."""
        if name not in self._tables:
            if name == "totals":
                self._tables[name] = self.spark.createDataFrame([(self._total("n"), self._total("tokens"), self.built_by)], "n long, tokens long, tokenizer string")
            else:
                self._tables[name] = self._rows(name)
        return self._tables[name]

    def _rows(self, name: str, here: set[str] | None = None) -> DataFrame:
        """The rows of a table's buckets, all or those here."""
        live = {b: v["version"] for b, v in self._held["buckets"].items() if here is None or b in here}
        rows = self._all.table(self.version, name, here, dated=True)
        # what the last version wrote is all alive; other folders may hold buckets that were written again since
        if here is not None or set(live.values()) != {self.version}:
            named = F.broadcast(self.spark.createDataFrame([(int(b), v) for b, v in live.items()], "b long, v int"))
            rows = rows.join(named, (bucket("artifact_id", self.per_bucket) == F.col("b")) & (F.col("version") == F.col("v")), "left_semi")
        return rows.drop("bucket", "version")

    def touched(self, since: int) -> list[int]:
        """Buckets that are not in the folders they were in at another version."""
        old, new = self._all.read(since)["buckets"], self._held["buckets"]
        return sorted(int(b) for b in old.keys() | new.keys() if old.get(b, {}).get("tables") != new.get(b, {}).get("tables"))

    def _next(self, docs: DataFrame, replaced: set[str]) -> Index:
        """The next version: the buckets of these documents, and what this version has in buckets that aren't replaced."""
        number = self.version + 1
        own = bucket("artifact_id", self.per_bucket)
        folder = F.pmod(own, F.lit(FOLDERS))
        folders, doc_schema = self._all.write(number, "documents", docs.withColumn("bucket", folder).repartition("bucket"))
        written = self.spark.read.schema(StructType.fromJson(doc_schema)).parquet(f"{self.path}/documents/version={number}")
        sizes = {r["b"]: {"n": r["n"], "tokens": r["tokens"], "version": number} for r in written.groupBy(own.alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).collect()}
        # a folder of many tokens goes into several files; tasks are as many as the tokens need, however small their texts
        held = Counter()
        for b, size in sizes.items():
            held[b % FOLDERS] += size["tokens"]
        splits = max([1, *(-(-n // PER_FILE) for n in held.values())])
        tasks = max(1, min(len(held) * splits, 2 * -(-sum(held.values()) // PER_FILE)))
        dealt = written.withColumn("split", F.pmod(F.xxhash64("entry_uuid"), F.lit(splits))).repartition(tasks, "bucket", "split")
        posts = postings(dealt, self.tokenizer, kept=("bucket", "split")).drop("split").sortWithinPartitions("bucket", "term", "entry_uuid")
        post_folders, post_schema = self._all.write(number, "postings", posts)
        buckets = {b: v for b, v in self._held["buckets"].items() if b not in replaced and int(b) not in sizes}
        for b, size in sizes.items():
            f = str(b % FOLDERS)
            buckets[str(b)] = {"tables": {t: at[f] for t, at in (("documents", folders), ("postings", post_folders)) if f in at}, **size}
        about = {"tokenizer": self.tokenizer, "per_bucket": self.per_bucket}
        self._all.commit(number, {"buckets": buckets, "schemas": {"documents": doc_schema, "postings": post_schema}, "about": about})
        return Index(self.spark, self.path, number)

    def build(self, entries: DataFrame) -> Index:
        """The next version, of these entries alone."""
        return self._next(documents(entries, self.tokenizer), set(self._held["buckets"]))

    def sync(self, changed: DataFrame, gone: DataFrame, *, reindex: bool = False) -> Index:
        """The next version, in which the entries of the artifacts in `changed` are those there, and artifacts of `gone` (artifact_id) have none.

        Only buckets of touched artifacts are written, and only their folders read; in them a null-safe anti join drops what is
        touched. Changed entries are written once, beside the index, so their source is worked out once. An index of another
        tokenizer is refused, unless reindex is set: then all entries that stay are cut anew. The driver gets the numbers of
        the touched buckets.
        """
        other = self.built_by != self.tokenizer
        if other and not reindex:
            raise ValueError("the index was built by another tokenizer: build it anew")
        with self._all.aside(documents(changed, self.tokenizer)) as new:
            touched = new.select("artifact_id").unionByName(gone.select("artifact_id")).distinct().withColumnRenamed("artifact_id", "touched")
            here = {str(r[0]) for r in touched.select(bucket("touched", self.per_bucket)).distinct().collect()}
            kept = self._rows("documents", None if other else here & self._held["buckets"].keys())
            kept = kept.join(touched, F.col("artifact_id").eqNullSafe(F.col("touched")), "left_anti")
            kept = documents(kept.drop("dl"), self.tokenizer) if other else kept
            return self._next(kept.unionByName(new), set(self._held["buckets"]) if other else here)

    def bm25(self, q: search.Query, limit: int | None = None) -> DataFrame:
        """search.bm25() by postings: only those of the query's terms are read, and phrases are found by places. Entries are read only for facets and bounds."""
        if self.built_by and self.built_by != self.tokenizer:
            raise ValueError("the index was built by another tokenizer: build it anew")
        none = self.table("documents").select("entry_uuid", "session_uuid", F.lit(0.0).alias("rank")).where("false")
        phrases = [terms_of(p, self.tokenizer) for p in q.phrases]
        # a word without tokens says nothing, but a part of a text that is too short for this index is in none
        phrases = [p for p in phrases if p or self.tokenizer == TRIGRAMS]
        if not phrases or not all(phrases):
            return none
        terms = sorted({t for p in phrases for t in p.values()})
        posts = self.table("postings").where(F.col("term").isin(terms))
        if self.tokenizer == TRIGRAMS and len(phrases) == 1 and len(terms) > 1:
            # the list of the rarest token tells which entries of the others are looked at
            sizes = {r["term"]: r["n"] for r in posts.groupBy("term").agg(F.count("*").alias("n")).collect()}
            rarest = min(terms, key=lambda t: sizes.get(t, 0))
            few = posts.where(F.col("term") == rarest).select(F.col("entry_uuid").alias("e"), F.col("artifact_id").alias("a"))
            posts = posts.join(few, (F.col("entry_uuid") == F.col("e")) & F.col("artifact_id").eqNullSafe(F.col("a")), "left_semi")
        places = F.map_from_entries(F.collect_list(F.struct("term", "places")))
        by_entry = posts.groupBy("entry_uuid", "artifact_id").agg(places.alias("at"), F.first("session_uuid").alias("session_uuid"), F.first("dl").cast("double").alias("dl"))
        counts = [_occurrences(p).alias(f"tf{i}") for i, p in enumerate(phrases)]
        found = by_entry.select("entry_uuid", "artifact_id", "session_uuid", "dl", *counts)
        n, tokens = self._total("n"), self._total("tokens")
        stats = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]).select("*", F.lit(n).alias("n"), F.lit(tokens / n if n else 0.0).alias("avgdl"))
        hit = found.where(reduce(and_, [F.col(f"tf{i}") > 0 for i in range(len(phrases))]))
        if q.facets or q.since or q.until:
            passing = search.matching(self.table("documents"), q).select("entry_uuid", "artifact_id")
            hit = hit.join(passing, (hit.entry_uuid == passing.entry_uuid) & hit.artifact_id.eqNullSafe(passing.artifact_id), "left_semi")
        return search.ranked(hit.drop("artifact_id").join(F.broadcast(stats)), len(phrases), limit)
