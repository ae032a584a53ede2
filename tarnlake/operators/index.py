"""Keeping the search index and the ledger in step with what was captured: replacements, overlays, watermarks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokenizers that an index can be built with; the first is what one without a record was built with.
TOKENIZERS = ("unicode61", "trigram")


class TokenizerMismatch(ValueError):
    """An index was built with another tokenizer than is asked for: it has to be rebuilt as a whole."""


def tokenizer_for(recorded: str | None, asked: str, *, rebuild: bool = False) -> str:
    """The tokenizer to go on with. Another one than recorded is taken only by a rebuild; an unknown one raises ValueError."""
    if asked not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {asked}")
    if not rebuild and (recorded or TOKENIZERS[0]) != asked:
        raise TokenizerMismatch(f"built with {recorded or TOKENIZERS[0]}, asked for {asked}")
    return asked


def replaced(old: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key wasn't touched, and new's: a touched key without new rows loses all it had.

    Findings and entries are kept this way by artifact. Null keys of old are kept. `touched` holds keys only, so AQE
    broadcasts it when it is small and shuffles old by key when it isn't.
    """
    return old.join(touched.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without_session(rows: DataFrame, session: str) -> DataFrame:
    """Rows of all other sessions; those of no session stay."""
    return rows.where(~F.col("session_uuid").eqNullSafe(F.lit(session)))


def watermarked(old: DataFrame, entries: DataFrame, captured: DataFrame, now: str) -> DataFrame:
    """(source_path, source_sha256, doc_count, indexed_at): watermarks after the entries of captured (artifact_id, source_path, source_sha256).

    An artifact without entries gets one of no documents, so it isn't looked at again until it changes.
    """
    counts = entries.groupBy(F.col("artifact_id").alias("a")).agg(F.count("*").alias("n"))
    done = captured.join(counts, F.col("artifact_id") == F.col("a"), "left").select("source_path", "source_sha256", F.coalesce("n", F.lit(0)).alias("doc_count"), F.lit(now).alias("indexed_at"))
    return replaced(old, done, done, "source_path")


def index_report(candidates: DataFrame, watermark: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row (up_to_date, to_index, skipped_lines): candidates (artifact_id, source_path, source_sha256) by their watermark, and malformed lines (artifact_id, n) of those to index."""
    w = watermark.select(F.col("source_path").alias("p"), F.col("source_sha256").alias("h"))
    x = candidates.join(w, (F.col("source_path") == F.col("p")) & (F.col("source_sha256") == F.col("h")), "left").withColumn("same", F.col("p").isNotNull())
    x = x.join(skipped.select(F.col("artifact_id").alias("a"), "n"), F.col("artifact_id") == F.col("a"), "left")
    return x.agg(F.count_if("same").alias("up_to_date"), F.count_if(~F.col("same")).alias("to_index"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("n"))), F.lit(0)).cast("long").alias("skipped_lines"))


def rescan_updated(artifacts: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """artifacts with stored hash, size and flags of changes (id, stored_sha256, stored_bytes, redacted, quarantined) and verified now.

    What tells the source (its path, hash, size and session) stays as it was; artifacts without a change stay as they are.
    """
    c = changes.select(F.col("id").alias("__id"), *[F.col(n).alias(f"__{n}") for n in ("stored_sha256", "stored_bytes", "redacted", "quarantined")])
    x = artifacts.join(c, F.col("id") == F.col("__id"), "left")
    new = {n: F.when(F.col("__id").isNotNull(), F.col(f"__{n}")).otherwise(F.col(n)) for n in ("stored_sha256", "stored_bytes", "redacted", "quarantined")}
    new["verified_at"] = F.when(F.col("__id").isNotNull(), F.lit(now)).otherwise(F.col("verified_at"))
    return x.select(*[new.get(n, F.col(n)).alias(n) for n in artifacts.columns])


def overlaid(prior: DataFrame, run: DataFrame) -> DataFrame:
    """Manifest records after a run: this run's by (session_uuid, source), and prior ones that it didn't touch."""
    keys = ["session_uuid", "source"]
    return prior.join(run.select(*keys).distinct(), keys, "left_anti").select(*prior.columns).unionByName(run.select(*prior.columns))


def summary(records: DataFrame) -> DataFrame:
    """(session_uuid, artifacts, findings, redacted, quarantined): the scan summary of each session's records."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return records.groupBy("session_uuid").agg(F.count("*").alias("artifacts"), total("findings"), total("redacted"), F.coalesce(F.bool_or("quarantined"), F.lit(False)).alias("quarantined"))
