"""What the index holds of stored artifacts: an entry per line of a transcript, or one for the whole of another text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import archive, scanning, transcripts
from tarnlake.operators.postings import Index

#: What an entry takes from its artifact.
FACETS = ["session_uuid", "source_path", "project_slug", "cwd", "git_branch", "cc_version"]
COLUMNS = ["entry_uuid", "parent_uuid", "session_uuid", "artifact_id", "source_path", "role", "agent", "tool_name", "project_slug", "cwd", "git_branch", "cc_version", "timestamp", "has_redaction", "seq", "text"]


def indexed(artifacts: DataFrame) -> DataFrame:
    """Entries (COLUMNS) of stored artifacts (artifact_id, role, content string, agent, and FACETS).

    Transcripts, those of subagents too, give an entry per line that parses to one; tool results, logs, snapshots, pastes and
    histories give one entry named art:<artifact>, of role and agent main, without a timestamp; other roles give none. Texts of
    white space only are dropped. has_redaction is judged on the whole text, and the text is cut to the indexed length after
    that. A null content is empty; an artifact without an agent is of main. Facets are joined to entries by artifact: they are
    small, and AQE broadcasts them where they fit.
    """
    a = archive.modes(artifacts)
    lines = transcripts.lines(a.where("mode = 'entries'").select(F.col("artifact_id").alias("artifact"), F.coalesce("content", F.lit("")).alias("content")))
    parsed = transcripts.parsed_entries(transcripts.parsed(lines))
    facets = a.where("mode = 'entries'").select(F.col("artifact_id").alias("of"), F.coalesce("agent", F.lit("main")).alias("agent"), *FACETS)
    entries = parsed.join(facets, F.col("artifact") == F.col("of")).withColumn("artifact_id", F.col("of"))
    whole = a.where("mode = 'document'").where(~F.coalesce("content", F.lit("")).rlike(transcripts.BLANK))
    none = F.lit(None).cast("string")
    single = whole.select(
        F.concat(F.lit("art:"), "artifact_id").alias("entry_uuid"), none.alias("parent_uuid"), none.alias("timestamp"), "role", F.lit("main").alias("agent"),
        F.col("content").alias("text"), none.alias("tool_name"), "artifact_id", F.lit(0).cast("long").alias("seq"), *FACETS,
    )
    columns = [c for c in COLUMNS if c != "has_redaction"]
    both = entries.select(*columns).unionByName(single.select(*columns))
    return both.withColumn("has_redaction", scanning.redacted_mark(F.col("text"))).withColumn("text", scanning.bounded(F.col("text"))).select(*COLUMNS)


def skipped_lines(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, n): lines of transcripts that don't parse, for index_report()."""
    a = archive.modes(artifacts).where("mode = 'entries'").select(F.col("artifact_id").alias("artifact"), F.coalesce("content", F.lit("")).alias("content"))
    return transcripts.parsed(transcripts.lines(a)).groupBy(F.col("artifact").alias("artifact_id")).agg(F.count_if("malformed").alias("n"))


def build_index(spark: SparkSession, artifacts: DataFrame, path: str, **options: int) -> Index:
    """An index of all that stored artifacts hold, from their contents alone."""
    return Index(spark, path, **options).build(indexed(artifacts))


def sync_index(index: Index, artifacts: DataFrame, watermark: DataFrame) -> tuple[Index, DataFrame]:
    """The index after a run, and its watermarks: artifacts (source_sha256 as well) whose content the watermark (source_path, source_sha256, ...) doesn't have are read again.

    Artifacts with equal content are neither read nor written; what stands in no bucket of a changed one stays in its files.
    Two artifacts of one content are told apart by their paths.
    """
    done = watermark.select(F.col("source_path").alias("p"), F.col("source_sha256").alias("h"))
    stale = artifacts.join(done, (F.col("source_path") == F.col("p")) & (F.col("source_sha256") == F.col("h")), "left_anti")
    entries = indexed(stale)
    new = index.sync(entries, stale.select("artifact_id"))
    marks = new.table("documents").groupBy(F.col("artifact_id").alias("of")).agg(F.count("*").alias("doc_count"))
    fresh = stale.join(marks, F.col("artifact_id") == F.col("of"), "left").select("source_path", "source_sha256", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))
    kept = watermark.join(fresh.select(F.col("source_path").alias("f")), F.col("source_path") == F.col("f"), "left_anti")
    return new, kept.select("source_path", "source_sha256", "doc_count").unionByName(fresh)
