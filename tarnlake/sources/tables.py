"""The session model's relations, derived from the driver's tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ["transcript", "subagent", "subagent-meta", "tool-result", "history", "mcp", "scratch-file", "snapshot", "paste"]
INDEXABLE = ["transcript", "subagent", "tool-result", "mcp", "snapshot", "paste", "history"]
STORED_ROLES = ["transcript", "subagent", "transcript", "history", "paste", "snapshot", "scratch-file", "tool-result"]
TOOLS = ["Bash", "Read", "Edit"]
#: The moment that age rules take as now; always an argument of the operators.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    """The value at a place counted from 0; null beyond."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn of a conversation, with the facets that search filters on."""
    c = table(spark, sf_dir, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("entry_uuid"),
        F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent_uuid"),
        F.concat(F.lit("conv-"), "conv_id").alias("session_uuid"),
        F.col("conv_id").alias("artifact_id"),
        "role",
        F.when(F.col("conv_id") % 5 == 0, "sub").otherwise("main").alias("agent"),
        F.when(F.col("role") == "assistant", pick(TOOLS, F.col("turn") % 4)).alias("tool_name"),
        F.concat(F.lit("proj-"), F.col("conv_id") % 7).alias("project_slug"),
        F.concat(F.lit("/w/"), F.col("conv_id") % 4).alias("cwd"),
        pick(["main", "dev"], F.col("conv_id") % 3).alias("git_branch"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("turn").alias("seq"),
        "text",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("entry_count"))
    return c.select(
        F.concat(F.lit("conv-"), "conv_id").alias("uuid"), F.concat(F.lit("proj-"), F.col("conv_id") % 7).alias("project_slug"),
        pick(["main", "dev"], F.col("conv_id") % 3).alias("git_branch"), "entry_count",
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured document: its ledger row. Hashes of every tenth row's live content differ (drift) in live_sha256."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("conv-"), F.col("doc_id") % 50).alias("session_uuid"),
        pick(ROLES, F.col("doc_id") % 9).alias("role"),
        F.concat_ws("/", "source", "doc_id").alias("source_path"),
        "source",
        sha.alias("source_sha256"),
        F.octet_length("text").cast("long").alias("source_bytes"),
        F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("+")), 256)).otherwise(sha).alias("live_sha256"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(sha).alias("content_sha256"),
        (F.col("doc_id") % 17 == 0).cast("int").alias("redacted"),
        (F.col("doc_id") % 19 == 0).cast("int").alias("quarantined"),
        F.when(F.col("doc_id") % 3 > 0, "2024-01-20T00:00:00").alias("verified_at"),
        (F.col("doc_id") % 40).alias("age_days"),
        (F.col("doc_id") % 11 > 0).alias("archived"),
        "text",
    )


def stored(spark: SparkSession, sf_dir: str, transcripts) -> DataFrame:
    """One row per conversation as a stored artifact: transcripts (artifact, content) as they are, and in some other roles all texts of the conversation below one another."""
    e = entries(spark, sf_dir).withColumn("source_path", F.concat(F.lit("/p/"), "artifact_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    first = lambda c: F.first(c).alias(c)
    a = e.groupBy("artifact_id").agg(joined.alias("plain"), *map(first, ("session_uuid", "source_path", "project_slug", "cwd", "git_branch", "agent")))
    a = a.join(transcripts, F.col("artifact_id") == F.col("artifact"))
    role = pick(STORED_ROLES, F.col("artifact_id") % len(STORED_ROLES))
    return a.select("artifact_id", role.alias("role"), "session_uuid", "source_path", "project_slug", "cwd", "git_branch", F.concat(F.lit("1."), F.col("artifact_id") % 3).alias("cc_version"), "agent", F.when(role.isin("transcript", "subagent"), F.col("content")).otherwise(F.col("plain")).alias("content"))


#: The same relations in DuckDB's dialect, as common table expressions.
SQL = """entries AS (SELECT conv_id || ':' || turn AS entry_uuid, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_uuid, 'conv-' || conv_id AS session_uuid, conv_id AS artifact_id, role,
  CASE WHEN conv_id % 5 = 0 THEN 'sub' ELSE 'main' END AS agent, CASE WHEN role = 'assistant' THEN ['Bash', 'Read', 'Edit'][(turn % 4) + 1] END AS tool_name, 'proj-' || (conv_id % 7) AS project_slug,
  '/w/' || (conv_id % 4) AS cwd, ['main', 'dev'][(conv_id % 3) + 1] AS git_branch, strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') AS timestamp, turn AS seq, text FROM conversations),
sessions AS (SELECT 'conv-' || conv_id AS uuid, 'proj-' || (conv_id % 7) AS project_slug, ['main', 'dev'][(conv_id % 3) + 1] AS git_branch, count(*) AS entry_count FROM conversations GROUP BY conv_id),
artifacts AS (SELECT doc_id AS id, 'conv-' || (doc_id % 50) AS session_uuid, ['transcript', 'subagent', 'subagent-meta', 'tool-result', 'history', 'mcp', 'scratch-file', 'snapshot', 'paste'][(doc_id % 9) + 1] AS role, source || '/' || doc_id AS source_path, source,
  sha256(text) AS source_sha256, octet_length(encode(text)) AS source_bytes, CASE WHEN doc_id % 10 = 0 THEN sha256(text || '+') ELSE sha256(text) END AS live_sha256, CASE WHEN doc_id % 13 = 0 THEN '' ELSE sha256(text) END AS content_sha256,
  (doc_id % 17 = 0)::INT AS redacted, (doc_id % 19 = 0)::INT AS quarantined, CASE WHEN doc_id % 3 > 0 THEN '2024-01-20T00:00:00' END AS verified_at, doc_id % 40 AS age_days, doc_id % 11 > 0 AS archived, text FROM documents)"""
