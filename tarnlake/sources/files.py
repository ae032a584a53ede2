"""File sources and sinks: discovery by path, whole files under a size cap, concatenated zstd frames, JSON sidecars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.workers import MOST_HELD, give_back

#: Fixed value: larger files are not read.
MOST_BYTES = 256 * 1024 * 1024
#: Families of files and their roles.
FAMILIES = {"transcript": ["transcript"], "subagents": ["subagent", "subagent-meta"], "tool-results": ["tool-result"], "history": ["history"], "mcp": ["mcp"], "snapshots": ["snapshot"], "paste": ["paste"], "scratch": ["scratch-file"]}


def role_of(path: Column) -> Column:
    """What a file is, by its path; null for files of no family."""
    return (
        F.when(path.rlike(r"/projects/[^/]+/[^/]+\.jsonl$"), "transcript").when(path.rlike(r"/subagents/[^/]+\.meta\.json$"), "subagent-meta").when(path.rlike(r"/subagents/[^/]+\.jsonl$"), "subagent")
        .when(path.rlike(r"/tool-results/[^/]+\.txt$"), "tool-result").when(path.rlike(r"/history\.jsonl$"), "history").when(path.rlike(r"/mcp-logs-[^/]+/[^/]+\.jsonl$"), "mcp")
        .when(path.rlike(r"/shell-snapshots/[^/]+\.sh$"), "snapshot").when(path.rlike(r"/paste-cache/[^/]+\.txt$"), "paste")
    )


def include(families: str) -> list[str]:
    """Roles of a comma-separated list of families, once each; an `all` stands for every one, wherever it is in the list; an unknown name before it raises ValueError."""
    names: list[str] = []
    for x in (x.strip() for x in families.split(",")):
        if x == "all":
            names = list(FAMILIES)
            break
        if x and x not in FAMILIES:
            raise ValueError(f"unknown family: {x}")
        names += [x] if x else []
    return list(dict.fromkeys(r for x in names for r in FAMILIES[x]))


def discover(spark: SparkSession, root: str, families: str = "transcript,subagents,tool-results") -> DataFrame:
    """(path, role, project, session, server, length, modified, content) of the files of some families under a root.

    The size cap is a filter on the listing, so larger files are never opened; unused contents are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    path = F.col("path")
    part = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return files.select(
        "path", role_of(path).alias("role"), part(r"/projects/([^/]+)/").alias("project"), part(r"/projects/[^/]+/([^/.]+)").alias("session"), part(r"/mcp-logs-([^/]+)/").alias("server"),
        "length", F.col("modificationTime").alias("modified"), "content",
    ).where(F.col("role").isin(include(families)))


def with_agents(found: DataFrame) -> DataFrame:
    """Transcripts of subagents with `agent` from the sidecar beside them: its agentType, or subagent; other files are of main."""
    side = found.where("role = 'subagent-meta'").select(F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("of"), F.get_json_object(F.decode("content", "UTF-8"), "$.agentType").alias("kind"))
    agent = F.when(F.col("role") == "subagent", F.coalesce("kind", F.lit("subagent"))).otherwise("main")
    return found.where("role <> 'subagent-meta'").join(side, F.col("path") == F.col("of"), "left").withColumn("agent", agent).drop("of", "kind")


def _converted(batches: Iterator[pa.RecordBatch], convert: Callable[[bytes], bytes | None]) -> Iterator[pa.RecordBatch]:
    """Batches (path, content) with each content converted, about MOST_HELD bytes of results at a time."""
    for b in batches:
        start, out, size = 0, [], 0
        for i, x in enumerate(b.column(1)):
            content = x.as_py()
            out.append(None if content is None else convert(content))
            size += len(content or b"") + len(out[-1] or b"")
            if size >= MOST_HELD or i + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(out)), pa.array(out, pa.binary())], ["path", "content"])
                start, out, size = i + 1, [], 0
        give_back()


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io

    import zstandard

    def whole(frames: bytes) -> bytes | None:
        try:
            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(frames), read_across_frames=True).read()
        except zstandard.ZstdError:
            return None

    yield from _converted(batches, whole)


def decoded(stored: DataFrame) -> DataFrame:
    """(path, content) of stored (path, content): all zstd frames one after another; null if they cannot be read."""
    return stored.select("path", "content").mapInArrow(_frames, "path string, content binary")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    # one compressor for all: its tables are large
    yield from _converted(batches, zstandard.ZstdCompressor(level=19).compress)


def decoded_column(stored: Column) -> Column:
    """The content of stored frames, as decoded() has it; rows stay in the JVM."""
    @F.arrow_udf("binary")
    def run(frames: pa.Array) -> pa.Array:
        batches = iter([pa.RecordBatch.from_arrays([pa.nulls(len(frames)), frames], ["path", "content"])])
        return pa.concat_arrays([b.column(1) for b in _frames(batches)] or [pa.array([], pa.binary())])

    return run(stored)


def encoded(files: DataFrame) -> DataFrame:
    """(path, content) with each content as one zstd frame."""
    return files.select("path", "content").mapInArrow(_encode, "path string, content binary")


def append_log(records: DataFrame, path: str) -> None:
    """Adds records to an audit log of JSON lines."""
    records.write.mode("append").json(path)
