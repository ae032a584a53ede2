"""Incremental capture as a stream: each micro-batch of snapshots is planned against the ledger and merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.operators.ledger import capture_plan, upsert
from tarnlake.sources.versions import Versions

LEDGER = "path string, offset bigint, sha256 string"
#: Buckets of the ledger, by path: a batch reads and writes those of its paths.
BUCKETS = 64


def next_ledger(batch: DataFrame, prior: DataFrame) -> DataFrame:
    """The ledger after a batch of (path, content): captured up to the last newline, hashed over that beginning."""
    plan = capture_plan(batch, prior).where("plan <> 'skip'").select(F.col("path").alias("p"), "end")
    done = batch.join(plan, F.col("path") == F.col("p")).select("path", F.col("end").alias("offset"), F.sha2(F.expr("substr(content, 1, end)"), 256).alias("sha256"))
    return upsert(prior, done, "path", latest="offset")


def ledger(spark: SparkSession, ledger_dir: str, version: int | None = None) -> DataFrame:
    """The ledger as of a version (the last one by default); versions are numbered from 1."""
    held = Versions(spark, ledger_dir)
    number = held.latest() if version is None else version
    return held.table(number, "rows").select("path", "offset", "sha256") if number else spark.createDataFrame([], LEDGER)


def merged(spark: SparkSession, batch: DataFrame, number: int, ledger_dir: str, buckets: int = BUCKETS) -> None:
    """Merges the batch of a number into the ledger, by a new version of the buckets that its paths fall into; a batch that is in it already adds nothing.

    Folders that neither this version nor the one before names are deleted, so a reader of the one before can end.
    """
    held = Versions(spark, ledger_dir)
    last = held.latest()
    v = held.read(last)
    if v["about"].get("batch", -1) >= number:
        return
    bucket = F.pmod(F.xxhash64("path"), F.lit(v["about"].get("buckets", buckets))).cast("long")
    touched = {str(r[0]) for r in batch.select(bucket).distinct().collect()}
    if not touched:
        return
    prior = held.table(last, "rows", touched).select("path", "offset", "sha256") if last else spark.createDataFrame([], LEDGER)
    rows = next_ledger(batch, prior).withColumn("bucket", bucket).repartition("bucket")
    folders, schema = held.write(last + 1, "rows", rows)
    stay = {b: x for b, x in v["buckets"].items() if b not in touched} | {b: {"tables": {"rows": f}} for b, f in folders.items()}
    held.commit(last + 1, {"buckets": stay, "schemas": {"rows": schema}, "about": {"batch": number, "buckets": v["about"].get("buckets", buckets)}})
    held.forget(last - 1)


def capture_stream(spark: SparkSession, snapshots: DataFrame, ledger_dir: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over snapshots (path, content) and runs it over all there is.

    A batch that runs again after a failure counts once: either its version isn't there yet, and it is made anew from the one
    before, or it is, and the batch's number in it says so. What a batch writes is in proportion to the buckets of its paths.
    """
    return snapshots.writeStream.foreachBatch(lambda batch, number: merged(spark, batch, number, ledger_dir)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
