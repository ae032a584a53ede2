"""A capture run over live files, as one staged commit: originals, then frames of the store, then the ledger.

Every run writes folders of its own. What they hold counts only once a version of the ledger names it, and that version appears
by one rename at the end. A run that stops after any step has added nothing; the next one has the same number, writes the same
folders anew and goes through. So no row of the ledger lacks its bytes, and no redacted copy lacks its original.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.steps import step
from tarnlake.operators import archive
from tarnlake.operators.ledger import line_plan
from tarnlake.sources import files
from tarnlake.sources.versions import Versions

#: Roles of files that grow by whole lines.
APPENDABLE = ["transcript", "subagent", "history"]
LEDGER = (
    "source_path string, role string, session_uuid string, source_sha256 string, source_bytes bigint, content_sha256 string, content_bytes bigint, stored_bytes bigint, "
    "redacted boolean, quarantined boolean, findings array<struct<kind:string,severity:string,sha8:string,action:string,span_start:bigint,span_len:bigint>>, "
    "frames array<struct<run:bigint,src_offset:bigint,src_len:bigint,bytes:bigint>>, captured_at string"
)
#: Buckets of the ledger, by path: a run rewrites those of the paths it captures.
BUCKETS = 256


@dataclass
class Run:
    """What a run did. Its numbers are counted by the jobs that write, not by reading again."""

    number: int
    counts: dict[str, int] = field(default_factory=dict)
    buckets: dict = field(default_factory=dict, repr=False)
    schema: dict = field(default_factory=dict, repr=False)


class Store:
    """Originals, frames and ledger below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self._versions = spark, path.rstrip("/"), Versions(spark, f"{path.rstrip('/')}/ledger")
        self.buckets = self._versions.read(self._versions.latest())["about"].get("buckets", buckets)

    def _bucket(self, path: str = "source_path"):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("long")

    def ledger(self, version: int | None = None) -> DataFrame:
        """The ledger as of a version, the last one by default: a row per captured path."""
        number = self._versions.latest() if version is None else version
        if not number:
            return self.spark.createDataFrame([], LEDGER)
        return self._versions.table(number, "rows").select(*[c.split()[0] for c in self._columns()])

    @staticmethod
    def _columns() -> list[str]:
        return ["source_path", "role", "session_uuid", "source_sha256", "source_bytes", "content_sha256", "content_bytes", "stored_bytes", "redacted", "quarantined", "findings", "frames", "captured_at"]

    def contents(self, version: int | None = None, *columns: str) -> DataFrame:
        """(source_path, content) and columns of the ledger: the stored contents that it names, their frames decoded one after another; null if they cannot be read.

        Frames are dealt out by path once, as they are stored, and decoded in the rows that they are joined to.
        """
        rows = self.ledger(version)
        runs = sorted(r[0] for r in rows.select(F.explode("frames.run").alias("run")).distinct().collect())
        if not runs:
            return rows.where("false").select("source_path", F.lit(b"").alias("content"), *columns)
        held = self.spark.read.schema("source_path string, content binary").option("basePath", f"{self.path}/frames").parquet(*[f"{self.path}/frames/run={n}" for n in runs])
        frames = held.groupBy(F.col("source_path").alias("__p")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("run").cast("long"), "content"))).alias("__held"))
        x = rows.select("source_path", F.col("frames.run").alias("__runs"), *columns).join(frames, F.col("source_path") == F.col("__p"))
        # frames of a path follow one another in one zstd stream
        whole = F.aggregate(F.transform("__runs", lambda r: F.try_element_at("__held", r)), F.lit(b""), lambda a, f: F.concat(a, f))
        return step(x, ["source_path", *columns], __whole=whole).select("source_path", files.decoded_column(F.col("__whole")).alias("content"), *columns)


#: What the plan and the frames of a path need to know of its row in the ledger.
_OLD = ["source_bytes", "source_sha256", "content_sha256", "content_bytes"]


def planned(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """sources (source_path, role, content, ...) with plan (skip, tail or full), start and end, and with the ledger's sizes and hashes of their paths as old_*.

    Files that grow count up to their last newline, others as a whole, and only if their hash is another. One join with the
    ledger; contents that aren't captured go no further.
    """
    old = ledger.select(F.col("source_path").alias("__p"), *[F.col(c).alias(f"old_{c}") for c in _OLD])
    x = sources.join(old, F.col("source_path") == F.col("__p"), "left").drop("__p").withColumn("content", F.coalesce("content", F.lit(b"")))
    kept = x.columns
    same = F.coalesce(F.sha2("content", 256) == F.col("old_source_sha256"), F.lit(False))
    whole = F.struct(F.when(same, "skip").otherwise("full").alias("plan"), F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("end"))
    x = step(x, kept, __plan=F.when(F.col("role").isin(APPENDABLE), line_plan("content", "old_source_bytes", "old_source_sha256")).otherwise(whole))
    return x.select(*kept, "__plan.*")


def plan(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source_path, plan, start, end) of planned()."""
    return planned(sources, ledger).select("source_path", "plan", "start", "end")


def _aside(df: DataFrame, path: str) -> None:
    """Writes what only the steps of a run read, packed more tightly."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _safe(judged: DataFrame, there: DataFrame) -> DataFrame:
    """Judged rows that may go on: those that need no quarantine, and those whose original is there (p, h) by its path and hash."""
    quarantined = judged.where("needs_quarantine").withColumn("__h", F.sha2("original", 256)).drop("original")
    kept = quarantined.join(there, (F.col("source_path") == F.col("p")) & (F.col("__h") == F.col("h")), "left_semi").drop("__h")
    return judged.where("not needs_quarantine").drop("original").unionByName(kept)


def _merge(store: Store, run: Run, new: DataFrame, after: Callable[[str], None]) -> None:
    """Writes the ledger's buckets of new rows, in which they replace those of their paths."""
    versions = store._versions
    held = versions.read(versions.latest())
    touched = {str(r[0]) for r in new.select(store._bucket()).distinct().collect()}
    stay = versions.table(versions.latest(), "rows", touched).drop("bucket") if held["buckets"] else store.spark.createDataFrame([], LEDGER)
    merged = stay.select(*new.columns).join(new.select(F.col("source_path").alias("n")), F.col("source_path") == F.col("n"), "left_anti").unionByName(new)
    folders, schema = versions.write(run.number, "rows", merged.withColumn("bucket", store._bucket()).repartition("bucket"))
    run.buckets = {b: v for b, v in held["buckets"].items() if b not in touched} | {b: {"tables": {"rows": f}} for b, f in folders.items()}
    run.schema = schema
    after("ledger")


def _commit(store: Store, run: Run) -> None:
    """Makes the ledger that a run wrote the last version."""
    store._versions.commit(run.number, {"buckets": run.buckets, "schemas": {"rows": run.schema}, "about": {"buckets": store.buckets, "counts": run.counts}})


def capture(
    store: Store, sources: DataFrame, now: str, *, allow: list[str] | None = None, scan: bool = True, quarantine_all: bool = False,
    write_originals: Callable[[DataFrame, str], None] = _write, after: Callable[[str], None] = lambda step: None,
) -> Run:
    """Captures live files (source_path, role, session_uuid, content binary), one row a path, into a store.

    Steps, each a job that writes one folder of the run: `scanned` (of what is new up to its last newline, the outcome of its scan,
    what its frame will hold, and the content where it needs quarantine), `originals` (contents that need quarantine), `frames`, `ledger`. An artifact that needs quarantine goes on only if its
    original is found among those written, byte for byte by its hash; others are left for a later run. A frame holds what follows
    the stored content if that is the exact beginning of the new one, else all of it. A path once redacted stays marked so. `after`
    is called after every step, before the version is switched. A null content is empty; a null role is no growing file. Paths that
    aren't among the sources keep their rows.
    """
    spark, versions = store.spark, store._versions
    run = Run(versions.latest() + 1)
    folder = lambda name: f"{store.path}/{name}/run={run.number}"
    src = sources.select("source_path", F.coalesce("role", F.lit("")).alias("role"), "session_uuid", "content")
    prior = store.ledger()
    x = planned(src, prior if run.number > 1 else F.broadcast(prior))
    seen = Observation("plan")
    x = x.observe(seen, F.count_if(F.col("plan") == "skip").alias("skipped"))
    todo = x.where("plan <> 'skip'").withColumn("content", F.expr("substr(content, 1, cast(end AS int))"))
    judged = archive.scan_artifacts(todo, allow, scan=scan, quarantine_all=quarantine_all)
    found = Observation("scan")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    judged = judged.observe(found, F.count("*").alias("scanned"), total("redacted_count").alias("redacted"), total("flagged").alias("flagged"), F.count_if("needs_quarantine").alias("needing_quarantine"))
    begins = (F.col("plan") == "tail") & (F.sha2(F.expr("substr(redacted, 1, cast(old_content_bytes AS int))"), 256) == F.col("old_content_sha256"))
    grows = F.coalesce(begins & (F.col("old_content_bytes") <= F.octet_length("redacted")), F.lit(False))
    judged = judged.withColumn("grows", grows).select(
        "source_path", "role", "session_uuid", "start", "end", "grows", "was_redacted", "needs_quarantine", "findings",
        F.sha2("content", 256).alias("source_sha256"), F.sha2("redacted", 256).alias("content_sha256"), F.octet_length("redacted").cast("long").alias("content_bytes"),
        F.when(F.col("needs_quarantine"), F.col("content")).alias("original"), F.when(F.col("grows"), F.expr("substr(redacted, cast(old_content_bytes AS int) + 1)")).otherwise(F.col("redacted")).alias("rest"),
    )
    _aside(judged, folder("scanned"))
    after("scanned")
    judged = spark.read.schema(judged.schema).parquet(folder("scanned"))

    write_originals(judged.where("needs_quarantine").select("source_path", F.col("original").alias("content")), folder("originals"))
    after("originals")
    there = spark.read.schema("source_path string, content binary").parquet(folder("originals")).select(F.col("source_path").alias("p"), F.sha2("content", 256).alias("h"))
    x = _safe(judged, there)
    frame = files.encoded(x.select(F.col("source_path").alias("path"), F.col("rest").alias("content"))).withColumnRenamed("path", "source_path")
    stored = Observation("frames")
    _write(frame.observe(stored, F.count("*").alias("written"), total(F.octet_length("content")).alias("bytes_stored")), folder("frames"))
    after("frames")

    size = spark.read.schema("source_path string, content binary").parquet(folder("frames")).select(F.col("source_path").alias("f"), F.octet_length("content").cast("long").alias("bytes"))
    old = prior.select(F.col("source_path").alias("p"), F.col("stored_bytes").alias("old_stored"), F.col("redacted").alias("old_redacted"), F.col("frames").alias("old_frames"))
    y = judged.join(size, F.col("source_path") == F.col("f")).join(old, F.col("source_path") == F.col("p"), "left")
    one = F.array(F.struct(F.lit(run.number).cast("long").alias("run"), F.when(F.col("grows"), F.col("start")).otherwise(F.lit(0)).cast("long").alias("src_offset"), (F.col("end") - F.when(F.col("grows"), F.col("start")).otherwise(F.lit(0))).cast("long").alias("src_len"), "bytes"))
    new = y.select(
        "source_path", "role", "session_uuid", "source_sha256", F.col("end").alias("source_bytes"), "content_sha256", "content_bytes",
        (F.when(F.col("grows"), F.col("old_stored")).otherwise(F.lit(0)) + F.col("bytes")).cast("long").alias("stored_bytes"), (F.col("was_redacted") | F.coalesce("old_redacted", F.lit(False))).alias("redacted"),
        F.col("needs_quarantine").alias("quarantined"), "findings", F.when(F.col("grows"), F.concat("old_frames", one)).otherwise(one).alias("frames"), F.lit(now).alias("captured_at"),
    )
    _merge(store, run, new, after)
    run.counts = {**seen.get, **found.get, **stored.get}
    run.counts["refused"] = run.counts["scanned"] - run.counts["written"]
    _commit(store, run)
    return run


def rescan(
    store: Store, now: str, *, allow: list[str] | None = None, write_originals: Callable[[DataFrame, str], None] = _write, after: Callable[[str], None] = lambda step: None,
) -> Run:
    """Scans all that a store holds by the present rules and writes back what changes, in the steps of capture().

    Contents are scanned as stored ones, whose placeholders are the redactor's own; what is one quarantine marker and recorded as
    quarantined is passed over. A content that a second scan would change again isn't written, and counts as `unstable`. What needs
    quarantine goes on only if the content before the change is found among the originals written. A changed path has one frame,
    the hashes and sizes of its new content, is marked redacted, and stays quarantined if it was; what tells its source, and the
    source's part that it covers, stay. Contents that don't change are not written.
    """
    spark, versions = store.spark, store._versions
    run = Run(versions.latest() + 1)
    folder = lambda name: f"{store.path}/{name}/run={run.number}"
    rows = store.ledger()
    marker = F.decode("content", "UTF-8").rlike(r"(?U)^\s*‹QUARANTINED:[^›]*›\s*$") & F.is_valid_utf8(F.col("content").cast("string"))
    held = store.contents(None, "role", "quarantined").where("content is not null").withColumnRenamed("quarantined", "was_quarantined")
    live = held.where(~(F.col("was_quarantined") & marker))
    once = archive.scan_artifacts(live, allow, trust_tags=True).where("redacted <> content")
    first = ["needs_quarantine", "findings", "content"]
    again = archive.scan_artifacts(once.select("source_path", "role", *[F.col(c).alias(f"first_{c}") for c in first], F.col("redacted").alias("content")), allow, trust_tags=True)
    # a marker is its own fix-point: it is never scanned again
    whole = F.decode("content", "UTF-8").rlike(r"(?U)^\s*‹QUARANTINED:[^›]*›\s*$") & F.col("first_needs_quarantine")
    seen = Observation("rescan")
    judged = again.select("source_path", *[F.col(f"first_{c}").alias(c) for c in first], F.col("content").alias("redacted"), (whole | (F.col("redacted") == F.col("content"))).alias("stable"))
    judged = judged.observe(seen, F.count("*").alias("changed"), F.count_if(~F.col("stable")).alias("unstable"), F.count_if("needs_quarantine").alias("needing_quarantine"))
    judged = judged.where("stable").select(
        "source_path", "needs_quarantine", "findings", F.when(F.col("needs_quarantine"), F.col("content")).alias("original"), "redacted", F.sha2("redacted", 256).alias("sha"), F.octet_length("redacted").cast("long").alias("n"),
    )
    _aside(judged, folder("scanned"))
    after("scanned")
    judged = spark.read.schema(judged.schema).parquet(folder("scanned"))
    write_originals(judged.where("needs_quarantine").select("source_path", F.col("original").alias("content")), folder("originals"))
    after("originals")
    there = spark.read.schema("source_path string, content binary").parquet(folder("originals")).select(F.col("source_path").alias("p"), F.sha2("content", 256).alias("h"))
    frame = files.encoded(_safe(judged, there).select(F.col("source_path").alias("path"), F.col("redacted").alias("content"))).withColumnRenamed("path", "source_path")
    stored = Observation("rescan frames")
    _write(frame.observe(stored, F.count("*").alias("written"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes_stored")), folder("frames"))
    after("frames")
    size = spark.read.schema("source_path string, content binary").parquet(folder("frames")).select(F.col("source_path").alias("f"), F.octet_length("content").cast("long").alias("bytes"))
    c = judged.select(F.col("source_path").alias("s"), "sha", "n", "needs_quarantine", F.col("findings").alias("found")).join(size, F.col("s") == F.col("f"))
    new = rows.join(c, F.col("source_path") == F.col("s")).select(
        "source_path", "role", "session_uuid", "source_sha256", "source_bytes", F.col("sha").alias("content_sha256"), F.col("n").alias("content_bytes"), F.col("bytes").alias("stored_bytes"), F.lit(True).alias("redacted"),
        (F.col("quarantined") | F.col("needs_quarantine")).alias("quarantined"), F.col("found").alias("findings"),
        F.array(F.struct(F.lit(run.number).cast("long").alias("run"), F.lit(0).cast("long").alias("src_offset"), F.col("source_bytes").alias("src_len"), "bytes")).alias("frames"), F.lit(now).alias("captured_at"),
    )
    _merge(store, run, new, after)
    run.counts = {**seen.get, **stored.get}
    run.counts["refused"] = run.counts["changed"] - run.counts["unstable"] - run.counts["written"]
    _commit(store, run)
    return run


def status(ledger: DataFrame) -> DataFrame:
    """One row of a ledger's counts and bytes, those of the sources and those stored; zeros for an empty one."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return ledger.agg(F.count("*").alias("artifacts"), F.count_distinct("session_uuid").alias("sessions"), F.count_if("redacted").alias("redacted"), F.count_if("quarantined").alias("quarantined"), total("source_bytes"), total("stored_bytes"), total("content_bytes"))
