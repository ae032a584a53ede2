"""Retention verdicts, admission and reconciliation as classifications over joins. Nothing is deleted here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Ages in days; the windows are fixed values. `full` sets aside retention windows and keeps the active window as the floor."""

    min_age: float = 7
    retain: tuple[tuple[str, float], ...] = (("transcript", 90), ("subagent", 90), ("mcp", 14), ("scratch-file", 3), ("paste", 14), ("snapshot", 30))
    active_window: float = 1 / 24
    full: bool = False
    require_indexed: bool = False

    def floor(self) -> float:
        return self.active_window if self.full else self.min_age

    def window(self, role: Column) -> Column:
        if self.full:
            return F.lit(0.0)
        out = F.lit(float(self.min_age))
        for name, days in self.retain:
            out = F.when(role == name, float(days)).otherwise(out)
        return out


def file_verdicts(candidates: DataFrame, ledger: DataFrame, indexed: DataFrame, active: DataFrame, policy: Policy) -> DataFrame:
    """(source_path, verdict, reason, bytes, archived_bytes): the first gate that fails decides.

    candidates: source_path, session_uuid, role, live_sha256, bytes, age_days, denied, readable; ledger: source_path,
    source_sha256, content_sha256, stored_ok; indexed: source_path, source_sha256; active: session_uuid.
    """
    x = candidates.join(ledger.select(F.col("source_path").alias("lp"), F.col("source_sha256").alias("ls"), "content_sha256", "stored_ok"), F.col("source_path") == F.col("lp"), "left")
    x = x.join(indexed.select(F.col("source_path").alias("ip"), F.col("source_sha256").alias("is")), (F.col("source_path") == F.col("ip")) & (F.col("ls") == F.col("is")), "left")
    x = x.join(active.select(F.col("session_uuid").alias("au")).distinct(), F.col("session_uuid") == F.col("au"), "left")
    age, floor = F.col("age_days"), policy.floor()
    reason = (
        F.when(F.col("denied"), "Blacklisted").when(~F.col("readable"), "OpenFailed").when(F.col("lp").isNull(), "NoCatalogRow")
        .when(F.col("live_sha256") != F.col("ls"), "ShaMismatch").when(F.col("content_sha256") == "", "EmptyContentSha").when(~F.col("stored_ok"), "StoreReverifyFailed")
    )
    if policy.require_indexed:
        reason = reason.when(F.col("ip").isNull(), "NotIndexed")
    reason = reason.when(age < floor, "TooYoung").when(age < F.greatest(F.lit(floor), policy.window(F.col("role"))), "RetainWindow").when(F.col("au").isNotNull() | (age < policy.active_window), "SessionLive")
    verdict = F.when(reason.isNull(), "delete").when(reason.isin("TooYoung", "RetainWindow", "SessionLive"), "protected").otherwise("unverified")
    archived = F.when(reason.isNull() | ~reason.isin("Blacklisted", "OpenFailed", "NoCatalogRow", "ShaMismatch", "EmptyContentSha", "StoreReverifyFailed"), F.col("bytes")).otherwise(0)
    return x.select("source_path", verdict.alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"), "bytes", archived.alias("archived_bytes"))


def rollup(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict", "reason").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.sum("archived_bytes").cast("long").alias("archived_bytes"))


#: File name patterns that scratch capture admits and denies.
ALLOW = ["*.md", "*.txt", "*.json", "*.output", "*.log", "*.csv", "*.sh", "*.py"]
DENY = [".git/**", "node_modules/**", "target/**", "**/*.mp4", "**/*.zip", "**/*.tar", "**/*.iso", "**/*.bin"]


def glob_pattern(globs: list[str]) -> str:
    """One regular expression for globs that also hold at any depth; * goes over slashes, ? is one character."""
    out = []
    for g in globs:
        r = ""
        k = 0
        while k < len(g):
            if g.startswith("**/", k):
                r, k = r + "(?:.*/)?", k + 3
            elif g.startswith("*", k):
                r, k = r + ".*", k + (2 if g.startswith("**", k) else 1)
            else:
                r, k = r + ("." if g[k] == "?" else "\\" + g[k] if not g[k].isalnum() else g[k]), k + 1
        out.append(f"(?:.*/)?{r}")
    return f"^(?:{'|'.join(out)})$"


def admission(files: DataFrame, file_cap: int, total_cap: int, *, caps_lifted: bool = False) -> DataFrame:
    """(tree, path, bytes, not_stored, stored, over_total): the first failing rule per file; a tree over its cap stores none.

    Totals are pre-aggregated per tree and joined back, so a large tree is one row per task in the shuffle.
    """
    rule = F.when(~F.col("path").rlike(glob_pattern(ALLOW)), "not_allowed").when(F.col("path").rlike(glob_pattern(DENY)), "denied")
    if not caps_lifted:
        rule = rule.when(F.col("bytes") > file_cap, "file_cap")
    x = files.withColumn("not_stored", rule)
    totals = x.groupBy(F.col("tree").alias("t")).agg(F.coalesce(F.sum(F.when(F.col("not_stored").isNull(), F.col("bytes"))), F.lit(0)).alias("admitted"))
    over = (F.col("admitted") > total_cap) & F.lit(not caps_lifted)
    return x.join(totals, F.col("tree") == F.col("t")).select("tree", "path", "bytes", "not_stored", (F.col("not_stored").isNull() & ~over).alias("stored"), over.alias("over_total"))


def tree_totals(admitted: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    return admitted.groupBy("tree").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("total_bytes"), s(F.col("not_stored").isNull()).alias("admitted_bytes"), s(F.col("stored")).alias("archived_bytes"), s(~F.col("stored")).alias("unarchived_bytes"), F.bool_or("over_total").alias("over_total"))


#: Fixed value: live files of more bytes are not hashed again, so they are never covered.
MOST_REHASHED = 64 * 1024 * 1024


def tree_coverage(live: DataFrame, manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(tree, reason): the first live file, by path, that the archive doesn't hold as it is, and why; '' if all are covered.

    live: (tree, path, bytes, live_sha256, readable, denied), path null where the name can't be told; manifest: (tree, path, no,
    blacklisted, capture_failed, stored, bytes, source_sha256, content_sha256), of one path the last by `no`; store: (tree, path,
    sha256), the hash of the decoded artifact, null if it can't be decoded. Gates, in order: a row of the manifest, no denied entry
    or failed capture; a file that isn't stored needs the recorded size only; a stored one both hashes recorded, a live file that
    may be opened, has the recorded size and is not over MOST_REHASHED, its hash, and the artifact's.
    """
    m = manifest.where("path is not null").groupBy(F.col("tree").alias("mt"), F.col("path").alias("mp")).agg(F.max_by(F.struct("blacklisted", "capture_failed", "stored", "bytes", "source_sha256", "content_sha256"), "no").alias("m"))
    held = store.groupBy(F.col("tree").alias("st"), F.col("path").alias("sp")).agg(F.first("sha256").alias("held"))
    x = live.join(m, (F.col("tree") == F.col("mt")) & (F.col("path") == F.col("mp")), "left").join(held, (F.col("tree") == F.col("st")) & (F.col("path") == F.col("sp")), "left")
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    why = (
        F.when(F.col("mp").isNull(), "NoCatalogRow").when(F.col("m.blacklisted"), "Blacklisted").when(F.col("m.capture_failed"), "OpenFailed")
        .when(~F.col("m.stored"), F.when(F.col("bytes") != F.col("m.bytes"), "ShaMismatch"))
        .when(none("m.source_sha256") | none("m.content_sha256"), "StoreReverifyFailed").when(F.col("denied"), "Blacklisted").when(~F.col("readable"), "OpenFailed")
        .when((F.col("bytes") != F.col("m.bytes")) | (F.col("bytes") > MOST_REHASHED) | ~F.col("live_sha256").eqNullSafe(F.col("m.source_sha256")), "ShaMismatch")
        .when(~F.col("held").eqNullSafe(F.col("m.content_sha256")), "StoreReverifyFailed")
    )
    # a path that can't be told comes first
    return x.withColumn("why", why).groupBy("tree").agg(F.coalesce(F.min_by("why", F.when(F.col("why").isNotNull(), F.coalesce("path", F.lit("")))), F.lit("")).alias("reason"))


def retained(prior: DataFrame, live: DataFrame) -> DataFrame:
    """Manifest entries after a capture: those of live files, and vanished ones as not present; of equal paths the first."""
    gone = prior.join(live.select("tree", "path"), ["tree", "path"], "left_anti")
    once = gone.groupBy("tree", "path").agg(F.min_by("sha256", "no").alias("sha256"))
    return live.select("tree", "path", "sha256", F.lit(True).alias("present")).unionByName(once.withColumn("present", F.lit(False)))


#: Fields of a manifest's entry.
ENTRY = ["tree", "path", "shown", "bytes", "present", "capture_failed", "stored", "source_sha256", "content_sha256", "quarantined"]


def salvaged(prior: DataFrame, live: DataFrame, store: DataFrame) -> DataFrame:
    """A manifest's entries (ENTRY) after a run: of live files, of those that couldn't be read, and of what is gone.

    live: (tree, path, bytes, readable, stored, source_sha256, content_sha256, quarantined), one row a path; prior: ENTRY and `no`,
    the order of entries, with path null where it can't be decoded; store: (tree, path) of artifacts that are there.
    A readable file has what the run made of it. One that couldn't be read is marked so, and carries on what the first prior entry
    of its path claims, if that was stored and its artifact is there; else it is not stored. A prior path without a live file stays
    once, as not present, by its first entry. Entries that can't be decoded stay as they are, every one.
    """
    first = prior.where("path is not null").groupBy(F.col("tree").alias("pt"), F.col("path").alias("pp")).agg(F.min_by(F.struct(*ENTRY), "no").alias("p"))
    held = store.select(F.col("tree").alias("st"), F.col("path").alias("sp")).distinct()
    x = live.join(first, (F.col("tree") == F.col("pt")) & (F.col("path") == F.col("pp")), "full").join(held, (F.col("tree") == F.col("st")) & (F.col("path") == F.col("sp")), "left")
    carried = F.coalesce(F.col("p.stored") & F.col("sp").isNotNull(), F.lit(False))
    either = lambda c, none: F.when(F.col("readable"), F.col(c)).when(carried, F.col(f"p.{c}")).otherwise(F.lit(none)).alias(c)
    now = x.where("path is not null").select(
        "tree", "path", F.col("path").alias("shown"), "bytes", F.lit(True).alias("present"), (~F.col("readable")).alias("capture_failed"), F.when(F.col("readable"), F.col("stored")).otherwise(carried).alias("stored"),
        either("source_sha256", None), either("content_sha256", None), either("quarantined", False),
    )
    gone = x.where("path is null").select("p.*").withColumn("present", F.lit(False))
    return now.unionByName(gone.select(*ENTRY)).unionByName(prior.where("path is null").select(*ENTRY))


def captured(entries: DataFrame) -> DataFrame:
    """(tree, captured) of entries (ENTRY): whether any file that is present is stored. A tree without entries has no row, and captured nothing."""
    return entries.groupBy("tree").agg(F.coalesce(F.bool_or(F.col("present") & F.col("stored")), F.lit(False)).alias("captured"))


def manifest_totals(entries: DataFrame) -> DataFrame:
    """(tree, entries, total_bytes, stored_bytes, failed, complete) of entries (ENTRY): bytes of present files, of stored ones, and whether every entry could be decoded."""
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    return entries.groupBy("tree").agg(F.count("*").alias("entries"), size(F.col("present")).alias("total_bytes"), size(F.col("present") & F.col("stored")).alias("stored_bytes"), F.count_if("capture_failed").alias("failed"), F.bool_and(F.col("path").isNotNull()).alias("complete"))


#: What each issue is, and which compare a ledger with a store and so need that nobody writes meanwhile.
CLASSES = {
    "refused key": ["ForeignStoreDir", "UnreadableStoreRoot", "StoreKeyCollision", "UnreconcilableKey", "QuarantineForeignRoot"],
    "violation": ["NoManifest", "UnreadableManifest", "MissingArtifact", "UnclaimedArtifact", "OrphanArtifact", "ContentMismatch", "DuplicateIdentity", "QuarantineCollision", "QuarantineMissing", "QuarantineMismatch"],
    "unverifiable": ["NoContentHash", "UndecodableEntry", "UndecodableIdentity", "QuarantineNoSourceHash"],
    "foreign matter": ["ForeignArtifact", "QuarantineLegacyLayout", "QuarantineStray"],
}
EXCLUSIVE = ["NoManifest", "MissingArtifact", "UnclaimedArtifact", "OrphanArtifact", "ContentMismatch", "QuarantineStray", "QuarantineMismatch"]


def store_issues(store: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, path, issue) of stores against their manifests, from both sides; a path can have several issues.

    store: artifacts (key, path, sha256, regular), the hash null where they can't be decoded; entries: (key, no, path, shown, stored,
    content_sha256), no being their order and path null where it can't be decoded (then `shown` names the entry).
    Of entries of one path the first is judged, and the others are told once. An entry that isn't stored claims no artifact; a
    stored one needs its artifact, and its hash if the entry has one (null or empty: none). What is no regular file is told and
    counts for nothing else. Artifacts that no entry names are orphans, except under keys with an entry that can't be decoded, for
    they may be that entry's; such a key is told as a whole, with an empty path.
    """
    named = entries.where("path is not null").groupBy("key", "path").agg(F.count("*").alias("n"), F.min_by(F.struct("stored", "content_sha256"), "no").alias("first"))
    held = store.where("regular").groupBy(F.col("key").alias("sk"), F.col("path").alias("sp")).agg(F.first("sha256").alias("sha256"))
    x = named.join(held, (F.col("key") == F.col("sk")) & (F.col("path") == F.col("sp")), "full")
    there, stored = F.col("sp").isNotNull(), F.col("first.stored")
    content = F.nullif("first.content_sha256", F.lit(""))
    verdict = (
        F.when(~stored & there, "UnclaimedArtifact").when(~stored, None).when(~there, "MissingArtifact").when(content.isNull(), "NoContentHash")
        .when(F.coalesce(content != F.col("sha256"), F.lit(True)), "ContentMismatch")
    )
    claimed = x.where("key is not null").select("key", "path", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "DuplicateIdentity"), verdict))).alias("issue"))
    lost = entries.where("path is null")
    blind = lost.select(F.col("key").alias("blind")).distinct()
    orphans = x.where("key is null").join(blind, F.col("sk") == F.col("blind"), "left_anti").select(F.col("sk").alias("key"), F.col("sp").alias("path"), F.lit("OrphanArtifact").alias("issue"))
    undecoded = lost.select("key", F.col("shown").alias("path"), F.lit("UndecodableEntry").alias("issue"))
    whole = blind.select(F.col("blind").alias("key"), F.lit("").alias("path"), F.lit("UnreconcilableKey").alias("issue"))
    foreign = store.where("not regular").select("key", "path", F.lit("ForeignArtifact").alias("issue"))
    return claimed.unionByName(orphans).unionByName(undecoded).unionByName(whole).unionByName(foreign)


def legacy_places(path: Column) -> Column:
    """Where superseded layouts would have put the original that belongs at a path, likeliest first."""
    part = F.split(path, "/")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    below = lambda n: F.array_join(F.slice(part, n, F.greatest(F.size(part), F.lit(1))), "/")
    scratch = F.array(F.concat_ws("/", F.concat(F.lit("_scratch--"), second), below(2)))
    category = F.array(F.concat_ws("/", first, path))
    session = F.array(F.concat_ws("/", second, below(3)), F.concat_ws("/", second, path))
    return F.when(F.size(part) < 2, F.array().cast("array<string>")).when(first == "_scratch", scratch).when(F.startswith(first, F.lit("_")), category).otherwise(session)


def _below(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Those paths (path, ...) that are, or stand below, a root (root): paths meet roots by each of their beginnings."""
    part = F.split("path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.array_join(F.slice(part, F.lit(1), k), "/"))
    below = paths.select("path", F.explode(begins).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select(F.col("path").alias("__below")).distinct()
    return paths.join(below, F.col("path") == F.col("__below"), "left_semi")


def quarantine_issues(files: DataFrame, claims: DataFrame, *, unexamined: DataFrame | None = None, opened: bool = True, swept: bool = True, foreign_root: bool = False) -> DataFrame:
    """(path, issue) of originals set aside against the ledger; a path can have several issues.

    files: (path, sha256, regular); claims: (path, no, quarantined, source_sha256) of all artifacts, path being where an original
    belongs, and no their order. Claims that record an original: two of one path collide; the original of each path, spoken for
    by its first claim, is missing unless it stands there as a regular file or in a superseded layout, which is told under the path
    where it stands. With `opened` its hash is compared, at an old place too; a null or empty one can't be. With `swept` files
    that no artifact claims, whether or not it records an original, are strays, or of an old layout by their form: the first part is
    a claim's session, begins with _scratch--, or comes twice. Nothing below an unexamined root (root) is swept. A root of the
    whole tree that isn't the store's own ends all checks.
    """
    if foreign_root:
        return files.sparkSession.createDataFrame([("", "QuarantineForeignRoot")], "path string, issue string")
    recorded = claims.where("quarantined").groupBy("path").agg(F.count("*").alias("n"), F.min_by(F.coalesce("source_sha256", F.lit("")), "no").alias("claimed"))
    f = files.where("regular").groupBy(F.col("path").alias("fp")).agg(F.first("sha256").alias("sha256"))
    x = recorded.join(f, F.col("path") == F.col("fp"), "left")
    # an old place is looked up for claims without an original only; of several the first that is there counts
    lost = x.where("fp is null").select(F.col("path").alias("lost"), F.posexplode(legacy_places(F.col("path"))).alias("at", "old"))
    moved = lost.join(f, F.col("old") == F.col("fp")).groupBy("lost").agg(F.min_by(F.struct("old", "sha256"), "at").alias("moved"))
    x = x.join(moved, F.col("path") == F.col("lost"), "left").withColumn("place", F.when(F.col("fp").isNotNull(), F.col("path")).otherwise(F.col("moved.old")))
    hashed = F.coalesce("sha256", "moved.sha256")
    compared = F.when(F.lit(opened) & F.col("place").isNotNull(), F.when(F.col("claimed") == "", "QuarantineNoSourceHash").when(F.coalesce(F.col("claimed") != hashed, F.lit(True)), "QuarantineMismatch"))
    found = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.struct("path", F.lit("QuarantineCollision").alias("issue"))),
        F.when(F.col("place").isNull(), F.struct("path", F.lit("QuarantineMissing").alias("issue"))),
        F.when(F.col("fp").isNull() & F.col("place").isNotNull(), F.struct(F.col("place").alias("path"), F.lit("QuarantineLegacyLayout").alias("issue"))),
        F.when(compared.isNotNull(), F.struct(F.col("place").alias("path"), compared.alias("issue"))),
    ))
    out = x.select(F.explode(found).alias("i")).select("i.path", "i.issue")
    if not swept:
        return out
    known = claims.select(F.col("path").alias("k")).unionByName(moved.select(F.col("moved.old").alias("k"))).distinct()
    rest = files.select("path").join(known, F.col("path") == F.col("k"), "left_anti")
    if unexamined is not None:
        rest = rest.join(_below(rest, unexamined).select(F.col("path").alias("skipped")), F.col("path") == F.col("skipped"), "left_anti")
    part = F.split("path", "/")
    session = claims.select(F.split("path", "/").alias("p")).where("size(p) > 1 and not startswith(p[0], '_')").select(F.get("p", F.lit(1)).alias("session")).distinct()
    rest = rest.withColumn("first", F.get(part, F.lit(0))).join(session, F.col("first") == F.col("session"), "left")
    old_form = F.col("session").isNotNull() | F.startswith("first", F.lit("_scratch--")) | F.coalesce(F.col("first") == F.get(part, F.lit(1)), F.lit(False))
    return out.unionByName(rest.select("path", F.when(old_form, "QuarantineLegacyLayout").otherwise("QuarantineStray").alias("issue")))


def classed(issues: DataFrame, *, exclusive: bool) -> DataFrame:
    """(issue, class, n): without exclusive access an issue that needs it is unverifiable; an unknown one has no class."""
    c = F.lit(None).cast("string")
    for name, held in CLASSES.items():
        c = F.when(F.col("issue").isin(held), name).otherwise(c)
    c = F.when(F.col("issue").isin(EXCLUSIVE) & F.lit(not exclusive), "unverifiable").otherwise(c)
    return issues.groupBy("issue").agg(F.count("*").alias("n")).select("issue", c.alias("class"), "n")
