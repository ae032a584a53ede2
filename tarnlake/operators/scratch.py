"""Scratch trees and their store: reuse of captures, reconciliation, byte splits, tree verdicts, and checks per store key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.ledger import store_key
from tarnlake.operators.retention import Policy

_HEX = r"^([0-9a-fA-F]{2})+$"


def reusable(live: DataFrame, prior: DataFrame, store: DataFrame, originals: DataFrame, *, same_policy: bool = True, rearchive: bool = False) -> DataFrame:
    """(tree, path, reused, content_sha256, quarantined) of live files (tree, path, source_sha256).

    A capture is reused if scan policy and run allow it, the prior entry is stored, present and without a failed capture,
    both of its hashes are known, its source hash is that of the bytes now, the artifact is in the store (tree, path), and a
    quarantined one's original is among originals (tree, path). What isn't reused has neither hash nor flag.
    """
    side = lambda df, mark: df.select("tree", "path").distinct().withColumn(mark, F.lit(True))
    p = prior.select("tree", "path", "stored", "present", "capture_failed", F.col("source_sha256").alias("prior_sha"), F.col("content_sha256").alias("carried"), F.col("quarantined").alias("was_quarantined"))
    x = live.join(p, ["tree", "path"], "left").join(side(store, "kept"), ["tree", "path"], "left").join(side(originals, "original"), ["tree", "path"], "left")
    entry = F.col("stored") & F.col("present") & ~F.col("capture_failed") & F.col("carried").isNotNull() & (F.col("prior_sha") == F.col("source_sha256"))
    on_disk = F.col("kept") & (~F.col("was_quarantined") | F.coalesce("original", F.lit(False)))
    reused = F.coalesce(F.lit(same_policy and not rearchive) & entry & on_disk, F.lit(False))
    return x.select("tree", "path", reused.alias("reused"), F.when(reused, F.col("carried")).alias("content_sha256"), F.when(reused, F.col("was_quarantined")).alias("quarantined"))


def byte_split(entries: DataFrame) -> DataFrame:
    """(tree, archived, unarchived): bytes of present entries (tree, bytes, stored, present) by whether a copy is stored."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    return entries.groupBy("tree").agg(part(F.col("present") & F.col("stored")).alias("archived"), part(F.col("present") & ~F.col("stored")).alias("unarchived"))


def wipe_split(live: DataFrame, entries: DataFrame) -> DataFrame:
    """(tree, archived, unarchived) of live trees (tree, bytes): no more counts as archived than is there, and all the rest as not."""
    x = live.join(byte_split(entries).withColumnRenamed("archived", "told").drop("unarchived"), "tree", "left")
    archived = F.least(F.coalesce("told", F.lit(0)), "bytes").cast("long")
    return x.select("tree", archived.alias("archived"), (F.col("bytes") - archived).cast("long").alias("unarchived"))


def reconciled(store: DataFrame, claims: DataFrame, capped: DataFrame) -> DataFrame:
    """(tree, removed, by_cap): artifacts of the store (tree, path) that no stored claim explains, and those among them that a cap declined.

    A tree with a claim of an unknown path is left alone: its artifacts can't be told from orphans.
    """
    illegible = claims.where("path is null").select("tree").distinct()
    orphans = store.select("tree", "path").join(claims.where("stored").select("tree", "path"), ["tree", "path"], "left_anti").join(illegible, "tree", "left_anti")
    marked = orphans.join(capped.select("tree", "path").distinct().withColumn("capped", F.lit(True)), ["tree", "path"], "left")
    return marked.groupBy("tree").agg(F.count("*").alias("removed"), F.count_if("capped").alias("by_cap"))


def tree_verdicts(trees: DataFrame, coverage: DataFrame, active: DataFrame, policy: Policy, *, wipe: bool = False) -> DataFrame:
    """(tree, verdict, reason): the first gate that fails decides.

    trees: tree, session_uuid, foreign, manifest (ok, missing, unreadable), identity (same, other, corrupt, unrecorded), age_days
    of the newest file (null without files: 0), captured, caps_lifted; coverage: tree, reason ('' if covered); active:
    session_uuid. A wipe asks for age and liveness only.
    """
    x = trees.join(coverage.select("tree", F.nullif("reason", F.lit("")).alias("uncovered")), "tree", "left")
    x = x.join(active.select(F.col("session_uuid").alias("au")).distinct(), F.col("session_uuid") == F.col("au"), "left")
    aged = not (policy.full or wipe)
    age, floor = F.coalesce("age_days", F.lit(0)), policy.min_age if aged else policy.active_window
    retain = max([floor, *(days for role, days in policy.retain if role == "scratch-file" and aged)])
    reason = F.when(age < floor, "TooYoung").when(age < retain, "RetainWindow").when(F.col("au").isNotNull() | (age < policy.active_window), "SessionLive")
    if not wipe:
        gate = (
            F.when(F.col("foreign"), "ForeignStoreDir").when(F.col("manifest") != "ok", "NoCatalogRow").when(F.col("identity") == "other", "StoreKeyCollision")
            .when(F.col("identity") == "corrupt", "UndecodableIdentity").when(F.col("uncovered").isNotNull(), F.col("uncovered"))
        )
        if policy.full:
            gate = gate.when(F.col("captured"), "Captured").when(~F.col("caps_lifted"), "NotFullyArchived")
        reason = F.coalesce(gate, reason)
    protected = reason.isin("TooYoung", "RetainWindow", "SessionLive", "Captured", "NotFullyArchived")
    return x.select("tree", F.when(reason.isNull(), "delete").when(protected, "protected").otherwise("unverified").alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"))


def empty_dir_verdicts(dirs: DataFrame, policy: Policy) -> DataFrame:
    """(path, verdict, reason) of directories (path, readable, children, age_days): only old ones without children may go."""
    age = F.col("age_days")
    reason = F.when(~F.col("readable"), "OpenFailed").when(F.col("children") > 0, "RetainWindow").when(age < policy.min_age, "TooYoung").when(age < policy.active_window, "SessionLive")
    verdict = F.when(reason.isNull(), "delete").when(reason == "OpenFailed", "unverified").otherwise("protected")
    return dirs.select("path", verdict.alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"))


def _text(hexed: Column) -> Column:
    """The text that hexadecimal digits stand for; null if they are none."""
    return F.when(hexed.rlike(_HEX), F.decode(F.unhex(hexed), "UTF-8"))


def selected_keys(keys: DataFrame, selector: str) -> DataFrame:
    """(key, state): store keys (key, uuid_hex) that a full key or a session's name selects; `unreadable` where only an illegible record could tell."""
    fields = F.split(F.substr("key", F.lit(7)), "--")
    coded = F.coalesce((F.size(fields) == 2) & (_text(F.get(fields, F.lit(1))) == selector), F.lit(False))
    by_record = F.when(F.col("uuid_hex").isNull(), None).when(_text(F.col("uuid_hex")).isNull(), "unreadable").when(_text(F.col("uuid_hex")) == selector, "match")
    plain = F.when(F.endswith("key", F.lit(f"--{selector}")), "match")
    state = F.when(F.col("key") == selector, "match").when(F.startswith("key", F.lit("_h256--")), by_record).when(F.startswith("key", F.lit("_hex--")), F.when(coded, "match")).otherwise(plain)
    return keys.select("key", state.alias("state")).where("state is not null")


def the_key(keys: DataFrame, selector: str) -> str:
    """The one store key that a selector names; LookupError if there is none, or more than one."""
    found = selected_keys(keys, selector).where("state = 'match'").orderBy("key").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{selector}: {'ambiguous' if found else 'no such key'}")
    return found[0]["key"]


def key_issues(keys: DataFrame) -> DataFrame:
    """(key, issue) of store keys: what keeps a key's store from being checked, or is wrong with the key itself.

    keys: key, readable, foreign, manifest (ok, missing, unreadable), slug_hex, uuid_hex ('' if not recorded), undecodable (entries
    whose identity can't be read), irregular (artifacts that are no regular files). The first of the refusals ends the checks.
    """
    slug, uuid = F.coalesce("slug_hex", F.lit("")), F.coalesce("uuid_hex", F.lit(""))
    recorded = (slug != "") | (uuid != "")
    legible = slug.rlike(_HEX) & uuid.rlike(_HEX)
    stop = (
        F.when(F.col("foreign"), "ForeignStoreDir").when(~F.col("readable"), "UnreadableStoreRoot").when(F.col("manifest") == "missing", "NoManifest").when(F.col("manifest") == "unreadable", "UnreadableManifest")
        .when(legible & (store_key(_text(slug), _text(uuid)) != F.col("key")), "StoreKeyCollision")
    )
    more = F.array(
        F.when(recorded & ~legible, "UndecodableIdentity"), F.when(F.col("irregular") > 0, "ForeignArtifact"), F.when(F.col("undecodable") > 0, "UndecodableEntry"), F.when(F.col("undecodable") > 0, "UnreconcilableKey"),
    )
    return keys.select("key", F.explode(F.when(stop.isNotNull(), F.array(stop)).otherwise(F.array_compact(more))).alias("issue"))
