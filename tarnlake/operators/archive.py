"""A capture run: what a scan makes of an artifact, how its stored form is written, and what is recorded of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.steps import step
from tarnlake.operators import scanning, transcripts

#: Roles whose entries are indexed line by line, and roles that are one document.
PER_ENTRY, SINGLE = ["transcript", "subagent"], ["tool-result", "mcp", "snapshot", "paste", "history"]
#: Roles whose lines must be JSON.
JSON_LINES = ["transcript", "subagent", "history"]
#: What retention can be asked for.
TARGETS = ["transcripts", "scratch", "mcp", "empty-dirs", "paste", "snapshots"]


def modes(artifacts: DataFrame) -> DataFrame:
    """artifacts (role, ...) with `mode`: entries, document or skip."""
    return artifacts.withColumn("mode", F.when(F.col("role").isin(PER_ENTRY), "entries").when(F.col("role").isin(SINGLE), "document").otherwise("skip"))


def enriched(docs: DataFrame, artifacts: DataFrame, sessions: DataFrame, agent: str) -> DataFrame:
    """docs (artifact_id, ...) with the facets of their session: session_uuid, project_slug, cwd, git_branch, and the agent."""
    facets = sessions.select(F.col("uuid").alias("session_uuid"), "project_slug", "cwd", "git_branch")
    own = artifacts.select(F.col("id").alias("artifact_id"), "session_uuid").join(facets, "session_uuid", "left")
    return docs.join(own, "artifact_id", "left").withColumn("agent", F.lit(agent))


def targets(listed: str) -> list[str]:
    """Names of a comma-separated list, in order and once each; an unknown one raises ValueError."""
    found = list(dict.fromkeys(x.strip() for x in listed.split(",") if x.strip()))
    for x in found:
        if x not in TARGETS:
            raise ValueError(f"unknown target: {x}")
    return found


def deletable(verdicts: DataFrame, kind: str) -> DataFrame:
    """One row, n: verdicts (kind, verdict) of a kind that say delete."""
    return verdicts.agg(F.count_if((F.col("kind") == kind) & (F.col("verdict") == "delete")).alias("n"))


def not_denied(files: DataFrame, denied: DataFrame) -> DataFrame:
    """files (dev, ino, ...) of which no denied file (dev, ino) is the same; a file without numbers is not known to be another one, and is left out."""
    d = denied.select(F.col("dev").alias("d"), F.col("ino").alias("i")).distinct()
    return files.where("dev is not null and ino is not null").join(d, (F.col("dev") == F.col("d")) & (F.col("ino") == F.col("i")), "left_anti")


def manifest_state(keys: DataFrame, manifests: DataFrame, schema: str = "version int, trees array<string>") -> DataFrame:
    """(key, state, manifest) of keys: missing without a manifest (key, content), unreadable where its content is no JSON object, else ok; absent fields are null."""
    x = keys.select("key").join(manifests.select("key", "content"), "key", "left")
    legible = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("content")), F.lit("OBJECT")), F.lit(False))
    state = F.when(F.col("content").isNull(), "missing").when(legible, "ok").otherwise("unreadable")
    return x.select("key", state.alias("state"), F.when(legible, F.from_json("content", schema)).alias("manifest"))


#: The fields of a session's manifest.
RECORD = "role string, path string, source string, source_sha256 string, source_bytes bigint, stored_sha256 string, stored_bytes bigint, content_sha256 string, redacted boolean, quarantined boolean, scan struct<findings:bigint,redacted:bigint,flagged:bigint,quarantined:boolean>, frames array<struct<src_offset:bigint,src_len:bigint,captured_at:string>>"
MANIFEST = (
    "schema_version int, session_uuid string, project_slug string, cwd string, git_branch string, cc_version string, session_start string, session_end string, entry_count bigint, captured_at string, "
    f"artifacts array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECORD.split(', '))}>>, secret_scan struct<scanned:boolean,findings:bigint,quarantined:boolean,flagged:bigint,redacted:bigint>"
)
SCHEMA_VERSION = 1


def manifests(sessions: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """(session_uuid, content): the manifest of each session as JSON, its records in order of their source; absent facets are left out.

    sessions: session_uuid, project_slug, cwd, git_branch, cc_version, session_start, session_end, entry_count; records: session_uuid
    and RECORD. The summary of the scan is added up from the records; one of none was not scanned. A manifest is one document, so
    the records of a session meet in one row.
    """
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    total = lambda c: F.coalesce(F.sum(f"scan.{c}"), F.lit(0)).cast("long").alias(c)
    held = records.groupBy(F.col("session_uuid").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("source", F.struct(*fields).alias("r")))).alias("all"),
        F.struct(F.lit(True).alias("scanned"), total("findings"), F.coalesce(F.bool_or("quarantined"), F.lit(False)).alias("quarantined"), total("flagged"), total("redacted")).alias("secret_scan"),
    )
    x = sessions.join(held, F.col("session_uuid") == F.col("of"), "left")
    none = F.from_json(F.lit('{"scanned":false,"findings":0,"quarantined":false,"flagged":0,"redacted":0}'), "scanned boolean, findings bigint, quarantined boolean, flagged bigint, redacted bigint")
    artifacts = F.coalesce(F.transform("all", lambda a: a["r"]), F.expr(f"cast(array() as array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECORD.split(', '))}>>)"))
    facets = [F.col(c) for c in ("session_uuid", "project_slug", "cwd", "git_branch", "cc_version", "session_start", "session_end", "entry_count")]
    content = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *facets, F.lit(now).alias("captured_at"), artifacts.alias("artifacts"), F.coalesce("secret_scan", none).alias("secret_scan")))
    return x.select("session_uuid", content.alias("content"))


def read_manifests(stored: DataFrame) -> DataFrame:
    """(key, state, manifest) of stored manifests (key, content), with all of MANIFEST; manifest_state() says what state means."""
    return manifest_state(stored, stored, MANIFEST)


#: The finding that stands for placeholders which a text brought along.
FORGED = {"kind": "preinjected-placeholder", "severity": "low", "sha8": "00000000", "action": "flag"}


def _judged(x: DataFrame, content: Column, allow: list[str] | None, *, quarantine_all: bool) -> DataFrame:
    """x (id, __text, __why, __forged) with the outcome of a scan; content is what the artifact's tag and size are of. Rows with a reason in __why are not scanned."""
    x = scanning.with_findings(x, "__text", allow, redacted="__redacted", findings="__found")
    n = lambda *actions: F.size(F.filter("__found", lambda f: f["action"].isin(*actions))).cast("long")
    whole, tag = F.col("__why").isNotNull(), F.substring(F.sha2(content, 256), 1, 8)
    one = lambda kind, severity, sha8, action, size: F.array(F.struct(kind.alias("kind"), severity.alias("severity"), sha8.alias("sha8"), action.alias("action"), F.lit(0).cast("long").alias("span_start"), size.cast("long").alias("span_len")))
    set_aside = one(F.col("__why"), F.lit("high"), tag, F.lit("quarantine"), F.octet_length(content))
    flag = one(*[F.lit(v) for v in FORGED.values()], F.lit(0))
    either = lambda a, b: F.when(whole, a).otherwise(b)
    count = n("redact", "quarantine")
    return x.select(
        "*", F.col("__why").alias("why"), (~whole).alias("scanned"), either(F.concat(F.lit(scanning.QUARANTINED), "__why", F.lit(":"), tag, F.lit("›\n")), F.col("__redacted")).alias("redacted"),
        either(F.lit(True), F.col("__forged") | (F.col("__redacted") != F.col("__text"))).alias("was_redacted"),
        either(F.lit(True), (n("quarantine") > 0) | (F.lit(quarantine_all) & (count > 0))).alias("needs_quarantine"),
        either(F.lit(0), n("flag") + F.col("__forged").cast("long")).cast("long").alias("flagged"), either(F.lit(1), count).cast("long").alias("redacted_count"),
        either(set_aside, F.when(F.col("__forged"), F.concat(flag, "__found")).otherwise(F.col("__found"))).alias("findings"),
    )


OUTCOME = ["scanned", "redacted", "was_redacted", "needs_quarantine", "flagged", "redacted_count", "findings"]


def _unscanned(x: DataFrame, redacted: Column) -> DataFrame:
    """x with the outcome of a run that scans nothing: every artifact passes as it is, and counts as scanned."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    none = F.expr(f"cast(array() as {scanning.FINDINGS})")
    return x.select("*", F.lit(True).alias("scanned"), redacted.alias("redacted"), no.alias("was_redacted"), no.alias("needs_quarantine"), zero.alias("flagged"), zero.alias("redacted_count"), none.alias("findings"))


def outcomes(texts: DataFrame, allow: list[str] | None = None, *, scan: bool = True, quarantine_all: bool = False) -> DataFrame:
    """(id, scanned, redacted, was_redacted, needs_quarantine, flagged, redacted_count, findings) of artifacts (id, text, why) whose gates were judged before.

    why says for what an artifact is set aside as a whole (null: it isn't): then the stored text is one marker with the tag of
    its bytes, and one finding covers them all. Otherwise placeholders it brought along are made harmless, which is a finding
    of low severity, and what the detectors find is redacted. With quarantine_all a text with any finding that isn't allowed
    needs quarantine too. Without scan all texts pass as they are, and count as scanned. A null text is empty.
    """
    t = texts.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "why")
    if not scan:
        return _unscanned(t.select("id", "text"), F.col("text")).select("id", *OUTCOME)
    clean = F.when(F.col("why").isNull(), scanning.harmless(F.col("text"))).otherwise("")
    x = t.select("id", "text", clean.alias("__text"), F.col("why").alias("__why"), scanning.redacted_mark(F.col("text")).alias("__forged"))
    return _judged(x, F.col("text"), allow, quarantine_all=quarantine_all).select("id", *OUTCOME)


def _malformed(text: str) -> Column:
    """Whether a line of a column of texts that isn't blank is no JSON, by the test of transcripts.parsed()."""
    whole = "try_parse_json(concat('[', l, ']')) IS NOT NULL AND try_parse_json(concat('{\"v\":', l, '}')) IS NOT NULL"
    return F.expr(f"exists(split({text}, '\n'), l -> NOT rlike(l, '{transcripts.BLANK_SQL}') AND NOT ({whole}))")


def scan_artifacts(artifacts: DataFrame, allow: list[str] | None = None, *, scan: bool = True, quarantine_all: bool = False, trust_tags: bool = False) -> DataFrame:
    """artifacts (role, content binary, ...) with the outcome of their scan: why, scanned, redacted (binary), was_redacted, needs_quarantine, flagged, redacted_count, findings.

    One pass from the bytes on: the first gate that fails says why an artifact is set aside as a whole. The gates are bytes that
    are no text (non-utf8, utf16-decode-failed, utf16-ambiguous), in roles of JSON lines a line that isn't JSON (malformed-jsonl),
    and a secret that shows only unescaped or in canonical form (escape-hidden-secret). What passes is redacted as outcomes()
    says. trust_tags is for stored contents, whose placeholders are the redactor's own. A null content is empty. Columns of
    artifacts stay; names that begin with two underscores are taken.
    """
    kept = artifacts.columns
    raw = F.coalesce(F.col("content"), F.lit(b""))
    if not scan:
        return _unscanned(artifacts.withColumn("why", F.lit(None).cast("string")), raw).select(*kept, "why", *OUTCOME)
    x = artifacts.withColumn("__d", scanning.decoded_column(F.col("content")))
    text = F.coalesce("__d.text", F.lit(""))
    forged = F.lit(False) if trust_tags else scanning.redacted_mark(text)
    x = step(x, [*kept, "__d"], __forged=forged, __clean=text if trust_tags else scanning.harmless(text))
    lines = F.coalesce(F.col("role").isin(JSON_LINES), F.lit(False))
    x = step(x, [*kept, "__forged", "__clean"], __first=F.coalesce("__d.reason", F.when(lines & _malformed("__clean"), "malformed-jsonl")))
    hidden = scanning.hides_column(F.when(F.col("__first").isNull(), F.col("__clean")), lines, allow)
    x = x.withColumn("__hidden", hidden)
    x = step(x, [*kept, "__forged", "__clean"], __why=F.coalesce("__first", F.when(F.col("__hidden"), "escape-hidden-secret")))
    # an artifact that is set aside is not scanned: its text goes through empty
    x = x.withColumn("__text", F.when(F.col("__why").isNull(), F.col("__clean")).otherwise(""))
    out = _judged(x, raw, allow, quarantine_all=quarantine_all)
    return out.withColumn("redacted", F.encode("redacted", "UTF-8")).select(*kept, "why", *OUTCOME)


def originals(texts: DataFrame, outcome: DataFrame) -> DataFrame:
    """(id, content): originals of artifacts that need quarantine. They are written first; what could not be written is not archived."""
    return texts.select("id", F.coalesce("text", F.lit("")).cast("binary").alias("content")).join(outcome.where("needs_quarantine").select("id"), "id", "left_semi")


def frames(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(path, how, content): what to write of artifacts (path, content): all of a new or changed one, or a frame with what follows where the stored bytes are the exact beginning; nothing of an equal one."""
    s = stored.select(F.col("path").alias("p"), F.col("content").alias("old"))
    x = now.select("path", "content").join(s, F.col("path") == F.col("p"), "left").where("old is null or old <> content")
    grows = F.coalesce(F.startswith("content", "old"), F.lit(False))
    tail = F.expr("substr(content, octet_length(old) + 1)")
    return x.select("path", F.when(grows, "append").otherwise("rewrite").alias("how"), F.when(grows, tail).otherwise(F.col("content")).alias("content"))


def finding_kinds(scan: DataFrame) -> DataFrame:
    """(id, kinds) of scanned texts: how many findings of each kind were redacted or quarantined, by kind; texts without one are absent."""
    f = scanning.findings(scan).where(F.col("action").isin("redact", "quarantine"))
    n = f.groupBy("id", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
