"""Ledger merges, capture plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the shape of every file of a scratch tree.
SCRATCH_SHAPE = "/tmp/claude-<uid>/<slug>/<uuid>/scratch"


def latest_of(rows: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row of each key: the one with the largest value of `latest` (null last); of equal ones the one that comes last as JSON."""
    order = [F.col(latest)] if latest else []
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, F.to_json(F.struct(*rows.columns)))).alias("row")).select("row.*")


def upsert(old: DataFrame, new: DataFrame, key: str, *, latest: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: new rows, and the old ones whose key isn't among them.

    Of several new rows of a key latest_of() counts. The columns in `keep`, such as an id, stay as the old row has them; any
    other column that new lacks is null in its rows.
    """
    new = latest_of(new, key, latest)
    out = new
    if keep:
        before = old.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in keep])
        kept = [F.coalesce(f"__{c}", *([c] if c in new.columns else [])).alias(c) for c in keep]
        out = new.join(before, F.col(key) == F.col("__key"), "left").select(*[c for c in new.columns if c not in keep], *kept)
    return old.join(new.select(key), key, "left_anti").unionByName(out, allowMissingColumns=True)


def merge_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions (uuid, project_slug, cwd, git_branch, cc_version, first_seen, last_archived) after a run, one row each.

    A session met again takes the run's project_slug and last_archived, of its facets those that the run knows, and keeps
    its first_seen. Of several new rows the one archived last counts.
    """
    o = old.select([F.col(c).alias(f"o_{c}") for c in old.columns])
    n = latest_of(new, "uuid", "last_archived")
    both = n.join(o, n.uuid == F.col("o_uuid"), "full")
    newer = lambda c: F.coalesce(c, f"o_{c}").alias(c)
    return both.select(*map(newer, ("uuid", "project_slug", "cwd", "git_branch", "cc_version")), F.coalesce("o_first_seen", "first_seen").alias("first_seen"), newer("last_archived"))


def capture_plan(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, plan, start, end): what to capture of appendable files up to their last newline.

    Skip if the captured beginning is unchanged and nothing whole follows, tail from the captured end if it is
    unchanged, else full. `current` has (path, content binary), `prior` (path, offset, sha256).
    """
    x = current.join(prior.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left")
    return x.select("path", F.inline(F.array(line_plan("content", "offset", "sha256"))))


def line_plan(content: str, offset: str, sha256: str) -> Column:
    """A struct (plan, start, end) of capture_plan() for a content and the captured size and hash of its row."""
    end = F.expr(f"CASE WHEN instr(decode({content}, 'ISO-8859-1'), '\n') = 0 THEN 0 ELSE octet_length({content}) - instr(reverse(decode({content}, 'ISO-8859-1')), '\n') + 1 END")
    same = (F.col(offset) <= F.octet_length(content)) & (F.sha2(F.expr(f"substr({content}, 1, cast({offset} AS int))"), 256) == F.col(sha256))
    plan = F.when(F.coalesce(same, F.lit(False)), F.when(end <= F.col(offset), "skip").otherwise("tail")).otherwise("full")
    return F.struct(plan.alias("plan"), F.when(plan == "full", 0).otherwise(F.col(offset)).cast("long").alias("start"), end.cast("long").alias("end"))


def changed(candidates: DataFrame, watermark: DataFrame) -> DataFrame:
    """Candidates (source_path, source_sha256, ...) whose content the watermark doesn't have."""
    return candidates.join(watermark.select("source_path", "source_sha256"), ["source_path", "source_sha256"], "left_anti")


def flips(planned: DataFrame, now: DataFrame) -> DataFrame:
    """(planned, now, n): verdicts of a plan against those at its execution, by source_path; only what is `delete` in both may go, and what has gone is null."""
    then = planned.select("source_path", F.col("verdict").alias("planned"))
    return then.join(now.select("source_path", F.col("verdict").alias("now")), "source_path", "left").groupBy("planned", "now").agg(F.count("*").alias("n"))


def stored_ok(stored: DataFrame, decoded: DataFrame) -> DataFrame:
    """(path, ok): the stored bytes (path, content, stored_sha256, content_sha256) have their hash, and so have the decoded ones (path, content).

    An empty content hash is an old record, for which the first check alone counts; what can't be decoded is not ok.
    """
    # contents are hashed where they are: the join moves hashes only
    plain = decoded.select(F.col("path").alias("dp"), F.sha2("content", 256).alias("plain"))
    outer = stored.select("path", (F.sha2("content", 256) == F.col("stored_sha256")).alias("same"), "content_sha256")
    x = outer.join(plain, F.col("path") == F.col("dp"), "left")
    inner = (F.col("content_sha256") == "") | (F.col("plain") == F.col("content_sha256"))
    return x.select("path", F.coalesce(F.col("same") & inner, F.lit(False)).alias("ok"))


def status(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row of counts; zeros for empty tables."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    a = artifacts.agg(F.count("*").alias("artifacts"), total("redacted").alias("redacted"), total("quarantined").alias("quarantined"), F.count_if(F.col("verified_at").isNull()).alias("unverified"), total("source_bytes").alias("bytes"))
    return sessions.agg(F.count("*").alias("sessions")).join(a)


def secrets_report(found: DataFrame, artifacts: DataFrame, least: str = "low") -> DataFrame:
    """Findings of a severity or more with their artifacts; `by_text` orders severities as text (med, low, high), `by_grade` by grade."""
    grades = ["low", "med", "high"]
    grade = lambda c: F.array_position(F.array(*map(F.lit, grades)), c).cast("long")
    x = found.where(F.col("severity").isin(grades[grades.index(least):])).join(artifacts.select("id", "session_uuid", "source_path"), "id")
    return x.select("id", "session_uuid", "source_path", "kind", "severity", "sha8", "action", grade(F.col("severity")).alias("grade")).orderBy(F.desc("severity"), "session_uuid", "id", "sha8")


def store_key(slug: Column, uuid: Column) -> Column:
    """slug--uuid; the hexadecimal form of the two if that begins like a coded key or is longer than 255 bytes, and a digest of that form if it is longer than 255 bytes too.

    Fixed values: the two beginnings and the length.
    """
    plain = F.concat(slug, F.lit("--"), uuid)
    pair = F.concat(F.lower(F.hex(slug)), F.lit("--"), F.lower(F.hex(uuid)))
    coded = F.startswith(plain, F.lit("_hex--")) | F.startswith(plain, F.lit("_h256--")) | (F.octet_length(plain) > 255)
    long = F.length(pair) + len("_hex--") > 255
    return F.when(~coded, plain).when(~long, F.concat(F.lit("_hex--"), pair)).otherwise(F.concat(F.lit("_h256--"), F.sha2(pair, 256)))


def shapes(files: DataFrame) -> DataFrame:
    """(user, kind, shape, n, bytes, example) of users' files (user, home, root, path, bytes): what lies below a root, by the template of its path.

    root says what the home is: `claude` for session files, whose second part below it is the project's slug, `cache` for logs of
    servers, which are of kind mcp, and `tmp` for scratch trees, which are of one shape. Parts of 32 or more hexadecimal digits
    and dashes, before .jsonl as well, are names of sessions. Slugs and sessions become templates. The kind of a session file is
    told by its name and its folder's. Files outside their home are left out.
    """
    below = F.split(F.substr("path", F.length("home") + 2), "/")
    name, parent = F.element_at("part", -1), F.try_element_at("part", F.lit(-2))
    template = F.transform("part", lambda p, i: F.when((i == 1) & (F.col("root") == "claude"), "<slug>").when(p.rlike(r"^[0-9a-fA-F-]{32,}(\.jsonl)?$"), "<uuid>").otherwise(p))
    session = F.when(F.endswith(name, F.lit(".meta.json")) | (parent == "subagents"), "subagents").when(parent == "tool-results", "tool-results").when(F.endswith(name, F.lit(".jsonl")), "transcript").otherwise("unknown")
    kind = F.when(F.col("root") == "cache", "mcp").when(F.col("root") == "tmp", "scratch").otherwise(session)
    label = F.when(F.col("root") == "claude", ".claude").otherwise(F.element_at(F.split("home", "/"), -1))
    x = files.where(F.startswith("path", F.concat("home", F.lit("/")))).withColumn("part", below)
    shape = F.when(F.col("root") == "tmp", SCRATCH_SHAPE).otherwise(F.concat_ws("/", label, F.array_join(template, "/")))
    x = x.select("user", kind.alias("kind"), shape.alias("shape"), "bytes", "path")
    return x.groupBy("user", "shape").agg(F.min_by("kind", "path").alias("kind"), F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.min("path").alias("example"))
