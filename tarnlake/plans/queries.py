"""The registered queries of the session model, each with SQL over the same tables where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import archive, capture, documents, index, ledger, paths, postings, retention, scanning, scratch, search, transcripts
from tarnlake.sources import files
from tarnlake.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and SQL that follows the common relations of tables.SQL."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {t.SQL}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


# --- search and read ---------------------------------------------------------------------------------------

_RECENT = "SELECT entry_uuid, session_uuid, role, timestamp, substr(text, 1, 200) AS snippet, 0.0::DOUBLE AS rank FROM entries WHERE {} ORDER BY timestamp DESC NULLS LAST, entry_uuid LIMIT {}"


def _search(name: str, text: str, where: str, limit: int = 20, **named: str) -> None:
    query(name, _RECENT.format(where, limit))(lambda s, d: search.recent(t.entries(s, d), search.parse(text, **named), limit))


_search("search_metadata_recent", "", "true")
_search("search_facets", "project:proj-3 role:assistant", "project_slug = 'proj-3' AND role = 'assistant'", 50)
_search("search_facet_tool", "tool:Read agent:main", "tool_name = 'Read' AND agent = 'main'", 50)
_search("search_facet_branch_cwd", "branch:main cwd:/w/1", "git_branch = 'main' AND cwd = '/w/1'", 50)
_search("search_inline_loses_to_named", "role:user session:conv-4", "role = 'assistant' AND session_uuid = 'conv-4'", role="assistant")
_search("search_time_range", "since:2024-01-02 until:2024-01-03", "timestamp >= '2024-01-02' AND timestamp < '2024-01-03'", 100)
_search("search_on_date", "since:2024-01-09", "timestamp >= '2024-01-02' AND timestamp < '2024-01-03'", 100, on="2024-01-02")

_NORMAL = f"""' ' || trim(regexp_replace(translate(lower(text), '{search.FOLD[0]}', '{search.FOLD[1]}'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g')) || ' '"""


def _ranked(phrases: list[str], where: str = "true") -> str:
    tf = ", ".join(f"len(regexp_extract_all(replace(norm, ' ', '  '), ' {p.replace(' ', '  ')} '))::DOUBLE AS tf{i}" for i, p in enumerate(phrases))
    score = " + ".join(
        f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) ELSE 1e-6 END) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
        for i in range(len(phrases))
    )
    return f""", n0 AS (SELECT *, {_NORMAL} AS norm FROM entries), n1 AS (SELECT *, CASE WHEN length(norm) <= 2 THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) - 1 END::DOUBLE AS dl, {tf} FROM n0),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases)))} FROM n1)
 SELECT entry_uuid, session_uuid, round(-({score}), 9) AS rank FROM n1, st WHERE {" AND ".join(f"tf{i} > 0" for i in range(len(phrases)))} AND {where}"""


_built: dict[tuple, postings.Index] = {}


def _shared(s: SparkSession) -> str:
    """The folder that executors share (on a local master without one: a temporary folder, for the session)."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not s.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tarnlake-")
        s.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _kept(s: SparkSession, d: str, name: str, make: Callable[[str], postings.Index]) -> postings.Index:
    """An index that is made in a new folder at its first use in a session, and again once the table's files have changed."""
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/conversations.parquet")
    fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    files = sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path))
    key = (name, s.sparkContext.applicationId, *files)
    if key not in _built:
        _built[key] = make(f"{_shared(s)}/index-{uuid.uuid4().hex}")
    return _built[key]


def _index(s: SparkSession, d: str) -> postings.Index:
    """The index of all entries."""
    return _kept(s, d, "entries", lambda folder: postings.Index(s, folder).build(t.entries(s, d)))


def _bm25(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda s, d: _index(s, d).bm25(search.parse(text)))


_bm25("search_bm25_single", "than", _ranked(["than"]))
_bm25("search_bm25_and", "the er", _ranked(["the", "er"]))
_bm25("search_bm25_faceted", "étion role:user", _ranked(["etion"], "role = 'user'"))
_bm25("search_phrase", "of:the", _ranked(["of the"]))


@query("search_bm25_unindexed", _ranked(["of the"]))
def _(s, d):
    return search.bm25(t.entries(s, d), search.parse("of:the"))


def _terms_sql(entries: str) -> str:
    return f""", e AS ({entries}), n0 AS (SELECT entry_uuid, unnest(string_split(trim({_NORMAL}), ' ')) AS term FROM e), n1 AS (SELECT term, entry_uuid, count(*) AS tf FROM n0 WHERE term <> '' GROUP BY ALL)
 SELECT term, count(*) AS entries, sum(tf)::BIGINT AS occurrences FROM n1 GROUP BY term"""


def _terms(held: postings.Index) -> DataFrame:
    return held.table("postings").groupBy("term").agg(F.count("*").alias("entries"), F.sum("tf").alias("occurrences"))


@query("index_build", _terms_sql("SELECT * FROM entries"))
def _(s, d):
    return _terms(_index(s, d))


@query("index_sync", _terms_sql("SELECT entry_uuid, CASE WHEN artifact_id % 10 = 0 THEN text || ' Dőrch čas' ELSE text END AS text FROM entries WHERE artifact_id % 10 <> 1"))
def _(s, d):
    e = t.entries(s, d)
    changed = e.where("artifact_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" Dőrch čas")))
    return _terms(_kept(s, d, "synced", lambda folder: postings.Index(s, folder).build(e).sync(changed, e.where("artifact_id % 10 = 1"))))


@query("search_trigram_substring", "SELECT entry_uuid, session_uuid FROM entries WHERE contains(lower(text), 'tion')")
def _(s, d):
    return search.contains_trigrams(t.entries(s, d), "Tion")


@query("search_trigram_index", "SELECT entry_uuid, session_uuid FROM entries WHERE contains(lower(text), 'rention')")
def _(s, d):
    held = _kept(s, d, "trigrams", lambda folder: postings.Index(s, folder, tokenizer=postings.TRIGRAMS).build(t.entries(s, d)))
    return held.bm25(search.Query(phrases=["renTion"])).select("entry_uuid", "session_uuid")


#: The window is found by joining every hit with the hits that end within it, and put together again token by token.
_SNIPPET = f""", n0 AS (SELECT entry_uuid, regexp_extract_all(text, '[\\pL\\pN\\p{{Mn}}]+') AS tok, string_split_regex(text, '[\\pL\\pN\\p{{Mn}}]+') AS gap, string_split(trim({_NORMAL}), ' ') AS norm FROM entries),
 p AS (SELECT entry_uuid, len(tok) AS n, norm, unnest(range(0, len(tok))) AS i FROM n0),
 h AS (SELECT entry_uuid, n, i, 2 AS size, 'of the' AS no FROM p WHERE norm[i + 1] = 'of' AND norm[i + 2] = 'the' UNION ALL SELECT entry_uuid, n, i, 1, 'in' FROM p WHERE norm[i + 1] = 'in' UNION ALL SELECT entry_uuid, n, i, 1, 'the' FROM p WHERE norm[i + 1] = 'the'),
 w AS (SELECT a.entry_uuid, a.n, a.i, count(DISTINCT b.no) AS kinds, count(*) AS hits, max(b.i + b.size) AS last FROM (SELECT DISTINCT entry_uuid, n, i FROM h) a JOIN h b ON a.entry_uuid = b.entry_uuid AND b.i >= a.i AND b.i + b.size <= a.i + 12 GROUP BY a.entry_uuid, a.n, a.i),
 best AS (SELECT *, greatest(0, least(i - (12 - (last - i)) // 2, n - 12)) AS first FROM (SELECT *, row_number() OVER (PARTITION BY entry_uuid ORDER BY kinds DESC, hits DESC, i) AS r FROM w) WHERE r = 1),
 c AS (SELECT entry_uuid, first, least(first + 12, n) AS upto, n, unnest(range(first, least(first + 12, n))) AS k FROM best),
 m AS (SELECT c.*, tok, gap, (SELECT count(*) FROM h WHERE h.entry_uuid = c.entry_uuid AND h.i >= first AND h.i + size <= upto AND h.i <= k AND k < h.i + size) AS covered,
   (SELECT count(*) FROM h WHERE h.entry_uuid = c.entry_uuid AND h.i >= first AND h.i + size <= upto AND h.i < k AND k < h.i + size) AS before, (SELECT count(*) FROM h WHERE h.entry_uuid = c.entry_uuid AND h.i >= first AND h.i + size <= upto AND h.i <= k AND k + 1 < h.i + size) AS behind FROM c JOIN n0 USING (entry_uuid))
 SELECT entry_uuid, any_value(CASE WHEN first > 0 THEN '… ' ELSE gap[1] END) || string_agg(CASE WHEN k > first THEN gap[k + 1] ELSE '' END || CASE WHEN covered > 0 AND before = 0 THEN '[' ELSE '' END || tok[k + 1] || CASE WHEN covered > 0 AND behind = 0 THEN ']' ELSE '' END, '' ORDER BY k)
   || any_value(CASE WHEN upto < n THEN ' …' ELSE gap[n + 1] END) AS snippet FROM m GROUP BY entry_uuid"""


@query("search_snippet", _SNIPPET)
def _(s, d):
    return search.snippet(t.entries(s, d), ["of the", "in", "the"])


_THREAD = "SELECT entry_uuid, parent_uuid, role, agent, tool_name, timestamp, seq, text FROM entries WHERE session_uuid = '{}'"


@query("read_session", _THREAD.format("conv-3") + " AND agent = 'main'")
def _(s, d):
    return search.thread(t.entries(s, d), "conv-3")


@query("read_session_agents", _THREAD.format("conv-5"))
def _(s, d):
    return search.thread(t.entries(s, d), "conv-5", agents=True)


@query("read_entry", _THREAD.format("conv-3") + " AND entry_uuid = '3:1'")
def _(s, d):
    return search.thread(t.entries(s, d), "conv-3", agents=True).where("entry_uuid = '3:1'")


@query("read_grep", _THREAD.format("conv-1") + " AND contains(text, 'in')")
def _(s, d):
    return search.thread(t.entries(s, d), "conv-1", agents=True, grep="in")


# --- transcripts -------------------------------------------------------------------------------------------

_LINES = """, l AS (SELECT *, seq % 11 = 10 AS cut, tool_name IS NOT NULL AS calls, role = 'user' AND seq % 2 = 0 AND seq > 0 AS answers FROM entries),
 p AS (SELECT artifact_id AS artifact, seq, entry_uuid, parent_uuid, timestamp, CASE WHEN answers THEN 'tool_result' ELSE role END AS role, CASE WHEN calls THEN '$' || tool_name || ' ' || substr(text, 1, 40) ELSE text END AS text,
   CASE WHEN calls THEN tool_name WHEN answers THEN (SELECT c.tool_name FROM l c WHERE c.artifact_id = l.artifact_id AND c.seq = l.seq - 1 AND NOT c.cut AND c.calls) END AS tool_name FROM l WHERE NOT cut AND NOT regexp_matches(text, '^[\\s\\pZ]*$'))"""


def _values(s: SparkSession, d: str) -> DataFrame:
    return transcripts.parsed(transcripts.lines(transcripts.as_transcripts(t.entries(s, d))))


@query("jsonl_parse_entries", f"{_LINES} SELECT artifact, seq, entry_uuid, parent_uuid, timestamp, role, text, tool_name FROM p")
def _(s, d):
    return transcripts.parsed_entries(_values(s, d))


@query("jsonl_tool_names", f"{_LINES} SELECT role, tool_name, count(*) AS n FROM p WHERE tool_name IS NOT NULL GROUP BY ALL")
def _(s, d):
    return transcripts.parsed_entries(_values(s, d)).where("tool_name is not null").groupBy("role", "tool_name").agg(F.count("*").alias("n"))


@query("jsonl_skipped_count", "SELECT artifact_id AS artifact, count(*) FILTER (seq % 11 = 10) AS skipped, count(*) AS lines FROM entries GROUP BY 1")
def _(s, d):
    return _values(s, d).groupBy("artifact").agg(F.count_if("malformed").alias("skipped"), F.count("*").alias("lines"))


@query("transcript_header", "SELECT artifact_id AS artifact, arg_min(cwd, seq) AS cwd, arg_min(git_branch, seq) AS branch, '1.' || (artifact_id % 3) AS version, arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen, count(*) AS n_lines FROM entries WHERE seq % 11 <> 10 GROUP BY 1")
def _(s, d):
    return transcripts.header(_values(s, d))


# --- index of stored artifacts -----------------------------------------------------------------------------

#: Entries of t.stored(): the roles are written out, and what is a document gives its texts as one.
_STORED_DOCS = _LINES + """, d AS (SELECT artifact_id, ['transcript', 'subagent', 'transcript', 'history', 'paste', 'snapshot', 'scratch-file', 'tool-result'][(artifact_id % 8) + 1] AS role, session_uuid, any_value(agent) AS agent, any_value(project_slug) AS project_slug,
   any_value(cwd) AS cwd, any_value(git_branch) AS git_branch, '1.' || (artifact_id % 3) AS cc_version, string_agg(text, chr(10) ORDER BY seq) AS text FROM entries GROUP BY artifact_id, session_uuid),
 docs AS (SELECT entry_uuid, parent_uuid, session_uuid, artifact_id, '/p/' || artifact_id AS source_path, p.role, agent, tool_name, project_slug, cwd, git_branch, cc_version, timestamp, contains(p.text, '‹REDACTED:') OR contains(p.text, '‹QUARANTINED:') AS has_redaction, seq,
   CASE WHEN length(p.text) > 262144 THEN left(p.text, 262144) || '…[truncated]' ELSE p.text END AS text FROM p JOIN d ON artifact = artifact_id WHERE artifact_id % 8 IN (0, 1, 2)
   UNION ALL SELECT 'art:' || artifact_id, NULL, session_uuid, artifact_id, '/p/' || artifact_id, role, 'main', NULL, project_slug, cwd, git_branch, cc_version, NULL, contains(text, '‹REDACTED:') OR contains(text, '‹QUARANTINED:'), 0,
   CASE WHEN length(text) > 262144 THEN left(text, 262144) || '…[truncated]' ELSE text END FROM d WHERE artifact_id % 8 IN (3, 4, 5, 7) AND NOT regexp_matches(text, '^[\\s\\pZ]*$'))"""
_DOC_COLUMNS = ", ".join(documents.COLUMNS)


def _stored_artifacts(s: SparkSession, d: str) -> DataFrame:
    a = t.stored(s, d, transcripts.as_transcripts(t.entries(s, d)))
    return a.withColumn("source_sha256", F.sha2("content", 256))


def _changed_artifacts(s: SparkSession, d: str) -> DataFrame:
    """Of every hundred artifacts the last has grown by a line."""
    grown = F.col("artifact_id") % 100 == 99
    line = F.to_json(F.struct(F.lit("summary").alias("type"), F.concat(F.lit("s"), "artifact_id").alias("uuid"), F.lit("Dőrch čas").alias("summary")))
    entry = F.when(F.col("role").isin("transcript", "subagent"), F.concat(line, F.lit("\n"))).otherwise("\nDőrch čas")
    a = _stored_artifacts(s, d).withColumn("content", F.when(grown, F.concat("content", entry)).otherwise(F.col("content")))
    return a.withColumn("source_sha256", F.sha2("content", 256))


def _transcript_index(s: SparkSession, d: str) -> postings.Index:
    return _kept(s, d, "stored", lambda folder: documents.build_index(s, _stored_artifacts(s, d), folder, per_bucket=10))


def _grown_index(s: SparkSession, d: str) -> postings.Index:
    def make(folder: str) -> postings.Index:
        old = _stored_artifacts(s, d)
        built = documents.build_index(s, old, folder, per_bucket=10)
        return documents.sync_index(built, _changed_artifacts(s, d), old.select("source_path", "source_sha256", F.lit(0).cast("long").alias("doc_count")))[0]

    return _kept(s, d, "grown", make)


@query("index_documents", f"{_STORED_DOCS} SELECT {_DOC_COLUMNS} FROM docs")
def _(s, d):
    return documents.indexed(_stored_artifacts(s, d))


@query("search_transcripts", _STORED_DOCS + _ranked(["of the"]).replace("FROM entries)", "FROM docs)", 1))
def _(s, d):
    return _transcript_index(s, d).bm25(search.parse("of:the"))


@query("search_transcripts_faceted", _STORED_DOCS + _ranked(["the"], "role = 'tool_result' AND tool_name = 'Edit' AND timestamp >= '2024-01-02'").replace("FROM entries)", "FROM docs)", 1))
def _(s, d):
    return _transcript_index(s, d).bm25(search.parse("the role:tool_result tool:Edit since:2024-01-02"))


_GROWN = """, more AS (SELECT artifact_id, CASE WHEN role IN ('transcript', 'subagent') THEN 's' || artifact_id ELSE 'art:' || artifact_id END AS entry_uuid, role IN ('transcript', 'subagent') AS own, text FROM d WHERE artifact_id % 100 = 99 AND role <> 'scratch-file')"""


@query("index_increment", f"{_STORED_DOCS}{_GROWN} SELECT entry_uuid, artifact_id, sha256(text) AS sha256 FROM docs WHERE entry_uuid NOT IN (SELECT entry_uuid FROM more) UNION ALL SELECT entry_uuid, artifact_id, sha256(CASE WHEN own THEN 'Dőrch čas' ELSE text || chr(10) || 'Dőrch čas' END) FROM more")
def _(s, d):
    return _grown_index(s, d).table("documents").select("entry_uuid", "artifact_id", F.sha2("text", 256).alias("sha256"))


@query("index_touched", "SELECT DISTINCT artifact_id // 10 AS bucket FROM conversations, (SELECT DISTINCT conv_id AS artifact_id FROM conversations) WHERE artifact_id % 100 = 99 AND artifact_id % 8 <> 6")
def _(s, d):
    return s.createDataFrame([(b,) for b in _grown_index(s, d).touched(1)], "bucket long")


# --- scan --------------------------------------------------------------------------------------------------

#: Keys made from ids, so that several detectors have something to find; put together when the query runs.
_PLANT = [("AK", "IA", 16, True), ("gh", "p_", 36, False), ("xox", "b-", 20, False), ("np", "m_", 40, False)]


def _planted(s: SparkSession, d: str) -> DataFrame:
    x = t.table(s, d, "documents")
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    forms = [F.concat(F.lit(a + b), F.upper(F.substring(key, 1, n)) if up else F.substring(key, 1, n)) for a, b, n, up in _PLANT]
    return x.select(F.col("doc_id").alias("id"), F.concat(F.lit("key "), F.get(F.array(*forms), (F.col("doc_id") % 4).cast("int")), F.lit(" \n"), "text").alias("text"))


_PLANT_SQL = ", ".join(f"'{a}' || '{b}' || {'upper' if up else ''}(substr(sha256(doc_id::VARCHAR), 1, {n}))" for a, b, n, up in _PLANT)
_KINDS = [k for k, _, _ in scanning.DETECTORS]
_FOUND = f""", planted AS (SELECT doc_id AS id, 'key ' || [{_PLANT_SQL}][(doc_id % 4) + 1] || ' ' || chr(10) || text AS text FROM documents),
 matched AS (SELECT id, regexp_extract_all(text, $${scanning.DETECTORS[17][2]}$$) AS hits, string_split_regex(text, $${scanning.DETECTORS[17][2]}$$) AS gaps FROM planted),
 entropy AS (SELECT id, hits[k] AS found, octet_length(encode(array_to_string(gaps[1:k], '') || array_to_string(hits[1:k - 1], ''))) AS pos FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM matched)),
 f AS (SELECT id, ['aws-key', 'github-token', 'slack-token', 'npm-token'][(id % 4) + 1] AS kind, 'high' AS severity, 'quarantine' AS action, 4 AS pos, [{_PLANT_SQL.replace("doc_id", "id")}][(id % 4) + 1] AS found FROM planted
   UNION ALL SELECT id, 'generic-entropy', 'med', 'redact', pos, found FROM entropy)"""


@query("scan_findings", f"{_FOUND} SELECT id, kind, severity, substr(sha256(found), 1, 8) AS sha8, action, pos::BIGINT AS span_start, octet_length(encode(found))::BIGINT AS span_len FROM f")
def _(s, d):
    return scanning.findings(scanning.scanned(_planted(s, d)))


@query("scan_findings_by_kind", f"{_FOUND} SELECT kind, severity, count(*) AS n FROM f GROUP BY ALL")
def _(s, d):
    return scanning.findings(scanning.scanned(_planted(s, d))).groupBy("kind", "severity").agg(F.count("*").alias("n"))


_PLACE = "'‹REDACTED:' || kind || ':' || substr(sha256(found), 1, 8) || '›'"


@query("scan_redacted_text", f"""{_FOUND}, once AS (SELECT id, any_value(found) FILTER (kind = 'generic-entropy') AS e, any_value({_PLACE}) FILTER (kind = 'generic-entropy') AS ep, any_value(found) FILTER (kind <> 'generic-entropy') AS k, any_value({_PLACE}) FILTER (kind <> 'generic-entropy') AS kp FROM f GROUP BY id)
 SELECT p.id, replace(replace(text, k, kp), coalesce(e, k), coalesce(ep, kp)) AS redacted FROM planted p JOIN once USING (id)""")
def _(s, d):
    return scanning.scanned(_planted(s, d)).select("id", "redacted")


@query("scan_tally", f"{_FOUND} SELECT id, count(*) AS n_findings, count(*) AS n_redacted, 0::BIGINT AS n_flagged, count(*) FILTER (action = 'quarantine') AS n_quarantined, true AS needs_quarantine FROM f GROUP BY id")
def _(s, d):
    return scanning.tally(scanning.scanned(_planted(s, d)))


@query("scan_allowlist", f"{_FOUND} SELECT kind, CASE WHEN kind = 'npm-token' THEN 'allowed' ELSE action END AS action, count(*) AS n FROM f GROUP BY ALL")
def _(s, d):
    return scanning.findings(scanning.scanned(_planted(s, d), ["^npm_", "(broken"])).groupBy("kind", "action").agg(F.count("*").alias("n"))


_FORGED = "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN '‹REDACTED:aws-key:00000000› ' WHEN doc_id % 9 = 1 THEN '‹QUARANTINED:x:0› ' ELSE '' END || text AS text FROM documents"


def _forged(s: SparkSession, d: str) -> DataFrame:
    x = t.table(s, d, "documents")
    mark = F.when(F.col("doc_id") % 9 == 0, "‹REDACTED:aws-key:00000000› ").when(F.col("doc_id") % 9 == 1, "‹QUARANTINED:x:0› ").otherwise("")
    return x.select(F.col("doc_id").alias("id"), F.concat(mark, "text").alias("text"))


@query("scan_defang", f", x AS ({_FORGED}) SELECT id, replace(replace(text, '‹REDACTED:', '<REDACTED:'), '‹QUARANTINED:', '<QUARANTINED:') AS text, contains(text, '‹REDACTED:') OR contains(text, '‹QUARANTINED:') AS forged FROM x")
def _(s, d):
    return scanning.defanged(_forged(s, d))


@query("scan_has_redaction_truncate", f", x AS ({_FORGED}), y AS (SELECT id, repeat(text, 1 + (id % 50)) AS text FROM x) SELECT id, CASE WHEN length(text) > 262144 THEN left(text, 262144) || '…[truncated]' ELSE text END AS text, contains(text, '‹REDACTED:') OR contains(text, '‹QUARANTINED:') AS has_redaction FROM y")
def _(s, d):
    return scanning.indexed_text(_forged(s, d).select("id", F.repeat("text", (1 + F.col("id") % 50).cast("int")).alias("text")))


@query("scan_jsonl_gate", "SELECT artifact_id AS artifact, bool_or(seq % 11 = 10) AS quarantined FROM entries GROUP BY 1")
def _(s, d):
    return _values(s, d).groupBy("artifact").agg(F.bool_or("malformed").alias("quarantined"))


#: The key's first letters in forms that a plain pattern doesn't see: an escape, a control character, bold mathematical letters, half a surrogate pair, a space of no width.
_MASKS = ["AK\\u0049A", "AK\bIA", "\U0001D400\U0001D40A\U0001D408\U0001D400", "AK\\ud800IA", "AK\u200bIA"]
_MASKED_SQL = "CASE doc_id % 8 WHEN 0 THEN 'AK\\u0049A' WHEN 1 THEN 'AK' || chr(8) || 'IA' WHEN 2 THEN chr(119808) || chr(119818) || chr(119816) || chr(119808) WHEN 3 THEN 'AK\\ud800IA' WHEN 4 THEN 'AK' || chr(8203) || 'IA' WHEN 5 THEN 'AK' || 'IA' ELSE '' END"
_ALL_HITS = "list_concat(" * (len(scanning.DETECTORS) - 1) + f"regexp_extract_all(form, $${scanning.DETECTORS[0][2]}$$)" + "".join(f", regexp_extract_all(form, $${p}$$))" for *_, p in scanning.DETECTORS[1:])


def _masked(s: SparkSession, d: str) -> DataFrame:
    x = t.table(s, d, "documents")
    mask = F.coalesce(t.pick([*_MASKS, "AK" + "IA"], F.col("doc_id") % 8), F.lit(""))
    return x.select(F.col("doc_id").alias("id"), F.concat(F.lit(" "), mask, F.upper(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)), F.lit(" "), "text").alias("text"))


@query("scan_hidden_secret", f""", x AS (SELECT doc_id AS id, ' ' || {_MASKED_SQL} || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) || ' ' || text AS text FROM documents),
 deep AS (SELECT id, text, regexp_replace(replace(replace(text, '\\u0049', 'I'), '\\ud800', ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\p{{Cf}}\\p{{M}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g') AS bare FROM x),
 forms AS (SELECT id, text, translate(bare, chr(119808) || chr(119818) || chr(119816), 'AKI') AS form FROM deep)
 SELECT id, len(list_filter({_ALL_HITS}, lambda h: NOT contains(text, h))) > 0 AS hidden FROM forms""")
def _(s, d):
    return scanning.hidden_secrets(_masked(s, d))


@query("scan_hidden_in_lines", f""", x AS (SELECT doc_id AS id, {_MASKED_SQL} || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) AS word, doc_id % 8 AS k FROM documents)
 SELECT id, regexp_matches(replace(replace(regexp_replace(word, '[\\x08\\x{{200B}}]', '', 'g'), '\\u0049', 'I'), '\\ud800', ''), $${scanning.DETECTORS[0][2]}$$) AND k <> 5 OR k = 2 AS hidden FROM x""")
def _(s, d):
    word = F.regexp_extract("text", "^ ([^ ]*) ", 1)
    line = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.struct(F.array(word).alias("b")).alias("a")))).otherwise(F.concat(F.lit('{"'), F.replace(F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("\b"), F.lit("\\b")), F.lit('": 1}')))
    return scanning.hidden_secrets(_masked(s, d).select("id", F.concat(F.lit('{"x": 1}\nnone\n'), line, F.lit("\n")).alias("text")), lines=True)


@query("scan_nul_island", "SELECT doc_id AS id, doc_id % 5 = 0 AS island FROM documents")
def _(s, d):
    x = t.table(s, d, "documents")
    zeros = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("a\0\0\0"), 16)).when(F.col("doc_id") % 5 == 1, F.repeat(F.lit("abcdefg\0"), 16)).otherwise("")
    return scanning.nul_islands(x.select(F.col("doc_id").alias("id"), F.concat(F.repeat(F.lit("."), 50), zeros, F.repeat(F.lit("."), 50), "text").cast("binary").alias("content")))


_STORED = """, x AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN '‹QUARANTINED:malformed-jsonl:00000000›' || chr(10) WHEN doc_id % 8 = 1 THEN 'AK' || 'IA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) ELSE text END AS text, doc_id % 8 AS k FROM documents),
 r AS (SELECT id, CASE WHEN k = 1 THEN 'visible-quarantine' ELSE 'in-place' END AS transition FROM x WHERE k = 1 OR (k > 1 AND regexp_matches(text, $$""" + scanning.DETECTORS[17][2] + "$$)))"


def _stored(s: SparkSession, d: str) -> DataFrame:
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 8
    key = F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)))
    text = F.when(k == 0, "‹QUARANTINED:malformed-jsonl:00000000›\n").when(k == 1, key).otherwise(F.col("text"))
    return x.select(F.col("doc_id").alias("id"), text.alias("text"), (k == 0).cast("int").alias("quarantined"))


@query("rescan_plan", f"{_STORED} SELECT id, transition, true AS fixpoint FROM r")
def _(s, d):
    return scanning.rescan_plan(_stored(s, d))


@query("rescan_transitions", f"{_STORED} SELECT transition, count(*) AS n FROM r GROUP BY 1")
def _(s, d):
    return scanning.rescan_plan(_stored(s, d)).groupBy("transition").agg(F.count("*").alias("n"))


@query("rescan_kinds", f"{_STORED}, h AS (SELECT id, CASE WHEN k = 1 THEN 'aws-key' ELSE 'generic-entropy' END AS kind, CASE WHEN k = 1 THEN 1 ELSE len(regexp_extract_all(text, $${scanning.DETECTORS[17][2]}$$)) END AS n FROM x WHERE k > 0) SELECT id, kind, n::BIGINT AS n FROM h WHERE n > 0")
def _(s, d):
    kinds = archive.finding_kinds(scanning.scanned(_stored(s, d).where("quarantined = 0").select("id", "text")))
    return kinds.select("id", F.explode("kinds").alias("kind", "n"))


# --- capture run -------------------------------------------------------------------------------------------

#: Live files of a first and a second run: unchanged results of tools, the same with a key before them, pastes that grow, transcripts that grow by a line and a half.
_LIVE = f""", x AS (SELECT doc_id AS i, doc_id % 4 AS k, source || '/' || doc_id AS source_path, text, '{{"type":"summary","summary":"' || sha256(text) || '"}}' || chr(10) AS line, 'AK' || 'IA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) AS key FROM documents),
 y AS (SELECT i, k, source_path, ['tool-result', 'tool-result', 'paste', 'transcript'][k + 1] AS role, key, CASE k WHEN 1 THEN key || ' ' || text WHEN 2 THEN text || ' more' WHEN 3 THEN line || line ELSE text END AS content FROM x),
 z AS (SELECT *, regexp_extract_all(content, $${scanning.DETECTORS[17][2]}$$) AS hits, string_split_regex(content, $${scanning.DETECTORS[17][2]}$$) AS gaps FROM y),
 r AS (SELECT *, replace(array_to_string(list_transform(range(1, len(gaps) + 1), lambda j: gaps[j] || CASE WHEN j <= len(hits) THEN '‹REDACTED:generic-entropy:' || substr(sha256(hits[j]), 1, 8) || '›' ELSE '' END), ''), CASE WHEN k = 1 THEN key ELSE chr(0) END, '‹REDACTED:aws-key:' || substr(sha256(key), 1, 8) || '›') AS stored FROM z)"""


def _live(s: SparkSession, d: str, *, second: bool) -> DataFrame:
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 4
    key = F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)), F.lit(" "), "text")
    line = F.concat(F.lit('{"type":"summary","summary":"'), F.sha2("text", 256), F.lit('"}\n'))
    grown = (F.concat("text", F.lit(" more")), F.concat(line, line, F.lit('{"type"'))) if second else (F.col("text"), line)
    content = F.when(k == 1, key).when(k == 2, grown[0]).when(k == 3, grown[1]).otherwise(F.col("text"))
    return x.select(F.concat_ws("/", "source", "doc_id").alias("source_path"), t.pick(["tool-result", "tool-result", "paste", "transcript"], k).alias("role"), F.lit("s").alias("session_uuid"), content.cast("binary").alias("content"))


def _captured_twice(s: SparkSession, d: str) -> tuple[capture.Store, capture.Run]:
    """A store after two runs, and what the second one did."""
    store = capture.Store(s, f"{_shared(s)}/store-{uuid.uuid4().hex}", buckets=8)
    capture.capture(store, _live(s, d, second=False), "2024-01-01T00:00:00")
    return store, capture.capture(store, _live(s, d, second=True), "2024-01-02T00:00:00")


@query("capture_ledger", f"{_LIVE} SELECT source_path, role, sha256(content) AS source_sha256, strlen(content) AS source_bytes, sha256(stored) AS content_sha256, k = 1 OR len(hits) > 0 AS redacted, k = 1 AS quarantined, CASE WHEN k = 3 THEN 2 ELSE 1 END AS n_frames, CASE WHEN k < 2 THEN '2024-01-01T00:00:00' ELSE '2024-01-02T00:00:00' END AS captured_at FROM r")
def _(s, d):
    return _captured_twice(s, d)[0].ledger().select("source_path", "role", "source_sha256", "source_bytes", "content_sha256", "redacted", "quarantined", F.size("frames").alias("n_frames"), "captured_at")


@query("capture_contents", f"{_LIVE} SELECT source_path, stored AS content FROM r")
def _(s, d):
    return _captured_twice(s, d)[0].contents().select("source_path", F.decode("content", "UTF-8").alias("content"))


@query("capture_counts", f"{_LIVE} SELECT count(*) FILTER (k < 2) AS skipped, count(*) FILTER (k > 1) AS written, sum(len(hits)) FILTER (k > 1)::BIGINT AS redacted FROM r")
def _(s, d):
    counts = _captured_twice(s, d)[1].counts
    return s.createDataFrame([tuple(counts[c] for c in ("skipped", "written", "redacted"))], "skipped long, written long, redacted long")


@query("rescan_apply", f"{_LIVE} SELECT source_path, stored AS content, k = 1 OR len(hits) > 0 AS redacted, k = 1 AS quarantined, CASE WHEN k = 1 OR len(hits) > 0 THEN '2024-01-03T00:00:00' ELSE '2024-01-02T00:00:00' END AS captured_at FROM r")
def _(s, d):
    store = capture.Store(s, f"{_shared(s)}/store-{uuid.uuid4().hex}", buckets=8)
    capture.capture(store, _live(s, d, second=True), "2024-01-02T00:00:00", scan=False)
    capture.rescan(store, "2024-01-03T00:00:00")
    held = store.contents(None, "redacted", "quarantined", "captured_at")
    return held.select("source_path", F.decode("content", "UTF-8").alias("content"), "redacted", "quarantined", "captured_at")


@query("status_stored", f"{_LIVE} SELECT count(*) AS artifacts, 1::BIGINT AS sessions, count(*) FILTER (k = 1 OR len(hits) > 0) AS redacted, count(*) FILTER (k = 1) AS quarantined, sum(strlen(content))::BIGINT AS source_bytes, sum(strlen(stored))::BIGINT AS content_bytes, true AS stored FROM r")
def _(s, d):
    row = capture.status(_captured_twice(s, d)[0].ledger())
    return row.withColumn("stored", F.col("stored_bytes") > 0).drop("stored_bytes")


_GATED = """, x AS (SELECT doc_id AS id, doc_id % 8 AS k, text FROM documents)
 SELECT id, CASE k WHEN 1 THEN 'non-utf8' WHEN 2 THEN 'utf16-ambiguous' WHEN 3 THEN 'malformed-jsonl' WHEN 4 THEN 'escape-hidden-secret' WHEN 5 THEN 'escape-hidden-secret' END AS why, k IN (0, 6, 7) AS scanned, k BETWEEN 1 AND 5 AS needs_quarantine, CASE WHEN k = 6 THEN 1 ELSE 0 END::BIGINT AS flagged,
  CASE k WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'high' WHEN 5 THEN 'high' WHEN 6 THEN 'low' END AS severity FROM x"""


@query("scan_artifacts", _GATED)
def _(s, d):
    i, k = F.col("doc_id"), F.col("doc_id") % 8
    line = F.concat(F.lit('{"type":"user","text":"'), F.sha2("text", 256), F.lit('"}\n'))
    hidden = F.concat(F.lit("AK\\u0049A"), F.upper(F.substring(F.sha2(i.cast("string"), 256), 1, 16)))
    content = (
        F.when(k == 1, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).when(k == 2, F.concat(F.col("text").cast("binary"), F.lit(b"a\0" * 40))).when(k == 3, F.concat(line, F.lit("{broken\n")).cast("binary"))
        .when(k == 4, F.concat(line, F.lit('["'), hidden, F.lit('"]\n')).cast("binary")).when(k == 5, F.concat("text", hidden).cast("binary")).when(k == 6, F.concat(F.lit("‹REDACTED:x:0› "), line).cast("binary")).otherwise(line.cast("binary"))
    )
    role = F.when(k.isin(0, 3, 4, 7), "transcript").otherwise("paste")
    out = archive.scan_artifacts(t.table(s, d, "documents").select(i.alias("id"), role.alias("role"), content.alias("content")))
    return out.select("id", "why", "scanned", "needs_quarantine", "flagged", F.get("findings", F.lit(0))["severity"].alias("severity"))


_WHY = "CASE WHEN doc_id % 9 = 4 THEN 'non-utf8' END"


def _captured(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d).select("id", F.when(F.col("id") % 8 == 0, F.concat(F.lit("‹REDACTED:x:0› "), "text")).otherwise(F.col("text")).alias("text"), F.when(F.col("id") % 9 == 4, "non-utf8").alias("why"))


_CAPTURED = _STORED.replace("r AS (SELECT", "unused AS (SELECT", 1) + f""", c AS (SELECT x.id, CASE WHEN k = 0 THEN '‹REDACTED:x:0› ' || x.text ELSE x.text END AS text, {_WHY.replace("doc_id", "x.id")} AS why, k, len(regexp_extract_all(x.text, $${scanning.DETECTORS[17][2]}$$)) AS e FROM x)"""


@query("archive_outcomes", f"""{_CAPTURED}, o AS (SELECT id, why IS NULL AS scanned, why IS NOT NULL OR k IN (0, 1) OR e > 0 AS was_redacted, why IS NOT NULL OR k = 1 AS needs_quarantine, CASE WHEN why IS NULL AND k = 0 THEN 1 ELSE 0 END::BIGINT AS flagged, CASE WHEN why IS NOT NULL THEN 1 WHEN k = 1 THEN 1 ELSE e END::BIGINT AS redacted_count,
 CASE WHEN why IS NOT NULL THEN '‹QUARANTINED:non-utf8:' || substr(sha256(text), 1, 8) || '›' || chr(10) WHEN k = 1 THEN '‹REDACTED:aws-key:' || substr(sha256(text), 1, 8) || '›' WHEN k = 0 AND e = 0 THEN replace(replace(text, '‹REDACTED:', '<REDACTED:'), '‹QUARANTINED:', '<QUARANTINED:') WHEN e = 0 THEN text END AS redacted FROM c)
 SELECT * FROM o""")
def _(s, d):
    o = archive.outcomes(_captured(s, d))
    plain = ~F.exists("findings", lambda f: f["kind"] == "generic-entropy")
    return o.select("id", "scanned", "was_redacted", "needs_quarantine", "flagged", "redacted_count", F.when(plain, F.col("redacted")).alias("redacted"))


@query("archive_quarantine_all", f"{_CAPTURED} SELECT id, sha256(text) AS sha256 FROM c WHERE why IS NOT NULL OR k = 1 OR e > 0")
def _(s, d):
    x = _captured(s, d)
    return archive.originals(x, archive.outcomes(x, quarantine_all=True)).select("id", F.sha2("content", 256).alias("sha256"))


@query("archive_frames", ", x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN text || 'x' ELSE text END AS old, CASE WHEN doc_id % 5 < 3 THEN text || 'more' ELSE text END AS now FROM documents) SELECT doc_id::VARCHAR AS path, CASE WHEN starts_with(now, old) THEN 'append' ELSE 'rewrite' END AS how, sha256(CASE WHEN starts_with(now, old) THEN substr(now, length(old) + 1) ELSE now END) AS sha256 FROM x WHERE old IS NULL OR old <> now")
def _(s, d):
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 5
    path = F.col("doc_id").cast("string").alias("path")
    now = x.select(path, F.when(k < 3, F.concat("text", F.lit("more"))).otherwise(F.col("text")).cast("binary").alias("content"))
    old = x.where(k > 0).select(path, F.when(k == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return archive.frames(old, now).select("path", "how", F.sha2("content", 256).alias("sha256"))


@query("archive_manifest_state", ", x AS (SELECT doc_id::VARCHAR AS key, doc_id % 4 AS k, doc_id FROM documents) SELECT key, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unreadable' ELSE 'ok' END AS state, CASE WHEN k = 3 THEN doc_id % 3 END::INT AS version FROM x")
def _(s, d):
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 4
    key = F.col("doc_id").cast("string").alias("key")
    content = F.when(k == 1, '{"version": ').when(k == 2, "[1]").otherwise(F.to_json(F.struct((F.col("doc_id") % 3).alias("version"))))
    return archive.manifest_state(x.select(key), x.where(k > 0).select(key, content.alias("content"))).select("key", "state", F.col("manifest.version").alias("version"))


@query("index_modes", "SELECT id, CASE WHEN role IN ('transcript', 'subagent') THEN 'entries' WHEN role IN ('tool-result', 'mcp', 'snapshot', 'paste', 'history') THEN 'document' ELSE 'skip' END AS mode FROM artifacts")
def _(s, d):
    return archive.modes(t.artifacts(s, d)).select("id", "mode")


@query("index_enriched", "SELECT a.id AS artifact_id, a.session_uuid, project_slug, git_branch, 'main' AS agent FROM artifacts a LEFT JOIN sessions s ON a.session_uuid = s.uuid")
def _(s, d):
    docs = t.artifacts(s, d).select(F.col("id").alias("artifact_id"))
    return archive.enriched(docs, t.artifacts(s, d), t.sessions(s, d).withColumn("cwd", F.lit(None).cast("string")), "main").drop("cwd")


@query("denied_inodes", "SELECT doc_id AS ino FROM documents WHERE doc_id % 7 <> 2 AND NOT (doc_id IN (SELECT doc_id // 2 FROM documents WHERE doc_id % 6 = 0) AND doc_id % 2 = 1)")
def _(s, d):
    x = t.table(s, d, "documents")
    files = x.select((F.col("doc_id") % 2).alias("dev"), F.when(F.col("doc_id") % 7 != 2, F.col("doc_id")).alias("ino"))
    return archive.not_denied(files, x.where("doc_id % 6 = 0").select(F.lit(1).cast("long").alias("dev"), F.expr("doc_id div 2").alias("ino"))).select("ino")


@query("deletable_trees", "SELECT count(*) FILTER (doc_id % 3 = 1 AND doc_id % 4 = 2) AS n FROM documents")
def _(s, d):
    x = t.table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 1, "scratch-tree").otherwise("file").alias("kind"), F.when(F.col("doc_id") % 4 == 2, "delete").otherwise("protected").alias("verdict"))
    return archive.deletable(x, "scratch-tree")


# --- ledger ------------------------------------------------------------------------------------------------


@query("index_candidates", "SELECT a.id, a.source_path, a.role, project_slug FROM artifacts a LEFT JOIN sessions s ON a.session_uuid = s.uuid WHERE role IN ('transcript', 'subagent', 'tool-result', 'mcp', 'snapshot', 'paste', 'history')")
def _(s, d):
    a, x = t.artifacts(s, d).where(F.col("role").isin(t.INDEXABLE)), t.sessions(s, d)
    return a.join(x, a.session_uuid == x.uuid, "left").select("id", "source_path", "role", "project_slug")


@query("index_changed", "SELECT id, source_path FROM artifacts WHERE source_sha256 <> live_sha256 OR NOT archived")
def _(s, d):
    a = t.artifacts(s, d)
    now = a.select("id", "source_path", F.col("live_sha256").alias("source_sha256"))
    return ledger.changed(now, a.where("archived").select("source_path", "source_sha256")).select("id", "source_path")


@query("index_doc_counts", "SELECT artifact_id, count(*) AS n FROM entries GROUP BY 1")
def _(s, d):
    return t.entries(s, d).groupBy("artifact_id").agg(F.count("*").alias("n"))


@query("status_counts", "SELECT (SELECT count(*) FROM sessions) AS sessions, count(*) AS artifacts, sum(redacted)::BIGINT AS redacted, sum(quarantined)::BIGINT AS quarantined, count(*) FILTER (verified_at IS NULL) AS unverified, sum(source_bytes)::BIGINT AS bytes FROM artifacts")
def _(s, d):
    return ledger.status(t.sessions(s, d), t.artifacts(s, d))


@query("status_unverified", "SELECT id, source_path FROM artifacts WHERE verified_at IS NULL")
def _(s, d):
    return t.artifacts(s, d).where("verified_at is null").select("id", "source_path")


@query("status_secrets", f"{_FOUND} SELECT f.id, session_uuid, source_path, kind, severity, substr(sha256(found), 1, 8) AS sha8, action, CASE severity WHEN 'high' THEN 3 WHEN 'med' THEN 2 END::BIGINT AS grade FROM f JOIN artifacts a ON f.id = a.id")
def _(s, d):
    return ledger.secrets_report(scanning.findings(scanning.scanned(_planted(s, d))), t.artifacts(s, d), "med")


@query("capture_whole_skip", "SELECT id FROM artifacts WHERE archived AND source_sha256 = live_sha256")
def _(s, d):
    a = t.artifacts(s, d)
    return a.join(a.where("archived").select(F.col("source_path").alias("p"), F.col("source_sha256").alias("h")), (F.col("source_path") == F.col("p")) & (F.col("live_sha256") == F.col("h")), "left_semi").select("id")


@query("capture_plan", """, x AS (SELECT doc_id, source || '/' || doc_id AS path, text || chr(10) || CASE WHEN doc_id % 4 = 1 THEN 'more' || chr(10) WHEN doc_id % 4 = 2 THEN 'part' ELSE '' END AS now, octet_length(encode(text)) + 1 AS n FROM documents)
 SELECT path, CASE WHEN doc_id % 4 = 3 OR doc_id % 11 = 0 THEN 'full' WHEN doc_id % 4 = 1 THEN 'tail' ELSE 'skip' END AS plan, CASE WHEN doc_id % 4 = 3 OR doc_id % 11 = 0 THEN 0 ELSE n END::BIGINT AS start, (n + CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 0 END)::BIGINT AS "end" FROM x""")
def _(s, d):
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 4
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    old = F.concat("text", F.lit("\n"))
    now = x.select(path, F.concat(old, F.when(k == 1, "more\n").when(k == 2, "part").otherwise("")).cast("binary").alias("content"))
    prior = x.where("doc_id % 11 > 0").select(path, F.octet_length(old).alias("offset"), F.when(k == 3, "changed").otherwise(F.sha2(old, 256)).alias("sha256"))
    return ledger.capture_plan(now, prior)


@query("capture_upsert", "SELECT id, source_path, CASE WHEN id % 10 = 0 THEN live_sha256 ELSE source_sha256 END AS source_sha256, CASE WHEN id % 10 = 0 THEN NULL ELSE verified_at END AS verified_at FROM artifacts WHERE archived OR id % 10 = 0")
def _(s, d):
    a = t.artifacts(s, d)
    old = a.where("archived").select("id", "source_path", "source_sha256", "verified_at")
    return ledger.upsert(old, a.where("id % 10 = 0").select("id", "source_path", F.col("live_sha256").alias("source_sha256")), "source_path")


@query("capture_upsert_repeats", "SELECT CASE WHEN archived THEN id ELSE 1000000 + id END AS id, source_path, CASE WHEN id % 10 = 0 THEN live_sha256 ELSE source_sha256 END AS source_sha256 FROM artifacts WHERE archived OR id % 10 = 0")
def _(s, d):
    a = t.artifacts(s, d)
    old = a.where("archived").select("id", "source_path", "source_sha256")
    new = a.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), "source_path", F.col("live_sha256").alias("source_sha256"), F.lit(2).alias("run"))
    earlier = new.withColumn("source_sha256", F.lit("earlier")).withColumn("run", F.lit(1))
    return ledger.upsert(old, earlier.unionByName(new), "source_path", latest="run", keep=("id",)).select("id", "source_path", "source_sha256")


@query("session_upsert", """, x AS (SELECT uuid, project_slug, git_branch, substr(uuid, 6)::INT AS n FROM sessions), o AS (SELECT *, 'old' AS o_branch FROM x WHERE n % 2 = 0), w AS (SELECT * FROM x WHERE n % 3 > 0)
 SELECT coalesce(w.uuid, o.uuid) AS uuid, coalesce(w.project_slug || '-now', o.project_slug) AS project_slug, coalesce(CASE WHEN w.n % 5 > 0 THEN '/new' END, CASE WHEN o.uuid IS NOT NULL THEN '/old' END) AS cwd, coalesce(w.git_branch, o.o_branch) AS git_branch,
 CASE WHEN w.uuid IS NOT NULL THEN '2.0' END AS cc_version, coalesce(CASE WHEN o.uuid IS NOT NULL THEN '2023' END, '2024') AS first_seen, CASE WHEN w.uuid IS NOT NULL THEN '2024' ELSE '2023' END AS last_archived FROM w FULL JOIN o ON w.uuid = o.uuid""")
def _(s, d):
    x, n = t.sessions(s, d), F.substring("uuid", 6, 9).cast("int")
    text = lambda v, name: F.lit(v).cast("string").alias(name)
    old = x.where(n % 2 == 0).select("uuid", "project_slug", text("/old", "cwd"), text("old", "git_branch"), text(None, "cc_version"), text("2023", "first_seen"), text("2023", "last_archived"))
    new = x.where(n % 3 > 0).select("uuid", F.concat("project_slug", F.lit("-now")).alias("project_slug"), F.when(n % 5 > 0, "/new").alias("cwd"), "git_branch", text("2.0", "cc_version"), text("2024", "first_seen"), text("2024", "last_archived"))
    return ledger.merge_sessions(old, new.unionByName(new.withColumn("cwd", F.lit("/earlier")).withColumn("last_archived", F.lit("2022"))))


@query("manifest_rollup", "SELECT session_uuid, count(*) AS n, sum(source_bytes)::BIGINT AS bytes, bool_or(quarantined = 1) AS any_quarantined FROM artifacts GROUP BY 1")
def _(s, d):
    return t.artifacts(s, d).groupBy("session_uuid").agg(F.count("*").alias("n"), F.sum("source_bytes").alias("bytes"), F.bool_or(F.col("quarantined") == 1).alias("any_quarantined"))


#: Session files, logs of servers below a cache, and files of scratch trees; the expected shape and kind stand beside each.
_USER_FILES = """, f AS (SELECT 'user-' || (doc_id % 3) AS "user", doc_id, n_chars AS bytes, sha256(doc_id::VARCHAR) AS sha, '/home/user-' || (doc_id % 3) AS h, source FROM documents),
 g AS (SELECT "user", bytes, CASE doc_id % 7 WHEN 0 THEN h || '/.claude/projects/-w-' || source || '/' || sha || '.jsonl' WHEN 1 THEN h || '/.claude/projects/-w-' || source || '/subagents/' || doc_id || '.jsonl' WHEN 2 THEN h || '/.claude/projects/-w-' || source || '/' || sha || '/tool-results/out.txt'
   WHEN 3 THEN h || '/.claude/projects/-w-' || source || '/note.meta.json' WHEN 4 THEN h || '/.claude/projects/-w-' || source || '/readme.txt' WHEN 5 THEN h || '/.cache/srv/' || source || '/mcp-logs-x/' || sha || '.jsonl' ELSE '/tmp/claude-7/' || source || '/' || sha || '/a/b.md' END AS path,
   CASE doc_id % 7 WHEN 0 THEN '.claude/projects/<slug>/<uuid>' WHEN 1 THEN '.claude/projects/<slug>/subagents/' || doc_id || '.jsonl' WHEN 2 THEN '.claude/projects/<slug>/<uuid>/tool-results/out.txt' WHEN 3 THEN '.claude/projects/<slug>/note.meta.json' WHEN 4 THEN '.claude/projects/<slug>/readme.txt'
   WHEN 5 THEN 'srv/' || source || '/mcp-logs-x/<uuid>' ELSE '/tmp/claude-<uid>/<slug>/<uuid>/scratch' END AS shape, ['transcript', 'subagents', 'tool-results', 'subagents', 'unknown', 'mcp', 'scratch'][(doc_id % 7) + 1] AS kind FROM f)"""


@query("shape_inventory", _USER_FILES + ' SELECT "user", shape, any_value(kind) AS kind, count(*) AS n, sum(bytes)::BIGINT AS bytes, min(path) AS example FROM g GROUP BY "user", shape')
def _(s, d):
    i, sha = F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256)
    user = F.concat(F.lit("user-"), i % 3)
    own = F.concat(F.lit("/home/"), user)
    k, project = i % 7, F.concat(F.lit("projects/-w-"), "source", F.lit("/"))
    leaf = (
        F.when(k == 0, F.concat(project, sha, F.lit(".jsonl"))).when(k == 1, F.concat(project, F.lit("subagents/"), i, F.lit(".jsonl"))).when(k == 2, F.concat(project, sha, F.lit("/tool-results/out.txt"))).when(k == 3, F.concat(project, F.lit("note.meta.json")))
        .when(k == 4, F.concat(project, F.lit("readme.txt"))).when(k == 5, F.concat("source", F.lit("/mcp-logs-x/"), sha, F.lit(".jsonl"))).otherwise(F.concat("source", F.lit("/"), sha, F.lit("/a/b.md")))
    )
    root = F.when(k == 5, "cache").when(k == 6, "tmp").otherwise("claude")
    home = F.when(k == 5, F.concat(own, F.lit("/.cache/srv"))).when(k == 6, "/tmp/claude-7").otherwise(F.concat(own, F.lit("/.claude")))
    return ledger.shapes(t.table(s, d, "documents").select(user.alias("user"), home.alias("home"), root.alias("root"), F.concat(home, F.lit("/"), leaf).alias("path"), F.col("n_chars").alias("bytes")))


#: Slugs as they are, with a leading underscore, with a coded key's beginning, long, and too long for the hexadecimal form.
_SLUGS = """, x AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '_' || source || '/x' WHEN 2 THEN '_hex--' || source WHEN 3 THEN '_h256--' || source ELSE repeat(source, 60) END AS slug, 'u' || doc_id AS uuid FROM documents)"""


@query("store_key", f"""{_SLUGS}, y AS (SELECT *, lower(hex(encode(slug))) || '--' || lower(hex(encode(uuid))) AS pair, slug || '--' || uuid AS plain FROM x)
 SELECT id, CASE WHEN id % 5 < 2 OR (id % 5 = 4 AND octet_length(encode(plain)) <= 255) THEN plain WHEN length('_hex--' || pair) <= 255 THEN '_hex--' || pair ELSE '_h256--' || sha256(pair) END AS key FROM y""")
def _(s, d):
    x, k = t.table(s, d, "documents"), F.col("doc_id") % 5
    slug = F.when(k == 0, F.col("source")).when(k == 1, F.concat(F.lit("_"), "source", F.lit("/x"))).when(k == 2, F.concat(F.lit("_hex--"), "source")).when(k == 3, F.concat(F.lit("_h256--"), "source")).otherwise(F.repeat("source", 60))
    return x.select(F.col("doc_id").alias("id"), ledger.store_key(slug, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("key"))


# --- retention ---------------------------------------------------------------------------------------------

_ACTIVE = "SELECT DISTINCT 'conv-' || user_id AS session_uuid FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'"


def _active(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "events").where(F.col("ts") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select(F.concat(F.lit("conv-"), "user_id").alias("session_uuid")).distinct()


def _verdicts(s: SparkSession, d: str, policy: retention.Policy) -> DataFrame:
    a = t.artifacts(s, d)
    candidates = a.select("source_path", F.when(F.col("role") == "transcript", F.col("session_uuid")).alias("session_uuid"), "role", "live_sha256", F.col("source_bytes").alias("bytes"), "age_days", (F.col("id") % 23 == 0).alias("denied"), (F.col("id") % 29 > 0).alias("readable"))
    kept = a.where("archived").select("source_path", "source_sha256", "content_sha256", (F.col("id") % 31 > 0).alias("stored_ok"))
    return retention.file_verdicts(candidates, kept, a.where("id % 2 = 0").select("source_path", "source_sha256"), _active(s, d), policy)


def _verdict_sql(full: bool, indexed: bool) -> str:
    floor = "1 / 24.0" if full else "7"
    window = "0" if full else "CASE role WHEN 'transcript' THEN 90 WHEN 'subagent' THEN 90 WHEN 'mcp' THEN 14 WHEN 'scratch-file' THEN 3 WHEN 'paste' THEN 14 WHEN 'snapshot' THEN 30 ELSE 7 END"
    return f""", act AS ({_ACTIVE}), g AS (SELECT source_path, source_bytes AS bytes, CASE WHEN id % 23 = 0 THEN 'Blacklisted' WHEN id % 29 = 0 THEN 'OpenFailed' WHEN NOT archived THEN 'NoCatalogRow' WHEN live_sha256 <> source_sha256 THEN 'ShaMismatch'
   WHEN content_sha256 = '' THEN 'EmptyContentSha' WHEN id % 31 = 0 THEN 'StoreReverifyFailed' {"WHEN id % 2 = 1 THEN 'NotIndexed'" if indexed else ""} WHEN age_days < {floor} THEN 'TooYoung' WHEN age_days < greatest({floor}, {window}) THEN 'RetainWindow'
   WHEN (role = 'transcript' AND session_uuid IN (SELECT session_uuid FROM act)) OR age_days < 1 / 24.0 THEN 'SessionLive' ELSE '' END AS reason FROM artifacts),
 v AS (SELECT source_path, CASE WHEN reason = '' THEN 'delete' WHEN reason IN ('TooYoung', 'RetainWindow', 'SessionLive') THEN 'protected' ELSE 'unverified' END AS verdict, reason, bytes::BIGINT AS bytes,
   CASE WHEN reason IN ('Blacklisted', 'OpenFailed', 'NoCatalogRow', 'ShaMismatch', 'EmptyContentSha', 'StoreReverifyFailed') THEN 0 ELSE bytes END::BIGINT AS archived_bytes FROM g)"""


for _name, _policy in (("gc_plan_files", retention.Policy()), ("gc_full_mode", retention.Policy(full=True)), ("gc_require_indexed", retention.Policy(full=True, require_indexed=True))):
    query(_name, f"{_verdict_sql(_policy.full, _policy.require_indexed)} SELECT * FROM v")(lambda s, d, p=_policy: _verdicts(s, d, p))


@query("gc_plan_rollup", f"{_verdict_sql(False, False)} SELECT verdict, reason, count(*) AS n, sum(bytes)::BIGINT AS bytes, sum(archived_bytes)::BIGINT AS archived_bytes FROM v GROUP BY ALL")
def _(s, d):
    return retention.rollup(_verdicts(s, d, retention.Policy()))


@query("gc_log_records", f"{_verdict_sql(True, False)} SELECT source_path, CASE verdict WHEN 'delete' THEN 'delete' WHEN 'protected' THEN 'protect' ELSE 'skip' END AS action, reason FROM v")
def _(s, d):
    v = _verdicts(s, d, retention.Policy(full=True))
    return v.select("source_path", F.when(F.col("verdict") == "delete", "delete").when(F.col("verdict") == "protected", "protect").otherwise("skip").alias("action"), "reason")


@query("gc_liveness", _ACTIVE)
def _(s, d):
    return _active(s, d)


_EXT = ["md", "zip", "log", "bin", "txt"]
_FILES = "fl AS (SELECT source AS tree, CASE WHEN doc_id % 12 = 0 THEN 'target/' ELSE 'a/' END || doc_id || '.' || ['md', 'zip', 'log', 'bin', 'txt'][(doc_id % 5) + 1] AS path, n_chars AS bytes, doc_id FROM documents)"
_ADMIT = f""", {_FILES}, ru AS (SELECT *, CASE WHEN doc_id % 5 IN (1, 3) THEN 'not_allowed' WHEN doc_id % 12 = 0 THEN 'denied' WHEN bytes > 5000 THEN 'file_cap' END AS not_stored FROM fl),
 ad AS (SELECT tree, path, bytes, not_stored, not_stored IS NULL AND NOT over_total AS stored, over_total FROM (SELECT *, coalesce(sum(bytes) FILTER (not_stored IS NULL) OVER (PARTITION BY tree), 0) > 40000 AS over_total FROM ru))"""


def _scratch(s: SparkSession, d: str) -> DataFrame:
    x = t.table(s, d, "documents")
    folder = F.when(F.col("doc_id") % 12 == 0, "target/").otherwise("a/")
    return x.select(F.col("source").alias("tree"), F.concat(folder, "doc_id", F.lit("."), t.pick(_EXT, F.col("doc_id") % 5)).alias("path"), F.col("n_chars").alias("bytes"), "doc_id", F.sha2("text", 256).alias("sha256"))


@query("scratch_admission", f"{_ADMIT} SELECT * FROM ad")
def _(s, d):
    return retention.admission(_scratch(s, d), 5000, 40_000)


@query("scratch_caps", f"{_ADMIT} SELECT tree, count(*) AS files, sum(bytes)::BIGINT AS total_bytes, coalesce(sum(bytes) FILTER (not_stored IS NULL), 0)::BIGINT AS admitted_bytes, coalesce(sum(bytes) FILTER (stored), 0)::BIGINT AS archived_bytes, coalesce(sum(bytes) FILTER (NOT stored), 0)::BIGINT AS unarchived_bytes, bool_or(over_total) AS over_total FROM ad GROUP BY tree")
def _(s, d):
    return retention.tree_totals(retention.admission(_scratch(s, d), 5000, 40_000))


#: What is wrong with a file of a tree, by its number: nothing of most, so that trees differ in their first reason.
_UNCOVERED = "CASE doc_id % 211 WHEN 5 THEN 'NoCatalogRow' WHEN 17 THEN 'Blacklisted' WHEN 29 THEN 'OpenFailed' WHEN 41 THEN 'ShaMismatch' WHEN 53 THEN 'StoreReverifyFailed' WHEN 67 THEN 'Blacklisted' WHEN 79 THEN 'OpenFailed' WHEN 83 THEN 'ShaMismatch' WHEN 97 THEN 'ShaMismatch' WHEN 101 THEN 'ShaMismatch' WHEN 113 THEN 'StoreReverifyFailed' WHEN 127 THEN 'StoreReverifyFailed' END"


@query("scratch_coverage", f", x AS (SELECT source AS tree, 'a/' || doc_id AS path, {_UNCOVERED} AS why FROM documents) SELECT tree, coalesce(arg_min(why, path) FILTER (why IS NOT NULL), '') AS reason FROM x GROUP BY tree")
def _(s, d):
    k, sha = F.col("doc_id") % 211, F.sha2("text", 256)
    x = t.table(s, d, "documents").select(F.col("source").alias("tree"), F.concat(F.lit("a/"), "doc_id").alias("path"), F.col("n_chars").alias("n"), k.alias("k"), sha.alias("sha"))
    size = F.when(F.col("k") == 101, F.lit(retention.MOST_REHASHED + 1)).otherwise(F.col("n"))
    live = x.select("tree", "path", size.alias("bytes"), F.when(F.col("k") == 97, "other").otherwise(F.col("sha")).alias("live_sha256"), (F.col("k") != 79).alias("readable"), (F.col("k") == 67).alias("denied"))
    recorded = F.when(F.col("k").isin(41, 83), F.col("n") + 1).otherwise(size)
    manifest = x.where("k <> 5").select(
        "tree", "path", F.lit(1).alias("no"), (F.col("k") == 17).alias("blacklisted"), (F.col("k") == 29).alias("capture_failed"), (~F.col("k").isin(41, 42)).alias("stored"), recorded.alias("bytes"),
        F.col("sha").alias("source_sha256"), F.when(F.col("k") == 53, F.lit(None)).otherwise(F.col("sha")).alias("content_sha256"),
    )
    # an earlier entry of the same path is not looked at
    manifest = manifest.unionByName(manifest.where("path like '%7'").withColumn("no", F.lit(0)).withColumn("stored", F.lit(False)).withColumn("bytes", F.lit(-1).cast("long")))
    store = x.where("k not in (41, 42, 113)").select("tree", "path", F.when(F.col("k") == 127, F.lit(None)).otherwise(F.col("sha")).alias("sha256"))
    return retention.tree_coverage(live, manifest, store)


@query("scratch_retention", ", x AS (SELECT source AS tree, 'a/' || doc_id AS path, sha256(text) AS sha256, doc_id % 6 > 0 AS present FROM documents) SELECT * FROM x")
def _(s, d):
    x = t.table(s, d, "documents").select(F.col("source").alias("tree"), F.concat(F.lit("a/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("no"))
    return retention.retained(x.unionByName(x.withColumn("sha256", F.lit("later")).withColumn("no", F.col("no") + 10**9)), x.where("no % 6 > 0"))


#: Live files that are read, that can't be read (with a prior entry that was stored and is there, was stored and is gone, wasn't stored, or without one), and prior entries without a file, twice, or that can't be decoded.
_SALVAGE = """, x AS (SELECT source AS tree, 'a/' || doc_id AS path, doc_id % 8 AS k, n_chars AS bytes, sha256(text) AS sha FROM documents),
 e AS (SELECT tree, path, path AS shown, bytes, true AS present, k > 0 AS capture_failed, k IN (0, 1) AS stored, CASE k WHEN 0 THEN sha WHEN 1 THEN 'prior' END AS source_sha256, k = 1 AS quarantined FROM x WHERE k < 5
   UNION ALL SELECT tree, path, path, bytes, false, false, true, 'prior', true FROM x WHERE k IN (5, 6) UNION ALL SELECT tree, NULL, path, bytes, true, false, true, 'prior', true FROM x WHERE k = 7)"""


def _salvaged(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 8
    x = t.table(s, d, "documents").select(F.col("source").alias("tree"), F.concat(F.lit("a/"), "doc_id").alias("path"), k.alias("k"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha"))
    live = x.where("k < 5").select("tree", "path", "bytes", (F.col("k") == 0).alias("readable"), (F.col("k") == 0).alias("stored"), F.col("sha").alias("source_sha256"), F.col("sha").alias("content_sha256"), F.lit(False).alias("quarantined"))
    entry = lambda stored, sha, no: x.select(
        "tree", F.when(F.col("k") < 7, F.col("path")).alias("path"), F.col("path").alias("shown"), "bytes", F.lit(True).alias("present"), F.lit(False).alias("capture_failed"), stored.alias("stored"), F.lit(sha).alias("source_sha256"), F.lit(sha).alias("content_sha256"), F.lit(True).alias("quarantined"), F.lit(no).alias("no"), "k",
    )
    prior = entry(F.col("k") != 3, "prior", 0).where("k <> 4").unionByName(entry(F.lit(True), "later", 1).where("k in (1, 3, 6)")).drop("k")
    return retention.salvaged(prior, live, x.where("k in (1, 3, 4)").select("tree", "path"))


@query("manifest_salvage", f"{_SALVAGE} SELECT * FROM e")
def _(s, d):
    return _salvaged(s, d).drop("content_sha256")


@query("manifest_captured", f"{_SALVAGE} SELECT tree, bool_or(present AND stored) AS captured FROM e GROUP BY tree")
def _(s, d):
    return retention.captured(_salvaged(s, d))


@query("manifest_round_trip", """, r AS (SELECT session_uuid, source_path AS source, source_sha256, source_bytes, id % 3 AS findings, quarantined = 1 AS quarantined FROM artifacts)
 SELECT session_uuid, 'proj-' || (substr(session_uuid, 6)::INT % 7) AS project_slug, CASE WHEN substr(session_uuid, 6)::INT % 2 = 0 THEN '/w' END AS cwd, source, source_sha256, source_bytes, findings::BIGINT AS findings,
  sum(findings) OVER (PARTITION BY session_uuid)::BIGINT AS all_findings, bool_or(quarantined) OVER (PARTITION BY session_uuid) AS any_quarantined, row_number() OVER (PARTITION BY session_uuid ORDER BY source) - 1 AS place FROM r""")
def _(s, d):
    a = t.artifacts(s, d)
    n = F.substring("session_uuid", 6, 20).cast("int")
    sessions = a.select("session_uuid").distinct().select("session_uuid", F.concat(F.lit("proj-"), n % 7).alias("project_slug"), F.when(n % 2 == 0, "/w").alias("cwd"), *[F.lit(None).cast("string").alias(c) for c in ("git_branch", "cc_version", "session_start", "session_end")], F.lit(1).cast("long").alias("entry_count"))
    scan = F.struct((F.col("id") % 3).alias("findings"), F.lit(0).cast("long").alias("redacted"), F.lit(0).cast("long").alias("flagged"), (F.col("quarantined") == 1).alias("quarantined"))
    frames = F.array(F.struct(F.lit(0).cast("long").alias("src_offset"), F.col("source_bytes").alias("src_len"), F.lit("t").alias("captured_at")))
    records = a.select(
        "session_uuid", "role", F.col("source_path").alias("path"), F.col("source_path").alias("source"), "source_sha256", "source_bytes", F.col("source_sha256").alias("stored_sha256"), F.col("source_bytes").alias("stored_bytes"),
        "content_sha256", (F.col("redacted") == 1).alias("redacted"), (F.col("quarantined") == 1).alias("quarantined"), scan.alias("scan"), frames.alias("frames"),
    )
    m = archive.read_manifests(archive.manifests(sessions, records, "t").withColumnRenamed("session_uuid", "key")).where("state = 'ok'")
    r = m.select("manifest", F.posexplode("manifest.artifacts").alias("place", "a"))
    return r.select("manifest.session_uuid", "manifest.project_slug", "manifest.cwd", "a.source", "a.source_sha256", "a.source_bytes", "a.scan.findings", F.col("manifest.secret_scan.findings").alias("all_findings"), F.col("manifest.secret_scan.quarantined").alias("any_quarantined"), "place")


@query("manifest_totals", f"{_SALVAGE} SELECT tree, count(*) AS entries, coalesce(sum(bytes) FILTER (present), 0)::BIGINT AS total_bytes, coalesce(sum(bytes) FILTER (present AND stored), 0)::BIGINT AS stored_bytes, count(*) FILTER (capture_failed) AS failed, bool_and(path IS NOT NULL) AS complete FROM e GROUP BY tree")
def _(s, d):
    return retention.manifest_totals(_salvaged(s, d))


#: What a case of law S has: whether an artifact is there, whether and as what it is claimed, and the issues that follow, as the law's own tests have them.
_LAW_S_CASES = [
    ("clean", True, ["claim"], []), ("absent", False, ["claim"], ["MissingArtifact"]), ("wrong", True, ["other"], ["ContentMismatch"]), ("legacy", True, ["unhashed"], ["NoContentHash"]),
    ("disclaimed", True, ["unstored"], ["UnclaimedArtifact"]), ("declined", False, ["unstored"], []), ("orphan", True, [], ["OrphanArtifact"]), ("twice", True, ["claim", "other"], ["DuplicateIdentity"]),
    ("twice_absent", False, ["claim", "claim", "unstored"], ["DuplicateIdentity", "MissingArtifact"]), ("twice_wrong", True, ["other", "claim"], ["DuplicateIdentity", "ContentMismatch"]), ("link", None, ["claim"], ["ForeignArtifact", "MissingArtifact"]),
]
_N = len(_LAW_S_CASES)
_LAW_S = f""", c AS (SELECT unnest([{", ".join(f"{{'k': {k}, 'issues': {issues!r}::VARCHAR[]}}" for k, (*_, issues) in enumerate(_LAW_S_CASES))}], recursive := true)),
 x AS (SELECT source AS key, 'a/' || doc_id AS path, doc_id % {_N} AS k, try_cast(substr(source, 4) AS INT) % 5 = 3 AS blind FROM documents),
 y AS (SELECT key, path, issue FROM (SELECT key, path, blind, unnest(issues) AS issue FROM x JOIN c USING (k)) WHERE NOT (blind AND issue = 'OrphanArtifact')
   UNION ALL SELECT DISTINCT key, unnest(['', '?']), unnest(['UnreconcilableKey', 'UndecodableEntry']) FROM x WHERE blind)"""


def _law_s(s: SparkSession, d: str) -> DataFrame:
    x = t.table(s, d, "documents").select(F.col("source").alias("key"), F.concat(F.lit("a/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha"), (F.col("doc_id") % _N).alias("k"))
    regular = t.pick([str(there) for _, there, *_ in _LAW_S_CASES], F.col("k"))
    store = x.where(regular != "False").select("key", "path", F.col("sha").alias("sha256"), (regular == "True").alias("regular"))
    kinds = F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<string>") for _, _, c, _ in _LAW_S_CASES]), F.col("k").cast("int"))
    entries = x.select("key", "path", "sha", F.posexplode(kinds).alias("no", "kind")).select(
        "key", "no", "path", F.col("path").alias("shown"), (F.col("kind") != "unstored").alias("stored"), F.when(F.col("kind") == "claim", F.col("sha")).when(F.col("kind") == "other", "other").otherwise("").alias("content_sha256")
    )
    # keys of some sources have an entry whose path can't be decoded
    blind = x.where(F.expr("try_cast(substr(key, 4) as int) % 5 = 3")).select("key").distinct()
    blind = blind.select("key", F.lit(-1).alias("no"), F.lit(None).cast("string").alias("path"), F.lit("?").alias("shown"), F.lit(True).alias("stored"), F.lit("").alias("content_sha256"))
    return retention.store_issues(store, entries.unionByName(blind))


@query("verify_law_s", f"{_LAW_S} SELECT * FROM y")
def _(s, d):
    return _law_s(s, d)


_CLASS_SQL = """CASE issue WHEN 'UnreconcilableKey' THEN 'refused key' WHEN 'DuplicateIdentity' THEN 'violation' WHEN 'NoContentHash' THEN 'unverifiable' WHEN 'UndecodableEntry' THEN 'unverifiable' WHEN 'ForeignArtifact' THEN 'foreign matter' ELSE '{}' END"""


@query("verify_classes", f"{_LAW_S} SELECT issue, {_CLASS_SQL.format('violation')} AS class, count(*) AS n FROM y GROUP BY issue")
def _(s, d):
    return retention.classed(_law_s(s, d), exclusive=True)


@query("verify_exclusion", f"{_LAW_S} SELECT issue, {_CLASS_SQL.format('unverifiable')} AS class, count(*) AS n FROM y GROUP BY issue")
def _(s, d):
    return retention.classed(_law_s(s, d), exclusive=False)


#: Cases of law Q: whether an original is there, its claims, and the issues that follow.
_LAW_Q_CASES = [
    ("clean", True, ["claim"], []), ("lost", False, ["claim"], ["QuarantineMissing"]), ("wrong", True, ["other"], ["QuarantineMismatch"]), ("unhashed", True, ["unhashed"], ["QuarantineNoSourceHash"]), ("stray", True, [], ["QuarantineStray"]),
    ("found_clean_later", True, ["unquarantined"], []), ("nothing", False, ["unquarantined"], []), ("collide", True, ["claim", "claim"], ["QuarantineCollision"]), ("collide_lost", False, ["claim", "other"], ["QuarantineCollision", "QuarantineMissing"]),
    ("collide_wrong", True, ["other", "claim"], ["QuarantineCollision", "QuarantineMismatch"]), ("one_claims", True, ["claim", "unquarantined"], []), ("link", None, ["claim"], ["QuarantineMissing"]),
]
_M = len(_LAW_Q_CASES)
_LAW_Q = f""", c AS (SELECT unnest([{", ".join(f"{{'k': {k}, 'issues': {issues!r}::VARCHAR[]}}" for k, (*_, issues) in enumerate(_LAW_Q_CASES))}], recursive := true)), x AS (SELECT source || '/' || doc_id AS path, doc_id % {_M} AS k, source, doc_id FROM documents)"""


def _law_q(s: SparkSession, d: str, **options) -> DataFrame:
    x = t.table(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha"), (F.col("doc_id") % _M).alias("k"))
    regular = t.pick([str(there) for _, there, *_ in _LAW_Q_CASES], F.col("k"))
    held = x.where(regular != "False").select("path", F.col("sha").alias("sha256"), (regular == "True").alias("regular"))
    kinds = F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<string>") for _, _, c, _ in _LAW_Q_CASES]), F.col("k").cast("int"))
    claims = x.select("path", "sha", F.posexplode(kinds).alias("no", "kind")).select("path", "no", (F.col("kind") != "unquarantined").alias("quarantined"), F.when(F.col("kind") == "claim", F.col("sha")).when(F.col("kind") == "other", "other").otherwise("").alias("source_sha256"))
    return retention.quarantine_issues(held, claims, **options)


@query("verify_law_q", f"{_LAW_Q} SELECT path, unnest(issues) AS issue FROM x JOIN c USING (k)")
def _(s, d):
    return _law_q(s, d)


@query("verify_law_q_unexamined", f"{_LAW_Q}, y AS (SELECT path, source, doc_id, unnest(issues) AS issue FROM x JOIN c USING (k)) SELECT path, issue FROM y WHERE issue NOT IN ('QuarantineMismatch', 'QuarantineNoSourceHash') AND NOT (issue = 'QuarantineStray' AND source = 'src1')")
def _(s, d):
    return _law_q(s, d, opened=False, unexamined=s.createDataFrame([("src1",), ("src2/none",)], "root string"))


# --- scratch trees and their store -------------------------------------------------------------------------

_TREE = "SELECT source AS tree, 'a/' || doc_id AS path, doc_id AS i, sha256(text) AS sha FROM documents"


def _tree(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select(F.col("source").alias("tree"), F.concat(F.lit("a/"), "doc_id").alias("path"), F.col("doc_id").alias("i"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("bytes"))


@query("scratch_reuse", f""", x AS ({_TREE}), y AS (SELECT *, i % 3 > 0 AND i % 4 > 0 AND i % 5 > 0 AND i % 7 <> 1 AND i % 11 > 0 AND i % 13 > 0 AND i % 17 > 0 AND (i % 6 > 1 OR i % 19 > 3) AS reused FROM x)
 SELECT tree, path, reused, CASE WHEN reused THEN sha END AS content_sha256, CASE WHEN reused THEN i % 6 <= 1 END AS quarantined FROM y""")
def _(s, d):
    x, i = _tree(s, d), F.col("i")
    prior = x.where("i % 3 > 0").select("tree", "path", (i % 4 > 0).alias("stored"), (i % 5 > 0).alias("present"), (i % 7 == 1).alias("capture_failed"), F.when(i % 11 > 0, F.col("sha")).otherwise("old").alias("source_sha256"), F.when(i % 13 > 0, F.col("sha")).alias("content_sha256"), (i % 6 <= 1).alias("quarantined"))
    return scratch.reusable(x.select("tree", "path", F.col("sha").alias("source_sha256")), prior, x.where("i % 17 > 0"), x.where("i % 19 > 3"))


_ENTRY = "SELECT source AS tree, n_chars AS bytes, doc_id % 3 > 0 AS stored, doc_id % 5 > 0 AS present FROM documents"


def _entries_of(s: SparkSession, d: str) -> DataFrame:
    return _tree(s, d).select("tree", "bytes", (F.col("i") % 3 > 0).alias("stored"), (F.col("i") % 5 > 0).alias("present"))


@query("scratch_byte_split", f", x AS ({_ENTRY}) SELECT tree, coalesce(sum(bytes) FILTER (present AND stored), 0)::BIGINT AS archived, coalesce(sum(bytes) FILTER (present AND NOT stored), 0)::BIGINT AS unarchived FROM x GROUP BY tree")
def _(s, d):
    return scratch.byte_split(_entries_of(s, d))


@query("scratch_wipe_split", f""", x AS ({_ENTRY}), l AS (SELECT source AS tree, sum(n_chars // 2) AS bytes FROM documents GROUP BY source), y AS (SELECT l.tree, l.bytes, coalesce(sum(x.bytes) FILTER (present AND stored), 0) AS told FROM l LEFT JOIN x ON l.tree = x.tree GROUP BY ALL)
 SELECT tree, least(told, bytes)::BIGINT AS archived, (bytes - least(told, bytes))::BIGINT AS unarchived FROM y""")
def _(s, d):
    live = _tree(s, d).groupBy("tree").agg(F.sum(F.expr("bytes div 2")).alias("bytes"))
    return scratch.wipe_split(live, _entries_of(s, d))


@query("scratch_orphans", f""", x AS ({_TREE}), o AS (SELECT * FROM x WHERE i % 2 = 0 AND i % 7 IN (0, 3) AND tree NOT IN (SELECT tree FROM x WHERE i % 101 = 0))
 SELECT tree, count(*) AS removed, count(*) FILTER (i % 7 = 3) AS by_cap FROM o GROUP BY tree""")
def _(s, d):
    x, i = _tree(s, d), F.col("i")
    claims = x.select("tree", F.when(i % 101 > 0, F.col("path")).alias("path"), (~(i % 7).isin(0, 3)).alias("stored"))
    return scratch.reconciled(x.where("i % 2 = 0"), claims, x.where("i % 7 = 3"))


_TREE_STATE = f"""SELECT doc_id AS tree, 'conv-' || (doc_id % 150) AS session_uuid, doc_id % 31 = 0 AS foreign_, doc_id % 29 = 0 AS missing, doc_id % 23 = 0 AS other, doc_id % 19 = 0 AS corrupt, doc_id % 17 = 0 AS uncovered, CASE WHEN doc_id % 13 > 0 THEN doc_id % 40 ELSE 0 END AS age,
 doc_id % 11 = 0 AS captured, doc_id % 7 = 0 AS lifted, 'conv-' || (doc_id % 150) IN ({_ACTIVE}) AS live FROM documents"""


def _tree_sql(gates: str, floor: str, window: str) -> str:
    return f""", x AS ({_TREE_STATE}), y AS (SELECT tree, CASE {gates} WHEN age < {floor} THEN 'TooYoung' WHEN age < {window} THEN 'RetainWindow' WHEN live OR age < 1 / 24.0 THEN 'SessionLive' ELSE '' END AS reason FROM x)
 SELECT tree, CASE WHEN reason = '' THEN 'delete' WHEN reason IN ('TooYoung', 'RetainWindow', 'SessionLive', 'Captured', 'NotFullyArchived') THEN 'protected' ELSE 'unverified' END AS verdict, reason FROM y"""


_GATES = "WHEN foreign_ THEN 'ForeignStoreDir' WHEN missing THEN 'NoCatalogRow' WHEN other THEN 'StoreKeyCollision' WHEN corrupt THEN 'UndecodableIdentity' WHEN uncovered THEN 'ShaMismatch'"


def _tree_verdicts(s: SparkSession, d: str, policy: retention.Policy, *, wipe: bool = False) -> DataFrame:
    i = F.col("doc_id")
    x = t.table(s, d, "documents").select(
        i.alias("tree"), F.concat(F.lit("conv-"), i % 150).alias("session_uuid"), (i % 31 == 0).alias("foreign"), F.when(i % 29 == 0, "missing").otherwise("ok").alias("manifest"),
        F.when(i % 23 == 0, "other").when(i % 19 == 0, "corrupt").otherwise("same").alias("identity"), F.when(i % 13 > 0, i % 40).alias("age_days"), (i % 11 == 0).alias("captured"), (i % 7 == 0).alias("caps_lifted"),
    )
    covered = x.select("tree", F.when(F.col("tree") % 17 == 0, "ShaMismatch").otherwise("").alias("reason"))
    return scratch.tree_verdicts(x, covered, _active(s, d), policy, wipe=wipe)


@query("scratch_gate_aged", _tree_sql(_GATES, "7", "10"))
def _(s, d):
    return _tree_verdicts(s, d, retention.Policy(retain=(("scratch-file", 10),)))


@query("scratch_gate_full", _tree_sql(f"{_GATES} WHEN captured THEN 'Captured' WHEN NOT lifted THEN 'NotFullyArchived'", "1 / 24.0", "0"))
def _(s, d):
    return _tree_verdicts(s, d, retention.Policy(full=True))


@query("scratch_gate_wipe", _tree_sql("", "1 / 24.0", "0"))
def _(s, d):
    return _tree_verdicts(s, d, retention.Policy(), wipe=True)


@query("gc_empty_dirs", """, x AS (SELECT url AS path, page_id AS i FROM pages), y AS (SELECT path, CASE WHEN i % 13 = 0 THEN 'OpenFailed' WHEN i % 3 > 0 THEN 'RetainWindow' WHEN i % 20 < 7 THEN 'TooYoung' ELSE '' END AS reason FROM x)
 SELECT path, CASE reason WHEN '' THEN 'delete' WHEN 'OpenFailed' THEN 'unverified' ELSE 'protected' END AS verdict, reason FROM y""")
def _(s, d):
    i = F.col("page_id")
    return scratch.empty_dir_verdicts(t.table(s, d, "pages").select(F.col("url").alias("path"), (i % 13 > 0).alias("readable"), (i % 3).alias("children"), (i % 20).alias("age_days")), retention.Policy())


@query("gc_commit_flips", f"""{_verdict_sql(True, False)}, n AS (SELECT v.source_path, CASE WHEN a.id % 4 = 0 THEN 'protected' ELSE verdict END AS now FROM v JOIN artifacts a ON a.source_path = v.source_path WHERE a.id % 9 > 0)
 SELECT verdict AS planned, now, count(*) AS n FROM v LEFT JOIN n ON v.source_path = n.source_path GROUP BY ALL""")
def _(s, d):
    v = _verdicts(s, d, retention.Policy(full=True))
    i = F.element_at(F.split("source_path", "/"), -1).cast("long")
    return ledger.flips(v, v.where(i % 9 > 0).withColumn("verdict", F.when(i % 4 == 0, "protected").otherwise(F.col("verdict"))))


@query("stored_verification", "SELECT source_path AS path, NOT (id % 5 = 0 OR (id % 7 = 0 AND id % 13 > 0)) AS ok FROM artifacts")
def _(s, d):
    i, plain = F.col("id"), F.col("text").cast("binary")
    a = t.artifacts(s, d).select(F.col("source_path").alias("path"), "id", plain.alias("content"))
    kept = files.encoded(a.select("path", "content"))
    hashes = a.select("path", F.when(i % 13 == 0, "").when(i % 7 == 0, "other").otherwise(F.sha2("content", 256)).alias("content_sha256"), "id")
    stored = kept.join(hashes, "path").withColumn("stored_sha256", F.when(i % 5 == 0, "other").otherwise(F.sha2("content", 256)))
    return ledger.stored_ok(stored, files.decoded(kept))


@query("store_key_select", "SELECT CASE WHEN doc_id % 3 = 0 THEN '_hex--' || lower(hex(encode('_hex--' || source))) || '--' || lower(hex(encode('u' || (doc_id % 10)))) WHEN doc_id % 3 = 1 THEN source || '--u' || (doc_id % 10) ELSE '_h256--' || doc_id END AS key, CASE WHEN doc_id % 3 = 2 AND doc_id % 7 = 0 THEN 'unreadable' ELSE 'match' END AS state FROM documents WHERE (doc_id % 3 < 2 AND doc_id % 10 = 4) OR (doc_id % 3 = 2 AND (doc_id % 7 = 0 OR doc_id % 10 = 4))")
def _(s, d):
    i = F.col("doc_id")
    uuid, slug = F.concat(F.lit("u"), (i % 10).cast("string")), F.col("source")
    key = F.when(i % 3 == 0, ledger.store_key(F.concat(F.lit("_hex--"), slug), uuid)).when(i % 3 == 1, ledger.store_key(slug, uuid)).otherwise(F.concat(F.lit("_h256--"), i.cast("string")))
    return scratch.selected_keys(t.table(s, d, "documents").select(key.alias("key"), F.when(i % 7 == 0, "xyz").otherwise(F.lower(F.hex(uuid))).alias("uuid_hex")), "u4")


@query("verify_keys", """, x AS (SELECT doc_id AS i, source || '--' || doc_id AS key FROM documents), y AS (SELECT key, i, CASE WHEN i % 23 = 0 THEN 'ForeignStoreDir' WHEN i % 19 = 0 THEN 'UnreadableStoreRoot' WHEN i % 17 = 0 THEN 'NoManifest' WHEN i % 17 = 1 THEN 'UnreadableManifest' WHEN i % 13 = 0 THEN 'StoreKeyCollision' END AS stop FROM x)
 SELECT key, stop AS issue FROM y WHERE stop IS NOT NULL UNION ALL SELECT key, 'UndecodableIdentity' FROM y WHERE stop IS NULL AND i % 13 = 1 UNION ALL SELECT key, 'ForeignArtifact' FROM y WHERE stop IS NULL AND i % 5 = 0 UNION ALL SELECT key, unnest(['UndecodableEntry', 'UnreconcilableKey']) FROM y WHERE stop IS NULL AND i % 7 = 0""")
def _(s, d):
    i = F.col("doc_id")
    slug, uuid = F.lower(F.hex("source")), F.lower(F.hex(i.cast("string")))
    x = t.table(s, d, "documents").select(
        ledger.store_key(F.col("source"), i.cast("string")).alias("key"), (i % 19 > 0).alias("readable"), (i % 23 == 0).alias("foreign"), F.when(i % 17 == 0, "missing").when(i % 17 == 1, "unreadable").otherwise("ok").alias("manifest"),
        F.when(i % 13 == 0, F.lit("61")).when(i % 13 == 2, "").otherwise(slug).alias("slug_hex"), F.when(i % 13 == 1, "6").when(i % 13 == 2, "").otherwise(uuid).alias("uuid_hex"), F.when(i % 7 == 0, 2).otherwise(0).alias("undecodable"), F.when(i % 5 == 0, 1).otherwise(0).alias("irregular"),
    )
    return scratch.key_issues(x)


@query("verify_legacy_layout", """, x AS (SELECT doc_id AS i, ['slug', '_scratch', '_history'][(doc_id % 3) + 1] || '/' || CASE WHEN doc_id % 3 < 2 THEN 'u' || doc_id || '/' ELSE '' END || doc_id || '.txt' AS path FROM documents),
 y AS (SELECT i, path, CASE i % 3 WHEN 0 THEN 'u' || i || '/' || i || '.txt' WHEN 1 THEN '_scratch--u' || i || '/u' || i || '/' || i || '.txt' ELSE '_history/' || path END AS old FROM x)
 SELECT CASE WHEN i % 4 = 1 THEN old ELSE path END AS path, CASE WHEN i % 4 = 1 THEN 'QuarantineLegacyLayout' ELSE 'QuarantineMissing' END AS issue FROM y WHERE i % 4 IN (1, 2)
 UNION ALL SELECT 'other/' || i, 'QuarantineStray' FROM y WHERE i % 4 = 3 UNION ALL SELECT '_scratch--gone/' || i, 'QuarantineLegacyLayout' FROM y WHERE i % 8 = 3
 UNION ALL SELECT old, 'QuarantineMismatch' FROM y WHERE i % 16 = 1""")
def _(s, d):
    i = F.col("i")
    name = F.concat(F.lit("u"), i.cast("string"))
    x = t.table(s, d, "documents").select(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("sha"))
    x = x.withColumn("path", F.concat_ws("/", t.pick(["slug", "_scratch", "_history"], i % 3), F.when(i % 3 < 2, name), F.concat(i.cast("string"), F.lit(".txt"))))
    x = x.withColumn("old", F.get(retention.legacy_places(F.col("path")), F.lit(0)))
    at = F.explode(F.array_compact(F.array(F.when(i % 4 == 0, F.col("path")), F.when(i % 4 == 1, F.col("old")), F.when(i % 4 == 3, F.concat(F.lit("other/"), i.cast("string"))), F.when(i % 8 == 3, F.concat(F.lit("_scratch--gone/"), i.cast("string"))))))
    claims = x.where("i % 4 < 3").select("path", F.lit(0).alias("no"), F.lit(True).alias("quarantined"), F.when(i % 16 == 1, "other").otherwise(F.col("sha")).alias("source_sha256"))
    return retention.quarantine_issues(x.select(at.alias("path"), F.col("sha").alias("sha256"), F.lit(True).alias("regular")), claims)


@query("scan_utf8_gate", """, x AS (SELECT doc_id AS id, doc_id % 7 AS k, text FROM documents) SELECT id, CASE k WHEN 2 THEN 'non-utf8' WHEN 3 THEN 'utf16-ambiguous' WHEN 4 THEN 'utf16-decode-failed' END AS reason, CASE WHEN k IN (2, 3, 4) THEN NULL WHEN k = 6 THEN repeat('é', 40) || chr(0) ELSE text END AS text FROM x""")
def _(s, d):
    k, text = F.col("doc_id") % 7, F.col("text").cast("binary")
    wide = F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))
    content = (
        F.when(k == 0, wide).when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), text)).when(k == 2, F.concat(text, F.lit(b"\xff"))).when(k == 3, F.concat(text, F.lit(b"a\0" * 40)))
        .when(k == 4, F.concat(wide, F.lit(b"a"))).when(k == 6, F.concat(F.repeat(F.lit("é"), 40).cast("binary"), F.lit(b"\0"))).otherwise(text)
    )
    return scanning.decoded_texts(t.table(s, d, "documents").select(F.col("doc_id").alias("id"), content.alias("content")))


@query("scan_canonical", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'AK' || 'IA-file ' || doc_id ELSE 'plain ' || doc_id || chr(10) END AS text FROM documents")
def _(s, d):
    x, i = t.table(s, d, "documents"), F.col("doc_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("A\u200b\uff2b\u0301IA-\u2060\ufb01le\xa0 "), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("plain\a "), i.cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("plain "), i.cast("string"), F.lit("\n")))
    return scanning.canonical_texts(x.select(i.alias("id"), text.alias("text")))


@query("scan_spans", f"{_FOUND} SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY pos) AS no, pos::BIGINT AS span_start, (pos + octet_length(encode(found)))::BIGINT AS span_end FROM f")
def _(s, d):
    f = scanning.scanned(_planted(s, d)).select("id", F.posexplode("findings").alias("at", "f"))
    return f.select("id", "f.kind", (F.col("at") + 1).cast("long").alias("no"), "f.span_start", (F.col("f.span_start") + F.col("f.span_len")).alias("span_end"))


@query("rescan_fixpoint", f"{_STORED} SELECT count(*) AS changed, count(*) AS fixpoints FROM r")
def _(s, d):
    return scanning.rescan_plan(_stored(s, d)).agg(F.count("*").alias("changed"), F.count_if("fixpoint").alias("fixpoints"))


@query("gc_age_policy", "SELECT role, count(*) AS n, count(*) FILTER (age_days >= CASE role WHEN 'transcript' THEN 90 WHEN 'subagent' THEN 90 WHEN 'mcp' THEN 14 WHEN 'paste' THEN 14 WHEN 'snapshot' THEN 30 ELSE 7 END) AS old_enough FROM artifacts GROUP BY role")
def _(s, d):
    policy = retention.Policy()
    old = F.col("age_days") >= F.greatest(F.lit(float(policy.floor())), policy.window(F.col("role")))
    return t.artifacts(s, d).groupBy("role").agg(F.count("*").alias("n"), F.count_if(old).alias("old_enough"))


# --- upkeep of index and ledger ----------------------------------------------------------------------------


@query("findings_replace", "SELECT id, 'old' AS kind FROM artifacts WHERE id % 2 = 0 AND id % 3 > 0 UNION ALL SELECT id, 'new' FROM artifacts WHERE id % 6 = 0")
def _(s, d):
    a = t.artifacts(s, d).select("id")
    found = lambda rows, kind: rows.withColumn("kind", F.lit(kind))
    return index.replaced(found(a.where("id % 2 = 0"), "old"), a.where("id % 3 = 0"), found(a.where("id % 6 = 0"), "new"), "id")


@query("index_delete_session", "SELECT entry_uuid, session_uuid FROM entries WHERE session_uuid <> 'conv-3'")
def _(s, d):
    return index.without_session(t.entries(s, d), "conv-3").select("entry_uuid", "session_uuid")


@query("index_watermarks", """SELECT source_path, source_sha256, 1::BIGINT AS doc_count, 'then' AS indexed_at FROM artifacts WHERE archived AND id % 10 > 0
 UNION ALL SELECT source_path, live_sha256, count(e.entry_uuid), 'now' FROM artifacts a LEFT JOIN entries e ON e.artifact_id = a.id WHERE a.id % 10 = 0 GROUP BY source_path, live_sha256""")
def _(s, d):
    a = t.artifacts(s, d)
    old = a.where("archived").select("source_path", "source_sha256", F.lit(1).cast("long").alias("doc_count"), F.lit("then").alias("indexed_at"))
    return index.watermarked(old, t.entries(s, d), a.where("id % 10 = 0").select(F.col("id").alias("artifact_id"), "source_path", F.col("live_sha256").alias("source_sha256")), "now")


@query("index_report", ", x AS (SELECT id, archived AND source_sha256 = live_sha256 AS same FROM artifacts) SELECT count(*) FILTER (same) AS up_to_date, count(*) FILTER (NOT same) AS to_index, coalesce(sum(id % 4) FILTER (NOT same), 0)::BIGINT AS skipped_lines FROM x")
def _(s, d):
    a = t.artifacts(s, d)
    now = a.select(F.col("id").alias("artifact_id"), "source_path", F.col("live_sha256").alias("source_sha256"))
    return index.index_report(now, a.where("archived").select("source_path", "source_sha256"), a.where("id % 4 > 0").select(F.col("id").alias("artifact_id"), (F.col("id") % 4).alias("n")))


@query("rescan_update", """SELECT id, source_path, source_sha256, CASE WHEN id % 8 = 1 THEN 'new' ELSE source_sha256 END AS stored_sha256, CASE WHEN id % 8 = 1 THEN 7 ELSE source_bytes END::BIGINT AS stored_bytes, CASE WHEN id % 8 = 1 THEN 1 ELSE redacted END AS redacted,
 CASE WHEN id % 8 = 1 THEN (id % 16 = 1)::INT ELSE quarantined END AS quarantined, CASE WHEN id % 8 = 1 THEN 'now' ELSE verified_at END AS verified_at FROM artifacts""")
def _(s, d):
    a = t.artifacts(s, d).select("id", "source_path", "source_sha256", F.col("source_sha256").alias("stored_sha256"), F.col("source_bytes").alias("stored_bytes"), "redacted", "quarantined", "verified_at")
    changes = a.where("id % 8 = 1").select("id", F.lit("new").alias("stored_sha256"), F.lit(7).cast("long").alias("stored_bytes"), F.lit(1).alias("redacted"), (F.col("id") % 16 == 1).cast("int").alias("quarantined"))
    return index.rescan_updated(a, changes, "now")


@query("manifest_merge", """, r AS (SELECT session_uuid, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS findings, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS redacted, id % 5 = 0 AND id % 2 = 0 AS quarantined FROM artifacts WHERE id % 3 > 0 OR id % 5 = 0)
 SELECT session_uuid, count(*) AS artifacts, sum(findings)::BIGINT AS findings, sum(redacted)::BIGINT AS redacted, bool_or(quarantined) AS quarantined FROM r GROUP BY 1""")
def _(s, d):
    a, i = t.artifacts(s, d), F.col("id")
    record = lambda rows, n, m, q: rows.select("session_uuid", F.col("source_path").alias("source"), F.lit(n).alias("findings"), F.lit(m).alias("redacted"), q.alias("quarantined"))
    return index.summary(index.overlaid(record(a.where("id % 3 > 0"), 1, 1, F.lit(False)), record(a.where("id % 5 = 0"), 2, 0, i % 2 == 0)))


# --- paths and inventories ---------------------------------------------------------------------------------

_PLACES = ["/home/u[1]/.keys.json", "/home/u[1]/backups/a/b", "/home/u[1]/./x/../.lake//y", "/srv/abc/x", "/data/k.pem", "/home/u1/.keys.json", "/home/u[1]/backup/a", "/home/u[1]/.lakes"]


@query("path_gates", f""", x AS (SELECT doc_id AS id, doc_id % 8 AS k FROM documents) SELECT id, replace(replace({_PLACES!r}[k + 1], './x/../', ''), '//', '/') AS normal, k <= 4 AS denied, k IN (0, 1, 2, 6, 7) AS inside FROM x""")
def _(s, d):
    x = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), t.pick(_PLACES, F.col("doc_id") % 8).alias("path"))
    p = F.col("path")
    return x.select("id", paths.normal_path(p).alias("normal"), paths.denied(p, ["~/.keys.json", "~/backups/**", "/srv/a*/x", "*.pem"], "/home/u[1]", "/home/u[1]/.lake").alias("denied"), paths.contained(p, ["/home/u[1]/", "/tmp"]).alias("inside"))


@query("path_inodes", """, x AS (SELECT doc_id AS id, doc_id % 8 AS k, doc_id % 2 AS dev, doc_id // 3 AS ino FROM documents)
SELECT id FROM x WHERE k > 4 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.k IN (0, 1) AND y.dev = x.dev AND y.ino = x.ino)""")
def _(s, d):
    i = F.col("doc_id")
    x = t.table(s, d, "documents").select(i.alias("id"), t.pick(_PLACES, i % 8).alias("path"), (i % 2).alias("dev"), F.floor(i / 3).alias("ino"))
    return paths.admitted(x, ["/srv/a*/x", "*.pem"], ["~/.keys.json", "~/backups/**"], "/home/u[1]", "/home/u[1]/.lake").select("id")


@query("live_sessions", """SELECT 'conv-' || (doc_id % 50) AS session_uuid FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 > 0 UNION SELECT 'conv-' || (100 + doc_id % 20) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 40 >= 30""")
def _(s, d):
    x, i = t.table(s, d, "documents"), F.col("doc_id")
    records = x.select(i.alias("pid"), F.when(i % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("conv-"), i % 50).alias("sessionId")))).alias("content"))
    locks = x.select(F.concat(F.lit("/locks/conv-"), 100 + i % 20, F.when(i % 2 == 0, ".lock").otherwise(".tmp")).alias("path"), (i % 40).alias("modified"))
    return paths.active_sessions(records, x.where("doc_id % 3 = 0").select(i.alias("pid")), locks, F.lit(30))


@query("scratch_trees", """SELECT source || '/' || (doc_id % 3) AS tree, count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(doc_id % 40) AS newest FROM documents GROUP BY 1 UNION ALL SELECT DISTINCT source || '/empty', 0, 0, NULL FROM documents""")
def _(s, d):
    x, i = t.table(s, d, "documents"), F.col("doc_id")
    files_ = x.select(F.concat_ws("/", F.lit("/tmp/r"), "source", i % 3, i).alias("path"), F.col("n_chars").alias("bytes"), (i % 40).alias("modified"))
    dirs = x.select(F.concat_ws("/", F.lit("/tmp/r"), "source", F.lit("empty")).alias("path"), F.lit(None).cast("long").alias("bytes"), F.lit(1).cast("long").alias("modified")).distinct()
    return paths.trees(files_.unionByName(dirs), "/tmp/r/")


@query("empty_dir_scan", "SELECT '/d/' || (doc_id % 50) || '/' || doc_id AS path, 4::BIGINT AS depth FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    x, i = t.table(s, d, "documents"), F.col("doc_id")
    above, own = F.concat(F.lit("/d/"), i % 50), F.concat(F.lit("/d/"), i % 50, F.lit("/"), i)
    return paths.empty_dirs(x.select(F.explode(F.array(above, own)).alias("path")), x.where("doc_id % 3 > 0").select(F.concat(own, F.lit("/f")).alias("path")))


@query("user_roots", "SELECT 'u' || doc_id AS user, doc_id AS uid, '/home/u' || doc_id AS home FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 > 0 AND doc_id % 2 = 0")
def _(s, d):
    x, i = t.table(s, d, "documents"), F.col("doc_id")
    home = F.concat(F.when(i % 5 > 0, "/home/u").otherwise("/var/u"), i)
    line = F.concat(F.lit("u"), i, F.lit(":x:"), F.when(i % 7 > 0, i.cast("string")).otherwise("bad"), F.lit(":9:a, b:"), home, F.lit(":/bin/sh"))
    return paths.user_roots(x.select(line.alias("value")), x.where("doc_id % 2 = 0").select(F.concat(home, F.lit("/.sessions")).alias("path")), "/home", ".sessions")
