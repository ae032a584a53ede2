"""Transcript lines in JSON to flat entries, in VARIANT and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.steps import step

#: Scalars of a tool call that its text shows, in this order.
SHOWN = ["command", "file_path", "description", "pattern", "path"]
MOST_TOOL_TEXT = 4096
_V = "'variant'"
#: A text of white space only, of whatever kind.
BLANK = r"(?U)^\s*$"
#: The same in a SQL string.
BLANK_SQL = BLANK.replace("\\", "\\\\")


def lines(files: DataFrame) -> DataFrame:
    """(artifact, seq, line) of each line of (artifact, content): what ends in a newline, of which a carriage return before it is part, and a rest that isn't empty."""
    cut = F.split("content", "\n")
    whole = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    rest = F.filter(F.slice(cut, -1, 1), lambda x: x != "")
    return files.select("artifact", F.posexplode(F.concat(whole, rest)).alias("seq", "line"))


def parsed(numbered: DataFrame) -> DataFrame:
    """Adds v, the line's value: null for blank and malformed lines; `malformed` tells the latter.

    A line counts only if it still parses inside brackets and inside an object, so trailing garbage cannot slip through.
    """
    t = F.col("line")
    blank = t.rlike(BLANK)
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull()
    first = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$[0]", "variant")
    # what is in brackets is the line's value, so a line is parsed twice
    x = step(numbered, numbered.columns, v=F.when(~blank & in_object, first))
    return x.withColumn("malformed", ~blank & F.col("v").isNull())


def text_at(v: str, path: str) -> str:
    """SQL: the string at a path, null for any other type; never coerced."""
    x = f"try_variant_get({v}, '{path}', {_V})"
    return f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END"


def _blocks(v: str, path: str) -> str:
    """SQL: the array at a path, empty if there is none."""
    return f"CASE WHEN startswith(schema_of_variant(try_variant_get({v}, '{path}', {_V})), 'ARRAY') THEN try_variant_get({v}, '{path}', 'array<variant>') ELSE array() END"


def _joined(blocks: str, kind: str, b: str = "b") -> str:
    """SQL: the texts of an array's blocks of a kind, newlines between them; b names the lambda's variable."""
    return f"array_join(array_compact(transform(filter({blocks}, {b} -> {text_at(b, '$.type')} = '{kind}'), {b} -> {text_at(b, '$.' + kind)})), '\n')"


def _call() -> str:
    """SQL: a tool call as text: its name and the scalars it shows."""
    shown = ", ".join(f"CASE WHEN regexp_like(schema_of_variant(try_variant_get(b, '$.input.{k}', {_V})), '^(STRING|BIGINT|BOOLEAN|DECIMAL.*|DOUBLE)$') THEN try_variant_get(b, '$.input.{k}', 'string') END" for k in SHOWN)
    return f"left(concat('$', coalesce({text_at('b', '$.name')}, 'tool'), ' ', array_join(array_compact(array({shown})), ' ')), {MOST_TOOL_TEXT})"


def parsed_entries(values: DataFrame) -> DataFrame:
    """(artifact, seq, entry_uuid, parent_uuid, timestamp, role, text, tool_name) of each line that is an entry; blank texts are dropped.

    An entry without an id, or with an empty one, is named by its artifact and line. Results of a tool carry the name of the
    call they answer: named calls of assistants and results meet in a join on (artifact, call id), the last definition winning.
    """
    content = _blocks("v", "$.message.content")
    x = values.where("v IS NOT NULL").selectExpr("artifact", "seq", "v", f"{text_at('v', '$.type')} AS kind", f"{text_at('v', '$.uuid')} AS uuid", f"{text_at('v', '$.parentUuid')} AS parent_uuid", f"{text_at('v', '$.timestamp')} AS timestamp", f"{content} AS blocks", f"{text_at('v', '$.message.content')} AS plain", f"startswith(schema_of_variant(try_variant_get(v, '$.message.content', {_V})), 'ARRAY') AS listed")
    results = f"filter(blocks, b -> {text_at('b', '$.type')} = 'tool_result')"
    inner = f"coalesce({text_at('b', '$.content')}, {_joined(_blocks('b', '$.content'), 'text', 'i')})"
    bodies = f"array_join(transform(filter(transform({results}, b -> struct({inner} AS body, coalesce(CASE WHEN schema_of_variant(try_variant_get(b, '$.is_error', {_V})) = 'BOOLEAN' THEN try_variant_get(b, '$.is_error', 'boolean') END, false) AS bad)), r -> r.bad OR NOT rlike(r.body, '{BLANK_SQL}')), r -> concat(CASE WHEN r.bad THEN '[error] ' ELSE '' END, r.body)), '\n')"
    said = f"array_join(array_compact(transform(blocks, b -> CASE {text_at('b', '$.type')} WHEN 'text' THEN {text_at('b', '$.text')} WHEN 'thinking' THEN {text_at('b', '$.thinking')} WHEN 'tool_use' THEN {_call()} END)), '\n')"
    x = x.selectExpr(
        "*", f"size({results}) > 0 AS answers",
        f"get(array_compact(transform(filter(blocks, b -> {text_at('b', '$.type')} = 'tool_use'), b -> {text_at('b', '$.name')})), 0) AS called",
    ).selectExpr(
        "artifact", "seq", "uuid", "parent_uuid", "timestamp", "blocks",
        "CASE WHEN kind = 'user' AND answers THEN 'tool_result' WHEN kind = 'user' AND (plain IS NOT NULL OR listed) THEN 'user' WHEN kind = 'assistant' AND listed THEN 'assistant' WHEN kind IN ('system', 'summary') THEN kind END AS role",
        f"CASE WHEN kind = 'user' AND answers THEN {bodies} WHEN kind = 'user' THEN coalesce(plain, {_joined('blocks', 'text')}) WHEN kind = 'assistant' AND listed THEN {said} WHEN kind = 'system' THEN coalesce({text_at('v', '$.content')}, plain) WHEN kind = 'summary' THEN {text_at('v', '$.summary')} END AS text",
        "CASE WHEN kind = 'assistant' THEN called END AS called",
    ).where(f"role IS NOT NULL AND NOT rlike(text, '{BLANK_SQL}')")
    calls = values.where(f"v IS NOT NULL AND {text_at('v', '$.type')} = 'assistant'").selectExpr("artifact", "seq", f"posexplode({content}) AS (at, b)").selectExpr("artifact AS a", f"{text_at('b', '$.id')} AS id", f"{text_at('b', '$.name')} AS name", f"{text_at('b', '$.type')} AS t", "struct(seq, at) AS place")
    calls = calls.where("t = 'tool_use' AND id IS NOT NULL AND name IS NOT NULL").groupBy("a", "id").agg(F.max_by("name", "place").alias("name"))
    asked = x.where("role = 'tool_result'").selectExpr("artifact", "seq", f"posexplode(transform({results}, b -> {text_at('b', '$.tool_use_id')})) AS (at, id)")
    answered = asked.join(calls, (F.col("artifact") == F.col("a")) & (asked.id == calls.id)).groupBy(F.col("artifact").alias("a2"), F.col("seq").alias("s2")).agg(F.min_by("name", "at").alias("answered"))
    out = x.join(answered, (F.col("artifact") == F.col("a2")) & (F.col("seq") == F.col("s2")), "left")
    uuid = F.coalesce(F.nullif("uuid", F.lit("")), F.concat(F.lit("line:"), "artifact", F.lit(":"), "seq"))
    return out.select("artifact", F.col("seq").cast("long").alias("seq"), uuid.alias("entry_uuid"), "parent_uuid", "timestamp", "role", "text", F.coalesce("called", "answered").alias("tool_name"))


def header(values: DataFrame) -> DataFrame:
    """(artifact, cwd, branch, version, first_seen, last_seen, n_lines): the first known cwd, branch and version, the range of timestamps, and parseable lines."""
    x = values.where("v IS NOT NULL").selectExpr("artifact", "seq", f"{text_at('v', '$.cwd')} AS cwd", f"{text_at('v', '$.gitBranch')} AS branch", f"{text_at('v', '$.version')} AS version", f"{text_at('v', '$.timestamp')} AS at")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return x.groupBy("artifact").agg(first("cwd").alias("cwd"), first("branch").alias("branch"), first("version").alias("version"), first("at").alias("first_seen"), F.max_by("at", F.when(F.col("at").isNotNull(), F.col("seq"))).alias("last_seen"), F.count("*").alias("n_lines"))


def as_transcripts(entries: DataFrame) -> DataFrame:
    """(artifact, content): entries as transcript files, every 11th line of an artifact cut short, for round trips."""
    block = lambda **kw: F.array(F.struct(*[v.alias(k) for k, v in kw.items()]))
    call = F.concat(F.lit("call-"), "seq")
    base = [F.col("role").alias("type"), F.col("entry_uuid").alias("uuid"), F.col("parent_uuid").alias("parentUuid"), F.concat(F.lit("1."), F.col("artifact_id") % 3).alias("version"), F.col("timestamp"), F.col("cwd"), F.col("git_branch").alias("gitBranch")]
    plain = F.to_json(F.struct(*base, F.struct(F.col("text").alias("content")).alias("message")))
    tool = F.to_json(F.struct(*base, F.struct(block(type=F.lit("tool_use"), id=call, name=F.col("tool_name"), input=F.struct(F.substring("text", 1, 40).alias("command"))).alias("content")).alias("message")))
    said = F.to_json(F.struct(*base, F.struct(block(type=F.lit("text"), text=F.col("text")).alias("content")).alias("message")))
    answer = F.to_json(F.struct(*base, F.struct(block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("call-"), F.col("seq") - 1), content=F.col("text")).alias("content")).alias("message")))
    line = F.when(F.col("tool_name").isNotNull(), tool).when(F.col("role") == "assistant", said).when((F.col("role") == "user") & (F.col("seq") % 2 == 0) & (F.col("seq") > 0), answer).otherwise(plain)
    line = F.when(F.col("seq") % 11 == 10, F.substring(line, 1, 20)).otherwise(line)
    lines_ = F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return entries.groupBy(F.col("artifact_id").alias("artifact")).agg(F.concat(F.array_join(lines_, "\n"), F.lit("\n")).alias("content"))
