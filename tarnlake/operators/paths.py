"""Directory inventories: normal paths, containment, denied globs and inodes, trees, empty directories, live sessions and users' roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.retention import glob_pattern

#: Characters that make a part of a path a glob.
_META = "*?["


def normal_path(path: Column) -> Column:
    """An absolute path without empty parts, single dots and double dots (those at the root lead nowhere); a lexical fold, links aren't followed."""
    step = lambda kept, p: F.when(p.isin("", "."), kept).when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def contained(path: Column, roots: list[str]) -> Column:
    """Whether a path lies at or below one of the roots once it is normal; a null path doesn't."""
    p = normal_path(path)
    inside = F.lit(False)
    for r in roots:
        r = "/" + "/".join(x for x in r.split("/") if x)
        inside = inside | (p == r) | F.startswith(p, F.lit(r.rstrip("/") + "/"))
    return F.coalesce(inside, F.lit(False))


def denied_pattern(entries: list[str], home: str, store: str | None) -> str:
    """One regular expression for denied paths: the store (if any) and all in it, and entries, of which those with ~/ lie in home.

    Home and store are paths, not globs, and so are the parts of an entry before its first part with a glob character.
    A relative entry holds at any depth.
    """
    quote = lambda t: "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in t)
    out = [f"{quote(store)}(?:/.*)?"] if store else []
    for e in entries:
        full = f"{home}/{e[2:]}" if e.startswith("~/") else e
        if not full.startswith("/"):
            out.append(glob_pattern([full])[1:-1])
            continue
        from_home = len(home) if e.startswith("~/") else 0
        first = min((full.find(c, from_home) for c in _META if full.find(c, from_home) >= 0), default=len(full))
        cut = full.rfind("/", 0, first) + 1 if first < len(full) else first
        tail = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in full[cut:].replace("**", "*"))
        out.append(quote(full[:cut]) + tail)
    return f"(?s)^(?:{'|'.join(out)})$"


def denied(path: Column, entries: list[str], home: str, store: str) -> Column:
    """Whether a path, once normal, is denied; a null path is."""
    return F.coalesce(normal_path(path).rlike(denied_pattern(entries, home, store)), F.lit(True))


def admitted(files: DataFrame, entries: list[str], guarded: list[str], home: str, store: str) -> DataFrame:
    """Files (path, dev, ino, ...) whose path isn't denied, and which are no other name of a file at a guarded path (globs as in entries).

    Where dev or ino is null a file's names can't be told, and its path alone counts; a null path is denied.
    """
    kept = files.where(~denied(F.col("path"), [*entries, *guarded], home, store))
    gone = files.where(normal_path(F.col("path")).rlike(denied_pattern(guarded, home, None)))
    gone = gone.select(F.col("dev").alias("__dev"), F.col("ino").alias("__ino")).distinct()
    return kept.join(gone, (F.col("dev") == F.col("__dev")) & (F.col("ino") == F.col("__ino")), "left_anti")


def trees(files: DataFrame, root: str) -> DataFrame:
    """(tree, files, bytes, newest) of files (path, bytes, modified; bytes null for a directory): what lies two levels below the root.

    An empty tree has a row of its own, from its directory's.
    """
    below = F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/")
    x = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).withColumn("part", below).where(F.size("part") >= F.when(F.col("bytes").isNull(), 2).otherwise(3))
    tree = F.array_join(F.slice("part", 1, 2), "/")
    is_file = F.col("bytes").isNotNull()
    return x.groupBy(tree.alias("tree")).agg(F.count_if(is_file).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.max(F.when(is_file, F.col("modified"))).alias("newest"))


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, depth) of directories (path) that are the parent of no directory and no file, deepest first."""
    parent = F.regexp_replace("path", "/[^/]*$", "").alias("parent")
    used = dirs.select(parent).unionByName(files.select(parent)).distinct()
    left = dirs.select("path").distinct().join(used, F.col("path") == F.col("parent"), "left_anti")
    return left.select("path", F.size(F.split("path", "/")).cast("long").alias("depth")).orderBy(F.desc("depth"), "path")


def active_sessions(records: DataFrame, alive: DataFrame, locks: DataFrame, since: Column) -> DataFrame:
    """(session_uuid): sessions of records (pid, content: JSON) whose process is alive (pid), and of locks (path, modified) touched since.

    A record that is no JSON or names no session tells nothing.
    """
    by_pid = records.join(alive.select("pid").distinct(), "pid", "left_semi").select(F.get_json_object("content", "$.sessionId").alias("session_uuid"))
    by_lock = locks.where(F.endswith("path", F.lit(".lock")) & (F.col("modified") >= since)).select(F.regexp_extract("path", r"([^/]+)\.lock$", 1).alias("session_uuid"))
    return by_pid.unionByName(by_lock).where("session_uuid <> ''").distinct()


def user_roots(passwd: DataFrame, dirs: DataFrame, base: str, folder: str) -> DataFrame:
    """(user, uid, home) of lines of a user table (value: name:x:uid:gid:comment:home:shell) whose home lies in base and has the folder, by dirs (path)."""
    part = F.split("value", ":")
    users = passwd.where(F.size(part) >= 7).select(F.get(part, F.lit(0)).alias("user"), F.get(part, F.lit(2)).try_cast("long").alias("uid"), F.get(part, F.lit(5)).alias("home"))
    users = users.where(F.startswith("home", F.lit(base.rstrip("/") + "/")) & F.col("uid").isNotNull())
    has = dirs.where(F.endswith("path", F.lit("/" + folder))).select(F.regexp_replace("path", "/[^/]*$", "").alias("of")).distinct()
    return users.join(has, F.col("home") == F.col("of"), "left_semi")
