"""Scans, caches, fingerprints, diffs and text sinks over file relations."""

from __future__ import annotations

import fnmatch
import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code
from graphloom.operators import predicates as P
from graphloom.operators.lineage import written

#: Folders that no scan enters; fixed values.
IGNORED = [".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".venv", "venv", ".next", ".idea", ".vscode"]
PARSE_CAP = 4 << 20


# ---------------------------------------------------------------- scans


def ignore_pattern(lines: list[str]) -> str:
    """One expression for the lines of an ignore file: globs, a trailing slash for folders, a
    leading slash for the root; comments and negations are left out."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        body = fnmatch.translate(line.strip("/")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace(".*", "[^/]*")
        out.append(("^" if line.startswith("/") else "(?:^|/)") + body + ("/" if line.endswith("/") else "(?:/|$)"))
    return "|".join(out) or r"(?!)"


def scan(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """``path, language, size_bytes, mtime, content`` of the files under a folder that Spark
    reads, without ignored ones; undecodable content is null."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.col("content").alias("raw"))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), P.strings(IGNORED)) & ~F.col("path").rlike(ignore_pattern(list(ignore))))
    return rows.select("path", code.language(F.col("path")).alias("language"), "size_bytes", "mtime", F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string")).alias("content"))


def workspace(files: DataFrame, prefix: str | None) -> DataFrame:
    return files if not prefix else files.where(P.in_workspace(F.col("path"), P.normal_path(prefix)))


# ---------------------------------------------------------------- caches


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that still hold, files to parse): a file whose modification time and
    size are the cache's is taken from there; files over ``PARSE_CAP`` are parsed by nobody."""
    keys = ["path", "mtime", "size_bytes"]
    hits = cache.join(files.select(*keys), keys, "left_semi")
    return hits, files.where(F.col("size_bytes") <= PARSE_CAP).join(cache.select(*keys), keys, "left_anti")


def stat_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """``path, mtime, size_bytes, hash``: the known hash where time and size are the same, else
    that of the content without a Markdown header. ``known``: path, mtime, size_bytes, hash."""
    keys = ["path", "mtime", "size_bytes"]
    rows = files.join(known.select(*keys, F.col("hash").alias("old")), keys, "left")
    return rows.select(*keys, F.coalesce("old", content_hash(F.col("path"), F.col("content"))).alias("hash"))


def without_header(path: Column, content: Column) -> Column:
    """Markdown without its front matter."""
    return F.when(path.endswith(".md"), F.regexp_replace(content, r"\A---\n(?s:.*?)\n---\n", "")).otherwise(content)


def content_hash(path: Column, content: Column) -> Column:
    return F.sha2(F.coalesce(without_header(path, content), F.lit("")), 256)


def fingerprint(hashes: DataFrame, head: str = "", buckets: int = 256) -> DataFrame:
    """One hash over all files (path, hash) and the head commit: files are hashed in order
    within buckets of their paths, and then the buckets, so that no task holds all."""
    line = F.concat_ws(":", "path", "hash")
    of = hashes.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return of.agg(F.sha2(F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "h"))), "\n")), 256).alias("fingerprint"))


#: Digits of a path's hash that lead through the tree, so sixteen children a node and at most 16^DEPTH leaves.
DEPTH = 4


def _branches(leaves: DataFrame) -> DataFrame:
    """``prefix, hash`` of the nodes above leaves, up to the root (the empty prefix)."""
    out, now = leaves, leaves
    for k in range(DEPTH - 1, -1, -1):
        now = written(_parents(now, k))
        out = out.unionByName(now)
    return out


def _parents(children: DataFrame, size: int) -> DataFrame:
    """A node's hash covers its children's last digits and hashes, in order: at most sixteen."""
    line = F.concat_ws(":", F.substring("prefix", size + 1, 1), "hash")
    return children.groupBy(F.substring("prefix", 1, size).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))


def _leaves(hashes: DataFrame) -> DataFrame:
    line = F.concat_ws(":", "path", "hash")
    return hashes.groupBy(F.substring(F.sha2("path", 256), 1, DEPTH).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))


def hash_tree(hashes: DataFrame) -> DataFrame:
    """``prefix, hash``: a hash tree over files (path, hash). The first digits of a path's hash lead to its leaf, which
    covers its files in order; a node covers its children. The root has the empty prefix. It depends on the files alone, not on how
    they came about, and trees of two states differ along the branches of what changed."""
    return _branches(written(_leaves(hashes)))


def update_tree(tree: DataFrame, before: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The tree after an edit of the files ``before`` (path, hash): ``changed`` (path, hash) are new or have new hashes, ``removed`` (path)
    are gone. Only the leaves of these and the nodes above them are hashed anew, from their files and their children."""
    leaf = F.substring(F.sha2("path", 256), 1, DEPTH)
    edited = changed.select("path").unionByName(removed.select("path")).distinct()
    hit = written(edited.select(leaf.alias("prefix")).distinct())
    files = before.withColumn("prefix", leaf).join(hit, "prefix", "left_semi").join(edited, "path", "left_anti").select("path", "hash")
    files = files.unionByName(changed.join(removed.select("path"), "path", "left_anti").select("path", "hash"))
    now = written(_leaves(files))
    level = tree.where(F.length("prefix") == DEPTH).join(hit, "prefix", "left_anti").unionByName(now)
    out = level
    for k in range(DEPTH - 1, -1, -1):
        above = hit.select(F.substring("prefix", 1, k).alias("prefix")).distinct()
        under = level.join(above.withColumnRenamed("prefix", "up"), F.substring("prefix", 1, k) == F.col("up"), "left_semi")
        level = tree.where(F.length("prefix") == k).join(above, "prefix", "left_anti").unionByName(written(_parents(under, k)))
        out = out.unionByName(level)
    return written(out)


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The leaves (prefix) that differ between two trees, met from the root down: a branch of equal hashes isn't entered."""
    differ = lambda k: old.where(F.length("prefix") == k).select("prefix", F.col("hash").alias("was")).join(new.where(F.length("prefix") == k), "prefix", "full").where(~F.col("was").eqNullSafe(F.col("hash"))).select("prefix")
    now = differ(0)
    for k in range(1, DEPTH + 1):
        now = differ(k).join(now.withColumnRenamed("prefix", "up"), F.substring("prefix", 1, k - 1) == F.col("up"), "left_semi")
    return now


# ---------------------------------------------------------------- diffs


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, is_new, added, removed``: numbers of the lines of changed files that the other
    side doesn't have. Sides: path, content."""
    a, b = old.select("path", F.split("content", "\n").alias("a")), new.select("path", F.split("content", "\n").alias("b"))
    both = b.join(a, "path", "left").where("a is null or a <> b")
    none = F.array().cast("array<string>")
    fresh = lambda mine, theirs: F.filter(F.transform(F.col(mine), lambda x, i: F.when(~F.array_contains(F.coalesce(theirs, none), x), i + 1)), lambda i: i.isNotNull())
    return both.select("path", F.col("a").isNull().alias("is_new"), fresh("b", F.col("a")).alias("added"), F.when(F.col("a").isNull(), F.array().cast("array<int>")).otherwise(fresh("a", F.col("b"))).alias("removed"))


_UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}


def window_of(text: str) -> timedelta:
    """``3 days``, ``1 week``, ``yesterday``: how far back an expression reaches."""
    text = text.strip().lower().removesuffix(" ago")
    if text in ("yesterday", "today"):
        return timedelta(days=1 if text == "yesterday" else 0)
    m = re.fullmatch(r"(\d+)\s*([a-z]+?)s?", text)
    if not m or m[2] not in {*_UNITS, "hour", "minute", "d", "h", "w", "m"}:
        raise ValueError(f"not a time expression: {text!r}")
    unit = {"d": "day", "w": "week", "h": "hour", "m": "minute"}.get(m[2], m[2])
    return timedelta(**{f"{unit}s": int(m[1])}) if unit in ("hour", "minute") else timedelta(days=int(m[1]) * _UNITS[unit])


def since(commits: DataFrame, days: int) -> DataFrame:
    """``base``: the last commit before the window (the parent of the oldest in it), else the
    oldest. ``commits``: sha, age."""
    inside, before = F.col("age") <= days, F.col("age") > days
    row = commits.agg(F.max_by(F.when(inside, F.col("sha")), F.when(inside, F.struct("age", (-F.col("sha")).alias("s")))).alias("oldest"), F.min_by(F.when(before, F.col("sha")), F.when(before, F.struct("age", (-F.col("sha")).alias("s")))).alias("parent"))
    return row.select(F.when(F.col("oldest").isNotNull(), F.coalesce("parent", "oldest")).alias("base"))


# ---------------------------------------------------------------- sinks


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def to_cypher(edges: DataFrame) -> DataFrame:
    """``line``: statements that build the graph (src, dst, edge_type)."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(F.concat(F.lit("MERGE (:File {path: "), quoted("n"), F.lit("});")).alias("line"))
    kind = F.upper(F.regexp_replace("edge_type", "[^A-Za-z0-9]+", "_"))
    links = edges.select(F.concat(F.lit("MATCH (a:File {path: "), quoted("src"), F.lit("}), (b:File {path: "), quoted("dst"), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("line")).distinct()
    return nodes.unionByName(links)


def to_graphml(edges: DataFrame) -> DataFrame:
    """``line``: the node and edge elements of a GraphML document."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(F.concat(F.lit('<node id="'), _escaped(F.col("n")), F.lit('"/>')).alias("line"))
    links = edges.select(F.concat(F.lit('<edge source="'), _escaped(F.col("src")), F.lit('" target="'), _escaped(F.col("dst")), F.lit('"><data key="type">'), _escaped(F.col("edge_type")), F.lit("</data></edge>")).alias("line")).distinct()
    return nodes.unionByName(links)


def union_merge(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two canonical artifacts (column line) as one: without conflict markers, blank and
    repeated lines; the order of the sides makes no difference."""
    both = ours.select("line").unionByName(theirs.select("line"))
    return both.where(~F.col("line").rlike(r"^(<{7}|={7}|>{7}|\|{7})") & (F.trim("line") != "")).distinct()


def render(sections: list[tuple[str, str]], kind: str = "markdown") -> str:
    """Titled sections as Markdown, XML or JSON."""
    import json
    from xml.sax.saxutils import escape, quoteattr

    if kind == "markdown":
        return "\n".join(f"## {t}\n\n{body}\n" for t, body in sections)
    if kind == "xml":
        return "<context>\n" + "".join(f"<section title={quoteattr(t)}>{escape(body)}</section>\n" for t, body in sections) + "</context>"
    if kind == "json":
        return json.dumps([{"title": t, "body": body} for t, body in sections], ensure_ascii=False)
    raise ValueError(f"not a format: {kind!r}")
