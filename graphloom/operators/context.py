"""Context for a task: which files, at which detail, within a budget; traces and references."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import code, packing, signals
from graphloom.operators import predicates as P
from graphloom.operators.lineage import cut, written

#: Extensions and folders by which a task mentions files; fixed values.
MENTION = re.compile(r"\b[\w/.-]+\.(?:rs|ts|js|py|go|java|rb|c|cpp|h|cs|swift|kt)\b|\b(?:src|lib|tests?|spec|app|pkg)/[\w/.-]+\b")
DEPENDENCY_SCORE, TRACE_SHARES = 0.5, (0.5, 0.25, 0.125)


def references(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """``path, defines``: files that define a name or hold it as a whole token."""
    token = rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(name)}([^\p{{L}}\p{{N}}_]|$)"
    uses = files.where(F.col("content").rlike(token)).select("path", F.lit(False).alias("d"))
    defined = symbols.where(F.col("name") == name).select("path", F.lit(True).alias("d"))
    return uses.unionByName(defined).groupBy("path").agg(F.max("d").alias("defines"))


def search(files: DataFrame, symbols: DataFrame, rank: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """``path, name, kind, start_line, score``: symbols that equal, begin with or contain the
    target (3, 2, 1), or, if there are none at all, files that hold it (0.5), each with half its
    file's PageRank on top; in a total order."""
    n, t = F.lower("name"), target.lower()
    tier = F.when(n == t, 3.0).when(n.startswith(t), 2.0).when(n.contains(t), 1.0)
    hits = symbols.withColumn("tier", tier).where("tier is not null").select("path", "name", "kind", "start_line", "tier")
    none = hits.limit(1).agg((F.count("*") == 0).alias("none"))
    held = files.where(F.lower("content").contains(t)).crossJoin(F.broadcast(none)).where("none")  # a row of one
    found = hits.unionByName(held.select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start_line"), F.lit(0.5).alias("tier")))
    scored = found.join(rank.withColumnRenamed("node", "path"), "path", "left").withColumn("score", F.col("tier") + 0.5 * F.coalesce("score", F.lit(0.0)))
    return scored.select("path", "name", "kind", "start_line", "score").orderBy(F.desc("score"), "path", F.asc_nulls_first("name"), "start_line", "kind").limit(limit)


def trace(files: DataFrame, symbols: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """``path, hops, share``: files that define a name (any case), else files that hold it, and
    their neighbours; each level gets a smaller share of the budget."""
    defined = symbols.where(F.lower("name") == target.lower()).select("path").distinct()
    none = defined.limit(1).agg((F.count("*") == 0).alias("none"))
    held = files.where(F.lower("content").contains(target.lower())).crossJoin(F.broadcast(none)).where("none").select("path")  # a row of one
    seeds = defined.unionByName(held).distinct()
    both = edges.select(F.col("src").alias("path"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("path"), F.col("src").alias("to")))
    near = seeds.join(both, "path").select(F.col("to").alias("path")).distinct().join(seeds, "path", "left_anti").join(files.select("path"), "path", "left_semi")
    return seeds.select("path", F.lit(0).alias("hops"), F.lit(TRACE_SHARES[0]).alias("share")).unionByName(near.select("path", F.lit(1).alias("hops"), F.lit(TRACE_SHARES[1]).alias("share")))


def palette(files: DataFrame, symbols: DataFrame, most: int = 20_000, quota: dict[str, float] | None = None) -> DataFrame:
    """``kind, label, path`` of a search palette: files and symbols by name, each kind up to its
    share of the entries, which is the feature. Tasks keep no more than that of a kind, so no task reads a kind as a whole."""
    quota = quota or {"file": 0.3, "symbol": 0.7}
    of = lambda kind, rows: rows.orderBy("label", "path").limit(int(most * quota[kind])).select(F.lit(kind).alias("kind"), "label", "path")
    return of("file", files.select(F.col("path").alias("label"), "path")).unionByName(of("symbol", symbols.select(F.col("name").alias("label"), "path").distinct()))


def pack_context(files: DataFrame, edges: DataFrame, wanted: list[str], budget: int, dependencies: bool = False, tests: bool = True) -> tuple[DataFrame, list[str]]:
    """(packed files, wanted paths that there aren't): the named files at score 1, with their
    dependencies at 0.5 if asked for, filled into the budget."""
    names = [P.normal_path(w) for w in wanted]
    spark = files.sparkSession
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "path string")
    found = files.join(F.broadcast(asked), "path", "left_semi")
    missing = [r.path for r in asked.join(files.select("path"), "path", "left_anti").collect()]  # of what the caller named
    rows = found.select("path", F.lit(1.0).alias("score"), "content")
    if dependencies:
        deps = edges.join(F.broadcast(asked.withColumnRenamed("path", "src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct().join(asked, "path", "left_anti")
        rows = rows.unionByName(files.join(deps, "path", "left_semi").select("path", F.lit(DEPENDENCY_SCORE).alias("score"), "content"))
    if not tests:
        rows = rows.where(~P.test_for_blast(F.col("path")))
    return packing.fill(rows.withColumn("g", F.lit(0)), "g", budget).drop("g"), missing


def mentions(task: str) -> list[str]:
    """Paths that a task names."""
    return list(dict.fromkeys(MENTION.findall(task)))


def context(files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame, tests: DataFrame, last_change: DataFrame, rank: DataFrame, task: str, budget: int = 50_000, focus: str | None = None, include_tests: bool = True, expand: dict[str, list[str]] | None = None, proximity: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """``section, path, score, tokens, level``: the files for a task: score all, seeds with
    their neighbours, the noise pipeline, the focus, then their tests; files are packed
    first, tests into what is left. ``names`` (key, path): edges are of keys; ``proximity``: that signal, where the caller has it."""
    words = signals.expand(signals.query_tokens(task), expand or {})
    scored = written(signals.score_all(files, symbols, imports, last_change, rank, words, proximity=proximity).select("path", "score"))
    chosen = cut(signals.seeds(scored, edges, names=names).select("path", "score"))
    # bounded: ``signals.SEEDS`` rows travel to the relations, which stay where they are
    seeds = F.broadcast(chosen.select("path"))
    near = rank.join(seeds.withColumnRenamed("path", "node"), "node", "left_semi")
    noise = code.filter_noise(chosen, files.join(seeds, "path", "left_semi"), cut(symbols.join(seeds, "path", "left_semi")), near)
    kept = F.broadcast(cut(noise.where("reason is null").select("path", "score")))
    if focus:
        kept = kept.where(P.focused(F.col("path"), focus))
    targets = files.select("path", "content").join(kept, "path").select(F.lit(0).alias("part"), "path", "score", "content")
    rows = targets
    if include_tests:
        mapped = tests.select(F.col("source").alias("path"), "test").join(kept, "path").select(F.col("test").alias("path"))
        own = files.join(kept, "path").where(P.inline_tests(F.col("language"), F.col("content"))).select("path")
        more = cut(mapped.unionByName(own).distinct())
        more = files.select("path", "content").join(F.broadcast(more) if more.limit(signals.FEW + 1).count() <= signals.FEW else more, "path")
        rows = rows.unionByName(more.select(F.lit(1).alias("part"), "path", F.lit(0.0).alias("score"), "content"))
    # tests come behind all files: their order is below that of any score
    ordered = rows.select(F.lit(0).alias("g"), F.concat(F.col("part").cast("string"), F.lit(":"), "path").alias("path"), (F.col("score") - 10.0 * F.col("part")).alias("score"), "content")
    packed = packing.fill(ordered, "g", budget)
    part = F.substring("path", 1, 1) == "1"
    return packed.select(F.when(part, "tests").otherwise("files").alias("section"), F.substring("path", 3, 1 << 20).alias("path"), F.when(part, 0.0).otherwise(F.col("score")).alias("score"), "tokens", "level")


def embedding_inputs(symbols: DataFrame, files: DataFrame, most: int = 8) -> DataFrame:
    """``path, header``: what a file is embedded by: its path, language and first public
    symbols in order of name."""
    public = symbols.where("visibility = 'public'").groupBy("path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most), ", ").alias("names"))
    return files.join(public, "path").select("path", F.concat_ws(" | ", "path", "language", "names").alias("header"))


def data_summary(columns: DataFrame, views: DataFrame, models: DataFrame, chains: DataFrame) -> DataFrame:
    """``kind, name, detail`` of the data layer."""
    tables = columns.groupBy("tab").agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.col("tab").alias("name"), F.concat(F.col("n").cast("string"), F.lit(" columns")).alias("detail"))
    seen = views.groupBy("kind", "name").agg(F.array_join(F.array_sort(F.collect_set("tab")), ", ").alias("detail")).select("kind", "name", "detail")
    mapped = models.select(F.lit("model").alias("kind"), F.col("class").alias("name"), F.concat_ws(" -> ", "framework", "tab").alias("detail"))
    moved = chains.groupBy("directory", "framework").agg(F.count("*").alias("n")).select(F.lit("migrations").alias("kind"), F.col("directory").alias("name"), F.concat_ws(" ", "framework", F.col("n").cast("string")).alias("detail"))
    return tables.unionByName(seen).unionByName(mapped).unionByName(moved)
