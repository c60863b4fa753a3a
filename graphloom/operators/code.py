"""The code layer: parsing, import and call resolution, test maps, dead code, schema edges,
bridges, routes, data flow and reading order. Relations come in and go out as DataFrames;
only parsers, and orders that are sequential by definition, run in Python."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import parsing
from graphloom.operators import predicates
from graphloom.operators.lineage import cut


def language(path: Column) -> Column:
    """By file name, then by extension."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ext = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.try_element_at(table(parsing.FILE_NAMES), name), F.try_element_at(table(parsing.EXTENSIONS), F.coalesce(ext, F.lit(""))))


def parse(files: DataFrame) -> DataFrame:
    """``path, language, symbols, imports``; files over 4 MiB are left out."""
    small = files.where(F.octet_length("content") <= 4 << 20).select("path", language(F.col("path")).alias("language"), "content")
    return small.mapInPandas(parsing.parse_batches, parsing.PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", F.inline("symbols"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", F.inline("imports"))


def import_edges(parsed: DataFrame) -> DataFrame:
    """``src, dst``: each import goes to the first of its candidate paths that exists."""
    rows = imports(parsed).where("source <> ''")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    up = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    dotted = F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/")
    base = F.when(up > 1, F.regexp_replace(folder, r"/?[^/]*$", "")).otherwise(folder)
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))
    py = F.when(up > 0, join(base, dotted)).otherwise(dotted)
    rust = F.regexp_replace(F.regexp_replace("source", r"^(crate|super|self)::", ""), "::", "/")
    js = join(folder, F.regexp_replace("source", r"^\./", ""))
    cut = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
    candidates = (
        F.when(F.col("language") == "python", F.array(F.concat(py, F.lit(".py")), F.concat(py, F.lit("/__init__.py")), F.concat(F.lit("src/"), py, F.lit(".py"))))
        .when(F.col("language") == "rust", F.array(*[F.concat(F.lit("src/"), x, F.lit(e)) for x in (rust, cut(rust)) for e in (".rs", "/mod.rs")]))
        .otherwise(F.array(*[F.concat(js, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")]))
    )
    tried = rows.select("path", "ord", F.posexplode(candidates).alias("priority", "dst"))
    hit = tried.join(parsed.select(F.col("path").alias("dst")), "dst").where("dst <> path")
    return hit.groupBy("path", "ord").agg(F.min_by("dst", "priority").alias("dst")).select(F.col("path").alias("src"), "dst").distinct()


#: Words before a bracket that are no calls; fixed values.
KEYWORDS = "if for while switch match return def fn func function class catch print elif with assert not and or in is lambda".split()


def call_edges(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """``caller_path, caller, callee, callee_path, confidence``: local symbols first, then
    those of imported files, both exact; then the first other file that has the name,
    approximately; else unresolved with a null path."""
    syms = symbols(parsed).where("kind in ('function', 'method')")
    sites = syms.select(F.col("path").alias("caller_path"), F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    sites = sites.where(~F.col("callee").isin(KEYWORDS) & (F.col("callee") != F.col("caller")))
    names = symbols(parsed).where("kind in ('function', 'method', 'class', 'struct')").select(F.col("path").alias("p"), F.col("name").alias("callee"), "visibility").distinct()
    linked = edges.select(F.col("src").alias("caller_path"), F.col("dst").alias("p"), F.lit(True).alias("linked"))
    found = sites.join(names, "callee", "left").join(linked, ["caller_path", "p"], "left")
    tier = F.when(F.col("p") == F.col("caller_path"), 0).when(F.col("linked") & (F.col("visibility") == "public"), 1).when((F.col("visibility") == "public"), 2)
    best = found.withColumn("tier", tier).groupBy("caller_path", "caller", "callee").agg(F.min(F.when(F.col("tier").isNotNull(), F.struct("tier", "p"))).alias("b"))
    return best.select("caller_path", "caller", "callee", F.col("b.p").alias("callee_path"), F.when(F.col("b").isNull(), "unresolved").when(F.col("b.tier") < 2, "exact").otherwise("approximate").alias("confidence"))


def is_test(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(^|/)tests?/") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"[_.](test|spec)\.[a-z]+$")


def test_map(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, test, confidence``: by name, by import, or both."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[a-z]+$", ""), r"^test_|[_.](test|spec)$", "")
    named = files.select("path", stem.alias("stem"), is_test(F.col("path")).alias("is_test"))
    a, b = named.where("not is_test").select(F.col("path").alias("source"), "stem"), named.where("is_test").select(F.col("path").alias("test"), "stem")
    by_name = a.join(b, "stem").select("source", "test", F.lit(True).alias("n"))
    by_import = edges.where(is_test(F.col("src")) & ~is_test(F.col("dst"))).select(F.col("dst").alias("source"), F.col("src").alias("test"), F.lit(True).alias("i")).distinct()
    return by_name.join(by_import, ["source", "test"], "full").select("source", "test", F.when(F.col("n") & F.col("i"), "both").when(F.col("n"), "name_match").otherwise("import_match").alias("confidence"))


def dead_code(parsed: DataFrame, calls: DataFrame, tests: DataFrame, rank: DataFrame) -> DataFrame:
    """Functions that nothing calls, that are no entry points and no tests; liveness is
    PageRank times tests + 1, doubled where public."""
    syms = symbols(parsed).where("kind in ('function', 'method')").where(~is_test(F.col("path")) & ~F.col("name").isin("main", "__init__", "new", "default") & ~F.col("name").rlike("^(test_|__)"))
    called = calls.where("callee_path is not null").select(F.col("callee_path").alias("path"), F.col("callee").alias("name")).distinct()
    n = tests.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_tests"))
    left = syms.join(called, ["path", "name"], "left_anti").join(n, "path", "left").join(rank.withColumnRenamed("node", "path"), "path", "left")
    live = F.coalesce("score", F.lit(0.0)) * (1 + F.coalesce("n_tests", F.lit(0))) * F.when(F.col("visibility") == "public", 2).otherwise(1)
    return left.select("path", "name", "visibility", "start_line", F.round(live, 6).alias("liveness"))


COLUMNS = "path string, tab string, ord int, col string, type string, nullable boolean, dflt string, fk_table string, fk_column string, in_key boolean"


def db_columns(files: DataFrame) -> DataFrame:
    """Columns of the CREATE TABLE statements in SQL files."""

    def run(batches):
        for b in batches:
            rows = [(p, *c) for p, t in zip(b["path"], b["content"], strict=True) for c in parsing.table_columns(t or "")]
            yield pd.DataFrame(rows, columns=["path", "tab", "ord", "col", "type", "nullable", "dflt", "fk_table", "fk_column", "in_key"])

    return files.where(language(F.col("path")) == "sql").select("path", "content").mapInPandas(run, COLUMNS)


def foreign_key_edges(columns: DataFrame) -> DataFrame:
    tables = columns.select(F.col("tab").alias("fk_table"), F.col("path").alias("dst")).distinct()
    return columns.join(tables, "fk_table").where("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("foreign_key").alias("edge_type")).distinct()


def embedded_sql_edges(files: DataFrame, columns: DataFrame) -> DataFrame:
    """Code that names a known table behind FROM, JOIN, INTO or UPDATE."""
    used = files.where(language(F.col("path")) != "sql").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_]\w*)"), F.lit(1))).alias("t"))
    tables = columns.select(F.col("tab").alias("t"), F.col("path").alias("dst")).distinct()
    return used.withColumn("t", F.lower("t")).join(tables, "t").select(F.col("path").alias("src"), "dst", F.lit("embedded_sql").alias("edge_type")).distinct()


#: framework and pattern (method, path) of routes; fixed values.
ROUTES = {"flask": r"@\w+\.(get|post|put|delete|route)\(\s*['\"]([^'\"]+)", "express": r"(?<!@)\b(?:app|router)\.(get|post|put|delete)\(\s*['\"]([^'\"]+)"}


def routes(files: DataFrame) -> DataFrame:
    """``path, framework, method, route`` with parameters written alike."""
    out = None
    for name, pattern in ROUTES.items():
        hit = files.select("path", F.lit(name).alias("framework"), F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("r")).alias("z")).select("path", "framework", F.inline("z"))
        out = hit if out is None else out.unionByName(hit)
    return out.select("path", "framework", F.upper("m").alias("method"), normal_route(F.col("r")).alias("route")).distinct()


def normal_route(r: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(r, r"https?://[^/]+", ""), r"<[^>]*>|:\w+|\{[^}]*\}|\$\{[^}]*\}", "{}"), r"(?<=.)/$", "")


def http_bridges(files: DataFrame) -> DataFrame:
    """Calls of clients to the routes of other files."""
    calls = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?:fetch|axios\.\w+|requests\.\w+)\(\s*['\"`]([^'\"`]+)"), F.lit(1))).alias("url"))
    served = routes(files).select(F.col("path").alias("dst"), "route").distinct()
    return calls.withColumn("route", normal_route(F.col("url"))).join(served, "route").where("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("cross_language:HttpCall").alias("edge_type")).distinct()


def containing_symbol(lines: DataFrame, syms: DataFrame) -> DataFrame:
    """The first symbol whose lines hold each line (``path, line``), else the module."""
    s = syms.select("path", "ord", "name", "start_line", "end_line")
    hit = lines.join(s, (lines.path == s.path) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    return hit.groupBy(lines.path, "line").agg(F.coalesce(F.min_by("name", "ord"), F.lit("<module>")).alias("symbol"))


def data_flow(calls: DataFrame, start: str, most: int = 10) -> DataFrame:
    """``nodes, truncated``: simple paths of calls from a symbol, at most ``most`` nodes; each
    round extends the open paths by a join."""
    pairs = cut(calls.where("callee_path is not null").select(F.concat_ws("::", "caller_path", "caller").alias("a"), F.concat_ws("::", "callee_path", "callee").alias("b")).distinct())
    now = pairs.where(F.element_at(F.split("a", "::"), -1) == start).select(F.array("a").alias("nodes")).distinct()
    done = now.limit(0).withColumn("truncated", F.lit(True))
    for _ in range(most - 1):
        step = cut(now.join(pairs, F.element_at("nodes", -1) == F.col("a"), "left").withColumn("cyclic", F.array_contains("nodes", F.col("b"))))
        if not step.limit(1).count():
            break
        done = done.unionByName(step.where("b is null or cyclic").select("nodes", F.coalesce("cyclic", F.lit(False)).alias("truncated")).distinct())
        now = step.where("b is not null and not cyclic").select(F.concat("nodes", F.array("b")).alias("nodes"))
    return done.unionByName(now.withColumn("truncated", F.lit(True))).distinct()


def reading_order(edges: DataFrame, files: DataFrame, phase: int = 9) -> DataFrame:
    """``pos, path, phase``: dependencies first, ties by path, cycles behind. The order is
    sequential by definition; it runs in one task over paths and edges alone."""
    both = files.select("path", F.lit(None).cast("string").alias("dep")).unionByName(edges.select(F.col("src").alias("path"), F.col("dst").alias("dep")).distinct())

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        needs = {p: set() for p in rows["path"]}
        for p, d in zip(rows["path"], rows["dep"], strict=True):
            if d in needs and d != p:
                needs[p].add(d)
        users: dict[str, list[str]] = {p: [] for p in needs}
        for p, ds in needs.items():
            for d in ds:
                users[d].append(p)
        open_ = {p: len(d) for p, d in needs.items()}
        todo, out = deque(sorted(p for p, n in open_.items() if not n)), []
        while todo:
            p = todo.popleft()
            out.append(p)
            free = []
            for u in users[p]:
                open_[u] -= 1
                if not open_[u]:
                    free.append(u)
            todo.extend(sorted(free))
        out += sorted(set(needs) - set(out))
        return pd.DataFrame({"pos": range(len(out)), "path": out, "phase": [i // phase for i in range(len(out))]})

    return both.groupBy(F.lit(0).alias("g")).applyInPandas(lambda rows: order(rows), "pos long, path string, phase long")


def function_density(parsed: DataFrame) -> DataFrame:
    """Functions, public share and mean length by language."""
    f = symbols(parsed).where("kind in ('function', 'method')")
    return f.groupBy("language").agg(F.count("*").alias("functions"), F.round(F.avg((F.col("visibility") == "public").cast("double")), 6).alias("public_share"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 6).alias("mean_lines"))


def noise(files: DataFrame) -> DataFrame:
    """``path, reason`` for every file: on the block list, generated, or null to keep."""
    return files.select("path", F.coalesce(predicates.noise_reason(F.col("path")), F.when(predicates.generated(F.col("content")), "generated_file")).alias("reason"))


def filter_noise(scored: DataFrame, files: DataFrame, symbols: DataFrame, rank: DataFrame, floor: float = 0.15, alike: float = 0.8) -> DataFrame:
    """``path, score, reason``: why a candidate (path, score) goes, null for those that stay. In
    turn: the block list and generated files; files whose sets of symbol names are alike
    (Jaccard over ``alike``) to one of a higher score, then rank, then smaller path, that
    itself stays; scores under ``floor``. The similar pairs come from an inverted index; who
    stays is settled in rounds along the order of preference, each of which decides at least
    the best undecided of every group."""
    from graphloom.operators import retrieval

    rows = scored.join(files.select("path", "content"), "path", "left").join(rank.select(F.col("node").alias("path"), F.col("score").alias("pr")), "path", "left")
    rows = rows.select("path", "score", F.coalesce("pr", F.lit(0.0)).alias("pr"), F.coalesce(predicates.noise_reason(F.col("path")), F.when(predicates.generated(F.coalesce("content", F.lit(""))), "generated_file")).alias("reason"))
    rows = cut(rows)
    left = rows.where("reason is null")
    names = symbols.where("name is not null").join(left.select("path"), "path", "left_semi").groupBy("path").agg(F.collect_set(F.xxhash64("name")).alias("terms"))
    pairs = retrieval.similar_pairs(names, alike)
    order = lambda df, c, pre: df.join(left.select(F.col("path").alias(c), F.struct((-F.col("score")).alias("s"), (-F.col("pr")).alias("r"), F.col("path").alias("p")).alias(pre)), c)
    ranked = order(order(pairs.select("p", "q"), "p", "op"), "q", "oq")
    better = cut(ranked.select(F.when(F.col("op") < F.col("oq"), F.col("p")).otherwise(F.col("q")).alias("better"), F.when(F.col("op") < F.col("oq"), F.col("q")).otherwise(F.col("p")).alias("worse"), F.least("op", "oq").alias("o")))
    gone, stays = None, None
    open_ = better
    while open_.limit(1).count():
        # those that nobody open is better than stay; what is alike to them goes
        sure = open_.select(F.col("better").alias("path")).distinct().join(open_.select(F.col("worse").alias("path")).distinct(), "path", "left_anti")
        hit = open_.join(sure.select(F.col("path").alias("better")), "better", "left_semi").groupBy(F.col("worse").alias("path")).agg(F.min_by("better", "o").alias("kept"))
        hit = cut(hit)
        gone = hit if gone is None else gone.unionByName(hit)
        names = hit.select("path")
        open_ = cut(open_.join(names.withColumnRenamed("path", "worse"), "worse", "left_anti").join(names.withColumnRenamed("path", "better"), "better", "left_anti"))
    if gone is None:
        return rows.select("path", "score", F.coalesce("reason", F.when(F.col("score") < floor, "below_relevance_floor")).alias("reason"))
    rows = rows.join(gone, "path", "left")
    return rows.select("path", "score", F.coalesce("reason", F.when(F.col("kept").isNotNull(), F.concat(F.lit("similar_to: "), F.col("kept"))), F.when(F.col("score") < floor, "below_relevance_floor")).alias("reason"))


def canonical(edges: DataFrame) -> DataFrame:
    """The edge list as sorted, distinct lines; the union of two such lists is one too."""
    return edges.select(F.concat_ws("\t", "src", "dst", "edge_type").alias("line")).distinct().orderBy("line")


def rank_by_churn(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(limit)
