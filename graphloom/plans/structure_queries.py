"""Queries over the structure of the code base: orders, drawings, radii, intervals, selections, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import blast, flow, graphs, history, intervals, layout, order, packing, retrieval, scan, treemap, verify
from graphloom.operators.lineage import written
from graphloom.plans.queries import query
from graphloom.sources import codebase as cb
from graphloom.sources.tables import table

CODE = cb.CODE
SHORT = f"{CODE}, {cb.SQL['sh']}"


def _files(spark, d):
    return cb.files(spark, d)


# ---------------------------------------------------------------- orders and drawings; tests hold them against a queue and loops


@query()
def reading_order(spark, d):
    return order.reading_order(cb.short_imports(spark, d), _files(spark, d))


@query()
def onboarding_map(spark, d):
    edges, files = written(cb.short_imports(spark, d)), written(_files(spark, d).select("path", "tokens"))
    symbols = cb.symbols(spark, d).where("visibility = 'public'").select("path", "name", F.col("start_line").alias("ord"))
    return order.phases(order.reading_order(edges, files), edges, files, graphs.pagerank(edges), symbols)


@query()
def graph_layout(spark, d):
    """Imports from orders of two lines: chains of some ten files."""
    edges = cb.short_imports(spark, d, 2).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return layout.layout(_files(spark, d).select(F.col("path").alias("id")), edges).nodes.drop("graph", "members")


@query()
def file_layouts(spark, d):
    """A drawing of each folder, nine nodes a layer at most; files are as wide and high as their tokens say."""
    files = _files(spark, d).select("dir", "path", F.log(F.col("tokens") + 1).alias("size"))
    scale = F.least(F.col("size") / F.greatest("most", F.lit(1e-6)), F.lit(1.0))
    sized = files.join(files.groupBy("dir").agg(F.max("size").alias("most")), "dir")
    nodes = sized.select(F.col("dir").alias("graph"), F.col("path").alias("id"), (layout.WIDTH * (0.7 + 0.7 * scale)).alias("width"), (layout.HEIGHT * (0.9 + 0.3 * scale)).alias("height"))
    edges = cb.imports(spark, d, inside=True).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return layout.layout(nodes, edges, layout.LAYER_LIMIT).nodes.withColumn("members", F.size(F.coalesce("members", F.array())))


# ---------------------------------------------------------------- radii

_RISK = "1.0 / (hops + 1.0) * w * coalesce(score, 0.0) * CASE WHEN tested THEN 1.0 ELSE 1.2 END"
_KIND = "(ends_with(n, 'test') OR ends_with(n, 'spec') OR contains(n, '_test.') OR contains(n, '_spec.') OR starts_with(n, 'test_') OR contains(n, '.test.') OR contains(n, '.spec.') OR list_has_any(string_split(lower(path), '/'), ['tests', 'test', 'spec', '__tests__']))"
#: The imports with types by the first letter of the importing file's name, so that all weights occur.
_TYPE = "CASE ascii(split_part(src, '/', -1)) % 5 WHEN 0 THEN 'foreign_key' WHEN 1 THEN 'embedded_sql' WHEN 2 THEN 'migration_sequence' WHEN 3 THEN 'cross_language:HttpCall' ELSE 'import' END"


def _level(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT path FROM l{j}" for j in range(k))
    return f"l{k} AS (SELECT path, {k} AS hops, row_number() OVER (ORDER BY t, path) AS turn FROM (SELECT src AS path, min(turn) AS t FROM ty JOIN l{k - 1} ON dst = path WHERE src NOT IN ({seen}) GROUP BY 1))"


@query(
    f"""WITH {CODE}, ty AS (SELECT src, dst, {_TYPE} AS edge_type FROM im), rk AS (SELECT path, count(*) AS n FROM im JOIN fl ON dst = path GROUP BY 1), sc AS (SELECT path, n / (SELECT max(n) FROM rk)::DOUBLE AS score FROM rk),
    l0 AS (SELECT path, 0 AS hops, row_number() OVER (ORDER BY path) AS turn FROM fl WHERE key % 50 = 0), {_level(1)}, {_level(2)}, al AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
    wy AS (SELECT v.path, u.hops + 1 AS hops, u.turn, edge_type, CASE edge_type WHEN 'import' THEN 1.0 WHEN 'foreign_key' THEN 1.0 WHEN 'embedded_sql' THEN 0.8 ELSE 0.5 END AS w, score, v.path IN (SELECT test FROM tm) AS tested,
      v.path IN (SELECT test FROM tm WHERE source IN (SELECT path FROM l0)) AS covers FROM ty JOIN al u ON dst = u.path JOIN al v ON src = v.path LEFT JOIN sc ON sc.path = v.path WHERE v.hops > 0 AND u.hops < 2 AND (u.hops < v.hops OR (u.hops = v.hops AND u.turn < v.turn))),
    bs AS (SELECT *, {_RISK} AS risk, row_number() OVER (PARTITION BY path ORDER BY {_RISK} DESC, hops, turn) AS k, lower(split_part(path, '/', -1)) AS n FROM wy)
    SELECT path, edge_type, hops, round(risk, 9) AS risk, CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level,
    CASE WHEN {_KIND} AND covers THEN 'test' WHEN hops = 1 THEN 'direct' WHEN edge_type IN ('foreign_key', 'embedded_sql') THEN 'schema' ELSE 'transitive' END AS kind FROM bs WHERE k = 1"""
)
def blast_radius(spark, d):
    """Two hops around all files whose key 50 divides; the share of the most imported file's imports stands for the rank."""
    edges = written(cb.imports(spark, d))
    first = F.ascii(F.element_at(F.split("src", "/"), -1)) % 5
    typed = edges.withColumn("edge_type", F.when(first == 0, "foreign_key").when(first == 1, "embedded_sql").when(first == 2, "migration_sequence").when(first == 3, "cross_language:HttpCall").otherwise("import"))
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    rank = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select("node", (F.col("n") / F.col("most")).alias("score"))  # a row of one
    seeds = _files(spark, d).where("key % 50 = 0").select("path")
    return blast.radius(typed, seeds, rank, cb.test_map(spark, d), 2).select("path", "edge_type", "hops", F.round("risk", 9).alias("risk"), "level", "kind")


@query(
    f"""WITH RECURSIVE {SHORT}, nd AS (SELECT src AS node FROM sh UNION SELECT dst FROM sh), r AS (SELECT node, node AS who, 0 AS k FROM nd UNION SELECT r.node, src, k + 1 FROM r JOIN sh ON dst = who WHERE k < 3)
    SELECT node, count(DISTINCT who) - 1 AS reached FROM r GROUP BY node"""
)
def reach_counts(spark, d):
    return graphs.reach_counts(cb.short_imports(spark, d), 3)


@query(
    f"""WITH {CODE}, dg AS (SELECT dst AS path, count(*) AS dependents FROM im GROUP BY 1), t AS (SELECT max(dependents) AS m FROM dg),
    en AS (SELECT path, coalesce(dependents, 0) AS dependents, round(coalesce(dependents, 0) / m::DOUBLE, 6) AS risk FROM fl LEFT JOIN dg USING (path), t),
    f AS (SELECT 'file' AS kind, path AS id, CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(string_split(path, '/')[:2], '/') WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'other' END AS parent, split_part(path, '/', -1) AS label,
      greatest(dependents::DOUBLE, 1.0) AS area, risk, 0::BIGINT AS children FROM en),
    m AS (SELECT parent, sum(area) AS area, max(risk) AS most, count(*) AS children FROM f GROUP BY 1),
    a AS (SELECT kind, id, parent, label, area, risk AS most, risk, children FROM f UNION ALL SELECT 'module', parent, 'root', parent, area, most, 0.0, children FROM m UNION ALL SELECT 'root', 'root', NULL, 'Repository', sum(area), max(most), 0.0, count(*) FROM m)
    SELECT kind, id, parent, label, area, CASE WHEN most >= 0.7 THEN 'high' WHEN most >= 0.4 THEN 'medium' ELSE 'low' END AS severity, risk, children FROM a"""
)
def risk_treemap(spark, d):
    """The share of the most imported file's dependents stands for the risk."""
    counts = cb.imports(spark, d).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    most = F.broadcast(counts.agg(F.max("dependents").alias("m")))  # a row of one
    entries = _files(spark, d).select("path").join(counts, "path", "left").crossJoin(most).withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return treemap.treemap(entries.select("path", F.round(F.col("dependents") / F.col("m"), 6).alias("risk"), F.lit(0.0).alias("percentile"), "dependents")).drop("percentile")


# ---------------------------------------------------------------- intervals

#: What a supplier delivers of a part is a symbol from its number on, over ten lines for each line of an order; every delivery changes a line.
_SPANS = "sp AS (SELECT path, name, start_line AS first, start_line + 10 * length(name) AS last, start_line AS ord FROM sy), ln AS (SELECT DISTINCT path, l_suppkey + l_linenumber * 3 AS line FROM lineitem JOIN fl ON l_partkey = key)"


def _spans(spark, d):
    return cb.symbols(spark, d).select("path", "name", F.col("start_line").alias("first"), (F.col("start_line") + 10 * F.length("name")).alias("last"), F.col("start_line").alias("ord"))


def _lines(spark, d):
    changed = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_suppkey") + F.col("l_linenumber") * 3).alias("line")).distinct()
    return changed.join(_files(spark, d).select("key", "path"), "key").select("path", "line")


@query(f"WITH {CODE}, {_SPANS} SELECT ln.path, line, coalesce(arg_min(name, lpad(CAST(ord AS VARCHAR), 12, '0') || name), '<module>') AS name FROM ln LEFT JOIN sp ON ln.path = sp.path AND line BETWEEN first AND last GROUP BY 1, 2")
def symbols_of_lines(spark, d):
    return intervals.first_holding(_lines(spark, d), _spans(spark, d), "path", "line", "<module>")


@query(f"WITH {CODE}, {_SPANS} SELECT path, name, first, last FROM sp WHERE EXISTS (SELECT 1 FROM ln WHERE ln.path = sp.path AND line % 2 = 0 AND line BETWEEN first AND last)")
def touched_symbols(spark, d):
    """Symbols with a changed line of an even number."""
    return intervals.touched(_spans(spark, d), _lines(spark, d).where("line % 2 = 0"), "path", "line").select("path", "name", "first", "last")


# ---------------------------------------------------------------- selections, search, trees

_LEVEL = "list_position(['full', 'trimmed', 'documented', 'signature', 'stub'], level)"


@query(
    f"""WITH {CODE}, s AS (SELECT dir, path, key % 3 = 0 AS selected, (key % 97) / 97.0 AS priority, [tokens, tokens * 3 // 4, tokens // 2, tokens // 4, tokens // 10] AS t FROM fl),
    st AS (SELECT dir, path, CASE WHEN selected THEN 2 ELSE 1 END AS phase, priority, k AS level, t[k + 1] - t[k] AS delta FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE NOT selected OR k <= 2 UNION ALL SELECT dir, path, 3, priority, 5, -t[5] FROM s WHERE NOT selected),
    rn AS (SELECT *, sum(delta) OVER (PARTITION BY dir ORDER BY phase, priority, path, level) AS less, row_number() OVER (PARTITION BY dir ORDER BY phase, priority, path, level) AS i FROM st),
    wh AS (SELECT dir, sum(t[1]) AS whole FROM s GROUP BY 1), sp AS (SELECT dir, min(i) AS stop FROM rn JOIN wh USING (dir) WHERE whole + less <= 2000 GROUP BY 1),
    hd AS (SELECT rn.dir, path, max(level) AS level FROM rn JOIN wh USING (dir) LEFT JOIN sp USING (dir) WHERE whole > 2000 AND i <= coalesce(stop, i) GROUP BY 1, 2)
    SELECT dir, path, ['full', 'trimmed', 'documented', 'signature', 'stub'][least(coalesce(level, 0), 4) + 1] AS level, CASE WHEN level = 5 THEN 0 ELSE t[least(coalesce(level, 0), 4) + 1] END AS tokens FROM s LEFT JOIN hd USING (dir, path)"""
)
def degraded_selections(spark, d):
    """Each folder is a selection with a budget of 2000 tokens."""
    t = F.col("tokens")
    files = _files(spark, d).select("dir", "path", (F.col("key") % 3 == 0).alias("selected"), ((F.col("key") % 97) / 97.0).alias("priority"), F.array(t, F.floor(t * 3 / 4), F.floor(t / 2), F.floor(t / 4), F.floor(t / 10)).alias("tokens"))
    return packing.degraded(files, "dir", 2000)


@query(
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), s AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.vec, v.vec), 4) AS similarity FROM v q JOIN v ON q.id % 50 = 0),
    r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank, id, similarity FROM s) SELECT query, rank, id, similarity FROM r WHERE rank <= 20"""
)
def embedding_topk_batch(spark, d):
    """Every vector whose id 50 divides, against all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.cosine_batch(e, e.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), 20)


def _tree_sql() -> str:
    levels = [f"t{scan.DEPTH} AS (SELECT left(sha256(path), {scan.DEPTH}) AS prefix, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS hash FROM h GROUP BY 1)"]
    for k in range(scan.DEPTH - 1, -1, -1):
        levels.append(f"t{k} AS (SELECT left(prefix, {k}) AS prefix, sha256(string_agg(substr(prefix, {k + 1}, 1) || ':' || hash, chr(10) ORDER BY prefix)) AS hash FROM t{k + 1} GROUP BY 1)")
    return ", ".join(levels)


@query(f"WITH {CODE}, h AS (SELECT path, sha256(content) AS hash FROM fl), {_tree_sql()} SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2")
def fingerprint_tree(spark, d):
    """The tree of an older state (files with a key that 7 divides are missing, those that 11 divides differ), after the edit."""
    now = written(_files(spark, d).select("key", "path", F.sha2("content", 256).alias("hash")))
    before = now.where("key % 7 <> 0").select("path", F.when(F.col("key") % 11 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    gone = spark.createDataFrame([("src/gone.rs", "x")], "path string, hash string")
    before = written(before.unionByName(gone))
    changed = now.where("key % 7 = 0 or key % 11 = 0").select("path", "hash")
    return scan.update_tree(scan.hash_tree(before), before, changed, gone.select("path")).where(F.length("prefix") <= 2)


_STYLE = "CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'SCREAMING_SNAKE_CASE' WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake_case' WHEN regexp_full_match(name, '[A-Z][A-Za-z0-9]*') THEN 'PascalCase' WHEN regexp_full_match(name, '[a-z][A-Za-z0-9]*') THEN 'camelCase' ELSE 'unknown' END"
_MESSAGE = "kind || ' ' || chr(39) || name || chr(39) || ' uses ' || style || ' but convention is ' || dominant"


@query(
    f"""WITH {CODE}, {_SPANS}, nm AS (SELECT CASE kind WHEN 'function' THEN 'Function' ELSE 'Type' END AS kind, {_STYLE} AS style FROM sy WHERE kind IN ('function', 'struct')), nc AS (SELECT kind, style, count(*) AS n FROM nm GROUP BY 1, 2),
    rl AS (SELECT kind, arg_max(style, n) AS dominant, max(n) AS n, sum(n) AS total FROM nc GROUP BY 1), rs AS (SELECT *, CASE WHEN n * 100.0 / total >= 90 THEN 'high' WHEN n * 100.0 / total >= 70 THEN 'medium' ELSE 'low' END AS severity FROM rl WHERE n * 100.0 / total >= 50),
    th AS (SELECT path, name, start_line AS line, CASE kind WHEN 'function' THEN 'Function' ELSE 'Type' END AS kind, {_STYLE} AS style FROM sy WHERE kind IN ('function', 'struct') AND EXISTS (SELECT 1 FROM ln WHERE ln.path = sy.path AND line BETWEEN start_line AND start_line + 10 * length(name)))
    SELECT path, line, 'naming' AS category, severity, {_MESSAGE} AS message FROM th JOIN rs USING (kind) WHERE style <> dominant"""
)
def verify_changes(spark, d):
    """Names of functions and types on changed lines, against those of most."""
    symbols = written(cb.symbols(spark, d).withColumn("end_line", F.col("start_line") + 10 * F.length("name")))
    found = verify.violations(verify.touched_symbols(symbols, _lines(spark, d)), verify.naming_rules(symbols))
    return found.select("path", "line", "category", "severity", "message")


_SINK = "(" + " OR ".join(f"contains(lower(symbol), '{k}')" for k in flow.SINKS) + ")"


@query(
    f"""WITH RECURSIVE {SHORT}, fn AS (SELECT path, min(name) AS symbol FROM sy WHERE kind = 'function' GROUP BY 1), cl AS (SELECT a.path AS caller_path, a.symbol AS caller, b.path AS callee_path, b.symbol AS callee FROM sh JOIN fn a ON a.path = src JOIN fn b ON b.path = dst),
    tr AS (SELECT [path] AS nodes, path, symbol, false AS cyclic FROM fn WHERE starts_with(symbol, '_load')
      UNION ALL SELECT list_append(nodes, callee_path), callee_path, callee, list_contains(nodes, callee_path) FROM tr JOIN cl ON caller_path = path AND caller = symbol WHERE NOT cyclic AND NOT (len(nodes) > 1 AND {_SINK}) AND len(nodes) < 6),
    en AS (SELECT *, CASE WHEN cyclic THEN 'cycle' WHEN len(nodes) > 1 AND {_SINK} THEN 'sink' WHEN len(nodes) >= 6 THEN 'depth' WHEN NOT EXISTS (SELECT 1 FROM cl WHERE caller_path = path AND caller = symbol) THEN 'dead_end' END AS "end" FROM tr)
    SELECT array_to_string(nodes, ' > ') AS path, len(nodes) AS length, "end", "end" IN ('cycle', 'depth') AS truncated, len(list_distinct(list_transform(nodes, lambda p: array_to_string(string_split(p, '/')[:2], '/')))) > 1 AS crosses_module FROM en WHERE "end" IS NOT NULL"""
)
def data_flow_traces(spark, d):
    """A file's first function calls those of the files that it imports; six nodes at most, from functions that load."""
    first = written(cb.symbols(spark, d).where("kind = 'function'").groupBy("path").agg(F.min("name").alias("symbol")))
    a, b = first.select(F.col("path").alias("src"), F.col("symbol").alias("caller")), first.select(F.col("path").alias("dst"), F.col("symbol").alias("callee"))
    calls = cb.short_imports(spark, d).join(a, "src").join(b, "dst").select(F.col("src").alias("caller_path"), "caller", F.col("dst").alias("callee_path"), "callee", F.lit("exact").alias("confidence"))
    found = flow.trace(calls, first.where("symbol like '\\_load%'"), depth=6)
    return found.select(F.array_join(F.transform("nodes", lambda n: n["path"]), " > ").alias("path"), "length", "end", "truncated", "crosses_module")


@query(
    f"""WITH {SHORT}, ch AS (SELECT key, path FROM fl WHERE key % 50 = 0), st AS (SELECT DISTINCT src AS path FROM im JOIN ch ON dst = path), ca AS (SELECT DISTINCT src AS path FROM sh JOIN ch ON dst = path),
    hi AS (SELECT DISTINCT f.path FROM lineitem a JOIN ch ON a.l_partkey = ch.key JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_shipdate >= DATE '1998-01-01' JOIN fl f ON f.key = b.l_partkey),
    mp AS (SELECT DISTINCT test AS path FROM tm JOIN ch ON source = ch.path), al AS (SELECT path FROM mp UNION (SELECT path FROM (SELECT * FROM st UNION SELECT * FROM ca UNION SELECT * FROM hi) WHERE starts_with(path, 'tests/') AND path NOT IN (SELECT path FROM ch))),
    fg AS (SELECT path AS test, path IN (SELECT path FROM mp) AS by_map, path IN (SELECT path FROM st) AND path NOT IN (SELECT path FROM ch) AS structural, path IN (SELECT path FROM ca) AND path NOT IN (SELECT path FROM ch) AS by_call, path IN (SELECT path FROM hi) AND path NOT IN (SELECT path FROM ch) AS historical FROM al)
    SELECT *, CASE WHEN (by_map OR structural) AND by_call AND historical THEN 0.90 WHEN (by_map OR structural) AND by_call THEN 0.85 WHEN (by_map OR structural) AND historical THEN 0.75 WHEN by_call AND historical THEN 0.70 WHEN by_map OR structural THEN 0.60 WHEN by_call THEN 0.50 WHEN historical THEN 0.40 ELSE 0.0 END::DOUBLE AS confidence FROM fg"""
)
def predicted_tests(spark, d):
    """All files whose key 50 divides change; imports of short orders stand for calls, late deliveries of the same order for co-changes."""
    files = _files(spark, d).select("key", "path")
    changed = written(files.where("key % 50 = 0"))
    hit = changed.select(F.col("path").alias("dst"))
    lines = table(spark, d, "lineitem")
    orders = lines.join(changed.select(F.col("key").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey").distinct()
    late = lines.where("l_shipdate >= date '1998-01-01'").join(orders, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("key")).distinct().join(files, "key").select("path")
    needs = lambda e: e.join(hit, "dst", "left_semi").select(F.col("src").alias("path"))
    return history.predict_tests(changed, needs(cb.imports(spark, d)), needs(cb.short_imports(spark, d)), late, cb.test_map(spark, d))
