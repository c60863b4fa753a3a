"""The engine's queries over the tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import architecture, conventions, graphs, history, retrieval
from graphloom.sources import relations as rel
from graphloom.sources.tables import table
from graphloom.streaming import changes as stream

QUERIES = {}
ORACLES: dict[str, str] = {}
S = rel.SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Operators over small written-out repositories, with their expected rows: checks for the tests, as they read none of the tables.
CHECKS = {}
EXPECTED: dict[str, str] = {}


def written_out(sql: str):
    def add(f):
        CHECKS[f.__name__] = f
        EXPECTED[f.__name__] = sql
        return f

    return add


CO = "co AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS n, min(a.age) AS age FROM hist a JOIN hist b ON a.sha = b.sha AND a.path < b.path WHERE a.age <= 180 AND b.age <= 180 AND a.sha IN (SELECT sha FROM hist WHERE age <= 180 GROUP BY sha HAVING count(*) BETWEEN 2 AND 200) GROUP BY 1, 2), cw AS (SELECT file_a, file_b, n, round(CASE WHEN age <= 30 THEN 1.0 ELSE 1.0 - 0.7 * (age - 30) / 150.0 END, 6) AS recency_weight FROM co)"
CHURN = "churn AS (SELECT path, count(*) FILTER (WHERE age <= 30) AS churn_30d, count(*) AS churn_180d, max(day) AS last_commit FROM hist WHERE age <= 180 GROUP BY path)"
DEG = "deg AS (SELECT path, count(*) AS in_degree FROM (SELECT file_a AS path FROM cw UNION ALL SELECT file_b FROM cw) GROUP BY path)"
CHANGED = "changed AS (SELECT path FROM hist WHERE age < 2 GROUP BY path)"


def _co(spark, d, threshold=1):
    return history.co_changes(rel.history(spark, d), threshold=threshold)


def _degree(co: DataFrame) -> DataFrame:
    return co.select(F.explode(F.array("file_a", "file_b")).alias("path")).groupBy("path").agg(F.count("*").alias("in_degree"))


def _changed(spark, d):
    return rel.history(spark, d).where("age < 2").select("path").distinct()


@query(
    f"""WITH {rel.HISTORY}, {S['files']}, {CHURN}, {CO}, {DEG}, r AS (SELECT path, coalesce(churn_30d, 0) AS churn, coalesce(in_degree, 0) AS dependents, tested FROM files LEFT JOIN churn USING (path) LEFT JOIN deg USING (path)),
    p AS (SELECT *, cume_dist() OVER (ORDER BY churn) AS pct, count(*) OVER () AS total FROM r),
    q AS (SELECT *, round(greatest(pct, 0.01) * least(dependents / total::DOUBLE, 1.0) * greatest(1 - tested::INT, 0.01), 9) AS risk FROM p)
    SELECT path, churn, dependents, round(pct, 6) AS churn_pct, risk, round(CASE WHEN total <= 1 THEN 1.0 ELSE (total - row_number() OVER (ORDER BY risk DESC, path)) / (total - 1)::DOUBLE END, 6) AS percentile FROM q"""
)
def risk_ranking(spark: SparkSession, d: str) -> DataFrame:
    past = rel.history(spark, d)
    return history.risk_ranking(rel.files(spark, d), history.churn(past), _degree(history.co_changes(past)))


@query(f"WITH {rel.HISTORY}, {CHURN} SELECT path, churn_30d, churn_180d, last_commit FROM churn")
def churn_windows(spark, d):
    return history.churn(rel.history(spark, d))


P75 = "s AS (SELECT churn_180d AS v, row_number() OVER (ORDER BY churn_180d) - 1 AS i, count(*) OVER () AS n FROM churn), t AS (SELECT greatest(3, coalesce(max(v), 3)) AS k FROM s WHERE i = floor(n * 3 / 4.0))"


@query(f"WITH {rel.HISTORY}, {CHURN}, {P75} SELECT path, CASE WHEN churn_30d >= k AND (churn_180d < k OR churn_30d * 6 > churn_180d) THEN 'hot' WHEN churn_30d >= k THEN 'chronic' WHEN churn_180d >= k THEN 'stabilized' ELSE 'cold' END AS trend FROM churn, t")
def churn_trend(spark, d):
    c = history.churn(rel.history(spark, d)).persist()
    return c.select("path", history.trend(F.col("churn_30d"), F.col("churn_180d"), history.p75_threshold(c, "churn_180d")).alias("trend"))


@query(f"WITH {rel.HISTORY}, {CHURN}, s AS (SELECT churn_180d AS v, row_number() OVER (ORDER BY churn_180d) - 1 AS i, count(*) OVER () AS n FROM churn) SELECT greatest(3, coalesce(max(v), 3))::BIGINT AS threshold FROM s WHERE i = floor(n * 3 / 4.0)")
def churn_p75(spark, d):
    n = history.p75_threshold(history.churn(rel.history(spark, d)), "churn_180d")
    return spark.createDataFrame([(n,)], "threshold long")


@query(f"WITH {rel.HISTORY}, {S['files']} SELECT dir, round(avg(CASE WHEN regexp_matches(replace(message, '1-URGENT', 'hot fix'), '(?i)\\b(fix|bug|patch|hotfix)\\b') THEN 1.0 ELSE 0.0 END), 6) AS density, count(*) AS touches FROM hist JOIN files USING (path) WHERE age <= 180 GROUP BY dir")
def bugfix_density(spark, d):
    return history.bugfix_density(rel.history(spark, d), rel.files(spark, d), F.replace("message", F.lit("1-URGENT"), F.lit("hot fix")).rlike(history.BUGFIX))


@query(f"WITH {rel.HISTORY}, a AS (SELECT path, min(age) AS age, count(*) AS mods FROM hist GROUP BY path) SELECT path, age, mods, round(least(greatest(1 - age / 90.0, 0.0), 1.0), 6) AS recency FROM a ORDER BY age, mods DESC, path LIMIT 50")
def recent_changes(spark, d):
    last = rel.history(spark, d).groupBy("path").agg(F.min("age").alias("age"), F.count("*").alias("mods"))
    return last.withColumn("recency", history.recency_score(F.col("age"))).orderBy("age", F.desc("mods"), "path").limit(50)


@query(f"WITH {rel.HISTORY}, {CO} SELECT * FROM cw")
def co_change_edges(spark, d):
    return _co(spark, d)


@query(f"WITH {rel.HISTORY}, {CO} SELECT * FROM cw WHERE n >= 2")
def co_change_edges_min2(spark, d):
    return _co(spark, d, 2)


@query(f"WITH {rel.HISTORY}, {CO}, e AS (SELECT DISTINCT file_a, file_b FROM cw WHERE (ascii(right(file_a, 1)) + ascii(right(file_b, 1))) % 3 = 0) SELECT * FROM cw ANTI JOIN e USING (file_a, file_b)")
def surprising_links(spark, d):
    co = _co(spark, d)
    edges = co.where("(ascii(right(file_a, 1)) + ascii(right(file_b, 1))) % 3 = 0").select(F.col("file_b").alias("src"), F.col("file_a").alias("dst"))
    return history.surprising(co, edges)


@query(
    f"""WITH {rel.HISTORY}, {CO}, {CHANGED}, s AS (SELECT cw.*, file_a IN (SELECT path FROM changed) AS ia, file_b IN (SELECT path FROM changed) AS ib FROM cw),
    m AS (SELECT CASE WHEN ia THEN file_b ELSE file_a END AS path, CASE WHEN ia THEN file_a ELSE file_b END AS because, round(n * recency_weight, 6) AS weight FROM s WHERE ia <> ib)
    SELECT path, because, weight FROM m WHERE weight >= 1.0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY weight DESC, because) = 1"""
)
def omissions(spark, d):
    return history.omissions(_co(spark, d), _changed(spark, d))


@query(
    f"""WITH {rel.HISTORY}, {CO}, {CHANGED}, b AS (SELECT file_a AS seed, file_b AS path, n, recency_weight FROM cw UNION ALL SELECT file_b, file_a, n, recency_weight FROM cw)
    SELECT path, round(max(n / (SELECT max(n) FROM cw)::DOUBLE * recency_weight), 6) AS score FROM b WHERE seed IN (SELECT path FROM changed) AND path NOT IN (SELECT path FROM changed) GROUP BY path"""
)
def historical_impact(spark, d):
    return history.historical_impact(_co(spark, d), _changed(spark, d))


@query(
    f"""WITH {rel.HISTORY}, {S['files']}, {CHURN}, {CO}, i AS (SELECT file_b AS path, count(*) AS in_degree FROM cw GROUP BY 1), o AS (SELECT file_a AS path, count(*) AS out_degree FROM cw GROUP BY 1),
    r AS (SELECT path, coalesce(in_degree, 0) AS i, coalesce(out_degree, 0) AS o, coalesce(churn_180d, 0) AS c, last_commit, row_number() OVER (ORDER BY last_commit DESC NULLS LAST, path) - 1 AS pos, count(*) OVER () AS n FROM files LEFT JOIN churn USING (path) LEFT JOIN i USING (path) LEFT JOIN o USING (path))
    SELECT path, round(i * 0.4 + o * 0.1 + (CASE WHEN last_commit IS NULL THEN 0.0 ELSE 1 - pos / n::DOUBLE END) * 0.3 + c / (SELECT max(churn_180d) FROM churn)::DOUBLE * 0.2, 6) AS importance FROM r"""
)
def file_importance(spark, d):
    past = rel.history(spark, d)
    deg = graphs.degrees(history.co_changes(past).select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"))).withColumnRenamed("node", "path")
    return history.importance(rel.files(spark, d), deg, history.churn(past))


SIG = "sig AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_size / 50.0 AS s1, round(p_retailprice / 2000, 6) AS s2, (p_partkey % 7) / 7.0 AS s3 FROM part)"
WEIGHTS = {"s1": 0.5, "s2": 0.3, "s3": 0.2}


def _signals(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") / 50.0).alias("s1"), F.round(F.col("p_retailprice") / 2000, 6).alias("s2"), ((F.col("p_partkey") % 7) / 7.0).alias("s3"))


@query(f"WITH {SIG} SELECT path, round(0.5 * 61 / (60 + rank() OVER (ORDER BY s1 DESC)) + 0.3 * 61 / (60 + rank() OVER (ORDER BY s2 DESC)) + 0.2 * 61 / (60 + rank() OVER (ORDER BY s3 DESC)), 6) AS score FROM sig")
def rrf_fusion(spark, d):
    return retrieval.fuse(_signals(spark, d), WEIGHTS)


@query(f"WITH {SIG} SELECT path, round(least(greatest(s1 * 0.5 + s2 * 0.3 + s3 * 0.2, 0.0), 1.0), 6) AS score FROM sig")
def weighted_fusion(spark, d):
    return retrieval.weighted(_signals(spark, d), WEIGHTS)


# graphs


@query(f"WITH {S['edges']} SELECT node, count(*) FILTER (WHERE o = 0) AS in_degree, count(*) FILTER (WHERE o = 1) AS out_degree FROM (SELECT src AS node, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node")
def graph_nodes(spark, d):
    return graphs.degrees(rel.trade_edges(spark, d))


@query(f"WITH {S['edges']} SELECT DISTINCT * FROM (SELECT dst AS node, 'out' AS direction, edge_type FROM edges WHERE src = 'NATION_10' UNION ALL SELECT src, 'in', edge_type FROM edges WHERE dst = 'NATION_10')")
def graph_neighbors(spark, d):
    return graphs.neighbours(rel.trade_edges(spark, d), "NATION_10")


@query(
    f"""WITH RECURSIVE {S['edges']}, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), near(node, hops) AS (SELECT DISTINCT a, 0 FROM both_ WHERE a = 'NATION_10' UNION SELECT b, hops + 1 FROM near JOIN both_ ON a = node WHERE hops < 2)
    SELECT src, dst, edge_type, n FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)"""
)
def graph_subgraph_d2(spark, d):
    return graphs.subgraph(rel.trade_edges(spark, d), ["NATION_10"], 2).select("src", "dst", "edge_type", "n")


@query(
    f"""WITH RECURSIVE {S['edges']}, back(node, h) AS (SELECT 'NATION_23', 0 UNION SELECT src, h + 1 FROM back JOIN edges ON dst = node WHERE h < 30), d AS (SELECT node, min(h) AS h FROM back GROUP BY 1),
    nx AS (SELECT src, min(dst) AS dst FROM edges JOIN d a ON src = a.node JOIN d b ON dst = b.node WHERE b.h = a.h - 1 GROUP BY 1), walk(hop, node) AS (SELECT 0, node FROM d WHERE node = 'NATION_0' UNION ALL SELECT hop + 1, nx.dst FROM walk JOIN nx ON node = src) SELECT hop, node FROM walk"""
)
def graph_shortest_path(spark, d):
    return graphs.shortest_path(rel.trade_edges(spark, d), "NATION_0", "NATION_23")


@query(f"WITH RECURSIVE {S['edges']}, r(node) AS (SELECT DISTINCT src FROM edges WHERE src = 'NATION_3' UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r")
def reachable(spark, d):
    return graphs.reach(rel.trade_edges(spark, d), ["NATION_3"], None, "out").select("node")


def _pagerank_sql(rounds: int, personal: bool) -> str:
    t = "CASE WHEN node = 'NATION_3' THEN 1.0 ELSE 0.0 END" if personal else "1.0 / (SELECT count(*) FROM nodes)"
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS (SELECT b.node, 0.15 * b.t + 0.85 * (coalesce(x, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} JOIN base USING (node) WHERE deg IS NULL) * b.t) AS r FROM base b LEFT JOIN "
            f"(SELECT dst AS node, sum(r / deg) AS x FROM r{i - 1} JOIN base USING (node) JOIN edges ON src = node WHERE deg IS NOT NULL GROUP BY dst) f USING (node))"
        )
    return f"WITH {S['edges']}, nodes AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges), base AS (SELECT node, {t} AS t, deg FROM nodes LEFT JOIN (SELECT src AS node, count(*) AS deg FROM edges GROUP BY src) USING (node)), {', '.join(steps)} SELECT node, round(r / (SELECT max(r) FROM r{rounds}), 6) AS score FROM r{rounds}"


@query(_pagerank_sql(10, False))
def pagerank_k10(spark, d):
    return graphs.pagerank(rel.trade_edges(spark, d), 10, tol=None).select("node", F.round("score", 6).alias("score"))


@query(_pagerank_sql(10, True))
def pagerank_personalized_k10(spark, d):
    return graphs.pagerank(rel.trade_edges(spark, d), 10, tol=None, personal={"NATION_3": 1.0}).select("node", F.round("score", 6).alias("score"))


CYCLIC = f"{S['edges']}, cyc AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE edge_type = 'import')"


def _cyclic(spark, d):
    e = rel.trade_edges(spark, d)
    return e.select("src", "dst").unionByName(e.where("edge_type = 'import'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query(f"WITH RECURSIVE {CYCLIC}, r(a, b) AS (SELECT src, dst FROM cyc UNION SELECT a, dst FROM r JOIN cyc ON b = src) SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a")
def scc_members(spark, d):
    return graphs.components(_cyclic(spark, d))


@query(
    f"""WITH {S['edges']}, w AS (SELECT src, dst, CASE WHEN edge_type = 'import' THEN 1.0 ELSE 0.5 END AS w FROM edges), l0 AS (SELECT 'NATION_24' AS path),
    l1 AS (SELECT src AS path, max(w) AS weight FROM w WHERE dst IN (SELECT path FROM l0) AND src NOT IN (SELECT path FROM l0) GROUP BY src),
    l2 AS (SELECT src AS path, max(w) AS weight FROM w WHERE dst IN (SELECT path FROM l1) AND src NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1) GROUP BY src),
    l3 AS (SELECT src AS path, max(w) AS weight FROM w WHERE dst IN (SELECT path FROM l2) AND src NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1 UNION SELECT path FROM l2) GROUP BY src),
    al AS (SELECT path, 1 AS hops, weight FROM l1 UNION ALL SELECT path, 2, weight FROM l2 UNION ALL SELECT path, 3, weight FROM l3), z AS (SELECT path, hops, round(least(weight / (hops + 1) * 1.2, 1.0), 6) AS risk FROM al)
    SELECT path, hops, risk, CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS category FROM z"""
)
def blast_radius_level(spark, d):
    return graphs.blast_radius(rel.trade_edges(spark, d), ["NATION_24"])


MODULES = "mods AS (SELECT n_name AS node, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _modules(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("module"))


COUPLED = f"{S['edges']}, {MODULES}, o AS (SELECT a.module, count(*) AS total, count(*) FILTER (WHERE a.module <> b.module) AS crossing FROM edges JOIN mods a ON src = a.node JOIN mods b ON dst = b.node GROUP BY 1), cp AS (SELECT module, n_files, coalesce(total, 0) AS total, coalesce(crossing, 0) AS crossing, round(CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE crossing / total::DOUBLE END, 6) AS coupling FROM (SELECT module, count(*) AS n_files FROM mods GROUP BY 1 HAVING count(*) >= 3) LEFT JOIN o USING (module))"


@query(f'WITH {COUPLED} SELECT module, n_files, total, crossing AS "cross", coupling FROM cp')
def module_coupling(spark, d):
    return architecture.module_coupling(rel.trade_edges(spark, d), _modules(spark, d))


@query(f"WITH {COUPLED} SELECT round((1 - coalesce(avg(coupling), 0.0)) * 10, 6) AS score FROM cp")
def coupling_score(spark, d):
    return architecture.coupling_score(architecture.module_coupling(rel.trade_edges(spark, d), _modules(spark, d)))


@query(f"WITH {S['edges']}, {MODULES}, x AS (SELECT a.module AS a, b.module AS b, count(*) AS n FROM edges JOIN mods a ON src = a.node JOIN mods b ON dst = b.node WHERE a.module <> b.module GROUP BY 1, 2) SELECT x.a, x.b, x.n, coalesce(y.n, 0) AS n_back, y.n IS NULL AS strict FROM x LEFT JOIN x y ON x.a = y.b AND x.b = y.a")
def strict_layers(spark, d):
    return architecture.layers(rel.trade_edges(spark, d), _modules(spark, d))


@query("WITH c AS (SELECT 's' || l_suppkey AS node, n_name AS module, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), st AS (SELECT module, avg(n) AS mean, stddev_pop(n) AS dev FROM c GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(n) > 0) SELECT module, node, n FROM c JOIN st USING (module) WHERE n > mean + 2.0 * dev")
def god_files(spark, d):
    c = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return architecture.god_files(c.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node"), F.col("n_name").alias("module")).agg(F.count("*").alias("n")))


@query(f"WITH {COUPLED}, pr AS ({_pagerank_sql(10, False).replace('round(r / ', '(r / ').replace(', 6) AS score', ') AS score')}), pw AS (SELECT module, round(sum(coalesce(score, 0.0)), 5) AS pagerank FROM mods LEFT JOIN pr USING (node) GROUP BY 1) SELECT module, n_files, pagerank, coupling, round(CASE WHEN n_files > 1 THEN (total - crossing) / (n_files * (n_files - 1))::DOUBLE ELSE 1.0 END, 6) AS cohesion FROM cp JOIN pw USING (module)")
def architecture_map(spark, d):
    e = rel.trade_edges(spark, d)
    return architecture.architecture_map(e, _modules(spark, d), graphs.pagerank(e, 10, tol=None))


@written_out(
    """WITH code(tab, col, type) AS (VALUES ('orders', 'o_orderkey', 'BIGINT'), ('orders', 'o_total', 'DOUBLE'), ('part', 'p_name', ' text '), ('users', 'id', 'INT')), live(tab, col, type) AS (VALUES ('orders', 'o_orderkey', 'bigint'), ('orders', 'o_total', 'FLOAT'), ('part', 'p_name', 'TEXT'), ('nation', 'n_name', 'TEXT'))
    SELECT tab, col, c.type AS code_type, l.type AS live_type, CASE WHEN c.type IS NULL THEN 'live_only' WHEN l.type IS NULL THEN 'code_only' ELSE 'type_differs' END AS kind FROM code c FULL JOIN live l USING (tab, col) WHERE c.type IS NULL OR l.type IS NULL OR lower(trim(c.type)) <> lower(trim(l.type))"""
)
def schema_drift(spark, d):
    code = spark.createDataFrame([("orders", "o_orderkey", "BIGINT"), ("orders", "o_total", "DOUBLE"), ("part", "p_name", " text "), ("users", "id", "INT")], "tab string, col string, type string")
    live = spark.createDataFrame([("orders", "o_orderkey", "bigint"), ("orders", "o_total", "FLOAT"), ("part", "p_name", "TEXT"), ("nation", "n_name", "TEXT")], "tab string, col string, type string")
    return architecture.schema_drift(code, live)


# text and retrieval

WORDS = r"list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), lambda w: strlen(w) >= 2)"
TERMS = f"{S['docs']}, terms AS (SELECT path, term, count(*) AS n FROM (SELECT path, unnest({WORDS}) AS term FROM docs) GROUP BY 1, 2)"


@query(f"WITH {S['docs']} SELECT language, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM docs GROUP BY 1")
def language_stats(spark, d):
    return retrieval.language_stats(rel.documents(spark, d))


@query(f"WITH {TERMS} SELECT term, sum(n)::BIGINT AS n FROM terms GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def top_terms(spark, d):
    return retrieval.top_terms(rel.documents(spark, d), 50)


@query(f"WITH {TERMS} SELECT path, round(sum(CASE WHEN term IN ('the', 'loser', 'und', 'que') THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS score FROM terms GROUP BY path HAVING score > 0")
def term_frequency_signal(spark, d):
    return retrieval.term_signal(rel.documents(spark, d), ["the", "loser", "und", "que"])


@query(f"WITH {S['docs']}, p AS (SELECT path, list_distinct(list_filter(string_split_regex(lower(path), '[/._-]+'), lambda w: strlen(w) >= 2)) AS parts FROM docs), s AS (SELECT path, len(list_intersect(parts, ['src3', 'en', 'txt'])) AS k, len(parts) AS n FROM p) SELECT path, round(0.7 * k / 3.0 + 0.3 * (CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0.0 END), 6) AS score FROM s WHERE k > 0")
def path_similarity(spark, d):
    return retrieval.path_signal(rel.documents(spark, d), ["src3", "en", "txt"])


@query("WITH n AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_name AS name FROM part), t AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 3 WHEN starts_with(lower(name), 'red') THEN 2 WHEN contains(lower(name), 'red') THEN 1 END AS tier FROM n) SELECT path, name, tier FROM t WHERE tier IS NOT NULL ORDER BY tier DESC, name, path LIMIT 20")
def symbol_search(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"))
    return retrieval.search_symbols(names, "red")


@query(f"WITH {S['docs']}, l AS (SELECT path, string_split(content, chr(10)) AS ls FROM docs), m AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) SELECT path, i AS line_no, ls[i] AS line, array_to_string(ls[greatest(i - 2, 1):i - 1], chr(10)) AS before, array_to_string(ls[i + 1:i + 2], chr(10)) AS after FROM m WHERE regexp_matches(ls[i], 'loser|idiot')")
def regex_search_context(spark, d):
    return retrieval.search_lines(rel.documents(spark, d), "loser|idiot").withColumn("line_no", F.col("line_no").cast("long"))


_SECRETS = ", ".join("('{}', '{}')".format(k, p.replace("'", "''")) for k, p in retrieval.SECRETS.items())


@query(f"WITH {S['docs']}, k(kind, pattern) AS (VALUES {_SECRETS}) SELECT path, kind, len(regexp_extract_all(content, pattern))::BIGINT AS hits FROM docs, k WHERE regexp_matches(content, pattern)")
def secret_scan(spark, d):
    return retrieval.secrets(rel.documents(spark, d))


@query(
    f"""WITH {TERMS}, s AS (SELECT path, term FROM terms), z AS (SELECT path, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS whole FROM s GROUP BY 1), c AS (SELECT a.path AS p, b.path AS q, count(*) AS k FROM s a JOIN s b ON a.term = b.term AND a.path < b.path GROUP BY 1, 2),
    j AS (SELECT p, q FROM c JOIN z x ON x.path = p JOIN z y ON y.path = q WHERE round(k / (x.n + y.n - k)::DOUBLE, 6) > 0.8), l AS (SELECT path, count(*) AS links FROM (SELECT p AS path FROM j UNION ALL SELECT q FROM j) GROUP BY 1),
    g AS (SELECT path, min(path) OVER (PARTITION BY whole) AS class, links FROM z LEFT JOIN l USING (path))
    SELECT path, coalesce(g.class, path) AS class, coalesce(g.links, 0) AS links FROM (SELECT DISTINCT path FROM docs) d LEFT JOIN g USING (path)"""
)
def similar_pairs_jaccard(spark, d):
    """A row for each document, with its class of equal sets and its number of links; one without terms stands alone."""
    docs = rel.documents(spark, d)
    found = docs.select("path").distinct().join(retrieval.similar_classes(retrieval.term_sets(docs)), "path", "left")
    return found.select("path", F.coalesce("class", "path").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


@query("WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 4) AS similarity FROM embeddings ORDER BY similarity DESC, id LIMIT 20")
def embedding_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").select("embedding").first()
    return retrieval.cosine_topk(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q.embedding if q else [], 20)


@query(f"WITH {S['docs']}, t AS (SELECT item_id AS query, path FROM benchmark b JOIN docs ON contains(content, b.text)), r AS (SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY path) AS rank FROM t), k AS (SELECT * FROM r WHERE rank <= 2) SELECT query, round(count(k.path) / count(*)::DOUBLE, 6) AS recall, round(coalesce(1.0 / min(k.rank), 0.0), 6) AS rr FROM t LEFT JOIN k USING (query, path) GROUP BY query")
def recall_mrr(spark, d):
    from pyspark.sql import Window as W

    truth = retrieval.holders(rel.documents(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"))
    ranked = truth.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("path"))).where("rank <= 2")
    return retrieval.recall_mrr(ranked, truth)


@query(f"WITH {S['docs']}, o AS (SELECT path, content FROM docs WHERE doc_id % 11 <> 0), n AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN content || 'x' ELSE content END AS content FROM docs WHERE doc_id % 17 <> 0) SELECT path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content")
def context_diff(spark, d):
    docs = rel.documents(spark, d)
    old = docs.where("doc_id % 11 <> 0")
    new = docs.where("doc_id % 17 <> 0").withColumn("content", F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return retrieval.snapshot_diff(old, new)


@query(f"WITH {S['docs']}, n AS (SELECT source, len(string_split(content, chr(10))) AS n FROM docs) SELECT coalesce(source, '(all)') AS source, count(*) AS files, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median FROM n GROUP BY ROLLUP (source)")
def function_length_stats(spark, d):
    return conventions.length_stats(rel.documents(spark, d))


STYLE = "CASE WHEN regexp_full_match(w, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'screaming_snake' WHEN regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake' WHEN regexp_full_match(w, '[A-Z][A-Za-z0-9]*') THEN 'pascal' WHEN regexp_full_match(w, '[a-z][A-Za-z0-9]*') THEN 'camel' ELSE 'other' END"
STYLES = f"w AS (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents), st AS (SELECT source, {STYLE} AS style, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)"


def _styles(spark, d):
    w = table(spark, d, "documents").select("source", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return w.select("source", conventions.style(F.regexp_replace("w", "\n", " ")).alias("style"))


@query(f"WITH {STYLES} SELECT source, style, n FROM st")
def naming_style(spark, d):
    return conventions.style_counts(table(spark, d, "documents"), "source", "text")


@query(f"WITH {STYLES}, t AS (SELECT source, max(n) AS top, sum(n) AS total FROM st GROUP BY 1), b AS (SELECT source, max(style) AS dominant, max(n) AS n, max(total)::BIGINT AS total FROM st JOIN t USING (source) WHERE n = top GROUP BY 1 HAVING count(*) = 1), p AS (SELECT *, round(n * 100.0 / total, 4) AS pct FROM b) SELECT source, dominant, n, total, pct, CASE WHEN pct >= 90 THEN 'convention' WHEN pct >= 70 THEN 'trend' ELSE 'mixed' END AS strength FROM p WHERE pct >= 50")
def pattern_strength(spark, d):
    return conventions.dominant(_styles(spark, d), "source", "style")


@query()
def budget_pack(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("path"), (-F.col("turn")).alias("score"), F.ceil(F.length("text") / 4).alias("tokens"))
    return retrieval.pack(c, "conv_id", 200)


@query("WITH c AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c) SELECT * FROM r WHERE running <= 200")
def budget_prefix(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).cast("long").alias("tokens"))
    return retrieval.budget_prefix(c, "conv_id", [F.col("turn")], "tokens", 200)


@query(
    """WITH e AS (SELECT 'u' || user_id AS path, event_type AS kind, ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT path, count(*) AS n, min(ts) AS "first", max(ts) AS "last", array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM s GROUP BY path, s"""
)
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"), "ts")
    return stream.debounce(e, "1 hour").withColumn("kinds", F.array_join("kinds", ","))


@query("WITH e AS (SELECT 'u' || user_id AS path, event_type AS kind, ts FROM events) SELECT path, CASE WHEN arg_max(kind, (ts, kind)) = 'removed' THEN 'removed' ELSE 'modified' END AS state FROM e GROUP BY path")
def classify_changes(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"), "ts")
    return stream.classify(e)


COMMITS = [("aaaaaaa1", "Add parser"), ("bbbbbbb2", "Revert aaaaaaa1"), ("ccccccc3", "revert something"), ("ddddddd4", "Reverted by hand"), ("eeeeeee5", "Fix bug")]


@written_out("WITH c(sha, message) AS (VALUES ('aaaaaaa1', 'Add parser'), ('bbbbbbb2', 'Revert aaaaaaa1'), ('ccccccc3', 'revert something'), ('ddddddd4', 'Reverted by hand'), ('eeeeeee5', 'Fix bug')), h AS (SELECT *, regexp_extract(message, '([0-9a-f]{7,40})', 1) AS k FROM c WHERE regexp_matches(message, '(?i)^revert\\b')) SELECT h.sha, o.sha AS reverted, o.message AS original FROM h LEFT JOIN c o ON h.k <> '' AND starts_with(o.sha, h.k)")
def revert_detection(spark, d):
    return history.reverts(spark.createDataFrame(COMMITS, "sha string, message string"))


@query(f"WITH {rel.HISTORY}, m AS (SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT sha) AS commits, count(DISTINCT path) AS files FROM hist GROUP BY 1) SELECT *, files - lag(files) OVER (ORDER BY month) AS step, CASE WHEN abs(files - lag(files) OVER (ORDER BY month)) > 0.2 * lag(files) OVER (ORDER BY month) THEN 'churn' END AS event FROM m")
def timeline_steps(spark, d):
    return history.timeline(rel.history(spark, d))


IMPACT = f"{S['edges']}, x AS (SELECT src AS path, sum(CASE WHEN edge_type = 'import' THEN 1.0 ELSE 0.5 END) AS x FROM edges WHERE dst IN ('NATION_20', 'NATION_21') GROUP BY 1), ci AS (SELECT path, round(x / greatest((SELECT max(x) FROM x), 1.0), 6) AS score FROM x WHERE path NOT IN ('NATION_20', 'NATION_21'))"


def _impact(spark, d):
    changed = spark.createDataFrame([("NATION_20",), ("NATION_21",)], "path string")
    return history.call_impact(rel.trade_edges(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), (F.col("edge_type") == "import").alias("exact")), changed)


@query(f"WITH {IMPACT} SELECT path, score FROM ci")
def call_impact(spark, d):
    return _impact(spark, d)


@query(
    f"""WITH {IMPACT}, st AS (SELECT n_name AS path FROM nation WHERE n_nationkey % 2 = 0), hi AS (SELECT n_name AS path FROM nation WHERE n_nationkey % 3 = 0),
    p AS (SELECT path FROM st UNION SELECT path FROM hi UNION SELECT path FROM ci), f AS (SELECT path, path IN (SELECT path FROM st) AS structural, path IN (SELECT path FROM ci) AS by_call, path IN (SELECT path FROM hi) AS historical FROM p)
    SELECT *, CASE WHEN structural AND by_call AND historical THEN 0.90 WHEN structural AND by_call THEN 0.85 WHEN structural AND historical THEN 0.75 WHEN by_call AND historical THEN 0.70 WHEN structural THEN 0.60 WHEN by_call THEN 0.50 WHEN historical THEN 0.40 ELSE 0.0 END::DOUBLE AS confidence FROM f"""
)
def predict_confidence(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("path"), "n_nationkey")
    return history.predict(n.where("n_nationkey % 2 = 0"), _impact(spark, d), n.where("n_nationkey % 3 = 0"))
