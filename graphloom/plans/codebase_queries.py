"""Queries over the code base that the tables stand for, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import conventions, graphs, health, packing, signals
from graphloom.operators import predicates as P
from graphloom.operators.lineage import written
from graphloom.plans.queries import query
from graphloom.sources import codebase as cb
from graphloom.sources import relations as rel
from graphloom.sources.tables import table

CF, CODE = cb.SQL["cf"], cb.CODE
HIST = rel.HISTORY


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, values, how: str) -> str:
    return "(" + " OR ".join(f"{how}({column}, '{v}')" for v in values) + ")"


# ---------------------------------------------------------------- predicates

#: Paths that show what the files of the code base don't.
ODD_PATHS = ["README.md", "src/tests/util.rs", "spec/app.spec.ts", "a/__tests__/b.js", "lib/footest", "web/dist/app.min.js", "api/user_pb2.py", "Cargo.lock", "pkg/Dockerfile", "src/b12/x.generated.ts", "test/A.java", "src/ATests.java", "docs/test_plan.md", "cmd/main.go", "x/y.gen.z", "src/b1", "src/b1/deep/er/file.rs"]
PATHS = f"pt AS (SELECT path FROM fl UNION ALL SELECT unnest({_list(ODD_PATHS)}))"


def _paths(spark, d):
    return cb.files(spark, d).select("path").unionByName(spark.createDataFrame([(p,) for p in ODD_PATHS], "path string"))


_NAME = "split_part({0}, '/', -1)"
_TESTNAME = "(contains({0}, '_test.') OR contains({0}, '_spec.') OR starts_with({0}, 'test_'))"
TEST_SQL = {
    "blast": f"list_has_any(string_split(lower(path), '/'), {_list(P.TEST_DIRS)}) OR {_TESTNAME.format('n')} OR {_any('n', ['test', 'spec'], 'ends_with')} OR {_any('n', ['.test.', '.spec.'], 'contains')}",
    "map": f"list_has_any(string_split(path, '/')[:-2], {_list(P.TEST_DIRS)}) OR {_TESTNAME.format('n')} OR {_any('n', P.MAPPED_ENDINGS, 'ends_with')}",
    "bridges": f"starts_with(lower(path), 'tests/') OR contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/') OR starts_with(n, 'test_') OR {_any('n', P.BRIDGE_ENDINGS, 'ends_with')}",
    "dead_code": f"{_any('path', ['tests/', 'test/', 'spec/'], 'starts_with')} OR {_any('path', ['/tests/', '/test/', '/spec/', '__tests__'], 'contains')} OR {_any('path', P.DEAD_ENDINGS, 'ends_with')}",
    "conventions": "contains(path, '/test') OR starts_with(path, 'tests/') OR contains(path, '_test.')",
    "onboarding": f"{_any('path', ['tests/', 'test/'], 'starts_with')} OR {_any('path', ['/tests/', '/test/'], 'contains')}",
    "health": _any("path", ["/tests/", "/test/", "/spec/", "_test.", ".test.", "_spec.", ".spec."], "contains"),
}


@query(f"WITH {CF}, {PATHS}, x AS (SELECT path, lower(split_part(path, '/', -1)) AS n FROM pt) SELECT path, {', '.join(f'({v}) AS {k}' for k, v in TEST_SQL.items())} FROM x")
def test_paths(spark, d):
    return _paths(spark, d).select("path", *[f(F.col("path")).alias(k) for k, f in P.TEST_PATHS.items()])


@query(
    f"""WITH {CF}, {PATHS}, x AS (SELECT path, lower(path) AS l, lower(split_part(path, '/', -1)) AS n FROM pt)
    SELECT path, n IN ({', '.join(f"'{k}'" for k in P.KEY_FILES)}) OR {_any('l', P.KEY_ENDINGS, 'ends_with')} AS key_file, starts_with(path, 'src/b1') AS focused, path = 'src/b1' OR starts_with(path, 'src/b1/') AS in_workspace,
    CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:-2][:2], '/') ELSE path END AS by_folders, array_to_string(string_split(path, '/')[:2], '/') AS by_segments FROM x"""
)
def path_predicates(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("path", P.key_file(p).alias("key_file"), P.focused(p, "src/b1").alias("focused"), P.in_workspace(p, "src/b1").alias("in_workspace"), P.module_of_folders(p).alias("by_folders"), P.module_of_segments(p).alias("by_segments"))


_DIR = f"list_filter(string_split(path, '/'), lambda s: list_contains({_list(P.NOISE_DIRS)}, s))"
NOISE_SQL = f"""CASE WHEN split_part(path, '/', -1) IN ({', '.join(f"'{k}'" for k in P.NOISE_FILES)}) THEN split_part(path, '/', -1) WHEN len({_DIR}) > 0 THEN {_DIR}[1] || '/'
    {' '.join(f"WHEN ends_with(path, '{v}') THEN '{v}'" for v in P.NOISE_SUFFIXES)} {' '.join(f"WHEN contains(path, '{v}') THEN '{v}'" for v in P.NOISE_PARTS)} END"""
MARKED = _any("array_to_string(string_split(content, chr(10))[:5], chr(10))", P.GENERATED, "contains")


@query(f"WITH {CF}, pc AS (SELECT path, content FROM fl UNION ALL SELECT unnest({_list(ODD_PATHS)}), '@generated'), r AS (SELECT path, {NOISE_SQL} AS r, {MARKED} AS g FROM pc) SELECT path, CASE WHEN r IS NOT NULL THEN 'blocklist: ' || r WHEN g THEN 'generated_file' END AS reason FROM r WHERE r IS NOT NULL OR g")
def noise_reasons(spark, d):
    rows = cb.files(spark, d).select("path", "content").unionByName(spark.createDataFrame([(p, "@generated") for p in ODD_PATHS], "path string, content string"))
    return rows.select("path", F.coalesce(P.noise_reason(F.col("path")), F.when(P.generated(F.col("content")), "generated_file")).alias("reason")).where("reason is not null")


INLINE = f"CASE WHEN language = 'rust' THEN {_any('content', P.INLINE_RUST, 'contains')} WHEN language = 'python' THEN contains(content, 'def test_') OR contains(content, 'class Test') WHEN language IN ('typescript', 'javascript', 'tsx', 'jsx') THEN contains(content, 'describe(') OR contains(content, ' it(') OR regexp_matches(content, '(^|[^A-Za-z0-9_])test\\(') WHEN language = 'go' THEN contains(content, 'func Test') ELSE false END"
IS_CODE = f"coalesce(list_contains({_list(P.CODE_LANGUAGES)}, language), false)"


@query(f"WITH {CF} SELECT path, {IS_CODE} AS code, {INLINE} AS inline FROM fl")
def inline_tests(spark, d):
    return cb.files(spark, d).select("path", P.code_language(F.col("language")).alias("code"), P.inline_tests(F.col("language"), F.col("content")).alias("inline"))


@query(f"WITH {CODE} SELECT path, name, kind FROM sy WHERE visibility = 'public'")
def public_symbols(spark, d):
    return cb.symbols(spark, d).where("visibility = 'public'").select("path", "name", "kind")


@query(f"WITH {CODE} SELECT path, name, kind, start_line FROM sy WHERE lower(name) = lower('LoadUser')")
def find_symbol(spark, d):
    return cb.symbols(spark, d).where(F.lower("name") == "loaduser").select("path", "name", "kind", "start_line")


@query(f"WITH {CODE} SELECT src AS path, count(*) AS n FROM im GROUP BY 1")
def import_counts(spark, d):
    return cb.imports(spark, d).groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"))


@query(f"WITH {rel.SQL['docs']} SELECT path FROM docs WHERE contains(lower(content), lower('LoSer'))")
def content_matches(spark, d):
    return rel.documents(spark, d).where(F.lower("content").contains("loser")).select("path")


@query(f"WITH {CODE} SELECT count(*) AS n FROM im")
def edge_count(spark, d):
    return cb.imports(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {CODE} SELECT src, dst FROM im WHERE (CASE WHEN contains(src, '/') THEN string_split(src, '/')[1] END) <> string_split(dst, '/')[1] AND contains(substr(dst, length(string_split(dst, '/')[1]) + 2), '/')")
def boundary_violations(spark, d):
    return P.boundary_edges(cb.imports(spark, d), 1)


@query(f"WITH {rel.SQL['edges']}, t AS (SELECT src, dst, CASE WHEN edge_type = 'import' THEN 'foreign_key' ELSE edge_type END AS edge_type FROM edges) SELECT src, dst FROM t WHERE list_contains({_list(P.SCHEMA_EDGES)}, edge_type)")
def schema_edge_filter(spark, d):
    e = rel.trade_edges(spark, d).withColumn("edge_type", F.when(F.col("edge_type") == "import", "foreign_key").otherwise(F.col("edge_type")))
    return e.where(P.schema_edge(F.col("edge_type"))).select("src", "dst")


# ---------------------------------------------------------------- health


@query(f"WITH {CODE}, s AS (SELECT *, {INLINE} AS inline FROM fl WHERE {IS_CODE} AND NOT {TEST_SQL['health']}) SELECT round(coalesce(avg(CASE WHEN inline OR path IN (SELECT source FROM tm) THEN 1.0 ELSE 0.0 END) * 10, 10.0), 6) AS score FROM s")
def health_coverage(spark, d):
    return health.coverage_score(cb.files(spark, d), cb.test_map(spark, d)).select(F.round("score", 6).alias("score"))


CHURN = "churn AS (SELECT path, count(*) FILTER (WHERE age <= 30) AS churn_30d FROM hist WHERE age <= 180 GROUP BY path)"


@query(f"WITH {HIST}, {rel.SQL['files']}, {CHURN} SELECT round(10 * (1 - least((SELECT count(*) FROM churn WHERE churn_30d > 10) / greatest((SELECT count(*) FROM files), 1)::DOUBLE, 1.0)), 6) AS score")
def health_stability(spark, d):
    from graphloom.operators import history

    return health.stability_score(rel.files(spark, d), history.churn(rel.history(spark, d))).select(F.round("score", 6).alias("score"))


STYLE = "CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'screaming_snake' WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake' WHEN regexp_full_match(name, '[A-Z][A-Za-z0-9]*') THEN 'pascal' WHEN regexp_full_match(name, '[a-z][A-Za-z0-9]*') THEN 'camel' ELSE 'other' END"
STRENGTH = "CASE WHEN pct >= 90 THEN 'convention' WHEN pct >= 70 THEN 'trend' ELSE 'mixed' END"
OBSERVED = f"""ob AS (SELECT kind AS k, {STYLE} AS v FROM sy UNION ALL SELECT 'visibility', visibility FROM sy), oc AS (SELECT k, v, count(*) AS n FROM ob GROUP BY 1, 2), ot AS (SELECT k, max(n) AS top, sum(n) AS total FROM oc GROUP BY 1),
    od AS (SELECT k AS category, max(v) AS dominant, max(n) AS n, max(total)::BIGINT AS total, round(max(n) * 100.0 / max(total), 4) AS pct FROM oc JOIN ot USING (k) WHERE n = top GROUP BY k HAVING count(*) = 1), conv AS (SELECT *, {STRENGTH} AS strength FROM od WHERE pct >= 50)"""


def observations(spark, d):
    s = cb.symbols(spark, d)
    rows = s.select(F.col("kind").alias("category"), conventions.style(F.col("name")).alias("value")).unionByName(s.select(F.lit("visibility").alias("category"), F.col("visibility").alias("value")))
    return conventions.dominant(rows, "category", "value")


@query(f"WITH {CODE}, {OBSERVED} SELECT * FROM conv")
def naming_conventions(spark, d):
    return observations(spark, d)


@query(f"WITH {CODE}, {OBSERVED} SELECT category, dominant FROM conv WHERE pct >= 70")
def conventions_by_strength(spark, d):
    return observations(spark, d).where("pct >= 70").select("category", "dominant")


DEAD = "dead AS (SELECT path, name FROM sy WHERE kind = 'function' AND visibility = 'private' AND lower(name) NOT IN (SELECT lower(name) FROM sy WHERE visibility = 'public'))"


CYC = f"{rel.SQL['edges']}, cyc AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE edge_type = 'import'), rr(a, b) AS (SELECT src, dst FROM cyc UNION SELECT a, dst FROM rr JOIN cyc ON b = src), scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM rr x JOIN rr y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"
MODS = "mods AS (SELECT n_name AS path, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"
METRICS = f"""mf AS (SELECT module, count(*) AS n_files FROM mods GROUP BY 1 HAVING count(*) >= 3), mo AS (SELECT a.module, count(*) AS e, count(*) FILTER (WHERE a.module = b.module) AS i FROM edges JOIN mods a ON src = a.path LEFT JOIN mods b ON dst = b.path GROUP BY 1),
    mm AS (SELECT module, n_files, coalesce(e, 0) AS edges, CASE WHEN coalesce(e, 0) = 0 THEN 0.0 ELSE (e - i) / e::DOUBLE END AS coupling, coalesce(i, 0) / (n_files * (n_files - 1))::DOUBLE AS cohesion FROM mf LEFT JOIN mo USING (module))"""


def _modules(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("path"), F.col("r_name").alias("module"))


def _metrics(spark, d):
    return health.module_metrics(_modules(spark, d), rel.trade_edges(spark, d))


@query(
    f"""WITH RECURSIVE {CODE}, {OBSERVED}, {HIST}, {rel.SQL['files']}, {CHURN}, {DEAD}, {CYC}, {MODS}, {METRICS}, sc AS (SELECT
    (SELECT avg(CASE strength WHEN 'convention' THEN 10.0 WHEN 'trend' THEN 7.0 ELSE 5.0 END) FROM conv) AS conventions,
    (SELECT avg(CASE WHEN {INLINE} OR path IN (SELECT source FROM tm) THEN 1.0 ELSE 0.0 END) * 10 FROM fl WHERE {IS_CODE} AND NOT {TEST_SQL['health']}) AS test_coverage,
    10 * (1 - least((SELECT count(*) FROM churn WHERE churn_30d > 10) / (SELECT count(*) FROM files)::DOUBLE, 1.0)) AS churn_stability,
    (SELECT (1 - avg(coupling)) * 10 FROM mm) AS coupling, 10.0 / (1 + (SELECT count(DISTINCT component) FROM scc)) AS cycles, 10 * (1 - (SELECT count(*) FROM dead) / (SELECT count(*) FROM sy)::DOUBLE) AS dead_code)
    SELECT round(conventions, 6) AS conventions, round(test_coverage, 6) AS test_coverage, round(churn_stability, 6) AS churn_stability, round(coupling, 6) AS coupling, round(cycles, 6) AS cycles, round(dead_code, 6) AS dead_code,
    round(0.2 * conventions + 0.2 * test_coverage + 0.15 * churn_stability + 0.2 * coupling + 0.15 * cycles + 0.1 * dead_code, 5) AS composite FROM sc"""
)
def health_score(spark, d):
    from graphloom.operators import history
    from graphloom.plans.queries import _cyclic

    files = cb.files(spark, d)
    got = health.health(
        {
            "conventions": health.conventions_score(observations(spark, d)),
            "test_coverage": health.coverage_score(files, cb.test_map(spark, d)),
            "churn_stability": health.stability_score(rel.files(spark, d), history.churn(rel.history(spark, d))),
            "coupling": _metrics(spark, d).agg(((1 - F.avg("coupling")) * 10).alias("score")),
            "cycles": health.cycles_score(graphs.components(_cyclic(spark, d))),
            "dead_code": health.unused_score(cb.symbols(spark, d), cb.parts(table(spark, d, "lineitem"))),
        }
    )
    return got.select(*[F.round(c, 6).alias(c) for c in health.WEIGHTS], F.round("composite", 5).alias("composite"))


@query(f"WITH {rel.SQL['edges']}, {MODS}, {METRICS} SELECT module, n_files, edges, round(coupling, 6) AS coupling, round(cohesion, 6) AS cohesion FROM mm")
def module_metrics(spark, d):
    return _metrics(spark, d).select("module", "n_files", "edges", F.round("coupling", 6).alias("coupling"), F.round("cohesion", 6).alias("cohesion"))


@query(f"WITH {rel.SQL['edges']}, {MODS}, {METRICS} SELECT count(*) AS module_count, round(avg(coupling), 6) AS mean_coupling, round(avg(cohesion), 6) AS mean_cohesion FROM mm")
def drift_metrics(spark, d):
    return health.snapshot(_metrics(spark, d)).select("module_count", F.round("mean_coupling", 6).alias("mean_coupling"), F.round("mean_cohesion", 6).alias("mean_cohesion"))


@query(f"WITH {rel.SQL['edges']}, {MODS}, {METRICS} SELECT module, 'High coupling: ' || format('{{:.2f}}', coupling) AS issue, round(coupling, 6) AS severity FROM mm WHERE coupling > 0.6")
def drift_hotspots(spark, d):
    return health.hotspots(_metrics(spark, d)).select("module", "issue", F.round("severity", 6).alias("severity"))


YEARS = "sn AS (SELECT year(l_shipdate) AS ts, count(DISTINCT l_suppkey) AS module_count, avg(l_discount) AS mean_coupling, avg(l_tax) AS mean_cohesion FROM lineitem GROUP BY 1)"


@query(f"WITH {YEARS} SELECT a.module_count - b.module_count AS module_count_delta, round(a.mean_coupling - b.mean_coupling, 6) AS mean_coupling_delta, round(a.mean_cohesion - b.mean_cohesion, 6) AS mean_cohesion_delta FROM sn a, sn b WHERE a.ts = (SELECT max(ts) FROM sn) AND b.ts = (SELECT min(ts) FROM sn) AND (SELECT count(*) FROM sn) >= 2")
def drift_trend(spark, d):
    snaps = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("ts")).agg(F.countDistinct("l_suppkey").alias("module_count"), F.avg("l_discount").alias("mean_coupling"), F.avg("l_tax").alias("mean_cohesion"))
    t = health.trend(snaps)
    return t.select("module_count_delta", F.round("mean_coupling_delta", 6).alias("mean_coupling_delta"), F.round("mean_cohesion_delta", 6).alias("mean_cohesion_delta"))


@query(
    f"""WITH {CODE}, p AS (SELECT path, count(*) AS public FROM sy WHERE visibility = 'public' GROUP BY 1), i AS (SELECT dst AS path, count(*) AS inbound FROM im GROUP BY 1),
    r AS (SELECT path, coalesce(public, 0) AS public, coalesce(inbound, 0) AS inbound, path NOT IN (SELECT source FROM tm) AS open FROM fl LEFT JOIN p USING (path) LEFT JOIN i USING (path)), m AS (SELECT max(public) * max(inbound) AS top FROM r)
    SELECT path, public, inbound, round(least(public * inbound / top::DOUBLE, 1.0), 6) AS score FROM r, m WHERE open AND public * inbound > 0"""
)
def exposure_scores(spark, d):
    return health.exposure(cb.files(spark, d), cb.symbols(spark, d), cb.imports(spark, d), cb.test_map(spark, d))


# ---------------------------------------------------------------- signals

WORDS = ["load", "user", "ring", "part"]
_Q = _list(WORDS)
_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace({0}, '(\p{{Lu}})', '_\1', 'g'), '_+'), lambda p: lower(p)), lambda p: strlen(p) >= 2)"
_ONE = _PARTS.format("w")
TOKENS = r"list_distinct(flatten(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN len(" + _ONE.replace("{", "{{").replace("}", "}}") + ") > 0 THEN " + _ONE.replace("{", "{{").replace("}", "}}") + " WHEN strlen(w) >= 2 THEN [lower(w)] ELSE [] END)))"
PATH_TOKENS = r"list_distinct(flatten(list_transform(string_split_regex(path, '[/._\-]'), lambda w: " + _ONE + ")))"
SYMBOL_SQL = f"sm AS (SELECT path, max(CASE WHEN len(t) > 0 THEN len(list_intersect(t, {_Q})) / len(list_distinct(list_concat(t, {_Q})))::DOUBLE ELSE 0.0 END) AS symbol_match FROM (SELECT path, {TOKENS.format('name')} AS t FROM sy) GROUP BY path)"
PROX_SQL = r"""ims AS (SELECT src AS path, regexp_replace(dst, '\.[a-z]+$', '') AS source FROM im), io AS (SELECT path, count(*) AS o FROM ims GROUP BY 1),
    ip AS (SELECT DISTINCT path AS by_, unnest(list_distinct(string_split_regex(lower(source), '[:/.\\]'))) AS stem FROM ims), ist AS (SELECT path, lower(split_part(split_part(path, '/', -1), '.', 1)) AS stem FROM fl),
    ii AS (SELECT ist.path, count(DISTINCT by_) AS i FROM ist JOIN ip USING (stem) WHERE ist.path <> by_ AND strlen(ist.stem) >= 2 GROUP BY 1), px AS (SELECT path, least(coalesce(o, 0) + coalesce(i, 0), 10) / 10.0 AS import_proximity FROM fl LEFT JOIN io USING (path) LEFT JOIN ii USING (path))"""
SIM_SQL = f"ps AS (SELECT path, CASE WHEN len(t) > 0 THEN 0.7 * len(list_intersect(t, {_Q})) / {len(WORDS)}.0 + 0.3 * len(list_intersect(t, {_Q})) / len(t) ELSE 0.0 END AS path_similarity FROM (SELECT path, {PATH_TOKENS} AS t FROM fl))"
TF_SQL = r"tf AS (SELECT path, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: list_contains(" + _Q + r", x))) / len(t)::DOUBLE ELSE 0.0 END AS term_frequency FROM (SELECT path, flatten(list_transform(list_filter(string_split_regex(content, '[^\p{L}\p{N}_]+'), lambda w: strlen(w) >= 2), lambda w: " + _ONE.replace("{{", "{").replace("}}", "}") + ")) AS t FROM fl))"
AGE_SQL = "ag AS (SELECT fl.path, min(hist.age) AS age FROM hist JOIN fl ON hist.path = 'p' || fl.key GROUP BY 1), rc AS (SELECT path, coalesce(least(greatest(1 - age / 90.0, 0.0), 1.0), 0.5) AS recency_boost FROM fl LEFT JOIN ag USING (path))"


def _pagerank(rounds: int) -> str:
    steps = ["q0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS r FROM pn)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"q{i} AS (SELECT b.node, 0.15 * b.t + 0.85 * (coalesce(x, 0) + (SELECT coalesce(sum(r), 0) FROM q{i - 1} JOIN pb USING (node) WHERE deg IS NULL) * b.t) AS r FROM pb b LEFT JOIN (SELECT dst AS node, sum(r / deg) AS x FROM q{i - 1} JOIN pb USING (node) JOIN im ON src = node WHERE deg IS NOT NULL GROUP BY dst) f USING (node))"
        )
    return f"pn AS (SELECT DISTINCT src AS node FROM im UNION SELECT dst FROM im), pb AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS t, deg FROM pn LEFT JOIN (SELECT src AS node, count(*) AS deg FROM im GROUP BY src) USING (node)), {', '.join(steps)}, pr AS (SELECT node AS path, r / (SELECT max(r) FROM q{rounds}) AS pagerank FROM q{rounds})"


ROUNDS = 4
SIGNAL_SQL = f"{HIST}, {CODE}, {SYMBOL_SQL}, {PROX_SQL}, {SIM_SQL}, {TF_SQL}, {AGE_SQL}, {_pagerank(ROUNDS)}"


def _imports_as_written(spark, d):
    return _as_written(cb.imports(spark, d))


def _as_written(edges):
    return edges.select(F.col("src").alias("path"), F.regexp_replace("dst", r"\.[a-z]+$", "").alias("source"))


def _last_change(spark, d):
    keyed = cb.files(spark, d).select(F.concat(F.lit("p"), F.col("key").cast("string")).alias("p"), "path")
    return rel.history(spark, d).groupBy(F.col("path").alias("p")).agg(F.min("age").alias("age")).join(keyed, "p").select("path", "age")


def _rank(spark, d):
    keyed = cb.keyed_imports(spark, d)
    if keyed is None:
        return graphs.pagerank(cb.imports(spark, d), ROUNDS, tol=None)
    found = graphs.pagerank(keyed, ROUNDS, tol=None)
    return found.join(cb.files(spark, d).select("key", "path"), F.col("node") == F.col("key")).select(F.col("path").alias("node"), "score")


def _scored(spark, d, fused):
    edges = written(cb.imports(spark, d))
    return signals.score_all(cb.files(spark, d), cb.symbols(spark, d), _as_written(edges), _last_change(spark, d), graphs.pagerank(edges, ROUNDS, tol=None), WORDS, fused=fused)


@query(f"WITH {CODE}, {SYMBOL_SQL} SELECT path, round(symbol_match, 6) AS score FROM sm")
def symbol_match_signal(spark, d):
    return signals.symbol_match(cb.symbols(spark, d), WORDS).select("path", F.round("symbol_match", 6).alias("score"))


@query(f"WITH {CODE}, {PROX_SQL} SELECT path, import_proximity AS score FROM px")
def import_proximity_signal(spark, d):
    return signals.import_proximity(cb.files(spark, d), _imports_as_written(spark, d)).select("path", F.col("import_proximity").alias("score"))


_NAMES = list(signals.WEIGHTS)[:6]
_JOINED = "js AS (SELECT fl.path, path_similarity, coalesce(symbol_match, 0.0) AS symbol_match, import_proximity, term_frequency, recency_boost, coalesce(pagerank, 0.0) AS pagerank FROM fl JOIN ps USING (path) LEFT JOIN sm USING (path) JOIN px USING (path) JOIN tf USING (path) JOIN rc USING (path) LEFT JOIN pr USING (path))"
_SUM = " + ".join(f"{signals.WEIGHTS[n]} * {n}" for n in _NAMES)


@query(f"WITH {SIGNAL_SQL}, {_JOINED} SELECT path, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)}, 0.0::DOUBLE AS embedding_similarity, 0.0::DOUBLE AS identifier_rank, round({_SUM}, 5) AS score FROM js")
def score_all(spark, d):
    got = _scored(spark, d, False)
    return got.select("path", *[F.round(n, 6).alias(n) for n in signals.WEIGHTS], "identifier_rank", F.round("score", 5).alias("score"))


_RRF = " + ".join(f"{signals.WEIGHTS[n]} * 61.0 / (60 + rank() OVER (ORDER BY {n} DESC))" for n in _NAMES[:4])


@query(f"WITH {CODE}, {SYMBOL_SQL}, {PROX_SQL}, {SIM_SQL}, {TF_SQL}, js AS (SELECT fl.path, path_similarity, coalesce(symbol_match, 0.0) AS symbol_match, import_proximity, term_frequency FROM fl JOIN ps USING (path) LEFT JOIN sm USING (path) JOIN px USING (path) JOIN tf USING (path)) SELECT path, round({_RRF}, 6) AS score FROM js")
def score_all_fused(spark, d):
    from graphloom.operators import retrieval

    files, edges = written(cb.files(spark, d).select("path", "content")), written(cb.imports(spark, d))
    rows = signals.path_similarity(files, WORDS).join(signals.symbol_match(cb.symbols(spark, d), WORDS), "path", "left").join(signals.import_proximity(files, _as_written(edges)), "path").join(signals.term_frequency(files, WORDS), "path").fillna(0.0)
    return retrieval.fuse(rows, {n: signals.WEIGHTS[n] for n in _NAMES[:4]})


DOCTERMS = "dt AS (SELECT DISTINCT path, unnest(string_split_regex(lower(content), '[^a-z0-9_]+')) AS term FROM fl)"
DEFS = "df AS (SELECT lower(name) AS k, count(*) AS definitions FROM sy GROUP BY 1)"
IMPORTANCE = "du AS (SELECT term, count(*) AS n, min(path) AS one FROM dt GROUP BY 1), si AS (SELECT sy.*, CASE WHEN visibility <> 'public' THEN 0.3 WHEN coalesce(n > 1 OR one <> path, false) THEN 1.0 ELSE 0.7 END AS importance FROM sy LEFT JOIN du ON lower(name) = term)"


#: With the parts of its words, and the names that its neighbours declare, a file's terms are those by which it refers to a symbol.
NAMED = f"""dn AS (SELECT path, unnest({TOKENS.format('content')}) AS term FROM fl UNION ALL SELECT path, term FROM dt UNION ALL SELECT n.path, lower(name) FROM (SELECT src AS path, dst AS by_ FROM im UNION SELECT dst, src FROM im) n JOIN sy ON sy.path = by_),
    du AS (SELECT term, min(path) AS lo, max(path) AS hi FROM dn GROUP BY 1), si AS (SELECT sy.*, CASE WHEN visibility <> 'public' THEN 0.3 WHEN coalesce(lo <> path OR hi <> path, false) THEN 1.0 ELSE 0.7 END AS importance FROM sy LEFT JOIN du ON lower(name) = term)"""


def _terms(spark, d):
    """Terms of the files: each file's words."""
    return cb.files(spark, d).select("path", F.explode(F.split(F.lower("content"), "[^a-z0-9_]+")).alias("term")).distinct()


def named_terms(files):
    """``path, term``: each file's words and their parts; a term may come more than once."""
    # the words of a file that are repeated are split once
    parts = signals.tokens(F.array_join(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_]+")), " "))
    return files.select("path", F.explode(F.concat(F.split(F.lower("content"), "[^a-z0-9_]+"), parts)).alias("term"))


@query(f"WITH {CODE}, {DEFS} SELECT k AS name, definitions AS n FROM df")
def symbol_definitions(spark, d):
    return cb.symbols(spark, d).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {CF}, {DOCTERMS} SELECT term, count(*) AS n FROM dt GROUP BY 1")
def cross_references(spark, d):
    return _terms(spark, d).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {CODE}, {DOCTERMS}, {NAMED} SELECT path, name, kind, start_line, importance::DOUBLE AS importance FROM si")
def symbol_importance(spark, d):
    return signals.symbol_importance(written(cb.symbols(spark, d)), named_terms(cb.files(spark, d)), cb.imports(spark, d)).select("path", "name", "kind", "start_line", "importance")


@query(
    f"""WITH {CODE}, {DOCTERMS}, {IMPORTANCE}, {DEFS}, {_pagerank(ROUNDS)}, s AS (SELECT si.path, name, definitions, importance / sum(importance) OVER (PARTITION BY si.path) AS share, greatest(coalesce(pagerank, 0.0), 0.05) AS pr FROM si JOIN df ON lower(name) = k LEFT JOIN pr ON si.path = pr.path),
    z AS (SELECT path, name, definitions, pr * share * (CASE WHEN len(list_intersect({TOKENS.format('name')}, {_Q})) > 0 THEN 10.0 ELSE 1.0 END) * (CASE WHEN definitions > 5 THEN 0.1 ELSE 1.0 END) * (CASE WHEN starts_with(name, '_') THEN 0.1 ELSE 1.0 END) AS score FROM s)
    SELECT path, name, definitions, round(score, 6) AS score FROM z"""
)
def identifier_ranking(spark, d):
    got = signals.identifier_ranking(written(cb.symbols(spark, d)), _terms(spark, d), _rank(spark, d), WORDS)
    return got.select("path", "name", "definitions", F.round("score", 6).alias("score"))


# seeds over simple scores

SIMPLE = "sc AS (SELECT path, round((key * 37 % 1000) / 1000.0, 6) * 0.3 AS score FROM fl)"


def _simple(spark, d):
    return cb.files(spark, d).select("path", (F.round((F.col("key") * 37 % 1000) / 1000.0, 6) * 0.3).alias("score"))


def _seeds_sql() -> str:
    steps = ["t0 AS (SELECT path, score AS turn FROM sc WHERE score >= 0.1)", "pp AS (SELECT src AS path, dst AS t FROM im UNION SELECT dst, src FROM im)", "ri AS (SELECT pp.path, t FROM pp JOIN t0 a ON pp.path = a.path JOIN t0 b ON t = b.path WHERE pp.path < t)"]
    for i in range(1, signals.LIFTS + 1):
        steps.append(f"t{i} AS (SELECT t0.path, greatest(t0.turn, coalesce(l, 0.0)) AS turn FROM t0 LEFT JOIN (SELECT t AS path, max(turn) * 0.7 AS l FROM ri JOIN t{i - 1} USING (path) GROUP BY 1) USING (path))")
    return ", ".join(steps) + f", fan AS (SELECT t AS path, max(turn) * 0.7 AS fan FROM t{signals.LIFTS} JOIN pp USING (path) GROUP BY 1), sd AS (SELECT path, greatest(coalesce(turn, 0.0), coalesce(fan, 0.0)) AS score, turn IS NOT NULL AS hit FROM t0 FULL JOIN fan USING (path) ORDER BY score DESC, path LIMIT 50)"


SEEDS = f"{SIMPLE}, {_seeds_sql()}"


@query(f"WITH {CODE}, {SEEDS} SELECT path, round(score, 6) AS score, hit FROM sd")
def seed_selection(spark, d):
    return signals.seeds(_simple(spark, d), cb.imports(spark, d)).select("path", F.round("score", 6).alias("score"), "hit")


@query(f"WITH {CF}, {SIMPLE}, b AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS place FROM sc ORDER BY score DESC, path LIMIT 30), j AS (SELECT b.path, row_number() OVER (ORDER BY tokens DESC, b.path) AS place FROM b JOIN fl USING (path)), m AS (SELECT j.path, b.score FROM j JOIN b USING (place)) SELECT sc.path, round(coalesce(m.score, sc.score), 6) AS score FROM sc LEFT JOIN m USING (path)")
def rerank_top(spark, d):
    joint = cb.files(spark, d).select("path", F.col("tokens").cast("double").alias("joint"))
    return signals.rerank(_simple(spark, d), joint, 30).select("path", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- budgets

_LT = "list_transform({0}, lambda x: CAST(ceil((length(x) + 1) / 4.0) AS BIGINT))"
_LINES = "string_split(regexp_replace({0}, '\\n$', ''), chr(10))"


@query("WITH b AS (SELECT p_partkey AS id, CAST(p_size * 100 AS BIGINT) AS budget FROM part), r AS (SELECT *, greatest(budget - 500, 0) AS rest FROM b) SELECT id, least(budget, 500)::BIGINT AS metadata, " + ", ".join(f"floor(rest * {v})::BIGINT AS {k}" for k, v in packing.SECTIONS.items()) + " FROM r")
def budget_sections(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), packing.sections((F.col("p_size") * 100).cast("long")).alias("s")).select("id", "s.*")


@query(
    f"""WITH {CF}, t AS (SELECT path, {_LT.format(_LINES.format('content'))} AS t FROM fl), n AS (SELECT path, t, list_sum(t)::BIGINT AS n FROM t), u AS (SELECT path, n, unnest(t) + 1 AS x, unnest(range(1, len(t) + 1)) AS i FROM n),
    c AS (SELECT path, n, sum(x) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM u), f AS (SELECT path, n, coalesce(max(run) FILTER (WHERE run <= 20), 0)::BIGINT AS fit FROM c GROUP BY 1, 2)
    SELECT path, CASE WHEN n <= 170 THEN n ELSE fit END AS used, n - CASE WHEN n <= 170 THEN n ELSE fit END AS omitted FROM f"""
)
def truncate_lines(spark, d):
    return packing.truncate(cb.files(spark, d), 170)


PACK_BUDGET = 150
CONV = f"cv AS (SELECT conv_id, 't' || turn AS path, -CAST(turn AS DOUBLE) AS score, {_LT.format(_LINES.format('text'))} AS t FROM conversations), cr AS (SELECT *, list_sum(t)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, path) AS i FROM cv)"


def _conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), (-F.col("turn").cast("double")).alias("score"), F.col("text").alias("content"))


_PREFIX = "list_transform(range(1, len(t) + 1), lambda k: list_sum(t[:k])::BIGINT)"
_CUT = "coalesce(list_max(list_filter(p, lambda r: r <= left_ - 5)), 0)"
PACK = f"""{CONV}, cp AS (SELECT *, {_PREFIX} AS p FROM cr), pk(conv_id, i, path, score, tokens, level, left_) AS (SELECT conv_id, 0::BIGINT, NULL::VARCHAR, NULL::DOUBLE, 0::BIGINT, NULL::VARCHAR, {PACK_BUDGET}::BIGINT FROM (SELECT DISTINCT conv_id FROM cp)
    UNION ALL SELECT c.conv_id, c.i, c.path, c.score, u, l, left_ - u FROM (SELECT cp.conv_id, cp.i, cp.path, cp.score, pk.left_, CASE WHEN n <= pk.left_ THEN n WHEN {_CUT} > 0 THEN least({_CUT} + 5, pk.left_) ELSE 0 END AS u, CASE WHEN n <= pk.left_ THEN 'full' ELSE 'truncated' END AS l FROM pk JOIN cp ON cp.conv_id = pk.conv_id AND cp.i = pk.i + 1 WHERE pk.left_ > 0) c),
    packed AS (SELECT conv_id, path, score, tokens, level FROM pk WHERE i > 0)"""


@query(f"WITH RECURSIVE {PACK} SELECT * FROM packed")
def fill_pack(spark, d):
    return packing.fill(_conversations(spark, d), "conv_id", PACK_BUDGET)


@query(f"WITH RECURSIVE {PACK} SELECT conv_id, count(*) AS relevant, count(tokens) AS covered, round(count(tokens) / count(*)::DOUBLE, 6) AS coverage, round(coalesce(sum(tokens), 0) / {PACK_BUDGET}.0, 6) AS utilisation, min(c.score) FILTER (WHERE tokens IS NOT NULL) AS lowest_in, max(c.score) FILTER (WHERE tokens IS NULL) AS highest_out FROM cv c LEFT JOIN packed USING (conv_id, path) GROUP BY conv_id")
def efficiency_report(spark, d):
    c = _conversations(spark, d)
    return packing.efficiency(c, packing.fill(c, "conv_id", PACK_BUDGET), "conv_id", PACK_BUDGET)


@query(
    f"""WITH RECURSIVE {CONV}, gs(conv_id, i, path, tokens, taken, left_) AS (SELECT DISTINCT conv_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, false, 120::BIGINT FROM cr
    UNION ALL SELECT cr.conv_id, cr.i, cr.path, cr.n, cr.n <= gs.left_, CASE WHEN cr.n <= gs.left_ THEN gs.left_ - cr.n ELSE gs.left_ END FROM gs JOIN cr ON cr.conv_id = gs.conv_id AND cr.i = gs.i + 1) SELECT conv_id, path, tokens FROM gs WHERE taken"""
)
def api_budget_trim(spark, d):
    rows = _conversations(spark, d).withColumn("tokens", packing.total(packing.line_tokens(packing.lines_of(F.col("content")))))
    return packing.greedy_skip(rows, "conv_id", -F.col("score"), 120)
