"""Queries of the code layer over a small repository built here; rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code, graphs
from graphloom.plans.queries import query, written_out
from graphloom.sources import relations as rel

FILES = [
    ("src/app.py", "from .db import load_user\nfrom .util import clean\n\n@app.get('/users/<id>')\ndef show(id):\n    row = load_user(id)\n    return clean(row)\n\ndef unused():\n    return 1\n\ndef main():\n    show(1)\n"),
    ("src/db.py", "from .util import clean\n\ndef load_user(id):\n    return query('select name from users where id = 1')\n\ndef query(sql):\n    return clean(sql)\n"),
    ("src/util.py", "def clean(x):\n    return _strip(x)\n\ndef _strip(x):\n    return x\n"),
    ("tests/test_db.py", "from src.db import load_user\n\ndef test_load():\n    assert load_user(1)\n"),
    ("tests/test_util.py", "def test_clean():\n    pass\n"),
    ("web/client.js", "import { h } from './h'\nexport function load(id) {\n  return fetch('/users/:id')\n}\n"),
    ("web/h.js", "export function h(x) {\n  return x\n}\n"),
    ("schema/users.sql", "CREATE TABLE users (\n  id INT PRIMARY KEY,\n  name VARCHAR(20) NOT NULL DEFAULT 'x',\n  team_id INT REFERENCES teams(id)\n);\n"),
    ("schema/teams.sql", "CREATE TABLE teams (id INT, title TEXT, PRIMARY KEY (id));\n"),
    ("src/lib.rs", "use crate::auth::token;\npub fn run() {\n    token();\n}\n"),
    ("src/auth.rs", "pub fn token() {\n}\n"),
    ("dist/app.min.js", "x"),
    ("src/gen.py", "# DO NOT EDIT\nx = 1\n"),
    ("Makefile", "all:\n\techo\n"),
]


#: The rows that the repository above must give, checked by hand.
EXPECTED = {
    "language_detection": (
        "path, language",
        ('Makefile', 'makefile'),
        ('dist/app.min.js', 'javascript'),
        ('schema/teams.sql', 'sql'),
        ('schema/users.sql', 'sql'),
        ('src/app.py', 'python'),
        ('src/auth.rs', 'rust'),
        ('src/db.py', 'python'),
        ('src/gen.py', 'python'),
        ('src/lib.rs', 'rust'),
        ('src/util.py', 'python'),
        ('tests/test_db.py', 'python'),
        ('tests/test_util.py', 'python'),
        ('web/client.js', 'javascript'),
        ('web/h.js', 'javascript'),
    ),
    "parse_symbols": (
        "path, language, ord, name, kind, visibility, signature, start_line, end_line",
        ('schema/teams.sql', 'sql', 0, 'teams', 'table', 'public', 'CREATE TABLE teams (id INT, title TEXT, PRIMARY KEY (id));', 1, 2),
        ('schema/users.sql', 'sql', 0, 'users', 'table', 'public', 'CREATE TABLE users (', 1, 3),
        ('src/app.py', 'python', 0, 'show', 'function', 'public', 'def show(id):', 5, 7),
        ('src/app.py', 'python', 1, 'unused', 'function', 'public', 'def unused():', 9, 10),
        ('src/app.py', 'python', 2, 'main', 'function', 'public', 'def main():', 12, 13),
        ('src/auth.rs', 'rust', 0, 'token', 'function', 'public', 'pub fn token() {', 1, 2),
        ('src/db.py', 'python', 0, 'load_user', 'function', 'public', 'def load_user(id):', 3, 4),
        ('src/db.py', 'python', 1, 'query', 'function', 'public', 'def query(sql):', 6, 7),
        ('src/lib.rs', 'rust', 0, 'run', 'function', 'public', 'pub fn run() {', 2, 4),
        ('src/util.py', 'python', 0, 'clean', 'function', 'public', 'def clean(x):', 1, 2),
        ('src/util.py', 'python', 1, '_strip', 'function', 'private', 'def _strip(x):', 4, 5),
        ('tests/test_db.py', 'python', 0, 'test_load', 'function', 'public', 'def test_load():', 3, 4),
        ('tests/test_util.py', 'python', 0, 'test_clean', 'function', 'public', 'def test_clean():', 1, 2),
        ('web/client.js', 'javascript', 0, 'load', 'function', 'public', 'export function load(id) {', 2, 4),
        ('web/h.js', 'javascript', 0, 'h', 'function', 'public', 'export function h(x) {', 1, 3),
    ),
    "import_resolution": (
        "src, dst",
        ('src/app.py', 'src/db.py'),
        ('src/app.py', 'src/util.py'),
        ('src/db.py', 'src/util.py'),
        ('src/lib.rs', 'src/auth.rs'),
        ('tests/test_db.py', 'src/db.py'),
        ('web/client.js', 'web/h.js'),
    ),
    "call_graph": (
        "caller_path, caller, callee, callee_path, confidence",
        ('src/app.py', 'main', 'show', 'src/app.py', 'exact'),
        ('src/app.py', 'show', 'clean', 'src/util.py', 'exact'),
        ('src/app.py', 'show', 'load_user', 'src/db.py', 'exact'),
        ('src/db.py', 'load_user', 'query', 'src/db.py', 'exact'),
        ('src/db.py', 'query', 'clean', 'src/util.py', 'exact'),
        ('src/lib.rs', 'run', 'token', 'src/auth.rs', 'exact'),
        ('src/util.py', 'clean', '_strip', 'src/util.py', 'exact'),
        ('tests/test_db.py', 'test_load', 'load_user', 'src/db.py', 'exact'),
        ('web/client.js', 'load', 'fetch', None, 'unresolved'),
    ),
    "test_map": (
        "source, test, confidence",
        ('src/db.py', 'tests/test_db.py', 'both'),
        ('src/util.py', 'tests/test_util.py', 'name_match'),
    ),
    "dead_code": (
        "path, name, visibility, start_line, liveness",
        ('src/app.py', 'unused', 'public', 9, 0.59546),
        ('src/lib.rs', 'run', 'public', 2, 0.59546),
        ('web/client.js', 'load', 'public', 2, 0.59546),
        ('web/h.js', 'h', 'public', 1, 1.101602),
    ),
    "schema_columns": (
        "path, tab, ord, col, type, nullable, dflt, fk_table, fk_column, in_key",
        ('schema/teams.sql', 'teams', 0, 'id', 'int', False, None, None, None, True),
        ('schema/teams.sql', 'teams', 1, 'title', 'text', True, None, None, None, False),
        ('schema/users.sql', 'users', 0, 'id', 'int', False, None, None, None, True),
        ('schema/users.sql', 'users', 1, 'name', 'varchar(20)', False, "'x'", None, None, False),
        ('schema/users.sql', 'users', 2, 'team_id', 'int', True, None, 'teams', 'id', False),
    ),
    "schema_edges": (
        "src, dst, edge_type",
        ('schema/users.sql', 'schema/teams.sql', 'foreign_key'),
        ('src/db.py', 'schema/users.sql', 'embedded_sql'),
    ),
    "route_detection": (
        "path, framework, method, route",
        ('src/app.py', 'flask', 'GET', '/users/{}'),
    ),
    "http_bridges": (
        "src, dst, edge_type",
        ('web/client.js', 'src/app.py', 'cross_language:HttpCall'),
    ),
    "containing_symbol": (
        "path, line, symbol",
        ('Makefile', 1, '<module>'),
        ('Makefile', 2, '<module>'),
        ('Makefile', 3, '<module>'),
        ('dist/app.min.js', 1, '<module>'),
        ('schema/teams.sql', 1, 'teams'),
        ('schema/teams.sql', 2, 'teams'),
        ('schema/users.sql', 1, 'users'),
        ('schema/users.sql', 2, 'users'),
        ('schema/users.sql', 3, 'users'),
        ('schema/users.sql', 4, '<module>'),
        ('schema/users.sql', 5, '<module>'),
        ('schema/users.sql', 6, '<module>'),
        ('src/app.py', 1, '<module>'),
        ('src/app.py', 10, 'unused'),
        ('src/app.py', 11, '<module>'),
        ('src/app.py', 12, 'main'),
        ('src/app.py', 13, 'main'),
        ('src/app.py', 14, '<module>'),
        ('src/app.py', 2, '<module>'),
        ('src/app.py', 3, '<module>'),
        ('src/app.py', 4, '<module>'),
        ('src/app.py', 5, 'show'),
        ('src/app.py', 6, 'show'),
        ('src/app.py', 7, 'show'),
        ('src/app.py', 8, '<module>'),
        ('src/app.py', 9, 'unused'),
        ('src/auth.rs', 1, 'token'),
        ('src/auth.rs', 2, 'token'),
        ('src/auth.rs', 3, '<module>'),
        ('src/db.py', 1, '<module>'),
        ('src/db.py', 2, '<module>'),
        ('src/db.py', 3, 'load_user'),
        ('src/db.py', 4, 'load_user'),
        ('src/db.py', 5, '<module>'),
        ('src/db.py', 6, 'query'),
        ('src/db.py', 7, 'query'),
        ('src/db.py', 8, '<module>'),
        ('src/gen.py', 1, '<module>'),
        ('src/gen.py', 2, '<module>'),
        ('src/gen.py', 3, '<module>'),
        ('src/lib.rs', 1, '<module>'),
        ('src/lib.rs', 2, 'run'),
        ('src/lib.rs', 3, 'run'),
        ('src/lib.rs', 4, 'run'),
        ('src/lib.rs', 5, '<module>'),
        ('src/util.py', 1, 'clean'),
        ('src/util.py', 2, 'clean'),
        ('src/util.py', 3, '<module>'),
        ('src/util.py', 4, '_strip'),
        ('src/util.py', 5, '_strip'),
        ('src/util.py', 6, '<module>'),
        ('tests/test_db.py', 1, '<module>'),
        ('tests/test_db.py', 2, '<module>'),
        ('tests/test_db.py', 3, 'test_load'),
        ('tests/test_db.py', 4, 'test_load'),
        ('tests/test_db.py', 5, '<module>'),
        ('tests/test_util.py', 1, 'test_clean'),
        ('tests/test_util.py', 2, 'test_clean'),
        ('tests/test_util.py', 3, '<module>'),
        ('web/client.js', 1, '<module>'),
        ('web/client.js', 2, 'load'),
        ('web/client.js', 3, 'load'),
        ('web/client.js', 4, 'load'),
        ('web/client.js', 5, '<module>'),
        ('web/h.js', 1, 'h'),
        ('web/h.js', 2, 'h'),
        ('web/h.js', 3, 'h'),
        ('web/h.js', 4, '<module>'),
    ),
    "data_flow_paths": (
        "nodes, truncated",
        ('src/app.py::main > src/app.py::show > src/db.py::load_user > src/db.py::query > src/util.py::clean > src/util.py::_strip', False),
        ('src/app.py::main > src/app.py::show > src/util.py::clean > src/util.py::_strip', False),
    ),
    "onboarding_phases": (
        "pos, path, phase",
        (0, 'Makefile', 0),
        (1, 'dist/app.min.js', 0),
        (10, 'src/db.py', 2),
        (11, 'web/client.js', 2),
        (12, 'src/app.py', 3),
        (13, 'tests/test_db.py', 3),
        (2, 'schema/teams.sql', 0),
        (3, 'schema/users.sql', 0),
        (4, 'src/auth.rs', 1),
        (5, 'src/gen.py', 1),
        (6, 'src/util.py', 1),
        (7, 'tests/test_util.py', 1),
        (8, 'web/h.js', 2),
        (9, 'src/lib.rs', 2),
    ),
    "function_density": (
        "language, functions, public_share, mean_lines",
        ('javascript', 2, 1.0, 3.0),
        ('python', 9, 0.888889, 2.111111),
        ('rust', 2, 1.0, 2.5),
    ),
    "noise_filter": (
        "path, reason",
        ('Makefile', None),
        ('dist/app.min.js', 'blocklist: dist/'),
        ('schema/teams.sql', None),
        ('schema/users.sql', None),
        ('src/app.py', None),
        ('src/auth.rs', None),
        ('src/db.py', None),
        ('src/gen.py', None),
        ('src/lib.rs', None),
        ('src/util.py', None),
        ('tests/test_db.py', None),
        ('tests/test_util.py', None),
        ('web/client.js', None),
        ('web/h.js', None),
    ),
    "graph_export": (
        "line",
        ('src/app.py\tsrc/db.py\timport',),
        ('src/app.py\tsrc/util.py\timport',),
        ('src/db.py\tsrc/util.py\timport',),
        ('src/lib.rs\tsrc/auth.rs\timport',),
        ('tests/test_db.py\tsrc/db.py\timport',),
        ('web/client.js\tweb/h.js\timport',),
    ),
}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def expected_rows(columns: str, *values) -> str:
    """SQL of rows that are written out."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, v)) + ')' for v in values)}) AS t({columns})"


def _expected(name: str) -> str:
    return expected_rows(*EXPECTED[name])


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")


def _parsed(spark):
    return code.parse(files(spark)).cache()


def _edges(spark, parsed):
    return code.import_edges(parsed)


@written_out(_expected("language_detection"))
def language_detection(spark, d):
    return files(spark).select("path", code.language(F.col("path")).alias("language"))


@written_out(_expected("parse_symbols"))
def parse_symbols(spark, d):
    return code.symbols(_parsed(spark)).drop("body")


@written_out(_expected("import_resolution"))
def import_resolution(spark, d):
    return _edges(spark, _parsed(spark))


@written_out(_expected("call_graph"))
def call_graph(spark, d):
    p = _parsed(spark)
    return code.call_edges(p, _edges(spark, p))


@written_out(_expected("test_map"))
def test_map(spark, d):
    return code.test_map(files(spark), _edges(spark, _parsed(spark)))


@written_out(_expected("dead_code"))
def dead_code(spark, d):
    p = _parsed(spark)
    e = _edges(spark, p)
    return code.dead_code(p, code.call_edges(p, e), code.test_map(files(spark), e), graphs.pagerank(e))


@written_out(_expected("schema_columns"))
def schema_columns(spark, d):
    return code.db_columns(files(spark))


@written_out(_expected("schema_edges"))
def schema_edges(spark, d):
    c = code.db_columns(files(spark)).cache()
    return code.foreign_key_edges(c).unionByName(code.embedded_sql_edges(files(spark), c))


@written_out(_expected("route_detection"))
def route_detection(spark, d):
    return code.routes(files(spark))


@written_out(_expected("http_bridges"))
def http_bridges(spark, d):
    return code.http_bridges(files(spark))


@written_out(_expected("containing_symbol"))
def containing_symbol(spark, d):
    lines = files(spark).select("path", F.posexplode(F.split("content", "\n")).alias("i", "t")).select("path", (F.col("i") + 1).alias("line"))
    return code.containing_symbol(lines, code.symbols(_parsed(spark)))


@written_out(_expected("data_flow_paths"))
def data_flow_paths(spark, d):
    p = _parsed(spark)
    return code.data_flow(code.call_edges(p, _edges(spark, p)), "main").withColumn("nodes", F.array_join("nodes", " > "))


@written_out(_expected("onboarding_phases"))
def onboarding_phases(spark, d):
    return code.reading_order(_edges(spark, _parsed(spark)), files(spark), 4)


@written_out(_expected("function_density"))
def function_density(spark, d):
    return code.function_density(_parsed(spark))


@written_out(_expected("noise_filter"))
def noise_filter(spark, d):
    return code.noise(files(spark))


@written_out(_expected("graph_export"))
def graph_export(spark, d):
    return code.canonical(_edges(spark, _parsed(spark)).withColumn("edge_type", F.lit("import")))


@query(f"WITH {rel.HISTORY} SELECT path, count(*) AS n FROM hist GROUP BY path ORDER BY n DESC, path LIMIT 20")
def churn_top20(spark, d):
    return code.rank_by_churn(rel.history(spark, d))
