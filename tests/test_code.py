"""The code layer over its small repository."""

from graphloom import catalog
from graphloom.functions import parsing


def rows(spark, name):
    return {tuple(r) for r in (catalog.QUERIES | catalog.CHECKS)[name](spark, "").collect()}


def test_languages(spark):
    got = dict(rows(spark, "language_detection"))
    assert (got["src/app.py"], got["src/lib.rs"], got["Makefile"], got["schema/users.sql"]) == ("python", "rust", "makefile", "sql")


def test_imports_resolve(spark):
    assert rows(spark, "import_resolution") == {("src/app.py", "src/db.py"), ("src/app.py", "src/util.py"), ("src/db.py", "src/util.py"), ("tests/test_db.py", "src/db.py"), ("web/client.js", "web/h.js"), ("src/lib.rs", "src/auth.rs")}


def test_calls(spark):
    got = {(a, b, c): (d, e) for a, b, c, d, e in rows(spark, "call_graph")}
    assert got["src/app.py", "show", "load_user"] == ("src/db.py", "exact")
    assert got["src/util.py", "clean", "_strip"] == ("src/util.py", "exact")
    assert got["src/lib.rs", "run", "token"] == ("src/auth.rs", "exact")
    assert got["web/client.js", "load", "fetch"] == (None, "unresolved")


def test_tests_and_dead_code(spark):
    assert rows(spark, "test_map") == {("src/db.py", "tests/test_db.py", "both"), ("src/util.py", "tests/test_util.py", "name_match")}
    dead = {r[1] for r in rows(spark, "dead_code")}
    assert "unused" in dead and not dead & {"load_user", "clean", "main", "query", "_strip"}


def test_schema(spark):
    assert ("schema/users.sql", "schema/teams.sql", "foreign_key") in rows(spark, "schema_edges")
    assert ("src/db.py", "schema/users.sql", "embedded_sql") in rows(spark, "schema_edges")
    assert parsing.table_columns("create table t (a int not null default 3, b text, primary key (a, b))") == [("t", 0, "a", "int", False, "3", None, None, True), ("t", 1, "b", "text", False, None, None, None, True)]


def test_routes_and_bridges(spark):
    assert rows(spark, "route_detection") == {("src/app.py", "flask", "GET", "/users/{}")}
    assert rows(spark, "http_bridges") == {("web/client.js", "src/app.py", "cross_language:HttpCall")}


def test_containing_symbol(spark):
    got = {(a, b): c for a, b, c in rows(spark, "containing_symbol")}
    assert got["src/app.py", 6] == "show" and got["src/app.py", 1] == "<module>"


def test_flow_and_order(spark):
    got = {r[0] for r in rows(spark, "data_flow_paths")}
    assert "src/app.py::main > src/app.py::show > src/db.py::load_user > src/db.py::query > src/util.py::clean > src/util.py::_strip" in got
    order = {p: i for i, p, _ in rows(spark, "onboarding_phases")}
    assert order["src/util.py"] < order["src/db.py"] < order["src/app.py"]


def test_noise(spark):
    got = dict(rows(spark, "noise_filter"))
    # of the fixed marks, "# DO NOT EDIT" is none; "// DO NOT EDIT" is
    assert (got["dist/app.min.js"], got["src/gen.py"], got["src/app.py"]) == ("blocklist: dist/", None, None)


def test_broken_source_gives_nothing():
    assert parsing.parse("def (", "python") == ([], [])
    assert parsing.parse(None, "rust") == ([], [])
