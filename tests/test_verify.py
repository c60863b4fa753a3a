"""Verification on a small code base, with all kinds of violations."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import verify


@pytest.mark.parametrize("name, snake, camel", [("HTTPServer", "http_server", "httpserver"), ("userId", "user_id", "userid"), ("parseXML", "parse_xml", "parsexml"), ("load_user_now", "load_user_now", "loadUserNow"), ("HTTP", "http", "http")])
def test_names(spark, name, snake, camel):
    (x,) = spark.createDataFrame([(name,)], "n string").select(verify.snake(F.col("n")).alias("s"), verify.camel(F.col("n")).alias("c")).collect()
    assert (x.s, x.c) == (snake, camel)


def test_violations(spark):
    rows = [("a.rs", f"load_{k}", "function", 10 * k, 10 * k + 5, "") for k in range(20)]
    rows += [("a.rs", "loadUser", "function", 300, 320, "x.unwrap()"), ("a.rs", "other", "function", 400, 420, "y.unwrap()"), ("tests/a.rs", "some_test", "function", 1, 9, "z.unwrap()"), ("b.rs", "user_row", "struct", 1, 3, ""), ("b.rs", "UserRow", "struct", 5, 8, ""), ("b.rs", "Row", "struct", 10, 12, "")]
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, start_line int, end_line int, body string")
    lines = spark.createDataFrame([("a.rs", 310), ("a.rs", 399), ("tests/a.rs", 4)], "path string, line int")
    fresh = spark.createDataFrame([("b.rs",)], "path string")
    rules = verify.naming_rules(symbols)
    more = spark.createDataFrame([("unwrap_in_source", "no .unwrap() in src/", 19, 20, 95.0, "convention"), ("import_style", "absolute", 8, 10, 80.0, "trend")], rules.schema)
    imports = spark.createDataFrame([("b.rs", "./near"), ("b.rs", "crate::far")], "path string, source string")
    rules = rules.unionByName(more)
    touched = verify.touched_symbols(symbols, lines, fresh)
    assert {x.name for x in touched.collect()} == {"loadUser", "some_test", "user_row", "UserRow", "Row"}
    found = verify.violations(touched, rules, imports)
    got = {(x.path, x.line, x.category, x.severity, x.suggestion) for x in found.collect()}
    assert got == {
        ("a.rs", 300, "naming", "high", "Rename to `load_user`"),
        ("a.rs", 300, "error_handling", "high", 'Replace .unwrap() with .map_err(|e| ...)? or .expect("reason")'),
        ("b.rs", 1, "naming", "low", None),
        ("b.rs", None, "imports", "medium", "Rewrite './near' as absolute import"),
    }
    assert verify.passed(found, rules).count() == 0
    assert {x.category for x in verify.passed(found.limit(0), rules).collect()} == {"naming", "error_handling", "imports"}
