"""Detectors as table functions of SQL."""

import pytest

from graphloom import plugins


def test_table_function(spark):
    plugins.as_table_function(spark, plugins.Markers(["todo"]), "todos")
    rows = [("a", "todo todo\nx\ntodo"), ("b", None), (None, "todo"), ("c", "todo")]
    spark.createDataFrame(rows, "path string, content string").createOrReplaceTempView("t")
    found = lambda q: sorted((r.path, r.message, r.line) for r in spark.sql(q).collect())
    want = [("a", "todo", 1), ("a", "todo", 1), ("a", "todo", 3), ("c", "todo", 1)]
    assert found("SELECT * FROM todos(TABLE(SELECT path, content FROM t) PARTITION BY path)") == want
    assert found("SELECT * FROM todos(TABLE(SELECT path, content, 1 AS more FROM t) WITH SINGLE PARTITION)") == want
    assert found("SELECT * FROM todos(TABLE(SELECT path FROM t) PARTITION BY path)") == []  # what isn't declared isn't seen


def test_table_function_refuses_what_it_cannot_read(spark):
    plugins.as_table_function(spark, plugins.Markers(["x"]), "marks")
    with pytest.raises(Exception, match="text column path"):
        spark.sql("SELECT * FROM marks(TABLE(SELECT 1 AS path) PARTITION BY path)").collect()
    big = spark.createDataFrame([("a", "x" * 200_000)], "path string, content string")
    big.createOrReplaceTempView("big")
    with pytest.raises(Exception, match="returns too much"):
        spark.sql("SELECT * FROM marks(TABLE(SELECT path, content FROM big) PARTITION BY path)").collect()
