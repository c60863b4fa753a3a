"""Symbol importance: what another file's terms hold, its neighbours' names and the parts of its words among them."""

import random

import duckdb
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import signals
from graphloom.plans import codebase_queries as cq

DATA = "/root/testdata/sf0.001"


def test_names_that_neighbours_declare_are_terms(spark):
    r = random.Random(9)
    paths = [f"f{i}" for i in range(12)]
    symbols = [(p, f"{r.choice('abcdefghij')}{k}", r.choice(["public", "public", "private"])) for p in paths for k in range(3)]
    terms = [(r.choice(paths), f"{r.choice('abcdefghij')}{r.randrange(3)}") for _ in range(8)] + [(None, "a0"), (None, "b1")]
    for n in (0, 1, 4, 10):
        edges = [tuple(r.sample(paths[:10], 2)) for _ in range(n)]
        near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
        held = set(terms) | {(a, name) for a, b in near for p, name, _ in symbols if p == b}
        want = sorted((p, name, 0.3 if v == "private" else 1.0 if any(t == name and q not in (p, None) for q, t in held) else 0.7) for p, name, v in symbols)
        s, t = spark.createDataFrame(symbols, "path string, name string, visibility string"), spark.createDataFrame(terms, "path string, term string")
        got = signals.symbol_importance(s, t, spark.createDataFrame(edges, "src string, dst string"))
        assert sorted((x.path, x.name, x.importance) for x in got.collect()) == want


def test_query_equals_its_sql_and_holds_all_terms(spark):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.execute(catalog.ORACLES["symbol_importance"]).fetchall())
    got = catalog.QUERIES["symbol_importance"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == want
    # public symbols of files with neighbours; by the words alone none is held elsewhere
    assert got.where(F.col("importance") == 1.0).count() > 300


def test_parts_of_words_are_terms(spark):
    """A part that another file's text holds within a word."""
    s = spark.createDataFrame([("a", "user", "public")], "path string, name string, visibility string")
    files = spark.createDataFrame([("b", "xx_loadUser one one")], "path string, content string")
    assert [r.importance for r in signals.symbol_importance(s, cq.named_terms(files)).collect()] == [1.0]
    assert sorted(r.term for r in cq.named_terms(files).distinct().collect()) == ["load", "one", "user", "xx", "xx_loaduser"]
