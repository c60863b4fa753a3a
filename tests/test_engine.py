"""The engine's own operators: against SQL on the smallest tables, and against small cases."""

import os

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import architecture, conventions, graphs, history, ranking, retrieval
from graphloom.sources import relations
from graphloom.streaming import changes as stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return str(round(v, 5))
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES | catalog.EXPECTED))
def test_query_equals_sql(spark, con, name):
    df = (catalog.QUERIES | catalog.CHECKS)[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    quoted = ",".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"select {quoted} from ({(catalog.ORACLES | catalog.EXPECTED)[name]})").fetchall())
    assert got == want


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "import") for a, b in pairs], "src string, dst string, edge_type string")


def test_pagerank_is_even_on_a_ring(spark):
    ring = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = {r.node: r.score for r in graphs.pagerank(ring, 30).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0, "c": 1.0}, abs=1e-9)


def test_pagerank_with_a_dangling_node_equals_brute_force(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a"), ("d", "e")]
    names, rank = "abcde", dict.fromkeys("abcde", 0.2)
    for _ in range(6):
        lost = rank["e"]
        rank = {n: 0.15 / 5 + 0.85 * (lost / 5 + sum(rank[s] / sum(x == s for x, _ in pairs) for s, t in pairs if t == n)) for n in names}
    want = {n: v / max(rank.values()) for n, v in rank.items()}
    assert {r.node: r.score for r in graphs.pagerank(edges(spark, pairs), 6, tol=None).collect()} == pytest.approx(want, abs=1e-9)


def test_mutual_import_is_one_component(spark):
    got = {tuple(r) for r in graphs.components(edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])).collect()}
    assert got == {("a", "a"), ("b", "a")}


def test_surprising_excludes_either_direction(spark):
    co = spark.createDataFrame([("A", "B", 9, 0.9), ("C", "D", 8, 0.8)], "file_a string, file_b string, n long, recency_weight double")
    for pair in (("A", "B"), ("B", "A")):
        assert [r.file_a for r in history.surprising(co, edges(spark, [pair])).collect()] == ["C"]


def test_single_file_risk_percentile_is_one(spark):
    files = spark.createDataFrame([("f", True)], "path string, tested boolean")
    none = spark.createDataFrame([], "path string, churn_30d long")
    deg = spark.createDataFrame([], "path string, in_degree long")
    assert history.risk_ranking(files, none, deg).first().percentile == 1.0


def test_packing_truncates_then_stops(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 50), (1, "b", 2.0, 80), (1, "c", 1.0, 10)], "g long, path string, score double, tokens long")
    got = {(r.path, r.used, r.truncated) for r in retrieval.pack(rows, "g", 100).collect()}
    assert got == {("a", 50, False), ("b", 50, True)}


def test_dominant_needs_no_tie(spark):
    rows = spark.createDataFrame([("x", "snake"), ("x", "snake"), ("x", "camel"), ("y", "snake"), ("y", "camel")], "g string, s string")
    assert [(r.g, r.dominant, r.strength) for r in conventions.dominant(rows, "g", "s").collect()] == [("x", "snake", "mixed")]


def test_god_file(spark):
    rows = spark.createDataFrame([(f"n{i}", "m", 1) for i in range(9)] + [("big", "m", 50)], "node string, module string, n long")
    assert [r.node for r in architecture.god_files(rows).collect()] == ["big"]


def test_classify_and_upsert(spark):
    ch = spark.createDataFrame([("a", "created", 1), ("a", "removed", 2), ("b", "modified", 1), ("node_modules/x", "created", 3)], "path string, kind string, ts long")
    states = stream.classify(ch)
    assert {tuple(r) for r in states.collect()} == {("a", "removed"), ("b", "modified")}
    now = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v long")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "path string, v long")
    assert {tuple(r) for r in stream.upsert(now, new, states).collect()} == {("b", 2), ("c", 1)}


def test_stream_of_changes(spark, tmp_path):
    """Versions by bucket: a start, an edit and a removal, an overflow, and a retried batch."""
    src, base = tmp_path / "src", str(tmp_path / "table")
    content = {"a": 1, "b": 1, "c": 1}
    schema = "path string, v long"

    def read(s, states):
        return s.createDataFrame([(r.path, content[r.path]) for r in states.where("state = 'modified'").collect()], schema)

    def everything(s):
        return s.createDataFrame([(p, v * 100) for p, v in content.items()], schema)

    def step(rows, name, bound):
        spark.createDataFrame(rows, "path string, kind string, ts long").coalesce(1).write.mode("append").parquet(str(src))
        changes = spark.readStream.schema("path string, kind string, ts long").parquet(str(src))
        stream.run_incremental(changes, read, everything, base, str(tmp_path / "ck"), bound, 4).trigger(availableNow=True).start().awaitTermination()

    like = spark.createDataFrame([], schema)
    step([(p, "created", 1) for p in content], "one", 100)
    assert {tuple(r) for r in stream.published(spark, base, 1, like).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    content["b"] = 2
    step([("a", "removed", 5), ("b", "modified", 6)], "two", 100)
    assert {tuple(r) for r in stream.published(spark, base, 2, like).collect()} == {("b", 2), ("c", 1)}
    assert {tuple(r) for r in stream.published(spark, base, 1, like).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    step([("b", "modified", 7), ("c", "modified", 8)], "three", 1)  # more events than fit: all is read afresh
    assert {tuple(r) for r in stream.published(spark, base, 3, like).collect()} == {("a", 100), ("b", 200), ("c", 100)}


def test_row_number_in_ranges_equals_window(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 101).alias("v"), "id")
    want = {tuple(r) for r in df.withColumn("n", F.row_number().over(W.orderBy(F.desc("v"), F.asc("id")))).collect()}
    assert {tuple(r) for r in ranking.row_number(df, [-F.col("v"), F.col("id")], "n").collect()} == want
    nulls = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, v long")
    assert {tuple(r) for r in ranking.row_number(nulls, [F.col("v").isNull(), F.col("v"), F.col("id")], "n").select("id", "n").collect()} == {(2, 1), (1, 2), (3, 3)}


def test_empty_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, edge_type string")
    assert graphs.pagerank(none).count() == 0
    assert graphs.degrees(none).where(F.col("in_degree") > 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_similar_pairs_of_all_documents_equal_brute_force(spark):
    sets = {}
    for r in retrieval.terms(relations.documents(spark, DATA)).select("path", "term").collect():
        sets.setdefault(r.path, set()).add(r.term)
    paths = sorted(sets)
    want = {(p, q) for i, p in enumerate(paths) for q in paths[i + 1 :] if round(len(sets[p] & sets[q]) / len(sets[p] | sets[q]), 6) > 0.8}
    got = {(r.p, r.q) for r in retrieval.similar_pairs(retrieval.term_sets(relations.documents(spark, DATA))).collect()}
    assert got == want and any("/de/" not in p for p, _ in want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_whole_trade_edges_equal_brute_force(spark, con):
    rows = con.execute("select c.n_name, s.n_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation c on c_nationkey = c.n_nationkey join nation s on s_nationkey = s.n_nationkey where c_nationkey < s_nationkey").fetchall()
    want = set(rows)
    assert {(r.src, r.dst) for r in relations.trade_edges(spark, DATA).collect()} == want
    degrees = {r.node: (r.in_degree, r.out_degree) for r in catalog.QUERIES["graph_nodes"](spark, DATA).collect()}
    assert degrees == {x: (sum(b == x for _, b in want), sum(a == x for a, _ in want)) for x in {y for e in want for y in e}}
    reach = {"NATION_3"}
    while more := {b for a, b in want if a in reach} - reach:
        reach |= more
    assert {r.node for r in catalog.QUERIES["reachable"](spark, DATA).collect()} == reach
    hops = {"NATION_0": 0}
    for h in range(1, 9):
        for b in {b for a, b in want if hops.get(a) == h - 1} - set(hops):
            hops[b] = h
    path = [r.node for r in catalog.QUERIES["graph_shortest_path"](spark, DATA).orderBy("hop").collect()]
    assert len(path) - 1 == hops.get("NATION_23", -1) and set(zip(path, path[1:])) <= want
