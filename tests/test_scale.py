"""What a task holds or reads stays small however the input is laid out."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import context, ranking, retrieval, signals
from graphloom.sources import codebase as cb

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_and_symbols_are_dealt_out_by_number(spark):
    """A table of one small file was read, and its long rows made, in one task."""
    for df in (cb.files(spark, DATA), cb.symbols(spark, DATA)):
        assert "REPARTITION_BY_NUM" in _plan(df)


def test_a_text_is_split_once_for_its_frequency(spark):
    """the same share as by the parts of each word."""
    texts = ["loadUser load_user LOAD x userÜber", "", None, "aB _ __ Éa loadA", "Σ ΟΔΟΣ user\nload-user.load", "İx i load"]
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    got = {r.path: r.term_frequency for r in signals.term_frequency(files, ["load", "user"]).collect()}
    for i, t in enumerate(texts):
        parts = [p for w in spark.createDataFrame([(t,)], "t string").select(F.explode(F.split("t", r"[^\p{L}\p{N}_]+")).alias("w")).where("octet_length(w) >= 2").select(signals.name_parts(F.col("w")).alias("p")).collect() for p in w.p if len(p.encode()) >= 2]
        assert got[i] == (sum(p in ("load", "user") for p in parts) / len(parts) if parts else 0.0)
    assert _plan(signals.term_frequency(files, ["load"])).count("split(") == 1


def test_tokens_of_a_name_are_made_once(spark):
    """A symbol's name was split for each place where its tokens stand."""
    s = spark.createDataFrame([("a", "loadUser"), ("a", "_x"), ("b", "aB"), ("c", "")], "path string, name string")
    got = {r.path: r.symbol_match for r in signals.symbol_match(s, ["load", "ab"]).collect()}
    assert got == {"a": 1 / 3, "b": 0.5, "c": 0.0}
    assert _plan(signals.symbol_match(s, ["load"])).count("split(name") == 1


def test_a_block_of_products_is_small():
    """products of 1024 queries with 32768 vectors took some 1 GB of each Python worker."""
    rng = np.random.default_rng(1)
    v = pd.DataFrame({"id": np.arange(1 << 15), "vec": list(rng.normal(size=(1 << 15, 8)))})
    q = pd.DataFrame({"query": np.arange(300), "vec": list(rng.normal(size=(300, 8)))})
    tracemalloc.start()
    got = retrieval._nearest(v, q, 20, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 6000 and most < 100e6
    a, b = np.stack(v["vec"]), q["vec"][7]
    sim = np.round(a @ b / np.sqrt((a * a).sum(1) * (b * b).sum()), 4)
    assert got[got["query"] == 7]["id"].tolist() == np.lexsort((v["id"], -sim))[:20].tolist()


def test_palette_has_no_window(spark):
    """a task read all entries of a kind."""
    files = spark.createDataFrame([(f"f{i}",) for i in range(9)], "path string")
    symbols = spark.createDataFrame([("f1", "b"), ("f1", "b"), ("f0", "b"), ("f2", "a"), ("f2", None)], "path string, name string")
    df = context.palette(files, symbols, 10, {"file": 0.3, "symbol": 0.3})
    assert "Window" not in _plan(df)
    assert sorted((r.kind, r.label or "", r.path) for r in df.collect()) == [("file", f"f{i}", f"f{i}") for i in range(3)] + [("symbol", "", "f2"), ("symbol", "a", "f2"), ("symbol", "b", "f0")]


def test_a_range_is_found_by_halving(spark):
    """each row was compared with every splitter."""
    kind = "struct<g:string,p:bigint>"
    cuts = [(None, 3), ("a", None), ("a", 1), ("a", 5), ("b", 2)]
    keys = [(None, None), (None, 3), (None, 9), ("", 1), ("a", None), ("a", 0), ("a", 1), ("a", 4), ("a", 5), ("b", 1), ("b", 2), ("é", 0)]
    df = spark.createDataFrame([((g, p),) for g, p in keys], f"k {kind}")
    order = lambda k: tuple((x is not None, x or (0 if i else "")) for i, x in enumerate(k))
    assert [r.r for r in df.select(ranking.range_of(F.col("k"), cuts, kind).alias("r")).collect()] == [sum(order(c) <= order(k) for c in cuts) for k in keys]
    # the comparisons on the way to a range, not all of them, are made: no sum over the splitters
    wide = ranking.range_of(F.col("k"), [("a", i) for i in range(255)], kind)
    assert " + " not in _plan(df.select(wide.alias("r")))
    nan = float("nan")
    assert [x[0] for x in sorted([(nan,), (1.0,), (None,), (-2.0,)], key=ranking._order)][:3] == [None, -2.0, 1.0]


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """tasks were as many as the session says, and short rows were broadcast by the bytes of their file."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    monkeypatch.setattr(cb, "ROWS", 500)
    n = -(-lines.count() // 500)
    assert cb.spread(lines, "l_partkey").rdd.getNumPartitions() == n > 4
    assert "hashpartitioning(l_partkey" in _plan(cb.symbols(spark, DATA)) and f", {n}), REPARTITION_BY_NUM" in _plan(cb.symbols(spark, DATA))
    assert "BroadcastHashJoin" not in _plan(cb.files(spark, DATA))


def test_ranks_go_by_keys(spark, tmp_path):
    """each round of the rank shuffled paths; by keys the ranks are the same, also where files have no path or a key twice."""
    from graphloom.operators import graphs
    from graphloom.plans import codebase_queries as q

    part = spark.read.parquet(f"{DATA}/part.parquet")
    odd = part.withColumn("p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")))
    for name, p in (("plain", part), ("odd", odd), ("twice", odd.unionByName(part.where("p_partkey < 9").withColumn("p_name", F.lit("x"))))):
        d = str(tmp_path / name)
        p.write.parquet(f"{d}/part.parquet")
        spark.read.parquet(f"{DATA}/lineitem.parquet").write.parquet(f"{d}/lineitem.parquet")
        keyed = cb.keyed_imports(spark, d)
        assert (keyed is None) if name == "twice" else (dict(keyed.dtypes)["src"] == "bigint")
        want = {r.node: round(r.score, 9) for r in graphs.pagerank(cb.imports(spark, d), q.ROUNDS, tol=None).where("node is not null").collect()}
        assert {r.node: round(r.score, 9) for r in q._rank(spark, d).where("node is not null").collect()} == want and want


def test_commits_are_dealt_out_by_number(spark, monkeypatch):
    """the pairs of a commit's files were made in as many tasks as the session says, by the few bytes of their commits."""
    from graphloom.operators import history
    from graphloom.sources import relations as rel

    monkeypatch.setattr(cb, "ROWS", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    pairs = _plan(history.co_changes(rel.history(spark, DATA)))
    assert f", {n}), REPARTITION_BY_NUM" in pairs and n > 4


def test_lines_of_nations_are_dealt_out_by_number(spark, monkeypatch):
    """lines met orders, customers and suppliers in as many tasks as the session says."""
    from graphloom.sources import relations as rel

    want = sorted(map(tuple, rel.trade_edges(spark, DATA).collect()))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" not in _plan(rel.trade_edges(spark, DATA))
    for rows in (500, 7):  # owners are sent, or dealt out as well
        monkeypatch.setattr(cb, "ROWS", rows)
        plan = _plan(rel.trade_edges(spark, DATA))
        assert "hashpartitioning(l_orderkey" in plan and f", {-(-lines // rows)}), REPARTITION_BY_NUM" in plan
        assert ("hashpartitioning(l_suppkey" in plan) == (rows == 7)
        assert sorted(map(tuple, rel.trade_edges(spark, DATA).collect())) == want


def test_dead_names_are_counted(spark):
    """private functions were sorted and joined with the names in use; the score is the same, names and kinds that are null among them."""
    from graphloom.operators import health

    rows = [("a", "f", "function", "private"), ("b", "F", "function", "private"), ("c", "g", "function", "private"), ("c", "G", "struct", "public"), (None, None, "function", "private"), ("d", None, "function", "public"), ("e", "h", None, "private"), ("e", "h", "function", None), ("f", "h", "function", "private")]
    kind = "path string, name string, kind string, visibility string"
    for some in (rows, rows[2:4], rows[:1], []):
        s = spark.createDataFrame(some, kind)
        k = F.lower("name").alias("k")
        dead = s.where("kind = 'function' and visibility = 'private'").withColumn("k", k).join(s.where("visibility = 'public'").select(k).distinct(), "k", "left_anti")
        assert health.unused_score(s, 3).collect() == health.dead_code_score(s, dead).collect()
    assert "Join" not in _plan(health.unused_score(s, 3))


def test_contents_are_not_sorted(spark):
    """contents of files were sorted for the join with the test map."""
    from graphloom.operators import health

    files = spark.createDataFrame([("a.py", "python", "def test_x"), ("b.py", "python", ""), ("c.py", "python", "x"), ("d.md", "markdown", "x")], "path string, language string, content string")
    df = health.coverage_score(files, spark.createDataFrame([("b.py", "t")], "source string, test string").hint("merge"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[: plan.index("Join")] and "Project [path" in plan
    assert round(df.first().score, 6) == round(20 / 3, 6)


def test_imports_are_shuffled_as_keys(spark):
    """lines were shuffled for each end of a pair, and paths of both ends wherever imports went."""
    lines = [(1, 1, 10), (1, 2, 11), (1, 2, 12), (1, 3, 10), (1, 5, 13), (2, 1, 11), (2, 2, 11), (2, 3, 12), (None, 1, 10), (None, 2, 11), (3, None, 10), (3, 2, None), (3, 1, 10), (1, 1, 10)]
    pairs = cb._pairs(spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long"))
    want = {(a[2], b[2]) for a in lines for b in lines if None not in a and None not in b and a[0] == b[0] and a[1] + 1 == b[1] and a[2] != b[2]}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert _plan(pairs).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2

    files = cb.files(spark, DATA).select("key", "path").persist()
    paths, keys = cb.imports(spark, DATA).persist(), cb.keyed_imports(spark, DATA, files).persist()
    written = paths.select(F.col("src").alias("path"), F.regexp_replace("dst", r"\.[a-z]+$", "").alias("source"))
    assert sorted(map(tuple, signals.import_proximity_by_key(files, keys).collect())) == sorted(map(tuple, signals.import_proximity(files, written).collect()))
    few = signals.FEW
    for n, most in ((37, few), (91, few), (37, 3)):
        signals.FEW = most
        scored = files.select("path", (F.pmod(F.xxhash64("path"), F.lit(n)) / n).alias("score"))
        try:
            got = signals.seeds(scored, keys, names=files).collect()
        finally:
            signals.FEW = few
        assert got == signals.seeds(scored, paths).collect() and len(got) == signals.SEEDS
