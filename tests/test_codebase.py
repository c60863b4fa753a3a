"""Operators over code bases: greedy rules, graphs and texts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.operators import code, context, graphs, packing, scan, signals
from graphloom.operators import predicates as P
from graphloom.plans import codebase_queries as cq
from graphloom.sources import codebase as cb

DATA = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "import") for a, b in pairs], "src string, dst string, edge_type string")


def test_seeds_equal_the_sequential_rule(spark):
    r = random.Random(1)
    for _ in range(4):
        names = [f"f{i:02}" for i in range(30)]
        score = {n: round(r.random() * 0.6, 3) for n in names}
        pairs = {(r.choice(names), r.choice(names)) for _ in range(45)}
        near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in names}
        now = {n: s for n, s in score.items() if s >= 0.1}
        hits = sorted(now)
        for s in hits:  # in order of path, with what earlier ones have lifted
            for t in near[s]:
                now[t] = max(now.get(t, 0.0), now[s] * 0.7)
        want = sorted(((round(v, 9), k, k in hits) for k, v in now.items()), key=lambda x: (-x[0], x[1]))[:50]
        df = spark.createDataFrame(list(score.items()), "path string, score double")
        got = [(round(x.score, 9), x.path, x.hit) for x in signals.seeds(df, edges(spark, pairs)).collect()]
        assert got == want


def test_filling_equals_the_sequential_rule(spark):
    r = random.Random(2)
    rows, want = [], []
    for g in range(6):
        files = [(f"p{i}", round(r.random(), 3), "\n".join("x" * r.randint(0, 60) for _ in range(r.randint(1, 12)))) for i in range(8)]
        rows += [(g, *f) for f in files]
        left = 120
        for path, score, text in sorted(files, key=lambda f: (-f[1], f[0])):
            t = [-(-(len(x) + 1) // 4) for x in text.split("\n")]
            if left <= 0:
                break
            if sum(t) <= left:
                want.append((g, path, sum(t), "full"))
                left -= sum(t)
                continue
            used = 0
            for x in t:
                if left <= 5 or used + x > left - 5:
                    break
                used += x
            used = min(used + 5, left) if used else 0
            want.append((g, path, used, "truncated"))
            left -= used
    df = spark.createDataFrame(rows, "g int, path string, score double, content string")
    assert sorted((x.g, x.path, x.tokens, x.level) for x in packing.fill(df, "g", 120).collect()) == sorted(want)


def test_degradation_takes_from_dependencies_first():
    files = [("sel", True, 0.9, [100, 80, 60, 20, 5]), ("dep", False, 0.2, [100, 80, 60, 20, 5]), ("dep2", False, 0.4, [50, 40, 30, 10, 5])]
    assert packing.degrade(files, 300) == [("sel", "full", 100), ("dep", "full", 100), ("dep2", "full", 50)]
    assert packing.degrade(files, 175) == [("sel", "full", 100), ("dep", "signature", 20), ("dep2", "full", 50)]
    assert packing.degrade(files, 75) == [("sel", "documented", 60), ("dep", "stub", 5), ("dep2", "stub", 5)]
    assert packing.degrade(files, 62) == [("sel", "documented", 60), ("dep", "stub", 0), ("dep2", "stub", 0)]
    assert packing.degrade(files, 1)[0] == ("sel", "documented", 60)


def test_components_equal_mutual_reach(spark):
    r = random.Random(3)
    for n, m in ((12, 14), (20, 40), (9, 30)):
        pairs = {(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)}
        nodes = {x for p in pairs for x in p}
        reach = {x: {x} for x in nodes}
        for _ in nodes:
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {(x, min(y for y in nodes if y in reach[x] and x in reach[y])) for x in nodes if any(y != x and y in reach[x] and x in reach[y] for y in nodes)}
        assert {tuple(x) for x in graphs.components(edges(spark, pairs)).collect()} == want
    assert graphs.components(edges(spark, [("a", "a")])).count() == 0
    ring = [(f"r{i:02}", f"r{(i + 1) % 25:02}") for i in range(25)]
    assert {x.component for x in graphs.components(edges(spark, ring)).collect()} == {"r00"}


def test_long_paths_and_depths(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)]
    got = graphs.shortest_path(edges(spark, chain), "c00", "c25").orderBy("hop").collect()
    assert [x.node for x in got] == [f"c{i:02}" for i in range(26)]
    assert graphs.shortest_path(edges(spark, chain), "c05", "c01").count() == 0
    assert graphs.blast_radius(edges(spark, chain), ["c03"], 0).count() == 0
    assert {x.node: x.layer for x in graphs.layers(edges(spark, chain)).collect()}["c25"] == 25
    with pytest.raises(ValueError, match="cycle"):
        graphs.layers(edges(spark, [("a", "b"), ("b", "a")])).count()


def test_pagerank_warm_equals_cold(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")])
    cold = {x.node: x.score for x in graphs.pagerank(e, 100, tol=1e-9).collect()}
    warm = graphs.pagerank(e, 100, tol=1e-9, warm=graphs.pagerank(e.where("src <> 'd'"), 20, tol=None))
    assert all(abs(x.score - cold[x.node]) < 2e-6 for x in warm.collect())
    names = sorted(cold)
    rank, deg = np.full(4, 0.25), {"a": 2, "b": 1, "c": 1, "d": 1}
    for _ in range(200):
        new = np.full(4, 0.15 / 4)
        for x in e.collect():
            new[names.index(x.dst)] += 0.85 * rank[names.index(x.src)] / deg[x.src]
        rank = new
    assert all(abs(cold[n] - v / rank.max()) < 1e-5 for n, v in zip(names, rank, strict=True))


def test_noise_pipeline_equals_the_sequential_rule(spark):
    r = random.Random(4)
    base = [{f"s{g}_{i}" for i in range(20)} for g in range(4)]
    files = []
    for k in range(24):
        names = set(base[k % 4])
        for x in r.sample(sorted(names), r.randint(0, 3)):
            names.discard(x)
        files.append((f"src/f{k:02}.py", round(r.choice([0.1, 0.3, 0.5, 0.5, 0.9]), 2), names))
    files.append(("vendor/x.py", 0.9, {"v"}))
    order = sorted(files[:24], key=lambda f: (-f[1], f[0]))
    removed = {}
    for i, a in enumerate(order):
        if a[0] in removed:
            continue
        for b in order[i + 1 :]:
            if b[0] not in removed and len(a[2] & b[2]) / len(a[2] | b[2]) > 0.8:
                removed[b[0]] = a[0]
    want = {p: f"similar_to: {removed[p]}" if p in removed else "below_relevance_floor" if s < 0.15 else None for p, s, _ in files[:24]} | {"vendor/x.py": "blocklist: vendor/"}
    scored = spark.createDataFrame([(p, s) for p, s, _ in files], "path string, score double")
    symbols = spark.createDataFrame([(p, n) for p, _, names in files for n in names], "path string, name string")
    content = scored.select("path", F.lit("x").alias("content"))
    got = code.filter_noise(scored, content, symbols, spark.createDataFrame([], "node string, score double"))
    assert {x.path: x.reason for x in got.collect()} == want


def test_context_holds_its_parts(spark):
    files = cb.files(spark, DATA)
    got = cq_context(spark, files).collect()
    assert sum(x.tokens for x in got) <= 900 and got and {x.section for x in got} <= {"files", "tests"}
    paths = {x.path for x in files.collect()}
    assert all(x.path in paths and not x.path.startswith("vendor/") for x in got)


def cq_context(spark, files):
    return context.context(files, cb.symbols(spark, DATA), cq._imports_as_written(spark, DATA), cb.imports(spark, DATA), cb.test_map(spark, DATA), cq._last_change(spark, DATA), cq._rank(spark, DATA), "load the user ring", 900)


def test_pack_context_names_what_is_missing(spark):
    files = spark.createDataFrame([("a.py", "x\n"), ("b.py", "y\n"), ("tests/c.py", "z\n")], "path string, content string")
    packed, missing = context.pack_context(files, edges(spark, [("a.py", "b.py"), ("a.py", "tests/c.py")]), ["./a.py", "no.py"], 100, dependencies=True, tests=False)
    assert [(x.path, x.score) for x in packed.collect()] == [("a.py", 1.0), ("b.py", 0.5)] and missing == ["no.py"]
    assert context.mentions("fix src/app.py and lib/x, not this") == ["src/app.py", "lib/x"]


def test_names_and_queries(spark):
    assert signals.split_name("HTTPServer") == ["h", "t", "t", "p", "server"]
    assert signals.query_tokens("load API of my_user") == ["load", "api", "of", "my", "user"]
    words = ["HTTPServer", "load_user", "_x", "API", "éa", "LOAD_USER", "aB"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(signals.tokens(F.col("w")).alias("t")).collect()
    assert [x.t for x in got] == [signals.query_tokens(w) for w in words]
    assert signals.expand(["db"], {"db": ["database"]}, {"Web": {"db": ["api"]}, "Ml": {"db": ["x"]}}, ["Web"]) == ["db", "database", "api"]
    assert P.normal_path(" ./a//b\\c ") == "a/b/c" and P.normal_symbol("x::y.z()") == "z"
    for bad in ("", "../x", "a/../../b"):
        with pytest.raises(ValueError):
            P.normal_path(bad)


def test_scan_of_a_folder(spark, tmp_path):
    for path, text in {"src/a.py": "x", "src/b.log": "y", "node_modules/c.js": "z", "docs/d.md": "---\nt: 1\n---\nbody", "tmp/e.py": "q", "bin/f.bin": None}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"\xff\xfe\x00" if text is None else text.encode())
    got = {x.path: (x.language, x.content) for x in scan.scan(spark, str(tmp_path), ["*.log", "/tmp/", "# no"]).collect()}
    assert got == {"src/a.py": ("python", "x"), "docs/d.md": ("markdown", "---\nt: 1\n---\nbody"), "bin/f.bin": (None, None)}
    assert scan.window_of("3 days ago").days == 3 and scan.window_of("1 week").days == 7 and scan.window_of("2h").seconds == 7200
    with pytest.raises(ValueError):
        scan.window_of("soon")
    assert scan.render([("T", "b & c")], "xml").count("&amp;") == 1 and scan.render([("T", "b")], "json") == '[{"title": "T", "body": "b"}]'


def test_plugins_are_scoped_and_bounded(spark):
    files = spark.createDataFrame([("src/a.py", "todo todo\nx"), ("src/in/b.py", "todo"), ("lib/c.py", "todo")], "path string, content string")
    got = {(x.path, x.message, x.line) for x in plugins.run([plugins.Markers(["todo"])], files, ["src/*"]).collect()}
    assert got == {("src/a.py", "todo", 1)}
    blind = plugins.Markers(["todo"], needs_content=False)
    assert plugins.run([blind], files).count() == 0
    big = spark.createDataFrame([("a", "todo" * 200_000)], "path string, content string")
    with pytest.raises(Exception, match="returns too much"):
        plugins.run([plugins.Markers(["todo"])], big).count()
