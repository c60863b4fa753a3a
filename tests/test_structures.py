"""Degradation, batch search, reach counts and hash trees against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphs, packing, retrieval, scan


@pytest.mark.parametrize("budget", [0, 300, 900, 2000, 5000, 100_000])
def test_degradation_of_many_selections(spark, budget):
    r = random.Random(budget)
    rows, want = [], {}
    for g in ("a", "b", "c", "hot"):
        own = []
        for k in range(60 if g == "hot" else r.randint(1, 12)):
            t = r.randint(10, 200)
            levels = [t, t * 3 // 4, t // 2 + r.randint(0, 9), t // 4, t // 9]
            own.append((f"{g}/f{k:02}", r.random() < 0.4, r.choice([0.1, 0.5, round(r.random(), 2)]), levels))
        rows += [(g, *f) for f in own]
        want |= {(g, p): (level, n) for p, level, n in packing.degrade(own, budget)}
    df = spark.createDataFrame(rows, "dir string, path string, selected boolean, priority double, tokens array<int>").repartition(4)
    got = {(x.dir, x.path): (x.level, x.tokens) for x in packing.degraded(df, "dir", budget).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_batch_search_equals_all_products(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(150)] + [(200 + i, [1.0] * 8) for i in range(30)]
    rows += [(300, [0.0] * 8), (301, [1.0] * 5), (302, None), (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [float("nan")])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = df.where("id % 10 = 0 or id > 299").select(F.col("id").alias("query"), "vec")
    got = {}
    for x in retrieval.cosine_batch(df, asked, 20, block=block).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append((x.id, x.similarity))
    own = {i: np.array(v) for i, v in rows[:182]}
    want = {}
    for q in [i for i in own if (i % 10 == 0 or i > 299) and np.any(own[i])]:
        sims = []
        for i, v in own.items():
            if len(v) == len(own[q]):
                n = np.sqrt((v @ v) * (own[q] @ own[q]))
                sims.append((-(round(float(v @ own[q] / n), 4) if n else 0.0) + 0.0, i))
        want[q] = [(i, -s + 0.0) for s, i in sorted(sims)[:20]]
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_reach_counts_equal_a_search_from_every_node(spark):
    r = random.Random(2)
    names = [f"n{k}" for k in range(300)]
    pairs = {(r.choice(names), r.choice(names)) for _ in range(380)}
    users = {}
    for a, b in pairs:
        users.setdefault(b, set()).add(a)
    df = spark.createDataFrame(list(pairs), "src string, dst string")

    def plain(n, depth):
        seen, now = {n}, {n}
        for _ in range(depth):
            now = {u for v in now for u in users.get(v, ())} - seen
            seen |= now
        return len(seen) - 1

    for depth, given in ((1, 1), (3, 3), (300, None)):
        got = {x.node: x.reached for x in graphs.reach_counts(df, given).collect()}
        assert set(got) == {n for p in pairs if p[0] != p[1] for n in p}
        for n, k in got.items():
            real = plain(n, depth)
            assert k == real if real < 100 else abs(k - real) <= 4 * 1.04 / 64 * real, (n, k, real)


def test_reach_counts_of_large_sets_stay_within_their_error(spark):
    hub = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst"))
    (x,) = graphs.reach_counts(hub, 1).where("node = 'hub'").collect()
    assert abs(x.reached - 20_000) <= 4 * 1.04 / 64 * 20_000


def test_hash_trees_follow_edits(spark):
    r = random.Random(5)
    files = {f"src/f{k}.rs": f"h{k}" for k in range(400)}
    frame = lambda d: spark.createDataFrame(list(d.items()) or [("x", "y")], "path string, hash string").limit(len(d))
    before = frame(files)
    tree = scan.hash_tree(before)
    for _ in range(3):
        changed = {p: f"new{r.random()}" for p in r.sample(sorted(files), 3)} | {f"src/added{r.random()}.rs": "a"}
        removed = r.sample(sorted(set(files) - set(changed)), 4)
        after = {p: h for p, h in (files | changed).items() if p not in removed}
        gone = spark.createDataFrame([(p,) for p in removed], "path string")
        made = scan.update_tree(tree, before, frame(changed), gone)
        fresh = scan.hash_tree(frame(after))
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, fresh.collect()))
        edited = spark.createDataFrame([(p,) for p in [*changed, *removed]], "path string").select(F.substring(F.sha2("path", 256), 1, scan.DEPTH).alias("prefix")).distinct()
        assert {x.prefix for x in scan.tree_diff(tree, made).collect()} == {x.prefix for x in edited.collect()}
        files, before, tree = after, frame(after), made
    none = scan.update_tree(tree, before, before.limit(0), before.select("path"))
    assert none.where("prefix = ''").count() == 0
    assert scan.hash_tree(before.limit(0)).count() == 0
