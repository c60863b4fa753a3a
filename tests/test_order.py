"""Reading order and phases against a queue, on random graphs with cycles."""

import random
from collections import defaultdict, deque

import pytest

from graphloom.operators import order
from graphloom.operators import ranking as R
from pyspark.sql import functions as F


def queue_order(paths, edges):
    paths, edges = sorted(set(paths)), set(edges)
    needs = {p: {d for s, d in edges if s == p and d in set(paths)} for p in paths}
    users = defaultdict(list)
    for p in paths:
        for d in needs[p]:
            users[d].append(p)
    open_ = {p: len(d) for p, d in needs.items()}
    todo, out = deque(p for p in paths if not open_[p]), []
    while todo:
        p = todo.popleft()
        out.append(p)
        for u in sorted(users[p]):
            open_[u] -= 1
            if not open_[u]:
                todo.append(u)
    return out + [p for p in paths if p not in set(out)]


def plain_phases(ordered, edges, tokens, score):
    def of(p):
        return "/".join(p.split("/")[:2])

    groups = defaultdict(list)
    for p in ordered:
        groups[of(p)].append(p)
    modules = sorted(groups, key=lambda m: (-sum(score.get(p, 0.0) for p in groups[m]), ordered.index(groups[m][0])))
    out = []
    for m in modules:
        chunks = [groups[m][k : k + 9] for k in range(0, len(groups[m]), 9)]
        for k, chunk in enumerate(chunks):
            title = m.split("/")[-1]
            title = title[:1].upper() + title[1:] + (f" ({k + 1}/{len(chunks)})" if len(chunks) > 1 else "")
            prior = next((o[1] for o in reversed(out) if any((p, q) in edges for p in o[3] for q in groups[m])), None)
            out.append((title, m, "Core module depended on by all others." if not out else f"Builds on {prior}." if prior else "Independent module.", chunk))
    return out


def frames(spark, paths, edges):
    e = spark.createDataFrame(list(edges), "src string, dst string")
    return e, spark.createDataFrame([(p, len(p)) for p in paths], "path string, tokens int")


@pytest.mark.parametrize("seed, n, m", [(1, 60, 50), (2, 60, 90), (3, 40, 0), (4, 1, 1), (5, 120, 140)])
def test_reading_order_is_that_of_a_queue(spark, seed, n, m):
    r = random.Random(seed)
    paths = [f"src/m{r.randint(0, 3)}/f{r.randint(0, 999):03}_{k}.rs" for k in range(n)]
    edges = {(r.choice(paths), r.choice([*paths, "elsewhere.rs"])) for _ in range(m)}
    e, files = frames(spark, paths, edges)
    got = order.reading_order(e.unionByName(e), files.unionByName(files))
    assert [x.path for x in got.orderBy("pos").collect()] == queue_order(paths, edges)
    assert {x.pos for x in got.collect()} == set(range(len(set(paths))))


def test_reading_order_without_files(spark):
    e, files = frames(spark, ["a"], {("a", "b")})
    assert order.reading_order(e, files.limit(0)).count() == 0
    assert [x.path for x in order.reading_order(e, files).collect()] == ["a"]


def test_phases_are_those_of_a_loop(spark):
    r = random.Random(9)
    paths = [f"{r.choice(['src/index', 'src/api', 'lib'])}/f{k:03}.rs" for k in range(70)] + ["main.rs", "src/one.rs"]
    edges = {(a, b) for a, b in ((r.choice(paths), r.choice(paths)) for _ in range(60)) if a > b} | {("lib/f001.rs", "lib/f001.rs")}
    e, files = frames(spark, paths, edges)
    score = {p: round(r.random(), 3) for p in paths if r.random() < 0.9}
    rank = spark.createDataFrame(list(score.items()), "node string, score double")
    symbols = spark.createDataFrame([("main.rs", f"s{k}", k) for k in range(7)], "path string, name string, ord int")
    ordered = order.reading_order(e, files)
    got = order.phases(ordered, e, files, rank, symbols).orderBy("phase").collect()
    want = plain_phases(queue_order(paths, edges), edges, {}, score)
    assert [(x.name, x.module, x.rationale, [f.path for f in x.files]) for x in got] == want
    assert [x.phase for x in got] == list(range(len(want)))
    (main,) = [f for x in got for f in x.files if f.path == "main.rs"]
    assert main.focus == ["s0", "s1", "s2", "s3", "s4"] and main.tokens == len("main.rs") and main.pagerank == score.get("main.rs", 0.0)


def test_reading_time(spark):
    rows = spark.createDataFrame([(0,), (1,), (200,), (11999,), (12001,), (60_000,)], "t long").select(order.reading_time(F.col("t")).alias("s")).collect()
    assert [x.s for x in rows] == ["~0m", "~1m", "~1m", "~1h 0m", "~1h 1m", "~5h 0m"]


def test_places_and_running_sums_of_groups(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "b"]) if k % 3 else "hot", k, r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(7)
    places = {x.k: x.place for x in R.places(df, ["g"], [F.col("k")], "place").collect()}
    sums = {x.k: (x.s, x.n) for x in R.running(df, ["g"], [F.col("k")], {"s": F.col("w"), "n": F.lit(1)}).collect()}
    for g, k, _ in rows:
        before = [x for x in rows if x[0] == g and x[1] < k]
        assert places[k] == len(before) and sums[k] == (sum(x[2] for x in before), len(before))
