"""Blast radius against a queue, on random typed graphs."""

import random
from collections import defaultdict, deque

import pytest

from graphloom.operators import blast
from graphloom.operators.graphs import BLAST_WEIGHTS

KINDS = [*blast.TYPES[:9], "cross_language:FfiBinding", "cross_language:HttpCall", "column_reference"]
SCHEMA = {"foreign_key", "embedded_sql", "orm_model", "view_reference", "trigger_target", "index_target", "column_reference"}


def order(kind):
    return (blast.TYPES.index(kind.split(":")[0]), blast.BRIDGES.index(kind.split(":")[1]) if ":" in kind else 0)


def queue(seeds, edges, rank, tests, depth):
    users = defaultdict(list)
    for s, d, k in sorted(set(edges), key=lambda e: (e[0], order(e[2]))):
        users[d].append((s, k))
    covered = {t for s, t in tests if s in seeds}
    every = {t for _, t in tests}
    todo, visited, best = deque(), set(), {}
    for seed in seeds:
        visited.add(seed)
        for path, kind in users[seed]:
            if path not in visited and path not in seeds:
                todo.append((path, 1, kind))
    while todo:
        path, hops, kind = todo.popleft()
        if hops > depth or path.startswith("col:"):
            continue
        risk = 1 / (hops + 1) * BLAST_WEIGHTS.get(kind, 0.5) * rank.get(path, 0.0) * (1.0 if path in every else 1.2)
        risk = min(max(risk, 0.0), 1.0)
        if path not in best or risk > best[path][0] or (risk == best[path][0] and hops < best[path][1]):
            best[path] = (risk, hops, kind)
        if path in visited:
            continue
        visited.add(path)
        if hops < depth:
            for nxt, k in users[path]:
                if nxt not in visited and nxt not in seeds:
                    todo.append((nxt, hops + 1, k))
    out = {}
    for path, (risk, hops, kind) in best.items():
        is_test = "test" in path.split("/")[:-1] or path.split("/")[-1].startswith("test_")
        group = "test" if is_test and path in covered else "direct" if hops == 1 else "schema" if kind in SCHEMA else "transitive"
        out[path] = (kind, hops, round(risk, 12), "high" if risk >= 0.7 else "medium" if risk >= 0.3 else "low", group)
    return out


@pytest.mark.parametrize("seed, n, m, depth", [(1, 30, 60, 3), (2, 40, 60, 5), (3, 12, 60, 4), (4, 30, 50, 1), (5, 25, 80, 2)])
def test_radius_is_that_of_a_queue(spark, seed, n, m, depth):
    r = random.Random(seed)
    paths = [r.choice(["src/{}.rs", "test/{}.rs", "lib/test_{}.py", "src/api/{}.ts"]).format(f"f{k:02}") for k in range(n)] + ["col:users.name"]
    edges = [(r.choice(paths), r.choice(paths), r.choice(KINDS)) for _ in range(m)]
    seeds = r.sample(paths[:-1], 3)
    rank = {p: r.choice([0.0, 0.25, 0.5, 1.0]) for p in paths if r.random() < 0.9}
    tests = [(r.choice(paths), p) for p in paths if "test" in p] + [(seeds[0], paths[0])]
    e = spark.createDataFrame(edges * 2, "src string, dst string, edge_type string")
    s = spark.createDataFrame([(p, k) for k, p in enumerate(seeds)], "path string, turn int")
    found = blast.radius(e, s, spark.createDataFrame(list(rank.items()), "node string, score double"), spark.createDataFrame(tests, "source string, test string"), depth)
    rows = found.collect()
    got = {x.path: (x.edge_type, x.hops, round(x.risk, 12), x.level, x.kind) for x in rows}
    want = queue(seeds, edges, rank, tests, depth)
    assert got == want and len(rows) == len(want)
    assert all((x.note is not None) == (x.kind == "test") for x in rows)
    (one,) = blast.summary(found).collect()
    assert one.total == len(want) == one.test + one.direct + one.schema + one.transitive == one.high + one.medium + one.low


def test_columns_and_focus(spark):
    e = spark.createDataFrame([("src/a.py", "col:users.name", "column_reference"), ("lib/b.py", "src/a.py", "import"), ("src/c.py", "col:users.mail", "column_reference"), ("col:users.name", "db/users.sql", "column_reference")], "src string, dst string, edge_type string")
    rank = spark.createDataFrame([("src/a.py", 1.0), ("lib/b.py", 0.5)], "node string, score double")
    none = spark.createDataFrame([], "source string, test string")
    got = {x.path: (x.hops, x.kind) for x in blast.column_radius(e, "Users", "NAME", rank, none).collect()}
    assert got == {"src/a.py": (1, "direct"), "lib/b.py": (2, "transitive")}
    assert [x.path for x in blast.column_radius(e, "users", "name", rank, none, focus="lib/").collect()] == ["lib/b.py"]
    seeds = spark.createDataFrame([("db/users.sql",)], "path string")
    assert blast.radius(e, seeds, rank, none).count() == 0  # column nodes aren't met on the way
    assert blast.radius(e.limit(0), seeds, rank, none).count() == 0
