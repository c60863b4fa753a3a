"""Data flow against a plain search, on random call graphs."""

import random
from collections import defaultdict

import pytest

from graphloom.operators import flow

NAMES = ["load", "parse_row", "save_user", "check", "find", "emit_all", "merge", "score", "build", "walk"]


def plain(calls, sources, sink, depth, language, sensitive):
    near = defaultdict(set)
    for a, f, b, g, c in calls:
        near[a, f].add((b, g, c == "exact"))
    out, todo = [], [([s], True) for s in set(sources)]
    while todo and calls:
        nodes, sure = todo.pop()
        last = nodes[-1]
        hit = any(k in last[1] for k in flow.SINKS)
        end = "cycle" if last in nodes[:-1] else "sink" if last[1] == sink or (len(nodes) > 1 and hit) else "depth" if len(nodes) >= depth else None if near[last] else "dead_end"
        if end is None:
            todo += [([*nodes, (b, g)], sure and e) for b, g, e in near[last]]
            continue
        steps = list(zip(nodes, nodes[1:], strict=False))
        out.append((tuple(nodes), end, "exact" if sure else "approximate", end in ("cycle", "depth"), any(a[0].split("/")[:2] != b[0].split("/")[:2] for a, b in steps), any(language.get(a[0]) != language.get(b[0]) for a, b in steps), any(n[0] in sensitive for n in nodes)))
    return sorted(out)


@pytest.mark.parametrize("seed, sink, depth", [(1, None, 10), (2, "merge", 6), (3, None, 3), (4, None, 1)])
def test_paths_equal_a_plain_search(spark, seed, sink, depth):
    r = random.Random(seed)
    nodes = [(f"src/{r.choice('ab')}/f{k}.rs", NAMES[k % 10]) for k in range(14)]
    calls = [(*r.choice(nodes), *r.choice(nodes), r.choice(["exact", "exact", "approximate"])) for _ in range(22)]
    sources = r.sample(nodes, 3)
    language = {p: r.choice(["rust", "python"]) for p, _ in nodes if r.random() < 0.8}
    sensitive = {nodes[0][0], nodes[5][0]}
    df = spark.createDataFrame(calls * 2, "caller_path string, caller string, callee_path string, callee string, confidence string")
    found = flow.trace(df, spark.createDataFrame(sources, "path string, symbol string"), sink, depth, spark.createDataFrame(list(language.items()), "path string, language string"), spark.createDataFrame([(p,) for p in sensitive], "path string"))
    got = sorted((tuple((n.path, n.symbol) for n in x.nodes), x.end, x.confidence, x.truncated, x.crosses_module, x.crosses_language, x.touches_sensitive) for x in found.collect())
    assert got == plain(calls, sources, sink, depth, language, sensitive)
    assert all(x.length == len(x.nodes) == len(x.kinds) and x.kinds[0] == "source" for x in found.collect())


def test_without_calls_or_depth(spark):
    df = spark.createDataFrame([("a", "f", "b", "save", "exact")], "caller_path string, caller string, callee_path string, callee string, confidence string")
    sources = spark.createDataFrame([("a", "f")], "path string, symbol string")
    assert flow.trace(df.limit(0), sources).count() == 0
    (x,) = flow.trace(df, sources, depth=0).collect()
    assert x.length == 1 and not x.truncated and x.confidence == "exact"
