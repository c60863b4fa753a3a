"""Interval joins against comparing all pairs."""

import random

import pytest

from graphloom.operators import intervals


def data(r, n, m, wide):
    spans = []
    for k in range(m):
        g, first = r.choice(["a", "b", "hot", "hot", "hot", None]), r.randint(0, 1000)
        spans.append((g, first, first + r.choice([-1, 0, 3, 40, wide]), r.randint(0, 50), f"s{k}"))
    points = [(r.choice(["a", "b", "hot", "hot", "none", None]), r.choice([r.randint(0, 1100), 500, None]), k) for k in range(n)]
    return spans, points


@pytest.mark.parametrize("seed, n, m, wide", [(1, 600, 80, 900), (2, 900, 300, 200), (3, 50, 0, 1), (4, 400, 400, 5000)])
def test_first_holding_equals_all_pairs(spark, seed, n, m, wide):
    spans, points = data(random.Random(seed), n, m, wide)
    s = spark.createDataFrame(spans, "path string, first int, last int, ord int, name string").repartition(3)
    p = spark.createDataFrame(points, "path string, line int, k int").repartition(3)
    got = {x.k: x.name for x in intervals.first_holding(p, s, "path", "line", "<module>").collect()}
    want = {k: min(((o, name) for h, a, b, o, name in spans if g is not None and h == g and at is not None and a <= at <= b), default=(0, "<module>"))[1] for g, at, k in points}
    assert got == want


def test_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        r = random.Random(8)
        spans = [("f", a, a + r.choice([5, 300, 2000]), k, f"s{k}") for k, a in enumerate(r.sample(range(4000), 300))] + [("f", 0, 5000, 999, "all"), ("g", 10, 20, 0, "g")]
        points = [("f", at, at) for at in range(0, 5000, 3)] + [("g", 15, 9999)]
        got = {x.k: x.name for x in intervals.first_holding(spark.createDataFrame(points, "path string, line int, k int"), spark.createDataFrame(spans, "path string, first int, last int, ord int, name string"), "path", "line").collect()}
        assert got == {k: min(((o, n) for h, a, b, o, n in spans if h == g and a <= at <= b), default=(0, None))[1] for g, at, k in points}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed, n, m, wide", [(1, 60, 80, 900), (2, 200, 300, 20), (3, 0, 10, 1), (4, 10, 0, 5)])
def test_touched_equals_all_pairs(spark, seed, n, m, wide):
    spans, points = data(random.Random(seed), n, m, wide)
    s = spark.createDataFrame(spans, "path string, first int, last int, ord int, name string")
    p = spark.createDataFrame(points, "path string, line int, k int")
    got = sorted(x.name for x in intervals.touched(s, p, "path", "line").collect())
    assert got == sorted(name for g, a, b, _, name in spans if any(h == g and g is not None and at is not None and a <= at <= b for h, at, _ in points))
