"""Seeds against a plain version in order of path, and how often their edges are read."""

import random

from graphloom.operators import ranking, signals


def _plain(scores, edges, limit):
    near = {p: set() for p in scores}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    top = {p: s for p, s in scores.items() if s >= signals.SEED_THRESHOLD}
    out = dict(top)
    for p in sorted(top):
        for q in near[p]:
            out[q] = max(out.get(q, 0.0), out[p] * signals.FANOUT)
    return [(p, s, p in top) for p, s in sorted(out.items(), key=lambda x: (-x[1], x[0]))][:limit]


def test_seeds_equal_the_plain_version_in_order_of_path(spark):
    for seed, limit in ((1, 10), (2, 50), (3, 500)):
        rng = random.Random(seed)
        scores = {f"f{i:03}": rng.choice([0.05, 0.1, 0.2, round(rng.random() ** 4, 3)]) for i in range(150)}
        edges = [tuple(rng.sample(sorted(scores), 2)) for _ in range(200)]
        got = signals.seeds(spark.createDataFrame(list(scores.items()), "path string, score double"), spark.createDataFrame(edges, "src string, dst string"), limit=limit).collect()
        assert [tuple(r) for r in got] == _plain(scores, edges, limit)


def test_edges_are_read_no_more_than_lifts_need(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(100)], "src string, dst string")
    edges = edges.mapInArrow(count, edges.schema)
    scores = spark.createDataFrame([(f"f{i}", 0.9 - i / 1000) for i in range(102)], "path string, score double")
    got = signals.seeds(scores, edges).collect()
    assert [r.path for r in got] == [f"f{i}" for i in range(50)]
    assert read.value <= 2 * 100  # nothing is lifted over the fiftieth score


def test_ranks_by_several_values_read_their_rows_once_for_each(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 2, 4)], "path string, x int, y int")
    got = {r.path: (r.rx, r.ry) for r in ranking.competition_ranks(rows, {"x": "rx", "y": "ry"}).collect()}
    assert got == {"a": (3, 1), "b": (1, 1), "c": (1, 3)}
