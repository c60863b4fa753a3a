"""Stored derived indexes: deltas equal full builds, wrong bases and damaged sets are refused."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from graphloom.operators import derived, scan


def edges_of(some, every):
    """A file names what it needs, a path a line."""
    named = some.select(F.col("path").alias("src"), F.explode(F.split("content", "\n")).alias("dst")).where("src <> dst")
    return named.join(every.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("import").alias("edge_type")).distinct()


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def same(a, b):
    for key in ("files", "tree", "edges"):
        assert sorted(map(tuple, a.tables[key].select(b.tables[key].columns).collect())) == sorted(map(tuple, b.tables[key].collect()))
    x, y = ({r.node: r.score for r in s.tables["rank"].collect()} for s in (a, b))
    assert set(x) == set(y) and all(abs(x[k] - y[k]) < 1e-3 for k in x)


def test_deltas_equal_full_builds(spark, tmp_path):
    r = random.Random(3)
    names = [f"src/f{k:02}.rs" for k in range(40)]
    files = {n: "\n".join(r.sample(names, r.randint(0, 3))) for n in names}
    at = f"file://{tmp_path}/a"
    now = derived.build(spark, at, frame(spark, files), edges_of)
    edits = [({n: "\n".join(r.sample(names, 2)) for n in r.sample(names, 4)}, []), ({"src/new.rs": names[0]}, [names[5]])]
    for changed, removed in edits:
        files = {n: c for n, c in (files | changed).items() if n not in removed}
        now = derived.advance(spark, at, now.fingerprint, frame(spark, files), paths(spark, changed), paths(spark, removed), edges_of)
        full = derived.build(spark, f"file://{tmp_path}/b", frame(spark, files), edges_of)
        assert now.fingerprint == full.fingerprint
        same(now, full)
    assert derived.load(spark, at, now.fingerprint).fingerprint == now.fingerprint


def test_what_cannot_be_trusted_is_not_used(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert derived.load(spark, at) is None
    with pytest.raises(derived.WrongBase):
        derived.load_for_delta(spark, at, "x")
    files = frame(spark, {"a": "b", "b": ""})
    made = derived.build(spark, at, files, edges_of)
    assert derived.load(spark, at, "other") is None and derived.load(spark, at, made.fingerprint, version=2) is None
    with pytest.raises(derived.WrongBase):
        derived.advance(spark, at, "other", files, paths(spark, ["a"]), paths(spark, ["none"]).limit(0), edges_of)
    assert derived.load_for_delta(spark, at, made.fingerprint).fingerprint == made.fingerprint
    folder = next(p for p in tmp_path.iterdir() if p.is_dir())
    shutil.rmtree(folder / "rank")
    assert derived.load(spark, at) is None
    (tmp_path / derived.POINTER).write_text("{half")
    (tmp_path / f".{derived.POINTER}.crc").unlink(missing_ok=True)
    assert derived.load(spark, at) is None


def test_a_fingerprint_is_that_of_the_files(spark):
    a = scan.hash_tree(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string"))
    b = scan.hash_tree(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, hash string"))
    assert derived.root(a) == derived.root(b) != derived.root(scan.hash_tree(spark.createDataFrame([("a", "1"), ("b", "3")], "path string, hash string")))
    assert derived.root(a.limit(0)) == ""
