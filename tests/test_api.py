"""Every operation of the facade over a small repository."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.plans.code_queries import FILES
from graphloom.plans.repository_queries import REPOSITORY

NEEDS = {
    "context": {"task": "load the user in src/db.py", "tokens": 400},
    "briefing": {"task": "load the user", "tokens": 400},
    "context_for_task": {"task": "load user"},
    "pack_context": {"files": ["src/app.py", "nope.py"], "include_dependencies": True, "tokens": 300},
    "retrieval": {"retrieval_op": "search", "target": "load"},
    "search": {"pattern": "def \\w+"},
    "graph": {"graph_op": "nodes"},
    "trace": {"target": "load_user"},
    "blast_radius": {"files": ["src/util.py"]},
    "data_flow": {"symbol": "main"},
    "predict": {"files": ["src/util.py"]},
}


@pytest.fixture(scope="module")
def base(spark):
    files = spark.createDataFrame([*FILES, *[f for f in REPOSITORY if f[0] not in dict(FILES)]], "path string, content string")
    day = dt.date(2024, 1, 1)
    log = [(f"c{i}", p, i, day, "fix") for i, ps in enumerate([["src/app.py", "src/db.py"], ["src/db.py", "src/util.py"], ["src/app.py", "src/db.py"]]) for p in ps]
    return api.Codebase(files, spark.createDataFrame(log, "sha string, path string, age long, day date, message string"))


def test_there_are_all_operations():
    assert len(api.OPERATIONS) == 29


@pytest.mark.parametrize("op", sorted(api.OPERATIONS))
def test_operation(spark, base, op):
    params = dict(NEEDS.get(op, {}))
    if op in ("diff", "review", "verify"):
        params["old"] = base.files.where("path <> 'src/util.py'").withColumn("content", F.when(F.col("path") == "src/db.py", "x = 1\n").otherwise(F.col("content")))
    if op == "visual":
        params = {"type": "graph", "format": "canonical"}
    got = {k: v.collect() if hasattr(v, "collect") else v for k, v in api.call(base, op, **params).items()}
    some = {k: len(v) for k, v in got.items() if isinstance(v, list)}
    assert got and (op in ("verify", "drift") or any(some.values()))
    if op == "pack_context":
        assert got["not_found"] == ["nope.py"] and {r.path for r in got["files"]} == {"src/app.py", "src/db.py", "src/util.py"}
    if op == "blast_radius":
        assert {"src/app.py", "src/db.py", "tests/test_db.py"} <= {r.path for r in got["affected"]}
    if op == "review":
        assert {(r.path, r.change) for r in got["changes"]} == {("src/util.py", "new"), ("src/db.py", "modified")}
        assert ("src/db.py", "load_user", "added") in {(r.path, r.name, r.change) for r in got["symbols"]}
    if op == "context":
        assert got["mentions"] == ["src/db.py"] and sum(r.tokens for r in got["files"]) <= 400
    if op == "health":
        assert 0 <= got["score"][0].composite <= 10


def test_unknown_operation(base):
    with pytest.raises(ValueError, match="not an operation"):
        api.call(base, "nothing")


def test_codebase_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    return 1\n")
    got = api.Codebase.of(spark, str(tmp_path))
    assert [(r.path, r.name) for r in got.symbols.collect()] == [("src/a.py", "f")]
