"""Derived indexes that outlive a run: a set of tables (graph, ranks, and whatever else follows from the files) under the
fingerprint of the files it was made from, and a pointer that is moved as a whole.

A set is written to a folder of its own first and never changed; then the pointer, a small file, is replaced by a
rename. A reader sees the old set or the new one. What can't be trusted isn't used: another version, another
fingerprint, a missing table or a pointer that can't be read is a miss; a delta whose base isn't the one the caller
stands on is refused. ``advance`` makes the next set from an edit: edges of the edited files are exchanged, the hash
tree follows along their branches, and the ranks start from the old ones. It makes all anew where an edit changes which
files there are, as names that led nowhere may lead somewhere now."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graphs, scan

VERSION = 1
POINTER = "current.json"


class WrongBase(ValueError):
    """A delta for another state than the one that is stored."""


@dataclass(frozen=True)
class Derived:
    fingerprint: str
    tables: dict[str, DataFrame]


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    fs, path = _files(spark, folder)
    at = path(f"{folder}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def save(spark: SparkSession, folder: str, fingerprint: str, tables: dict[str, DataFrame], version: int = VERSION) -> Derived:
    """Write a set and point at it. Writers at the same time leave the pointer at one whole set or the other."""
    name = uuid.uuid4().hex
    for key, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}/{key}")
    fs, path = _files(spark, folder)
    said = json.dumps({"version": version, "fingerprint": fingerprint, "set": name, "tables": {k: df.schema.json() for k, df in tables.items()}})
    new, at = path(f"{folder}/{name}.json"), path(f"{folder}/{POINTER}")
    stream = fs.create(new, True)
    stream.write(bytearray(said.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(new, at, options)
    return Derived(fingerprint, {k: spark.read.schema(df.schema).parquet(f"{folder}/{name}/{k}") for k, df in tables.items()})


def load(spark: SparkSession, folder: str, fingerprint: str | None = None, version: int = VERSION) -> Derived | None:
    """The stored set, if it is of this version and (where one is given) this fingerprint, and is whole; else None."""
    said = _pointer(spark, folder)
    if not said or said.get("version") != version or (fingerprint is not None and said.get("fingerprint") != fingerprint):
        return None
    try:
        tables = {k: spark.read.parquet(f"{folder}/{said['set']}/{k}") for k in said["tables"]}
    except AnalysisException:  # a table is gone
        return None
    if any(tables[k].schema.jsonValue()["fields"] and [f.name for f in tables[k].schema] != [f["name"] for f in json.loads(s)["fields"]] for k, s in said["tables"].items()):
        return None
    return Derived(said["fingerprint"], tables)


def load_for_delta(spark: SparkSession, folder: str, base: str) -> Derived:
    """The stored set to build a delta on, which must be that of ``base``; whoever has none builds in full."""
    found = load(spark, folder)
    if found is None or found.fingerprint != base:
        raise WrongBase(f"stored: {found.fingerprint if found else 'nothing'}, asked for: {base}")
    return found


def root(tree: DataFrame) -> str:
    """The fingerprint of a hash tree of files; that of no files is empty."""
    top = tree.where("prefix = ''").first()
    return top["hash"] if top else ""


def _hashes(files: DataFrame) -> DataFrame:
    return files.select("path", scan.content_hash(F.col("path"), F.col("content")).alias("hash"))


def build(spark: SparkSession, folder: str, files: DataFrame, edges_of: Callable[[DataFrame, DataFrame], DataFrame]) -> Derived:
    """The set of a state: ``files`` (path, hash), ``tree``, ``edges`` and ``rank``. ``edges_of`` gives the edges (src, dst, edge_type) that
    some files (path, content) have into all files."""
    hashes = _hashes(files)
    tree = scan.hash_tree(hashes)
    edges = edges_of(files, files)
    return save(spark, folder, root(tree), {"files": hashes, "tree": tree, "edges": edges, "rank": graphs.pagerank(edges)})


def advance(spark: SparkSession, folder: str, base: str, files: DataFrame, changed: DataFrame, removed: DataFrame, edges_of: Callable[[DataFrame, DataFrame], DataFrame]) -> Derived:
    """The next set, from that of ``base``: ``files`` (path, content) are all files after the edit, ``changed`` (path) those that are new
    or have new contents, ``removed`` (path) those that are gone."""
    old = load_for_delta(spark, folder, base)
    known = old.tables["files"].select("path")
    if not removed.join(known, "path", "left_semi").isEmpty() or not changed.join(known, "path", "left_anti").isEmpty():
        return build(spark, folder, files, edges_of)
    edited = files.join(changed.select("path").distinct(), "path", "left_semi")
    hashes = old.tables["files"].join(edited.select("path"), "path", "left_anti").unionByName(_hashes(edited))
    tree = scan.update_tree(old.tables["tree"], old.tables["files"], _hashes(edited), removed)
    edges = graphs.edge_delta(old.tables["edges"], changed, removed, edges_of(edited, files))
    return save(spark, folder, root(tree), {"files": hashes, "tree": tree, "edges": edges, "rank": graphs.pagerank(edges, warm=old.tables["rank"])})
