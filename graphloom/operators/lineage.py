"""Cutting of lineages that several jobs or rounds read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of applications on one machine that name none.
_LOCAL: dict[str, str] = {}


def _named(spark: SparkSession) -> str | None:
    """The folder that executors share, as the session names it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found and not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found or sc.getCheckpointDir()


def _folder(spark: SparkSession) -> str | None:
    """The named folder; on one machine (tests), where none is named, a temporary one. None on a cluster that names none."""
    sc = spark.sparkContext
    found = _named(spark)
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = _LOCAL.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="graphloom-")
        _LOCAL[sc.applicationId] = found
    return found.rstrip("/") if found else None


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared folder where the session names one, which
    survives lost executors; else kept by the executors."""
    return df.checkpoint() if _named(df.sparkSession) else df.persist()


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``cut`` for a large relation that is read as a whole again: as compressed columns, where
    there is a shared folder. ``by``: a column whose values are read one at a time."""
    spark = df.sparkSession
    folder = _folder(spark)
    if not folder:
        return df.persist()
    path = f"{folder}/relation-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._graphloom_path = path
    return read


def together(tables: list[DataFrame]) -> DataFrame:
    """The union of relations of one schema; those that were written are one scan."""
    paths = [getattr(t, "_graphloom_path", None) for t in tables]
    if all(paths):
        return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
