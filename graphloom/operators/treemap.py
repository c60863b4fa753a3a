"""The risk treemap: files as areas by what depends on them, in modules, in the repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least risks of each severity; fixed values.
HIGH, MEDIUM = 0.7, 0.4


def severity(risk: Column) -> Column:
    return F.when(risk >= HIGH, "high").when(risk >= MEDIUM, "medium").otherwise("low")


def group_of(path: Column) -> Column:
    """Two segments of a path with more, one of a path with two, else ``other``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) == 2, parts[0]).otherwise("other")


def treemap(entries: DataFrame) -> DataFrame:
    """``kind, id, parent, label, area, severity, risk, percentile, children`` of the root, its modules and their files. ``entries``: path,
    risk, percentile, dependents. A file's area is its dependents, at least 1; a module's is the sum of its files', its severity
    that of its riskiest file."""
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    files = entries.select(F.lit("file").alias("kind"), F.col("path").alias("id"), group_of(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("label"), F.greatest(F.col("dependents").cast("double"), F.lit(1.0)).alias("area"), severity(F.col("risk")).alias("severity"), F.col("risk").cast("double").alias("risk"), F.col("percentile").cast("double").alias("percentile"), none.alias("children"))
    modules = files.groupBy("parent").agg(F.sum("area").alias("area"), F.max("risk").alias("most"), F.count("*").alias("children"))
    named = modules.select(F.lit("module").alias("kind"), F.col("parent").alias("id"), F.lit("root").alias("parent"), F.col("parent").alias("label"), "area", severity(F.col("most")).alias("severity"), zero.alias("risk"), zero.alias("percentile"), "children")
    root = modules.agg(F.coalesce(F.sum("area"), zero).alias("area"), F.coalesce(F.max("most"), zero).alias("most"), F.count("*").alias("children"))
    top = root.select(F.lit("root").alias("kind"), F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("Repository").alias("label"), "area", severity(F.col("most")).alias("severity"), zero.alias("risk"), zero.alias("percentile"), "children")
    return files.unionByName(named).unionByName(top)
