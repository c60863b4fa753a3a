"""Data flow along calls: paths from symbols to sinks, many sources at once.

A path grows by a join of its last node with the calls, one hop a round, and ends at a sink (by its
name, or the one that was asked for), where nothing is called, where it meets itself, or at the depth.
Paths are all simple ones within the depth, so their number is that of the result; sinks bound it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import predicates
from graphloom.operators.lineage import together, written

#: Nodes of a path at most, and parts of names that tell what a callee does; fixed values.
DEPTH = 10
SINKS = ["save", "insert", "write", "put", "update", "delete", "send", "respond", "render", "emit", "publish", "store"]
TRANSFORMS = ["parse", "validate", "format", "sanitize", "transform", "encode", "decode", "serialize", "deserialize", "normalize"]


def kind_of(symbol: Column) -> Column:
    name = F.lower(symbol)
    return F.when(predicates.contains_any(name, SINKS), "sink").when(predicates.contains_any(name, TRANSFORMS), "transform").otherwise("passthrough")


def trace(calls: DataFrame, sources: DataFrame, sink: str | None = None, depth: int = DEPTH, languages: DataFrame | None = None, sensitive: DataFrame | None = None) -> DataFrame:
    """``source, nodes, kinds, length, end, confidence, truncated, crosses_module, crosses_language, touches_sensitive``. ``calls``: caller_path,
    caller, callee_path, callee, confidence (exact or approximate); ``sources``: path, symbol; ``languages``: path, language;
    ``sensitive``: path. ``end``: sink, dead_end, cycle (the node that is met again stands twice) or depth; the last two
    are truncated. Without calls there are no paths; with a depth of 0 a path is its source."""
    depth = min(depth, DEPTH)
    hops = calls.where("callee_path is not null").select("caller_path", "caller", F.struct(F.col("callee_path").alias("path"), F.col("callee").alias("symbol")).alias("next"), (F.col("confidence") == "exact").alias("sure"))
    hops = written(hops.distinct())
    start = written(sources.select(F.array(F.struct("path", "symbol")).alias("nodes"), F.lit(True).alias("exact")).distinct())
    if depth == 0:
        found = start.withColumn("end", F.lit("depth"))
        return _told(found.where(F.lit(not hops.isEmpty())), languages, sensitive).withColumn("truncated", F.lit(False))
    last, size = F.element_at("nodes", -1), F.size("nodes")
    asked = last["symbol"] == sink if sink is not None else F.lit(False)
    cyclic = F.array_contains(F.slice("nodes", F.lit(1), size - 1), last)
    at_sink = asked | ((size > 1) & (kind_of(last["symbol"]) == "sink"))
    end = F.when(cyclic, "cycle").when(at_sink, "sink").when(size >= depth, "depth")
    now = start.limit(0) if hops.isEmpty() else start
    ended = []
    for _ in range(depth):
        met = now.withColumn("end", end)
        step = met.join(hops, met["end"].isNull() & (last["path"] == F.col("caller_path")) & (last["symbol"] == F.col("caller")), "left")
        step = written(step.select("nodes", "exact", F.when(F.col("end").isNull() & F.col("next").isNull(), "dead_end").otherwise(F.col("end")).alias("end"), "next", "sure"))
        ended.append(step)
        now = step.where("end is null").select(F.concat("nodes", F.array("next")).alias("nodes"), (F.col("exact") & F.col("sure")).alias("exact"))
        if now.isEmpty():
            break
    found = together(ended).where("end is not null").select("nodes", "exact", "end")
    return _told(found, languages, sensitive)


def _told(found: DataFrame, languages: DataFrame | None, sensitive: DataFrame | None) -> DataFrame:
    paths = F.transform("nodes", lambda n: n["path"])
    near = lambda values: F.exists(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: ~F.element_at(values, i.cast("int")).eqNullSafe(F.get(values, i.cast("int"))) & (i < F.size(values)))
    rows = written(found.withColumn("id", F.monotonically_increasing_id()))
    modules = F.transform(paths, lambda p: predicates.module_of_segments(p))
    kinds = F.transform("nodes", lambda n, i: F.when(i == 0, "source").otherwise(kind_of(n["symbol"])))
    out = rows.select("id", F.element_at("nodes", 1).alias("source"), "nodes", kinds.alias("kinds"), F.size("nodes").alias("length"), "end", F.when(F.col("exact"), "exact").otherwise("approximate").alias("confidence"), F.col("end").isin("cycle", "depth").alias("truncated"), near(modules).alias("crosses_module"))
    each = rows.select("id", F.posexplode(paths).alias("at", "path"))
    if languages is not None:
        spoken = each.join(languages.select("path", "language"), "path", "left").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("language", F.lit("unknown")).alias("l")))), lambda x: x["l"]).alias("spoken"))
        out = out.join(spoken, "id", "left").withColumn("crosses_language", near(F.col("spoken"))).drop("spoken")
    else:
        out = out.withColumn("crosses_language", F.lit(None).cast("boolean"))
    if sensitive is not None:
        hit = each.join(sensitive.select("path").distinct(), "path", "left_semi").select("id").distinct().withColumn("touches_sensitive", F.lit(True))
        out = out.join(hit, "id", "left").withColumn("touches_sensitive", F.coalesce("touches_sensitive", F.lit(False)))
    else:
        out = out.withColumn("touches_sensitive", F.lit(False))
    return out.drop("id")
