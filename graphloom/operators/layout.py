"""Layered drawing of dependency graphs, of many graphs at once.

Cycles are condensed, nodes stand in layers by the longest path from a source, edges over several
layers are led through a point on each, four sweeps order the layers by the mean place of their
neighbours, and running sums of widths give coordinates. Nodes of a layer are ranked by ranges of
their key, so a layer of any size is dealt out; a sweep goes from layer to layer, each step a join of
two layers (all graphs at once), and steps number four times the layers. Graphs of few points, as those
with a limit of nodes a layer are, are swept each in a task instead.

``nodes``: ``id`` and, where they are there, ``graph``, ``width``, ``height``. ``edges``: ``source, target``. Ids are unique
over all graphs; edges between graphs, or to ids that aren't nodes, don't count; parallel ones count once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graphs, ranking
from graphloom.operators.lineage import written

#: Beside each other and above each other; sizes of a node; nodes of a layer at most where it is asked for;
#: sweeps; and the width of a grid in heights. Fixed values.
NODE_SEP, LAYER_SEP, WIDTH, HEIGHT = 60.0, 120.0, 160.0, 48.0
LAYER_LIMIT, SWEEPS, GRID, GRID_LEAST = 9, 4, 1.6, 4
#: Points, and steps between them, of a graph that one task sweeps; a larger one goes by ranges. A plan only: the result is the same.
FEW = 200_000


@dataclass(frozen=True)
class Drawing:
    """``nodes``: graph, id, layer, place (in its layer), x, y, width, height, members (ids that a cluster stands for);
    ``edges``: graph, source, target, waypoints; ``extents``: graph, width, height."""

    nodes: DataFrame
    edges: DataFrame
    extents: DataFrame


def _complete(nodes: DataFrame) -> DataFrame:
    have = set(nodes.columns)
    graph = F.col("graph") if "graph" in have else F.lit("")
    width = F.coalesce(F.col("width").cast("double"), F.lit(WIDTH)) if "width" in have else F.lit(WIDTH)
    height = F.coalesce(F.col("height").cast("double"), F.lit(HEIGHT)) if "height" in have else F.lit(HEIGHT)
    return written(nodes.select(graph.alias("graph"), "id", width.alias("width"), height.alias("height")))


def _within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes of one graph, each once."""
    ends = nodes.select("graph", "id")
    both = edges.select("source", "target").distinct().join(ends.withColumnRenamed("id", "source"), "source")
    return both.join(ends.select(F.col("graph").alias("other"), F.col("id").alias("target")), "target").where("graph = other").select("graph", "source", "target")


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, layer``: the longest path from a node without incoming edges, where the nodes of a cycle are one."""
    pairs = written(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).where("source <> target"))
    groups = written(graphs.components(pairs))
    named = nodes.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    named = written(named)
    ends = pairs.join(named.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    depth = graphs.layers(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    return named.join(depth.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def clustered(nodes: DataFrame, edges: DataFrame, most: int = LAYER_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes (with ``layer`` and ``members``) and edges where each layer of more than ``most`` nodes keeps the first of them, by id,
    and one cluster that stands for the others and has their edges."""
    placed = written(ranking.places(nodes, ["graph", "layer"], [F.col("id")], "_place"))
    full = placed.groupBy("graph", "layer").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    marked = written(placed.join(full, ["graph", "layer"], "left"))
    inside = F.col("_n").isNotNull() & (F.col("_place") >= most - 1)
    name = F.concat(F.lit("__cluster_"), F.when(F.col("graph") == "", "").otherwise(F.concat("graph", F.lit("_"))), F.col("layer").cast("string"))
    moved = written(marked.where(inside).select("graph", "id", "layer", "_place", name.alias("cluster")))
    made = moved.groupBy("graph", "layer", F.col("cluster").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "id"))), lambda s: s["id"]).alias("members"))
    out = marked.where(~inside).select("graph", "id", "width", "height", "layer", F.lit(None).cast("array<string>").alias("members"))
    out = out.unionByName(made.select("graph", "id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "layer", "members"))
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(moved.select(F.col("id").alias(end), "cluster"), end, "left").withColumn(end, F.coalesce("cluster", end)).drop("cluster")
    return written(out), written(ends.where("source <> target").select("graph", "source", "target").distinct())


def layout(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> Drawing:
    """The drawing of each graph; ``limit``: nodes of a layer at most (see ``clustered``). A graph of one layer becomes a grid."""
    own = _complete(nodes)
    pairs = written(_within(own, edges))
    own = written(own.join(layered(own, pairs), "id").withColumn("members", F.lit(None).cast("array<string>")).select("graph", "id", "width", "height", "layer", "members"))
    if limit:
        own, pairs = clustered(own.drop("members"), pairs, limit)
    chains = written(_chains(own, pairs))
    points = chains.where("inner").select("graph", F.col("id"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"), "layer")
    every = own.select("graph", "id", "width", "height", "layer").unionByName(points)
    ordered = _ordered(written(every), written(_steps(chains)))
    return _drawn(own, pairs, chains, ordered)


def _chains(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each edge as its points from layer to layer: graph, source, target, layer, id, inner (not an end)."""
    at = nodes.select("id", "layer")
    both = pairs.join(at.select(F.col("id").alias("source"), F.col("layer").alias("lo")), "source").join(at.select(F.col("id").alias("target"), F.col("layer").alias("hi")), "target")
    each = both.where("hi > lo").select("graph", "source", "target", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("layer"))
    inner = (F.col("layer") > F.col("lo")) & (F.col("layer") < F.col("hi"))
    point = F.concat_ws("_", F.lit("__dummy"), "source", "target", F.col("layer").cast("string"))
    return each.select("graph", "source", "target", "layer", F.when(inner, point).when(F.col("layer") == F.col("lo"), F.col("source")).otherwise(F.col("target")).alias("id"), inner.alias("inner"))


def _steps(chains: DataFrame) -> DataFrame:
    """Neighbours on layers that follow each other: layer, upper, lower."""
    below = chains.select("graph", "source", "target", (F.col("layer") - 1).alias("layer"), F.col("id").alias("lower"))
    return chains.withColumnRenamed("id", "upper").join(below, ["graph", "source", "target", "layer"]).select("graph", "layer", "upper", "lower")


def _ordered(every: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """The nodes and points with their places after the sweeps: graph, id, width, height, layer, place."""
    first = written(ranking.places(every, ["graph", "layer"], [F.col("id")], "place"))
    sizes = first.select("graph", F.lit(1).alias("point"), F.lit(0).alias("step")).unionByName(steps.select("graph", F.lit(0).alias("point"), F.lit(1).alias("step")))
    few = written(sizes.groupBy("graph").agg(F.sum("point").alias("points"), F.sum("step").alias("steps")).where((F.col("points") <= FEW) & (F.col("steps") <= FEW)).select("graph"))
    of = lambda df, how: df.join(few, "graph", how)
    small = of(first, "left_semi").groupBy("graph").cogroup(of(steps, "left_semi").groupBy("graph")).applyInPandas(_swept, first.schema)
    return [small, *_by_ranges(of(first, "left_anti"), of(steps, "left_anti"))]


def _swept(points: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """The points of one graph (with places by id) with their places after the sweeps."""
    points = points.sort_values(["layer", "place"], ignore_index=True)
    layer, first = points["layer"].to_numpy(), points["place"].to_numpy()
    place, number = first.copy(), points[["layer", "id"]].assign(i=np.arange(len(points)))
    met = steps.merge(number.rename(columns={"id": "upper", "i": "a"}), on=["layer", "upper"])
    met = met.assign(layer=met["layer"] + 1).merge(number.rename(columns={"id": "lower", "i": "b"}), on=["layer", "lower"]).sort_values("layer")
    a, b, below = met["a"].to_numpy(), met["b"].to_numpy(), met["layer"].to_numpy()
    last = int(layer.max(initial=0))
    at, step = np.searchsorted(layer, np.arange(last + 2)), np.searchsorted(below, np.arange(last + 2))
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        for k in range(1, last + 1) if down else range(last - 1, -1, -1):
            own, near = slice(at[k], at[k + 1]), slice(step[k], step[k + 1]) if down else slice(step[k + 1], step[k + 2])
            fixed, mine = (a[near], b[near]) if down else (b[near], a[near])
            n = at[k + 1] - at[k]
            count = np.bincount(mine - at[k], minlength=n)
            mean = np.where(count > 0, np.bincount(mine - at[k], place[fixed], n) / np.maximum(count, 1), place[own])
            ranked = np.empty(n, place.dtype)
            ranked[np.lexsort((first[own], mean))] = np.arange(n)
            place[own] = ranked
    return points.assign(place=place)


def _by_ranges(points: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """For each layer, its nodes and points with their places after the sweeps."""
    first = written(points, "layer")
    last = first.agg(F.max("layer")).first()[0]
    if last is None:
        return []
    steps = written(steps, "layer")
    now = [written(first.where(F.col("layer") == k)) for k in range(last + 1)]
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        for k in range(1, last + 1) if down else range(last - 1, -1, -1):
            near = steps.where(F.col("layer") == (k - 1 if down else k)).select(F.col("upper" if down else "lower").alias("fixed"), F.col("lower" if down else "upper").alias("id"))
            fixed = now[k - 1 if down else k + 1].select(F.col("id").alias("fixed"), F.col("place").alias("at"))
            means = near.join(fixed, "fixed").groupBy("id").agg((F.sum("at") / F.count("*")).alias("mean"))
            keyed = now[k].join(means, "id", "left").withColumn("mean", F.coalesce("mean", F.col("place").cast("double"))).drop("place")
            now[k] = written(ranking.places(keyed, ["graph"], [F.col("mean"), F.col("id")], "place").select(*first.columns))
    return now


def _drawn(own: DataFrame, pairs: DataFrame, chains: DataFrame, ordered: list[DataFrame]) -> Drawing:
    every = ordered[0]
    for layer in ordered[1:]:
        every = every.unionByName(layer)
    every = written(every)
    before = ranking.running(every, ["graph", "layer"], [F.col("place")], {"before": F.col("width")})
    wide = every.groupBy("graph", "layer").agg((F.sum("width") + (F.count("*") - 1) * NODE_SEP).alias("wide"))
    x = F.col("before") + F.col("place") * NODE_SEP + F.col("width") / 2 - F.col("wide") / 2
    at = written(before.join(wide, ["graph", "layer"]).select("graph", "id", "layer", "place", "width", x.alias("x"), (F.col("layer") * (HEIGHT + LAYER_SEP)).alias("y")))
    edge = at.groupBy("graph").agg(F.least(F.min("x"), F.lit(0.0)).alias("left"), F.max("layer").alias("last"))
    at = written(at.join(edge, "graph").withColumn("x", F.col("x") - F.col("left")).drop("left"))
    real = ranking.places(own.join(at.select("id", "x", "y", "last", F.col("place").alias("spot")), "id"), ["graph", "layer"], [F.col("spot")], "place").drop("spot")
    real = written(_gridded(real).select("graph", "id", "layer", "place", "x", "y", "width", "height", "members"))
    bends = chains.where("inner").join(at.select("id", "x", "y"), "id").groupBy("graph", "source", "target").agg(F.sort_array(F.collect_list(F.struct("layer", "x", "y"))).alias("bends"))
    waypoints = F.transform(F.coalesce("bends", F.array().cast("array<struct<layer:int,x:double,y:double>>")), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y")))
    lines = pairs.join(bends, ["graph", "source", "target"], "left").select("graph", "source", "target", waypoints.alias("waypoints"))
    span = lambda c, size: F.max(F.col(c) + F.col(size) / 2) - F.min(F.col(c) - F.col(size) / 2)
    extents = real.groupBy("graph").agg(span("x", "width").alias("width"), span("y", "height").alias("height"))
    return Drawing(real, lines, extents)


def _gridded(real: DataFrame) -> DataFrame:
    """Graphs of one layer as grids, by id; the others as they are."""
    sizes = real.where("last = 0").groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") >= GRID_LEAST)
    flat = written(ranking.places(real.join(sizes, "graph"), ["graph"], [F.col("id")], "k"))
    columns = F.greatest(F.ceil(F.sqrt(F.col("n") * GRID)), F.lit(1))
    row, column = F.floor(F.col("k") / columns), F.col("k") % columns
    grid = flat.withColumn("layer", row.cast("int")).withColumn("place", column).withColumn("x", column * (WIDTH + NODE_SEP)).withColumn("y", row * (HEIGHT + NODE_SEP))
    kept = real.join(sizes, "graph", "left_anti")
    return kept.unionByName(grid.select(*[F.col(f.name).cast(f.dataType) for f in kept.schema.fields]))
