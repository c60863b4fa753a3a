"""Graph operators over an edge DataFrame (src, dst, edge_type ...). Frontiers are joins; every
loop is bounded by a depth or a number of rounds, and long lineages are cut by checkpoints in
the shared folder where one is set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut as _cut

#: Weight of an edge type in a blast radius; fixed values.
BLAST_WEIGHTS = {"import": 1.0, "foreign_key": 1.0, "orm_model": 1.0, "column_reference": 0.9, "embedded_sql": 0.8, "view_reference": 0.8, "function_reference": 0.8, "trigger_target": 0.6, "index_target": 0.6, "migration_sequence": 0.5}
CROSS_LANGUAGE_WEIGHT = 0.5


def _kept(df: DataFrame) -> DataFrame:
    """A relation that several rounds read: computed once, and written where a folder is."""
    return _cut(df)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction"), "edge_type")
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction"), "edge_type")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def reach(edges: DataFrame, seeds: list[str], depth: int | None = None, direction: str = "both") -> DataFrame:
    """``node, hops`` within ``depth`` of the seeds that exist; without a depth, until nothing
    new is met."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = _kept({"out": pairs, "in": back, "both": pairs.unionByName(back)}[direction].distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    seen = nodes.where(F.col("node").isin(seeds)).withColumn("hops", F.lit(0))
    frontier = seen
    k = 0
    while depth is None or k < depth:
        k += 1
        step = frontier.join(pairs, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        if depth is None or k % 3 == 0:
            frontier = _cut(frontier)
            if not frontier.limit(1).count():
                break
            seen = _cut(seen.unionByName(frontier))
        else:
            seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, seeds: list[str], depth: int = 1) -> DataFrame:
    """The edges between the nodes within ``depth`` of the seeds."""
    edges = _kept(edges)
    near = _kept(reach(edges, seeds, depth).select("node"))
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``hop, node`` of the lexicographically smallest of the shortest directed paths: levels
    backwards from the end until the start or nothing new is met, each naming the smallest
    neighbour one level closer; then a walk along these."""
    spark = edges.sparkSession
    pairs = _kept(edges.select("src", "dst").distinct())
    best = spark.createDataFrame([(end, None)], "node string, next string")
    frontier = best.select("node")
    while not best.where(F.col("node") == start).limit(1).count():
        step = pairs.join(frontier.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
        level = _cut(step.join(best.select("node"), "node", "left_anti"))
        if not level.limit(1).count():
            break
        best, frontier = _cut(best.unionByName(level)), level.select("node")
    path, now = [], start
    while now is not None:  # one look-up a hop: a path is short beside its graph
        row = best.where(F.col("node") == now).first()
        if row is None:
            return spark.createDataFrame([], "hop int, node string")
        path.append((len(path), now))
        now = row.next
    return spark.createDataFrame(path, "hop int, node string")


def _ranked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    return nodes.join(out, "node", "left")


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tol: float | None = 1e-6, personal: dict[str, float] | None = None, warm: DataFrame | None = None) -> DataFrame:
    """``node, score``, divided by the largest. Parallel edges count each; what dangling nodes
    hold is spread like the teleport. ``tol`` None runs all rounds. ``warm`` (node, score): the
    ranks to begin with; nodes that it lacks begin with the mean."""
    pairs = _kept(edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    if not n:
        return edges.sparkSession.createDataFrame([], "node string, score double")
    total = sum((personal or {}).values())
    if personal and total > 0:
        given = edges.sparkSession.createDataFrame([(k, v / total) for k, v in personal.items()], "node string, t double")
        nodes = nodes.join(given, "node", "left").select("node", F.coalesce("t", F.lit(0.0)).alias("t"))
    else:
        nodes = nodes.withColumn("t", F.lit(1.0 / n))
    base = _kept(_ranked(pairs, nodes))
    rank = base.select("node", F.lit(1.0 / n).alias("r"))
    if warm is not None:
        known = base.select("node").join(warm, "node", "left")
        mean = known.agg(F.avg("score"), F.sum(F.coalesce("score", F.lit(0.0)))).first()
        if mean[0]:
            whole = mean[1] + mean[0] * known.where("score is null").count()
            rank = known.select("node", (F.coalesce("score", F.lit(mean[0])) / whole).alias("r"))
    for k in range(rounds):
        have = rank.join(base, "node")
        lost = have.where("deg is null").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        flow = have.where("deg is not null").join(pairs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w") / F.col("deg")).alias("x"))
        new = base.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) * F.col("t") + damping * (F.coalesce("x", F.lit(0.0)) + F.col("lost") * F.col("t"))).alias("r"))  # lost is a row of one
        if tol is not None or k % 3 == 2:
            new = _cut(new)
        settled = tol is not None and new.join(rank.withColumnRenamed("r", "old"), "node").agg(F.max(F.abs(F.col("r") - F.col("old")))).first()[0] < tol
        rank = new
        if settled:
            break
    top = rank.agg(F.max("r").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("node", (F.col("r") / F.col("top")).alias("score"))


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected groups of more than one node: ``node, component``, the component
    named by its smallest node. Trimming and colouring: nodes without an edge in or out go;
    each node takes the smallest name that reaches it; of every colour, what reaches the
    node that gave it, going backwards within the colour, is a component. Work is linear in
    the edges for each round, and pairs of nodes are never listed."""
    spark = edges.sparkSession
    left = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        left, size = _trim(left)
        if not size:
            break
        colour = _spread(left, left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inner = _cut(inner.select("src", "dst", F.col("cs").alias("c")))
        seen = _cut(colour.where("node = c"))
        frontier = seen
        while True:
            step = inner.join(frontier.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            frontier = _cut(step.join(seen, ["node", "c"], "left_anti"))
            if not frontier.limit(1).count():
                break
            seen = _cut(seen.unionByName(frontier))
        many = seen.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
        groups = _cut(seen.join(many, "c", "left_semi").select("node", F.col("c").alias("component")))
        found = groups if found is None else found.unionByName(groups)
        gone = seen.select("node")
        left = _cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found if found is not None else spark.createDataFrame([], "node string, component string")


def _trim(left: DataFrame) -> tuple[DataFrame, int]:
    """Without the edges of nodes that have none in or none out, round by round."""
    size = left.count()
    while size:
        both = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        less = _cut(left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        now = less.count()
        if now == size:
            break
        left, size = less, now
    return left, size


def _spread(pairs: DataFrame, colour: DataFrame) -> DataFrame:
    """``node, c``: the smallest colour that reaches each node."""
    colour = _cut(colour)
    while True:
        given = pairs.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("g"))
        new = _cut(colour.join(given, "node", "left").select("node", F.least("c", "g").alias("c"), (F.col("g") < F.col("c")).alias("moved")))
        colour = new.select("node", "c")
        if not new.where("moved").limit(1).count():
            return colour


def blast_weight(edge_type: Column) -> Column:
    out = F.lit(CROSS_LANGUAGE_WEIGHT)
    for k, v in BLAST_WEIGHTS.items():
        out = F.when(edge_type == k, v).otherwise(out)
    return out


def blast_radius(edges: DataFrame, seeds: list[str] | DataFrame, depth: int = 3, tested: DataFrame | None = None) -> DataFrame:
    """Who depends on the seeds, level by level: ``path, hops, risk, category``. Risk is the
    weight of the best edge from the level before, over hops + 1, times 1.2 if untested."""
    edges = _kept(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    seen = nodes.join(seeds.select("path"), "path", "left_semi") if isinstance(seeds, DataFrame) else nodes.where(F.col("path").isin(seeds))
    frontier = seen
    levels = seen.limit(0).select("path", F.lit(0.0).alias("weight"), F.lit(0).alias("hops"))
    for k in range(1, depth + 1):
        step = edges.join(frontier, F.col("dst") == F.col("path")).groupBy(F.col("src").alias("node")).agg(F.max(blast_weight(F.col("edge_type"))).alias("weight"))
        new = step.withColumnRenamed("node", "path").join(seen, "path", "left_anti").withColumn("hops", F.lit(k))
        levels = levels.unionByName(new)
        seen, frontier = seen.unionByName(new.select("path")), new.select("path")
    marked = levels.join(tested.select("path", F.lit(True).alias("tested")), "path", "left") if tested is not None else levels.withColumn("tested", F.lit(None).cast("boolean"))
    risk = F.round(F.least(F.col("weight") / (F.col("hops") + 1) * F.when(F.col("tested"), 1.0).otherwise(1.2), F.lit(1.0)), 6)
    return marked.select("path", "hops", risk.alias("risk")).withColumn("category", F.when(F.col("risk") >= 0.7, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low"))


def column_blast_radius(edges: DataFrame, tab: str, col: str, depth: int = 3, tested: DataFrame | None = None) -> DataFrame:
    """Who depends on a column: the blast radius of its node, without other column nodes."""
    return blast_radius(edges, [f"col:{tab}.{col}".lower()], depth, tested).where(~F.col("path").startswith("col:"))


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The graph with further edges; an edge stands once."""
    return edges.unionByName(more.select(*edges.columns)).distinct()


def without_edges_of(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The graph without the edges that start at some paths."""
    return edges.join(paths.select(F.col("path").alias("src")), "src", "left_anti").select(*edges.columns)


def edge_delta(old: DataFrame, changed: DataFrame, removed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The graph after an edit: edges of changed and removed files go, those that were found
    afresh for the changed ones come, and none may lead to a removed file."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    kept = without_edges_of(old, gone)
    now = with_edges(kept, fresh.join(changed.select(F.col("path").alias("src")), "src", "left_semi").select(*old.columns))
    return now.join(removed.select(F.col("path").alias("dst")), "dst", "left_anti").select(*old.columns)


def call_graph(calls: DataFrame, target: str | None, depth: int = 1, focus: str | None = None) -> DataFrame:
    """The calls (caller_path, caller, callee, callee_path) around what a name is part of: the
    files of matching callers or callees, widened by files that call each other ``depth`` - 1
    times, and the calls between those; at depth 1 the matching calls themselves."""
    known = calls.where("callee_path is not null")
    if target is None:
        found = known
    else:
        hit = known.where(F.lower("caller").contains(target.lower()) | F.lower("callee").contains(target.lower()))
        if depth <= 1:
            found = hit
        else:
            seeds = hit.select(F.explode(F.array("caller_path", "callee_path")).alias("path")).distinct()
            pairs = known.select(F.col("caller_path").alias("a"), F.col("callee_path").alias("b"))
            pairs = _kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
            for _ in range(depth - 1):
                seeds = _cut(seeds.unionByName(seeds.join(pairs, F.col("path") == F.col("a")).select(F.col("b").alias("path"))).distinct())
            found = known.join(seeds.withColumnRenamed("path", "caller_path"), "caller_path", "left_semi").join(seeds.withColumnRenamed("path", "callee_path"), "callee_path", "left_semi")
    return found.where(F.col("caller_path").startswith(focus)) if focus else found


def layers(edges: DataFrame) -> DataFrame:
    """``node, layer`` of an acyclic graph: the longest path from a node without incoming
    edges. Settles in as many rounds as there are layers; raises on a cycle."""
    pairs = _kept(edges.select("src", "dst").distinct())
    now = _cut(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("layer", F.lit(0)))
    n = now.count()
    for _ in range(n + 1):
        pushed = pairs.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("p"))
        new = _cut(now.join(pushed, "node", "left").select("node", F.greatest("layer", F.coalesce("p", F.lit(0))).alias("layer"), (F.coalesce("p", F.lit(0)) > F.col("layer")).alias("moved")))
        now = new.select("node", "layer")
        if not new.where("moved").limit(1).count():
            return now
    raise ValueError("the graph has a cycle")


def reach_counts(edges: DataFrame, depth: int | None = 3, lg_k: int = 12) -> DataFrame:
    """``node, reached``: for every node at once, how many others need it, within ``depth`` edges backwards (without a depth,
    until no count grows). Each node holds a mergeable sketch of what reaches it and merges those of the nodes that
    need it, round by round: work is edges times rounds, and a sketch has a fixed size, whatever it counts. Counts
    of up to some 2^(lg_k - 4) are exact but for rounding; beyond, the standard error is 1.04 / sqrt(2^lg_k)."""
    pairs = _kept(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = _cut(nodes.groupBy("node").agg(F.hll_sketch_agg("node", F.lit(lg_k)).alias("s")))
    total, k = -1, 0
    while depth is None or k < depth:
        k += 1
        given = pairs.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "s")
        now = _cut(now.unionByName(given).groupBy("node").agg(F.hll_union_agg("s").alias("s")))
        if depth is None:
            size = now.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0
            if size == total:
                break
            total = size
    return now.select("node", (F.hll_sketch_estimate("s") - 1).alias("reached"))


def query(edges: DataFrame, op: str, **params) -> DataFrame:
    """Dispatch of graph queries: node, nodes, neighbors, path, subgraph."""
    if op == "nodes":
        return degrees(edges)
    if op == "node":
        return degrees(edges).where(F.col("node") == params["id"])
    if op == "neighbors":
        return neighbours(edges, params["id"], params.get("direction", "both"))
    if op == "path":
        return shortest_path(edges, params["start"], params["end"])
    if op == "subgraph":
        return subgraph(edges, params["seeds"], params.get("depth", 1))
    raise ValueError(f"not a graph query: {op!r}")
