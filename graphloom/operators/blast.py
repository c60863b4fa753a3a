"""Blast radius: who is hit when files change, as a queue would meet them.

Dependents are met level by level. Within a level a file's turn follows from its first way in: the turn
of the file that leads to it, then its path; a level is sorted by ranges of that. An edge is
looked at from its changed end when that file has its turn, so a file is reached not only from
the level before but also from files of its own level that have their turn earlier; of all these ways the
one with the largest risk counts (then the one with fewer hops, then the earlier one). Levels
are joins of a frontier with the edges; all ways are weighed by one join at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import predicates, ranking
from graphloom.operators.graphs import BLAST_WEIGHTS, blast_weight
from graphloom.operators.lineage import together, written

#: Order of edge types between the same files; fixed values.
TYPES = ["import", "foreign_key", "view_reference", "trigger_target", "index_target", "function_reference", "embedded_sql", "orm_model", "migration_sequence", "cross_language", "column_reference"]
UNTESTED, HIGH, MEDIUM = 1.2, 0.7, 0.3
TEST_NOTE = "directly tests changed file"


def impact(hops: Column, edge_type: Column, rank: Column, tested: Column) -> Column:
    """What a change does to a dependent, 0 to 1."""
    raw = (1.0 / (hops + 1.0)) * blast_weight(edge_type) * rank * F.when(tested, 1.0).otherwise(UNTESTED)
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))


def _type_order(edge_type: Column) -> Column:
    at = F.lit(TYPES.index("cross_language"))
    for k in BLAST_WEIGHTS:
        at = F.when(edge_type == k, TYPES.index(k)).otherwise(at)
    return at


def met(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``path, hops, turn``: the seeds (``path``, and ``turn`` if they have an order) with hops 0, and what depends on them
    within ``depth`` hops. Column nodes are met as seeds only."""
    pairs = written(edges.select("src", "dst").distinct().where(~F.col("src").startswith("col:")))
    turn = F.col("turn") if "turn" in seeds.columns else F.lit(0)
    first = seeds.groupBy("path").agg(F.min(turn).alias("t"))
    levels = [ranking.spots(first.select("path", F.lit(0).alias("hops"), F.col("t").cast("long").alias("from")), [F.col("from"), F.col("path")], "turn")]
    for k in range(1, depth + 1):
        seen = together(levels).select("path")
        way = pairs.join(levels[-1].select(F.col("path").alias("dst"), "turn"), "dst").groupBy(F.col("src").alias("path")).agg(F.min("turn").alias("from"))
        new = way.join(seen, "path", "left_anti").select("path", F.lit(k).alias("hops"), "from")
        levels.append(ranking.spots(new, [F.col("from"), F.col("path")], "turn"))
        if not levels[-1].limit(1).count():
            break
    return together(levels).select("path", "hops", "turn")


def radius(edges: DataFrame, seeds: DataFrame, rank: DataFrame, tests: DataFrame, depth: int = 3, focus: str | None = None) -> DataFrame:
    """``path, edge_type, hops, risk, level, kind, note`` of the files that depend on the seeds (which aren't among them).
    ``edges``: src needs dst, edge_type; ``rank``: node, score (0 to 1); ``tests``: source, test. ``kind``: test (a test, by its
    path, of a seed), direct, schema or transitive; ``level``: high, medium or low risk."""
    kept = written(edges.select("src", "dst", "edge_type").distinct())
    found = written(met(kept, seeds, depth))
    scores = found.where("hops > 0").join(rank.select(F.col("node").alias("path"), "score"), "path", "left")
    every = tests.select(F.col("test").alias("path")).distinct().withColumn("tested", F.lit(True))
    covering = tests.join(seeds.select(F.col("path").alias("source")).distinct(), "source", "left_semi").select(F.col("test").alias("path")).distinct().withColumn("covers", F.lit(True))
    known = scores.join(every, "path", "left").join(covering, "path", "left")
    known = known.select(F.col("path").alias("src"), F.col("hops").alias("own"), F.col("turn").alias("own_turn"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tested", F.lit(False)).alias("tested"), F.coalesce("covers", F.lit(False)).alias("covers"))
    ways = kept.join(found.where(F.col("hops") < depth).select(F.col("path").alias("dst"), F.col("hops").alias("before"), "turn"), "dst").join(known, "src")
    ways = ways.where((F.col("before") < F.col("own")) | ((F.col("before") == F.col("own")) & (F.col("turn") < F.col("own_turn"))))
    hops = F.col("before") + 1
    risk = impact(hops, F.col("edge_type"), F.col("score"), F.col("tested"))
    way = F.struct(risk.alias("risk"), (-hops).alias("fewer"), (-F.col("turn")).alias("earlier"), (-_type_order(F.col("edge_type"))).alias("order"), (-_rest(F.col("edge_type"))).alias("rest"), F.col("edge_type").alias("edge_type"))
    best = ways.groupBy("src", "covers").agg(F.max(way).alias("way"))
    out = best.select(F.col("src").alias("path"), F.col("way.edge_type").alias("edge_type"), (-F.col("way.fewer")).alias("hops"), F.col("way.risk").alias("risk"), "covers")
    kind = F.when(predicates.test_for_blast(F.col("path")) & F.col("covers"), "test").when(F.col("hops") == 1, "direct").when(predicates.schema_edge(F.col("edge_type")), "schema").otherwise("transitive")
    level = F.when(F.col("risk") >= HIGH, "high").when(F.col("risk") >= MEDIUM, "medium").otherwise("low")
    out = out.select("path", "edge_type", "hops", "risk", level.alias("level"), kind.alias("kind")).withColumn("note", F.when(F.col("kind") == "test", TEST_NOTE))
    return out.where(F.col("path").startswith(focus)) if focus else out


def _rest(edge_type: Column) -> Column:
    """Bridges of different kinds between the same files: the kinds in order of their names."""
    return F.coalesce(F.array_position(F.array(*[F.lit(f"cross_language:{k}") for k in BRIDGES]), edge_type), F.lit(0)).cast("int")


#: Kinds of bridges, in order; fixed values.
BRIDGES = ["HttpCall", "FfiBinding", "GrpcCall", "GraphqlCall", "SharedSchema", "CommandExec"]


def column_radius(edges: DataFrame, table: str, column: str, rank: DataFrame, tests: DataFrame, depth: int = 3, focus: str | None = None) -> DataFrame:
    """Who is hit when a column changes: the radius of its node."""
    seed = edges.sparkSession.createDataFrame([(f"col:{table}.{column}".lower(),)], "path string")
    return radius(edges, seed, rank, tests, depth, focus)


def summary(found: DataFrame) -> DataFrame:
    """One row: how many files are hit, of each kind and of each level."""
    counts = [F.count(F.when(F.col(c) == v, 1)).alias(v) for c, vs in (("kind", ("test", "direct", "schema", "transitive")), ("level", ("high", "medium", "low"))) for v in vs]
    return found.agg(F.count("*").alias("total"), *counts)
