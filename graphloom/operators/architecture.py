"""Architecture: modules, coupling, god files, layers and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def module_coupling(edges: DataFrame, modules: DataFrame, least_files: int = 3) -> DataFrame:
    """Share of each module's outgoing edges that leave it; ``modules``: node, module."""
    src, dst = modules.select(F.col("node").alias("src"), F.col("module").alias("ms")), modules.select(F.col("node").alias("dst"), F.col("module").alias("md"))
    out = edges.join(src, "src").join(dst, "dst").groupBy(F.col("ms").alias("module")).agg(F.count("*").alias("total"), F.count(F.when(F.col("ms") != F.col("md"), 1)).alias("cross"))
    size = modules.groupBy("module").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least_files)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return size.join(out, "module", "left").select("module", "n_files", zero("total").alias("total"), zero("cross").alias("cross"), F.round(F.when(zero("total") == 0, 0.0).otherwise(zero("cross") / zero("total")), 6).alias("coupling"))


def coupling_score(coupled: DataFrame) -> DataFrame:
    return coupled.agg(F.round((1 - F.coalesce(F.avg("coupling"), F.lit(0.0))) * 10, 6).alias("score"))


def god_files(counts: DataFrame, least_files: int = 3, deviations: float = 2.0) -> DataFrame:
    """Files whose count is over the module's mean plus so many population deviations;
    ``counts``: node, module, n."""
    stats = counts.groupBy("module").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"), F.count("*").alias("k")).where((F.col("k") >= least_files) & (F.col("dev") > 0))
    return counts.join(stats, "module").where(F.col("n") > F.col("mean") + deviations * F.col("dev")).select("module", "node", "n")


def layers(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between pairs of modules, and whether the pair is one-way."""
    src, dst = modules.select(F.col("node").alias("src"), F.col("module").alias("a")), modules.select(F.col("node").alias("dst"), F.col("module").alias("b"))
    n = edges.join(src, "src").join(dst, "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    back = n.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_back"))
    return n.join(back, ["a", "b"], "left").select("a", "b", "n", F.coalesce("n_back", F.lit(0)).alias("n_back"), F.col("n_back").isNull().alias("strict"))


def architecture_map(edges: DataFrame, modules: DataFrame, rank: DataFrame) -> DataFrame:
    """Modules with their files, summed PageRank, coupling and cohesion (inner edges over
    possible ones)."""
    coupled = module_coupling(edges, modules, 1)
    weight = modules.join(rank, "node", "left").groupBy("module").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 5).alias("pagerank"))
    pairs = F.col("n_files") * (F.col("n_files") - 1)
    return coupled.join(weight, "module").select("module", "n_files", "pagerank", "coupling", F.round(F.when(pairs > 0, (F.col("total") - F.col("cross")) / pairs).otherwise(1.0), 6).alias("cohesion"))


def schema_drift(code: DataFrame, live: DataFrame) -> DataFrame:
    """Tables or columns on one side only, and types that differ but for case and spaces."""
    joined = code.select("tab", "col", F.col("type").alias("code_type")).join(live.select("tab", "col", F.col("type").alias("live_type")), ["tab", "col"], "full")
    kind = F.when(F.col("code_type").isNull(), "live_only").when(F.col("live_type").isNull(), "code_only").when(F.lower(F.trim("code_type")) != F.lower(F.trim("live_type")), "type_differs")
    return joined.withColumn("kind", kind).where("kind is not null")
