"""Health: six dimensions of 0 to 10 and their weighted mean; drift between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import predicates as P

#: Weights of the dimensions, and points of a convention's strength; fixed values.
WEIGHTS = {"conventions": 0.20, "test_coverage": 0.20, "churn_stability": 0.15, "coupling": 0.20, "cycles": 0.15, "dead_code": 0.10}
POINTS = {"convention": 10.0, "trend": 7.0, "mixed": 5.0}
HOT_CHANGES, HOTSPOT = 10, 0.6


def conventions_score(observations: DataFrame) -> DataFrame:
    """``score``: mean points of the observed patterns (column strength); 10 without any."""
    points = F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), F.col("strength"))
    return observations.agg(F.coalesce(F.avg(points), F.lit(10.0)).alias("score"))


def coverage_score(files: DataFrame, tests: DataFrame) -> DataFrame:
    """Share of source files in programming languages that a test maps to or that hold
    tests themselves, times 10; 10 without source files."""
    own = P.inline_tests(F.col("language"), F.col("content")).alias("own")  # before the join, which then sorts no contents
    source = files.where(P.code_language(F.col("language")) & ~P.test_for_health(F.col("path"))).select("path", own)
    mapped = tests.select(F.col("source").alias("path"), F.lit(True).alias("mapped")).distinct()
    covered = F.coalesce("mapped", F.lit(False)) | F.col("own")
    return source.join(mapped, "path", "left").agg(F.coalesce(F.avg(covered.cast("double")) * 10, F.lit(10.0)).alias("score"))


def stability_score(files: DataFrame, churned: DataFrame) -> DataFrame:
    """10 less the share of files with over ``HOT_CHANGES`` changes in 30 days."""
    hot = churned.agg(F.count(F.when(F.col("churn_30d") > HOT_CHANGES, 1)).alias("hot"))
    total = files.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return hot.crossJoin(total).select((10 * (1 - F.least(F.col("hot") / F.col("n"), F.lit(1.0)))).alias("score"))  # two rows of one


def cycles_score(groups: DataFrame) -> DataFrame:
    """10 / (1 + groups of files that depend on each other); ``groups``: node, component."""
    return groups.agg((F.lit(10.0) / (1 + F.countDistinct("component"))).alias("score"))


def dead_code_score(symbols: DataFrame, dead: DataFrame) -> DataFrame:
    both = symbols.agg(F.count("*").alias("n")).crossJoin(dead.agg(F.count("*").alias("k")))  # two rows of one
    return both.select(F.when(F.col("n") == 0, 10.0).otherwise(10 * (1 - F.col("k") / F.col("n"))).alias("score"))


#: Parts of one name's symbols, so that a name of many has no task for itself.
SALTS = 16


def unused_score(symbols: DataFrame, tasks: int) -> DataFrame:
    """``dead_code_score`` where the dead are the private functions of a name that no public symbol has: symbols (path, name, kind,
    visibility) are counted by name in ``tasks`` tasks, so that none are sorted and joined with the names in use."""
    public, private = F.col("visibility") == "public", (F.col("kind") == "function") & (F.col("visibility") == "private")
    rows = symbols.select(F.lower("name").alias("k"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"), public.alias("used"), private.alias("private"))
    by = lambda df, n, dead: df.agg(F.sum(n).alias("n"), F.sum(dead).alias("dead"), F.max(F.coalesce("used", F.lit(False))).alias("used"))
    some = by(rows.repartition(tasks, "k", "salt").groupBy("k", "salt"), F.lit(1), F.when(F.col("private"), 1).otherwise(0))
    names = by(some.repartition(tasks, "k").groupBy("k"), "n", "dead")
    dead = F.when(F.col("k").isNull() | ~F.col("used"), F.col("dead")).otherwise(0)
    both = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(dead).alias("dead"))
    return both.select(F.when(F.col("n") == 0, 10.0).otherwise(10 * (1 - F.col("dead") / F.col("n"))).alias("score"))


def composite(scores: dict[str, Column]) -> Column:
    """The weighted mean of the dimensions that are given."""
    total = sum(WEIGHTS[k] for k in scores)
    return sum((F.lit(WEIGHTS[k] / total) * v for k, v in scores.items()), F.lit(0.0))


def health(dimensions: dict[str, DataFrame]) -> DataFrame:
    """One row: each dimension and the composite. Every dimension is one row with a score."""
    out = None
    for name, df in dimensions.items():
        one = df.select(F.col("score").alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out.withColumn("composite", composite({k: F.col(k) for k in dimensions}))


def module_metrics(files: DataFrame, edges: DataFrame, depth: int = 2, least: int = 3) -> DataFrame:
    """``module, n_files, edges, coupling, cohesion`` of modules of at least ``least`` files: a
    module is a path's first segments."""
    of = files.select("path", P.module_of_segments(F.col("path"), depth).alias("module")) if "module" not in files.columns else files.select("path", "module")
    size = of.groupBy("module").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least)
    src, dst = of.select(F.col("path").alias("src"), "module"), of.select(F.col("path").alias("dst"), F.col("module").alias("other"))
    out = edges.join(src, "src").join(dst, "dst", "left").groupBy("module").agg(F.count("*").alias("edges"), F.count(F.when(F.col("other") == F.col("module"), 1)).alias("inner"))
    rows = size.join(out, "module", "left").select("module", "n_files", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("inner", F.lit(0)).alias("inner"))
    coupling = F.when(F.col("edges") == 0, 0.0).otherwise((F.col("edges") - F.col("inner")) / F.col("edges"))
    return rows.select("module", "n_files", "edges", coupling.alias("coupling"), (F.col("inner") / (F.col("n_files") * (F.col("n_files") - 1))).alias("cohesion"))


def snapshot(modules: DataFrame) -> DataFrame:
    """One row of architecture metrics."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return modules.agg(F.count("*").alias("module_count"), zero("coupling").alias("mean_coupling"), zero("cohesion").alias("mean_cohesion"))


def hotspots(modules: DataFrame) -> DataFrame:
    return modules.where(F.col("coupling") > HOTSPOT).select("module", F.concat(F.lit("High coupling: "), F.format_number("coupling", 2)).alias("issue"), F.col("coupling").alias("severity"))


def trend(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot (column ts) against the oldest; no row where there are under two."""
    metrics = ["module_count", "mean_coupling", "mean_cohesion"]
    row = snapshots.agg(F.count("*").alias("n"), F.max_by(F.struct(*metrics), "ts").alias("now"), F.min_by(F.struct(*metrics), "ts").alias("then"))
    return row.where("n >= 2").select(*[(F.col(f"now.{m}") - F.col(f"then.{m}")).alias(f"{m}_delta") for m in metrics])


def exposure(files: DataFrame, symbols: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """``path, public, inbound, score``: public symbols times dependents of files without a
    test, over the largest product there could be; files that score nothing are left out."""
    public = symbols.where("visibility = 'public'").groupBy("path").agg(F.count("*").alias("public"))
    inbound = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("inbound"))
    tested = tests.select(F.col("source").alias("path"), F.lit(0.0).alias("open")).distinct()
    rows = files.select("path").join(public, "path", "left").join(inbound, "path", "left").join(tested, "path", "left").fillna({"public": 0, "inbound": 0, "open": 1.0})
    top = rows.agg((F.max("public") * F.max("inbound")).alias("top"))
    scored = rows.crossJoin(top).withColumn("score", F.least(F.col("public") * F.col("inbound") * F.col("open") / F.col("top"), F.lit(1.0)))  # a row of one
    return scored.where("score > 0").select("path", "public", "inbound", F.round("score", 6).alias("score"))
