"""Change history: churn, trends, co-change, omissions, impact and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import predicates as P
from graphloom.operators import ranking

BUGFIX = r"(?i)\b(fix|bug|patch|hotfix)\b"


def churn(history: DataFrame) -> DataFrame:
    """Commits of each file in the last 30 and 180 days, and the day of its last one."""
    return history.where("age <= 180").groupBy("path").agg(F.count(F.when(F.col("age") <= 30, 1)).alias("churn_30d"), F.count("*").alias("churn_180d"), F.max("day").alias("last_commit"))


def trend(c30: Column, c180: Column, threshold: int) -> Column:
    """By which of the two windows reach the threshold: both is hot while the last 30 days
    outpace the 180, else chronic; the short one alone is hot, the long one stabilized."""
    short, long = c30 >= threshold, c180 >= threshold
    return F.when(short & (~long | (c30 * 6 > c180)), "hot").when(short, "chronic").when(long, "stabilized").otherwise("cold")


def p75_threshold(counts: DataFrame, column: str) -> int:
    """The value at index n * 3 // 4 of the sorted counts, at least 3; 5 if there are none."""
    by_value = counts.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    rows = sorted((r.v, r.k) for r in by_value.collect())  # a row for each distinct count, of which there are few
    place, seen = sum(k for _, k in rows) * 3 // 4, 0
    for v, k in rows:
        seen += k
        if seen > place:
            return max(3, v)
    return 5


def bugfix_density(history: DataFrame, files: DataFrame, is_fix: Column) -> DataFrame:
    """Share of touches that fix something, by directory."""
    return history.where("age <= 180").join(files, "path").groupBy("dir").agg(F.round(F.avg(F.when(is_fix, 1.0).otherwise(0.0)), 6).alias("density"), F.count("*").alias("touches"))


def decay(age: Column) -> Column:
    """1 up to 30 days, then linearly down to 0.3 at 180 days."""
    return F.when(age <= 30, 1.0).otherwise(1.0 - 0.7 * (age - 30) / 150.0)


def co_changes(history: DataFrame, days: int = 180, least_files: int = 2, most_files: int = 200, threshold: int = 1) -> DataFrame:
    """Pairs of files that change together. A commit of more than ``most_files`` files says
    nothing about pairs and is left out, which also bounds the self-join."""
    recent = history.where(F.col("age") <= days)
    size = recent.groupBy("sha").agg(F.count("*").alias("n_files")).where(F.col("n_files").between(least_files, most_files))
    kept = recent.join(size, "sha").select("sha", "path", "age")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path")))
    got = pairs.groupBy(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b")).agg(F.count("*").alias("n"), F.min("a.age").alias("age"))
    return got.where(F.col("n") >= threshold).select("file_a", "file_b", "n", F.round(decay(F.col("age")), 6).alias("recency_weight"))


def surprising(co: DataFrame, edges: DataFrame) -> DataFrame:
    """Co-changing files without a dependency in either direction."""
    both = edges.select(F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    return co.join(both, ["file_a", "file_b"], "left_anti")


def omissions(co: DataFrame, changed: DataFrame, least: float = 1.0) -> DataFrame:
    """Partners of changed files that didn't change with them, strongest evidence first."""
    a, b = changed.select(F.col("path").alias("file_a"), F.lit(True).alias("in_a")), changed.select(F.col("path").alias("file_b"), F.lit(True).alias("in_b"))
    sides = co.join(a, "file_a", "left").join(b, "file_b", "left")
    one = sides.where(F.coalesce("in_a", F.lit(False)) != F.coalesce("in_b", F.lit(False)))
    missing = one.select(F.when(F.col("in_a"), F.col("file_b")).otherwise(F.col("file_a")).alias("path"), F.when(F.col("in_a"), F.col("file_a")).otherwise(F.col("file_b")).alias("because"), F.round(F.col("n") * F.col("recency_weight"), 6).alias("weight"))
    best = W.partitionBy("path").orderBy(F.desc("weight"), "because")
    return missing.where(F.col("weight") >= least).withColumn("i", F.row_number().over(best)).where("i = 1").drop("i")


def historical_impact(co: DataFrame, changed: DataFrame) -> DataFrame:
    """For each file outside the change, the best (n / max n) * recency over its partners inside."""
    top = co.agg(F.max("n")).first()[0] or 1
    both = co.select(F.col("file_a").alias("seed"), F.col("file_b").alias("path"), "n", "recency_weight").unionByName(co.select(F.col("file_b").alias("seed"), F.col("file_a").alias("path"), "n", "recency_weight"))
    hit = both.join(changed.select(F.col("path").alias("seed")), "seed", "left_semi").join(changed.select("path"), "path", "left_anti")
    return hit.groupBy("path").agg(F.round(F.max(F.col("n") / top * F.col("recency_weight")), 6).alias("score"))


def risk_ranking(files: DataFrame, churned: DataFrame, in_degree: DataFrame) -> DataFrame:
    """Churn percentile times reach times lack of tests, with the rank as percentile."""
    total = files.count()
    rows = files.join(churned, "path", "left").join(in_degree, "path", "left").select("path", F.coalesce("churn_30d", F.lit(0)).alias("churn"), F.coalesce("in_degree", F.lit(0)).alias("dependents"), "tested")
    scored = ranking.cume_dist(rows, "churn", total, "pct")
    risk = F.greatest("pct", F.lit(0.01)) * F.least(F.col("dependents") / total, F.lit(1.0)) * F.greatest(1 - F.col("tested").cast("double"), F.lit(0.01))
    scored = scored.withColumn("risk", F.round(risk, 9))
    scored = ranking.row_number(scored, [-F.col("risk"), F.col("path")], "place")
    i = F.col("place") - 1
    return scored.select("path", "churn", "dependents", F.round("pct", 6).alias("churn_pct"), "risk", F.round(F.when(F.lit(total <= 1), 1.0).otherwise((total - 1 - i) / max(total - 1, 1)), 6).alias("percentile"))


def importance(files: DataFrame, degrees: DataFrame, churned: DataFrame) -> DataFrame:
    """in * 0.4 + out * 0.1 + recency * 0.3 + churn / max * 0.2; recency by position."""
    rows = files.join(degrees, "path", "left").join(churned, "path", "left")
    n = files.count()
    rows = ranking.row_number(rows, [F.col("last_commit").isNull(), -F.unix_date("last_commit"), F.col("path")], "pos").withColumn("pos", F.col("pos") - 1)
    most = churned.agg(F.max("churn_180d")).first()[0] or 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    recency = F.when(F.col("last_commit").isNull(), 0.0).otherwise(1 - F.col("pos") / n)
    return rows.select("path", F.round(zero("in_degree") * 0.4 + zero("out_degree") * 0.1 + recency * 0.3 + zero("churn_180d") / most * 0.2, 6).alias("importance"))


def recency_score(age: Column, horizon: int = 90) -> Column:
    return F.round(F.least(F.greatest(1 - age / float(horizon), F.lit(0.0)), F.lit(1.0)), 6)


def reverts(commits: DataFrame) -> DataFrame:
    """Commits that revert another: ``sha, reverted, original``, the original's message where
    the message names its hash. ``commits``: sha, message."""
    hit = commits.where(F.col("message").rlike(r"(?i)^revert\b")).withColumn("reverted", F.regexp_extract("message", r"([0-9a-f]{7,40})", 1))
    short = commits.select(F.substring("sha", 1, 7).alias("k"), F.col("sha").alias("full"), F.col("message").alias("original"))
    joined = hit.withColumn("k", F.substring("reverted", 1, 7)).join(short, "k", "left").where("full is null or startswith(full, reverted)")
    return joined.select("sha", F.col("full").alias("reverted"), "original")


def call_impact(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Callers of changed files: sum of 1 (exact) or 0.5, over the largest such sum (of all
    callers, changed ones included), without the changed. ``calls``: caller, callee, exact."""
    hit = calls.join(changed.select(F.col("path").alias("callee")), "callee", "left_semi")
    sums = hit.groupBy(F.col("caller").alias("path")).agg(F.sum(F.when(F.col("exact"), 1.0).otherwise(0.5)).alias("x"))
    top = sums.agg(F.max("x")).first()[0] or 1.0
    return sums.join(changed.select("path"), "path", "left_anti").select("path", F.round(F.col("x") / max(top, 1.0), 6).alias("score"))


def predict(structural: DataFrame, by_call: DataFrame, by_history: DataFrame) -> DataFrame:
    """``path, confidence`` from which of the three signals name a path."""
    flag = lambda df, n: df.select("path").distinct().withColumn(n, F.lit(True))
    rows = flag(structural, "s").join(flag(by_call, "c"), "path", "full").join(flag(by_history, "h"), "path", "full")
    s, c, h = (F.coalesce(F.col(x), F.lit(False)) for x in "sch")
    return rows.select("path", s.alias("structural"), c.alias("by_call"), h.alias("historical"), confidence(s, c, h).alias("confidence"))


def predict_tests(changed: DataFrame, structural: DataFrame, by_call: DataFrame, by_history: DataFrame, tests: DataFrame) -> DataFrame:
    """``test, by_map, structural, by_call, historical, confidence`` of the tests that a change of ``changed`` (path) concerns: tests of changed
    files by the test map (source, test), and test files, by their paths, that aren't changed themselves and that one of the three signals
    (path) names. A mapped test counts as much as a structural one."""
    flag = lambda df, n: df.select("path").distinct().withColumn(n, F.lit(True))
    mapped = flag(tests.join(changed.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("test").alias("path")), "m")
    named = lambda df, n: flag(df.where(P.test_for_blast(F.col("path"))).join(changed.select("path"), "path", "left_anti"), n)
    rows = mapped.join(named(structural, "s"), "path", "full").join(named(by_call, "c"), "path", "full").join(named(by_history, "h"), "path", "full")
    m, s, c, h = (F.coalesce(F.col(x), F.lit(False)) for x in "msch")
    return rows.select(F.col("path").alias("test"), m.alias("by_map"), s.alias("structural"), c.alias("by_call"), h.alias("historical"), confidence(m | s, c, h).alias("confidence"))


def confidence(structural: Column, by_call: Column, historical: Column) -> Column:
    """The eight levels; fixed values."""
    s, c, h = structural, by_call, historical
    return F.when(s & c & h, 0.90).when(s & c, 0.85).when(s & h, 0.75).when(c & h, 0.70).when(s, 0.60).when(c, 0.50).when(h, 0.40).otherwise(0.0)


def timeline(history: DataFrame) -> DataFrame:
    """Months in order: commits, files, the step from the month before, and key events where
    the files touched change by over a fifth."""
    months = history.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.countDistinct("sha").alias("commits"), F.countDistinct("path").alias("files"))
    order = W.orderBy("month")  # a row for each month
    step = F.col("files") - F.lag("files").over(order)
    event = F.when(F.abs(step) > 0.2 * F.lag("files").over(order), "churn")
    return months.select("month", "commits", "files", step.alias("step"), event.alias("event"))


def sampled(history: DataFrame, most: int) -> DataFrame:
    """``month, files, pairs``: every so many-th month, so that at most ``most`` are left, with
    the pairs that its files make."""
    months = history.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.countDistinct("path").alias("files"))
    order = W.orderBy("month")  # a row for each month
    numbered = months.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    kept = numbered.where(F.col("i") % F.ceil(F.col("n") / float(most)) == 0)
    return kept.select("month", "files", F.expr("files * (files - 1) div 2").alias("pairs"))


def step(before: DataFrame, after: DataFrame) -> DataFrame:
    """``kind, n``: files (path) added, removed and kept between two snapshots."""
    a, b = after.select("path", F.lit(True).alias("a")), before.select("path", F.lit(True).alias("b"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("kept")
    return a.join(b, "path", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
