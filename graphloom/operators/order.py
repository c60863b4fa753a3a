"""Reading order and onboarding phases.

The order is that of a queue: what depends on nothing first, by path; whoever loses the last
open dependency joins the end. It is found without a queue: a file's key is its round, the
place of its last dependency and its path, and a round is sorted by ranges. A round touches
the edges of the files that it frees; there are as many rounds as the longest chain is long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import predicates, ranking
from graphloom.operators.lineage import together, written

#: Files of a phase at most, symbols named for a file, and words read in a minute; fixed values.
PHASE_FILES, FOCUS_SYMBOLS, PER_MINUTE = 9, 5, 200


def reading_order(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``path, pos, round``: dependencies (``dst`` of the edges) before what needs them (``src``), in a queue's order.
    Files on cycles, or behind one, come last, by path, without a round. Edges that lead
    outside the files don't count, parallel ones count once, and a file that needs itself is a cycle."""
    paths = written(files.select("path").distinct())
    pairs = edges.select("src", "dst").distinct().join(paths.withColumnRenamed("path", "src"), "src", "left_semi").join(paths.withColumnRenamed("path", "dst"), "dst", "left_semi")
    pairs = written(pairs.select("src", "dst"))
    needs = paths.join(pairs.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("needs")), "path", "left")
    state = written(needs.select("path", F.coalesce("needs", F.lit(0)).alias("needs"), F.lit(0).cast("long").alias("last")))
    rounds: list[DataFrame] = []
    while True:
        free = ranking.spots(state.where("needs = 0").select("path", "last", F.lit(len(rounds)).alias("round")), [F.col("last"), F.col("path")], "spot")
        rounds.append(free)
        if not free.limit(1).count():
            break
        met = pairs.join(free.select(F.col("path").alias("dst"), "spot"), "dst").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("met"), F.max("spot").alias("spot"))
        left = state.where("needs > 0").join(met, "path", "left")
        # the last dependency of a file that gets free in this round is of the round before
        state = written(left.select("path", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs"), F.coalesce("spot", F.lit(0)).cast("long").alias("last")))
    ordered = together(rounds).select("path", "round", "spot")
    cyclic = state.where("needs > 0").select("path", F.lit(None).cast("int").alias("round"), F.lit(None).cast("long").alias("spot"))
    key = [F.coalesce("round", F.lit(len(rounds))), F.col("spot"), F.col("path")]
    return ranking.places(ordered.unionByName(cyclic), [], key, "pos").select("path", "pos", "round")


def module(path: Column) -> Column:
    return predicates.module_of_segments(path)


def _title() -> Column:
    """The last segment of the module, with a capital."""
    last = "element_at(split(module, '/'), -1)"
    return F.expr(f"concat(upper(left({last}, 1)), substring({last}, 2))")


def phases(ordered: DataFrame, edges: DataFrame, files: DataFrame, rank: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``phase, name, module, rationale, files`` in reading order: files of a module (two segments of the path), modules by the
    sum of their ranks, at most nine files a phase. ``ordered``: path, pos; ``files``: path, tokens; ``rank``: node, score;
    ``symbols``: path, name, ord, of which five are named for a file. A module builds on the last phase before that
    has a file that needs one of its files."""
    scored = ordered.select("path", "pos").join(rank.select(F.col("node").alias("path"), "score"), "path", "left").join(files.select("path", "tokens"), "path", "left")
    scored = scored.select("path", "pos", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), module(F.col("path")).alias("module"))
    if symbols is not None:
        top = symbols.select("path", "name", "ord", F.row_number().over(W.partitionBy("path").orderBy("ord", "name")).alias("k")).where(F.col("k") <= FOCUS_SYMBOLS)
        named = top.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]).alias("focus"))
        scored = scored.join(named, "path", "left")
    else:
        scored = scored.withColumn("focus", F.lit(None).cast("array<string>"))
    placed = written(ranking.places(scored, ["module"], [F.col("pos")], "place"))
    sums = placed.groupBy("module").agg(F.sum("score").alias("rank"), F.min("pos").alias("first"), F.count("*").alias("n"))
    sums = sums.withColumn("chunks", F.ceil(F.col("n") / PHASE_FILES))
    starts = written(ranking.running(sums, [], [-F.col("rank"), F.col("first")], {"start": F.col("chunks")}))
    chunk = F.floor(F.col("place") / PHASE_FILES)
    dealt = written(placed.join(starts.select("module", "start", "chunks"), "module").withColumn("phase", F.col("start") + chunk))
    made = dealt.groupBy("phase", "module", "start", "chunks").agg(F.sort_array(F.collect_list(F.struct("place", "path", F.col("score").alias("pagerank"), "tokens", F.coalesce("focus", F.array().cast("array<string>")).alias("focus")))).alias("files"))
    made = written(made)
    reasons = _rationale(made.select("phase", "module", "start"), dealt.select("path", "phase", "module"), edges)
    number = F.when(F.col("chunks") > 1, F.concat(F.lit(" ("), (F.col("phase") - F.col("start") + 1).cast("string"), F.lit("/"), F.col("chunks").cast("string"), F.lit(")"))).otherwise("")
    bare = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["pagerank"].alias("pagerank"), f["tokens"].alias("tokens"), f["focus"].alias("focus")))
    return made.join(reasons, "phase").select("phase", F.concat(_title(), number).alias("name"), "module", "rationale", bare.alias("files"))


def _rationale(made: DataFrame, dealt: DataFrame, edges: DataFrame) -> DataFrame:
    """``phase, rationale``. Phases of a module stand together, so the last phase before that needs the module is one
    of its own (found by counting those up to each phase), or else the last one before all of them."""
    into = edges.select("src", "dst").join(dealt.select(F.col("path").alias("src"), F.col("phase").alias("from")), "src").join(dealt.select(F.col("path").alias("dst"), "module"), "dst").select("from", "module").distinct()
    into = written(into.join(made.groupBy("module").agg(F.min("start").alias("start"), F.count("*").alias("own")), "module"))
    outside = into.where(F.col("from") < F.col("start")).groupBy("module").agg(F.max("from").alias("outside"))
    inside = into.where((F.col("from") >= F.col("start")) & (F.col("from") < F.col("start") + F.col("own"))).select(F.col("from").alias("phase"), F.lit(1).alias("hit"))
    counted = written(ranking.running(made.join(inside, "phase", "left"), [], [F.col("phase")], {"before": F.coalesce("hit", F.lit(0))}))
    ends = counted.where("hit = 1").select((F.col("before") + 1).alias("before"), F.col("phase").alias("inside"))
    both = counted.drop("hit").join(ends, "before", "left").join(outside, "module", "left")
    prior = F.when(F.col("inside") >= F.col("start"), F.col("inside")).otherwise(F.col("outside"))
    names = made.select(F.col("phase").alias("prior"), F.col("module").alias("of"))
    text = F.when(F.col("phase") == 0, "Core module depended on by all others.").when(F.col("of").isNotNull(), F.concat(F.lit("Builds on "), F.col("of"), F.lit("."))).otherwise("Independent module.")
    return both.select("phase", prior.alias("prior")).join(names, "prior", "left").select("phase", text.alias("rationale"))


def reading_time(tokens: Column) -> Column:
    """Hours and minutes for so many tokens."""
    minutes = F.ceil(tokens / PER_MINUTE)
    hours = F.concat(F.lit("~"), F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes >= 60, hours).otherwise(F.concat(F.lit("~"), minutes.cast("string"), F.lit("m")))
