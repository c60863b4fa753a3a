"""Points in intervals, by groups (lines of files, moments of users), without comparing every point with
every interval of its group.

Keys (group, position) are dealt into ranges by splitters from a bounded sample. An interval goes to the
two ranges where it begins and ends; those between are named by at most two nodes for each
level of a binary tree over the ranges, of which only the best interval of each node is kept, so
an interval of any length is a few rows and all long ones together are a row for each
range. A range is swept once in order, with a heap of the intervals that are open. Positions are
looked up once each, so a position that many points share is one row of a range."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import ranking
from graphloom.operators.lineage import written


def _key(group: str, position: Column) -> Column:
    return F.struct(F.col(group).alias("g"), position.alias("p"))


def _nodes(levels: int) -> Column:
    """Nodes (level, index) that make up the ranges ``lo`` + 1 to ``hi`` - 1."""
    out = []
    for k in range(levels):
        left, right = F.ceil((F.col("lo") + 1) / (1 << k)), F.floor(F.col("hi") / (1 << k))
        open_ = left < right
        out.append(F.when(open_ & (left % 2 == 1), F.struct(F.lit(k).alias("level"), left.alias("index"))))
        out.append(F.when(open_ & (right % 2 == 1), F.struct(F.lit(k).alias("level"), (right - 1).alias("index"))))
    return F.array_compact(F.array(*out))


def first_holding(points: DataFrame, spans: DataFrame, group: str, at: str, default: str | None = None) -> DataFrame:
    """``points`` with ``name``: that of the interval (``group``, ``first``, ``last``, ``ord``, ``name``; both ends inside) which holds the point
    and has the smallest ``ord`` (ties: name), or else ``default``. Points and intervals without a group or a position don't meet."""
    asked = written(points.select(F.col(group).alias("g"), F.col(at).cast("long").alias("p")).where("g is not null and p is not null").distinct())
    own = spans.select(F.col(group).alias("g"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("ord").cast("long").alias("ord"), "name")
    own = written(own.where("g is not null and first <= last"))
    cuts = ranking.cuts(asked.select(_key("g", F.col("p")).alias("_k")), "_k")
    kind = "struct<g:string,p:bigint>"
    dealt = written(own.select("*", ranking.range_of(_key("g", F.col("first")), cuts, kind).alias("lo"), ranking.range_of(_key("g", F.col("last")), cuts, kind).alias("hi")))
    best = F.min(F.struct("ord", "name")).alias("best")
    levels = max(1, len(cuts).bit_length() + 1)
    nodes = dealt.where("hi - lo > 1").select(F.explode(_nodes(levels)).alias("n"), "ord", "name").groupBy("n.level", "n.index").agg(best)
    spread = nodes.select(F.explode(F.expr("sequence(index * shiftleft(1, level), (index + 1) * shiftleft(1, level) - 1)")).alias("r"), "best")
    covers = written(spread.groupBy("r").agg(F.min("best").alias("best")))  # a row for each range at most
    kept = F.lit(None).cast("string")
    ends = dealt.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("r"), "g", F.col("first").alias("p"), F.lit(0).alias("kind"), "last", "ord", "name")
    rows = ends.unionByName(asked.select(ranking.range_of(_key("g", F.col("p")), cuts, kind).alias("r"), "g", "p", F.lit(1).alias("kind"), F.col("p").alias("last"), F.lit(0).cast("long").alias("ord"), kept.alias("name")))
    swept = rows.repartition("r").sortWithinPartitions("r", "g", "p", "kind").mapInPandas(_sweep, "r int, g string, p long, ord long, name string")
    both = swept.join(F.broadcast(covers), "r", "left")
    found = F.least(F.when(F.col("ord").isNotNull(), F.struct("ord", "name")), F.col("best"))["name"]
    answers = both.select(F.col("g").alias("_g"), F.col("p").alias("_p"), found.alias("_found"))
    joined = points.join(answers, (F.col(group) == F.col("_g")) & (F.col(at).cast("long") == F.col("_p")), "left")
    return joined.select(*[c for c in points.columns if c != "name"], F.coalesce("_found", F.lit(default)).alias("name"))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points (kind 1) with the first of the intervals (kind 0) that are open there; rows come in order."""
    place, open_ = None, []
    for b in batches:
        out = []
        for r, g, p, kind, last, order, name in zip(b["r"], b["g"], b["p"], b["kind"], b["last"], b["ord"], b["name"], strict=True):
            if (r, g) != place:
                place, open_ = (r, g), []
            if kind == 0:
                heapq.heappush(open_, (order, name, last))
                continue
            while open_ and open_[0][2] < p:
                heapq.heappop(open_)
            out.append((r, g, p, open_[0][0] if open_ else None, open_[0][1] if open_ else None))
        yield pd.DataFrame(out, columns=["r", "g", "p", "ord", "name"]).astype({"ord": "Int64"})


def touched(spans: DataFrame, points: DataFrame, group: str, at: str) -> DataFrame:
    """The intervals (``group``, ``first``, ``last``) that hold a point: those whose next point from their beginning comes no later than
    their end. Points and beginnings stand in one order; the next point is in the range, or the first of a later range of the group."""
    columns = spans.columns
    numbered = written(spans.withColumn("_id", F.monotonically_increasing_id()))
    asked = numbered.where(f"`{group}` is not null and first <= last").select(F.col(group).alias("g"), F.col("first").cast("long").alias("p"), F.lit(0).alias("kind"), F.col("last").cast("long").alias("last"), "_id")
    met = points.select(F.col(group).alias("g"), F.col(at).cast("long").alias("p")).where("g is not null and p is not null").distinct()
    rows = asked.unionByName(met.select("g", "p", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("_id")))
    ranged = written(rows.repartitionByRange("g", "p").withColumn("r", F.spark_partition_id()))
    firsts = ranged.groupBy("g", "r").agg(F.min(F.when(F.col("kind") == 1, F.col("p"))).alias("own"))
    later = firsts.select("g", "r", F.first("own", ignorenulls=True).over(W.partitionBy("g").orderBy("r").rowsBetween(1, W.unboundedFollowing)).alias("later"))
    ahead = W.partitionBy("r", "g").orderBy(F.desc("p"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    next_ = ranged.withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("p"))).over(ahead)).where("kind = 0")
    hit = next_.join(later, ["g", "r"]).where(F.coalesce("next", "later") <= F.col("last")).select("_id")
    return numbered.join(hit, "_id", "left_semi").select(*columns)
