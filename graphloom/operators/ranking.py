"""Ranks over a whole relation that don't sort it in one task.

Rows are dealt into ranges of their sort key by splitters from a bounded sample. The range of a
row is an expression of its key, so it is the same whenever it is computed; each range is
sorted for itself and numbered from the rows in the ranges before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from graphloom.operators.lineage import cut, written

#: Rows of the sample for each range.
PER_RANGE = 32


def _ranges(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with its sort key ``_k`` and range ``_r``."""
    keyed = cut(df.withColumn("_k", key))
    return keyed.withColumn("_r", range_of(F.col("_k"), cuts(keyed, "_k"), keyed.schema["_k"].dataType))


def cuts(keyed: DataFrame, key: str) -> list:
    """Splitters of a struct column, from a sample of at most ``PER_RANGE`` rows for each range."""
    n = max(1, min(256, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, 2.0 * n * PER_RANGE / max(1, keyed.count()))
    sample = sorted(keyed.where(place <= int(share * (1 << 30))).select(key, place.alias("p")).orderBy("p").limit(n * PER_RANGE).select(key).distinct().collect(), key=lambda r: _order(r[0]))
    return [sample[i * len(sample) // n][0] for i in range(1, n)] if len(sample) > n else []


def range_of(key: Column, splitters: list, kind: StructType | str) -> Column:
    """How many splitters (in order) a key of type ``kind`` isn't before, found by halving."""
    fields = kind if isinstance(kind, StructType) else _parse_datatype_string(kind)

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key < _literal(splitters[middle], fields), among(lo, middle)).otherwise(among(middle + 1, hi))

    return among(0, len(splitters))


def _order(v) -> tuple:
    """Spark's order: nulls first, NaN last."""
    return tuple((x is not None, x != x, 0 if x is None or x != x else x) for x in v)


def _literal(v, kind) -> Column:
    return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields, strict=True)])


def _upto(df: DataFrame, key: Column, weight: Column, name: str) -> DataFrame:
    """``name``: sum of the weights of all rows up to and with each, in order of the key."""
    dealt = _ranges(df, key)
    sums = {r["_r"]: r["w"] for r in dealt.groupBy("_r").agg(F.sum(weight).alias("w")).collect()}  # a row for each range
    before, total = [], 0
    for r in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(r, 0)
    own = F.sum(weight).over(W.partitionBy("_r").orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.withColumn(name, own + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_r"))).drop("_k", "_r")


def _totals(df: DataFrame, value: str, descending: bool) -> DataFrame:
    """Value, its rows, and the rows up to and with it: only distinct values are ordered."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    return _upto(counts, F.struct((-F.col(value) if descending else F.col(value)).alias("v")), F.col("_n"), "_upto")


def cume_dist(df: DataFrame, value: str, total: int, name: str) -> DataFrame:
    """``name``: share of rows whose ``value`` is at most the row's."""
    return df.join(_totals(df, value, False).select(value, (F.col("_upto") / max(total, 1)).alias(name)), value)


def competition_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: one more than the rows with a larger ``value``."""
    return competition_ranks(df, {value: name})


def competition_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``competition_rank`` by several values (value: name), each counted on ``df`` alone."""
    out = df
    for value, name in names.items():
        out = out.join(_totals(df, value, True).select(value, (F.col("_upto") - F.col("_n") + 1).alias(name)), value)
    return out


def row_number(df: DataFrame, key: list[Column], name: str) -> DataFrame:
    """``name``: place in ascending order of the key's columns, which must be a total order,
    from 1; nulls come first."""
    return _upto(df, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]), F.lit(1), name)


# columns of a relation that is sorted into ranges
RANGE, SPOT = "_graphloom_range", "_graphloom_spot"


def spots(df: DataFrame, key: list[Column], name: str) -> DataFrame:
    """``df`` written in ascending order of the key (nulls first), and ``name``: a number that grows with it. The
    numbers have gaps between ranges, so nothing is counted; ties have numbers of their own."""
    by = [c.asc_nulls_first() for c in key]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def _sorted(df: DataFrame, by: list[str], key: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` written in ranges of (group, key), and for each group and range that it meets: its
    first spot, and what the ranges before hold of the group (``_before``, and a sum by each name)."""
    order = [F.col(b).asc_nulls_first() for b in by] + [c.asc_nulls_first() for c in key]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().alias(SPOT), *[c.alias(f"_w_{n}") for n, c in sums.items()]))
    parts = dealt.groupBy(RANGE, *by).agg(F.min(SPOT).alias("_first"), F.count("*").alias("_n"), *[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in sums])
    before = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    held = {"_before": "_n"} | {f"_b_{n}": f"_s_{n}" for n in sums}
    parts = parts.select(F.col(RANGE).alias("_part"), *[F.col(b).alias(f"_by_{b}") for b in by], "_first", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(n) for n, s in held.items()])
    return dealt, parts


def _met(dealt: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    on = F.col(RANGE) == F.col("_part")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return dealt.join(parts, on)


def places(df: DataFrame, by: list[str], key: list[Column], name: str) -> DataFrame:
    """``name``: the place of each row in its group, in ascending order of the key (nulls first), from 0. A group of
    any size is spread over ranges, of which there is a row each to count those before."""
    dealt, parts = _sorted(df, by, key, {})
    return _met(dealt, parts, by).select(*df.columns, (F.col("_before") + F.col(SPOT) - F.col("_first")).alias(name))


def running(df: DataFrame, by: list[str], key: list[Column], sums: dict[str, Column]) -> DataFrame:
    """For each name, the sum of its column over the rows that stand before in the group: windows within
    ranges, and what the ranges before hold."""
    dealt, parts = _sorted(df, by, key, sums)
    own = W.partitionBy(RANGE, *by).orderBy(SPOT).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.select("*", *[F.coalesce(F.sum(f"_w_{n}").over(own), F.lit(0)).alias(f"_o_{n}") for n in sums])
    return _met(inside, parts, by).select(*[c for c in df.columns if c not in sums], *[(F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
