"""A Merkle manifest of a table: a hash tree over the rows of each group, and one over groups.

Rows become leaves; the leaves of a group stand in an order, and every ``FANOUT`` consecutive
nodes make a run whose digest is their parent, until one node, the group's subroot, is left.
The subroots, in the order of their groups, make the upper tree in the same way; its last node
is the root. All levels come from windows: a run is the ordered full-frame ``collect_list`` of
its nodes, partitioned by group and parent index; it is both the parent's preimage and the
siblings that a proof holds. One row of each run is kept before the next level, so the levels
together have half as many rows as there are leaves. Proofs are handed down from the root,
each level joined with the one above by group and parent index.

No group is ever one task's: rows are numbered by ranges of group and order (a group of any
size is spread over ranges), windows and joins have keys of at most ``FANOUT`` nodes. Only the
number of leaves of the largest group, and the root, come to the driver. Leaves and levels
are written to the shared folder.

Defined results: a null field counts as ``-``, an empty text as ``0:``; texts are hashed whole.
Rows without a group are a group, the first one; rows without an order value come first in
their group; rows of equal order stand by their digests, so repeated rows are leaves beside
each other with the same digest (and proofs that hold for either). A group of one leaf has that leaf as its subroot. Without
rows there are no result rows. Further columns of the table aren't hashed unless they are
named; ``tree`` keeps the columns of the leaves, and its own replace those of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialise

FANOUT = 3
#: The fields of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# columns that go along, under names that no table has
GROUP, INDEX, COUNT, DIGEST, PARENT, RUN, PATH, SUBROOT = (f"__graphloom_{x}" for x in ("group", "index", "count", "digest", "parent", "run", "path", "subroot"))
RANGE, PLACE, FIRST, BEFORE, NUMBER, LOWER = (f"__graphloom_{x}" for x in ("range", "place", "first", "before", "number", "lower"))
OF_GROUP, OF_PARENT, OF_RANGE, ABOVE, PATH_ABOVE = (f"__graphloom_{x}" for x in ("of_group", "of_parent", "of_range", "above", "path_above"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each with its length in bytes, so no two rows have the same
    preimage."""
    as_text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in as_text])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda d, step: digest(step["left"], d, step["right"]))


def siblings(proof: Column) -> Column:
    """The siblings of a proof, level by level from the leaf, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _numbered(leaves: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """Leaves with the number of their group, their index in it, and its number of leaves.

    Sorted ranges of (group, order): a place is in proportion to the rows before it within
    its range; a range adds the rows of the group that stand in ranges before."""
    by = [group.asc_nulls_first(), *[c.asc_nulls_first() for c in order]]
    dealt = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialise(dealt.select("*", group.alias(GROUP), F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().alias(PLACE)), "merkle_ranges")
    # a row for each group and each range that cuts one
    parts = dealt.groupBy(RANGE, GROUP).agg(F.min(PLACE).alias(FIRST), F.count("*").alias(COUNT))
    whole = W.partitionBy(GROUP)
    parts = parts.select(
        F.col(RANGE).alias(OF_RANGE),
        F.col(GROUP).alias(OF_GROUP),
        FIRST,
        F.min(FIRST).over(whole).alias(NUMBER),
        (F.sum(COUNT).over(whole.orderBy(RANGE)) - F.col(COUNT)).alias(BEFORE),
        F.sum(COUNT).over(whole).alias(COUNT),
    )
    joined = dealt.join(parts, (F.col(RANGE) == F.col(OF_RANGE)) & F.col(GROUP).eqNullSafe(F.col(OF_GROUP)))
    return joined.select(*leaves.columns, F.col(NUMBER).alias(GROUP), (F.col(BEFORE) + F.col(PLACE) - F.col(FIRST)).alias(INDEX), COUNT)


def _parent(index: Column) -> Column:
    return F.floor(index / FANOUT)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """For each level from the leaves up, a row for each run: its group, its parent's index,
    how many nodes the group has on this level, and the run."""
    levels, now = [], nodes
    most = nodes.agg(F.max(COUNT)).first()[0] or 0
    while most > 1:
        run = F.collect_list(DIGEST).over(W.partitionBy(GROUP, PARENT).orderBy(INDEX).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        runs = now.where(F.col(COUNT) > 1).select(GROUP, INDEX, COUNT, DIGEST, _parent(F.col(INDEX)).alias(PARENT)).withColumn(RUN, run)
        levels.append(materialise(runs.where(F.col(INDEX) % FANOUT == 0).select(GROUP, PARENT, COUNT, RUN), "merkle_level"))
        now = levels[-1].select(GROUP, F.col(PARENT).alias(INDEX), F.ceil(F.col(COUNT) / FANOUT).alias(COUNT), digest(F.array_join(RUN, "")).alias(DIGEST))
        most = -(-most // FANOUT)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of each group."""
    tops = nodes.where(F.col(COUNT) == 1).select(GROUP, F.col(DIGEST).alias(SUBROOT))
    for level in levels:
        tops = tops.unionByName(level.where(F.col(COUNT) <= FANOUT).select(GROUP, digest(F.array_join(RUN, "")).alias(SUBROOT)))
    return tops


def _step(run: Column, index: Column) -> Column:
    """What stands left and right of a node in its run."""
    k = (index % FANOUT).cast("int")
    return F.struct(F.array_join(F.slice(run, F.lit(1), k), "").alias("left"), F.array_join(F.slice(run, k + 2, F.lit(FANOUT)), "").alias("right"))


def _proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with their proofs and subroots; ``tops`` has, for each group, its subroot and the
    path that leads on from there."""
    paths = None
    for level in reversed(levels):
        ended = level.where(F.col(COUNT) <= FANOUT).join(tops, GROUP)
        paths = ended if paths is None else ended.unionByName(_handed(level.where(F.col(COUNT) > FANOUT), PARENT, paths))
    single = nodes.where(F.col(COUNT) == 1).join(tops, GROUP)
    return single if paths is None else single.unionByName(_handed(nodes.where(F.col(COUNT) > 1), INDEX, paths))


def _handed(below: DataFrame, index: str, paths: DataFrame) -> DataFrame:
    """Nodes (or runs, by their parent) with the path of the run that they are in, one step longer."""
    above = paths.select(F.col(GROUP).alias(OF_GROUP), F.col(PARENT).alias(OF_PARENT), F.col(RUN).alias(ABOVE), F.col(PATH).alias(PATH_ABOVE), SUBROOT)
    joined = below.join(above, (F.col(GROUP) == F.col(OF_GROUP)) & (_parent(F.col(index)) == F.col(OF_PARENT)))
    longer = F.concat(F.array(_step(F.col(ABOVE), F.col(index))), F.col(PATH_ABOVE))
    return joined.select(*below.columns, SUBROOT, longer.alias(PATH))


def tree(leaves: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """The columns of ``leaves``, and for each ``subroot`` and ``root`` (digests) and ``proof``: from the
    leaf to the root, the nodes left and right of it in its run (``left``, ``right``: digests one
    behind the other)."""
    nodes = _nodes(leaves, F.col(group), F.col(order), F.col(leaf))
    levels = _levels(nodes)
    groups = materialise(nodes.where(F.col(INDEX) == 0).select(GROUP, F.col(group).alias("of")).join(_tops(nodes, levels), GROUP), "merkle_groups")
    upper = _nodes(groups.withColumnRenamed(GROUP, LOWER), F.lit("all"), F.col("of"), F.col(SUBROOT)).drop(SUBROOT)
    upper_levels = _levels(upper)
    last = materialise(_tops(upper, upper_levels), "merkle_root")
    start = F.array().cast("array<struct<left:string,right:string>>")
    tops = _proofs(upper, upper_levels, last.withColumn(PATH, start)).select(F.col(LOWER).alias(GROUP), F.col(DIGEST).alias(SUBROOT), PATH)
    root = last.first()
    out = _proofs(nodes, levels, materialise(tops, "merkle_tops"))
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    return out.select(*kept, F.col(SUBROOT).alias("subroot"), F.lit(root[SUBROOT] if root else None).cast("string").alias("root"), F.col(PATH).alias("proof"))


def _nodes(leaves: DataFrame, group: Column, order: Column, digest_: Column) -> DataFrame:
    return materialise(_numbered(leaves.withColumn(DIGEST, digest_), group, [order, F.col(DIGEST)]), "merkle_nodes")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", **also: Column) -> DataFrame:
    """Group and order of each row of ``docs``, its ``leaf``, ``subroot``, ``root`` and ``proof``, and the
    columns ``also`` (expressions over ``docs``)."""
    leaves = docs.select(group, order, leaf(*[F.col(f) for f in fields]).alias("leaf"), *[c.alias(n) for n, c in also.items()])
    return tree(materialise(leaves, "merkle_leaves"), group, order)


def verify(proved: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``proved`` with ``folded_root``, what its column ``leaf`` and the proof lead to, and ``verified``,
    whether that is the root."""
    folded = fold(F.col(leaf), F.col("proof"))
    return proved.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
