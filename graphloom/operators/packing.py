"""Budgets: sections, truncation, greedy packing in the row, efficiency.

Tokens are counted by a deterministic proxy: a line has a token for each four characters,
its line break counted. Greedy rules are folds over the files of one selection, an array of
bounded length (``signals.SEEDS`` files), so they run inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import ranking
from graphloom.operators.lineage import written

#: Fixed part and shares of a budget; fixed values.
METADATA = 500
SECTIONS = {"directory_tree": 0.05, "module_map": 0.20, "dependency_graph": 0.15, "key_files": 0.20, "signatures": 0.30, "git_context": 0.10}
#: Tokens kept for the omission marker, tokens of the truncation marker, most for bridges.
RESERVE, MARKER, CROSS_LANGUAGE = 150, 5, 500


def line_tokens(lines: Column) -> Column:
    """Tokens of each line of an array."""
    return F.transform(lines, lambda line: F.ceil((F.length(line) + 1) / 4).cast("long"))


def lines_of(content: Column) -> Column:
    """Lines as an iterator of lines gives them: a last line break opens no line."""
    return F.split(F.regexp_replace(content, r"\n\z", ""), "\n")


def total(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x)


def fitting(tokens: Column, budget: Column) -> Column:
    """Tokens of the longest prefix of lines within the budget."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"))
    step = lambda s, x: F.struct(F.when(s["open"] & (s["used"] + x <= budget), s["used"] + x).otherwise(s["used"]).alias("used"), (s["open"] & (s["used"] + x <= budget)).alias("open"))
    return F.aggregate(tokens, start, step, lambda s: s["used"])


def sections(budget: Column) -> Column:
    """The parts of a budget."""
    rest = F.greatest(budget - METADATA, F.lit(0))
    return F.struct(F.least(budget, F.lit(METADATA)).cast("long").alias("metadata"), *[F.floor(rest * share).alias(name) for name, share in SECTIONS.items()])


def truncate(files: DataFrame, budget: int, keep: list[str] = ("path",)) -> DataFrame:
    """``used, omitted`` of each text cut to a budget by whole lines; what fits stays whole,
    and of what doesn't ``RESERVE`` tokens are kept for the marker. ``files``: content."""
    tokens = line_tokens(lines_of(F.col("content")))
    rows = files.select(*keep, tokens.alias("t")).select(*keep, "t", total(F.col("t")).alias("n"))
    used = F.when(F.col("n") <= budget, F.col("n")).otherwise(fitting(F.transform("t", lambda x: x + 1), F.lit(max(0, budget - RESERVE))))
    return rows.select(*keep, used.alias("used"), (F.col("n") - used).alias("omitted"))


def omission(section: str, tokens: int, budget: int) -> str:
    shown = f"~{tokens / 1000:.1f}k" if tokens >= 1000 else f"~{tokens}"
    need = f"{budget // 1000}k+" if budget >= 1000 else f"{budget}+"
    return f"<!-- {section} omitted: {shown} tokens. Use --tokens {need} to include -->"


def fill(files: DataFrame, group: str, budget: int) -> DataFrame:
    """Fill, then overflow: in each group best score first, ties by path; whole if it fits,
    else cut by lines to what is left, so that later, smaller files may still fit whole.
    ``group, path, score, tokens, level`` of the files that are reached. ``files``: group,
    path, score, content; a group holds one selection."""
    one = F.struct((-F.col("score")).alias("order"), "path", "score", line_tokens(lines_of(F.col("content"))).alias("t"))
    ranked = files.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("files"))
    empty = F.array().cast("array<struct<path:string,score:double,tokens:bigint,level:string>>")

    def step(s: Column, f: Column) -> Column:
        size, left = total(f["t"]), s["left"]
        cut = F.when(left <= MARKER, F.lit(0).cast("long")).otherwise(fitting(f["t"], left - MARKER))
        cut = F.when(cut > 0, F.least(cut + MARKER, left)).otherwise(F.lit(0).cast("long"))
        used = F.when(size <= left, size).otherwise(cut)
        row = F.struct(f["path"].alias("path"), f["score"].cast("double").alias("score"), used.alias("tokens"), F.when(size <= left, "full").otherwise("truncated").alias("level"))
        return F.struct(F.when(left > 0, left - used).otherwise(left).alias("left"), F.when(left > 0, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    packed = F.aggregate("files", F.struct(F.lit(budget).cast("long").alias("left"), empty.alias("out")), step, lambda s: s["out"])
    return ranked.select(group, F.inline(packed))


def greedy_skip(rows: DataFrame, group: str, order: Column, budget: int) -> DataFrame:
    """``group, path, tokens`` of the rows that fit, in order: one that doesn't is skipped and
    the next is tried; a budget of 0 takes all. ``rows``: group, path, tokens."""
    if budget == 0:
        return rows.select(group, "path", F.col("tokens").cast("long").alias("tokens"))
    ranked = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "path", F.col("tokens").cast("long").alias("tokens")))).alias("rows"))
    empty = F.array().cast("array<struct<path:string,tokens:bigint>>")

    def step(s: Column, r: Column) -> Column:
        fits = r["tokens"] <= s["left"]
        return F.struct(F.when(fits, s["left"] - r["tokens"]).otherwise(s["left"]).alias("left"), F.when(fits, F.concat(s["out"], F.array(F.struct(r["path"].alias("path"), r["tokens"].alias("tokens"))))).otherwise(s["out"]).alias("out"))

    taken = F.aggregate("rows", F.struct(F.lit(budget).cast("long").alias("left"), empty.alias("out")), step, lambda s: s["out"])
    return ranked.select(group, F.inline(taken))


def efficiency(relevant: DataFrame, packed: DataFrame, group: str, budget: int) -> DataFrame:
    """For each group: relevant files, those packed, the share of each and of the budget, the
    lowest score packed and the highest left out. ``relevant``: group, path, score."""
    rows = relevant.select(group, "path", "score").join(packed.select(group, "path", "tokens"), [group, "path"], "left")
    inside = F.col("tokens").isNotNull()
    return rows.groupBy(group).agg(
        F.count("*").alias("relevant"),
        F.count("tokens").alias("covered"),
        F.round(F.count("tokens") / F.count("*"), 6).alias("coverage"),
        F.round(F.coalesce(F.sum("tokens"), F.lit(0)) / budget, 6).alias("utilisation"),
        F.min(F.when(inside, F.col("score"))).alias("lowest_in"),
        F.max(F.when(~inside, F.col("score"))).alias("highest_out"),
    )


#: Levels of detail, from whole to least.
LEVELS = ["full", "trimmed", "documented", "signature", "stub"]


def degrade(files: list[tuple[str, bool, float, list[int]]], budget: int) -> list[tuple[str, str, int]]:
    """``(path, level, tokens)`` of the files of one selection, each (path, selected,
    priority, tokens at each level): dependencies lose detail first, the least first and down
    to stubs; then the selected ones, never below documented; then dependencies are left out."""
    level = [0] * len(files)
    dropped: set[int] = set()
    used = lambda: sum(0 if i in dropped else f[3][level[i]] for i, f in enumerate(files))
    done = lambda: [(f[0], LEVELS[level[i]], 0 if i in dropped else f[3][level[i]]) for i, f in enumerate(files)]
    if used() <= budget:
        return done()
    by_priority = sorted(range(len(files)), key=lambda i: files[i][2])
    others, chosen = [i for i in by_priority if not files[i][1]], [i for i in by_priority if files[i][1]]
    for group, lowest in ((others, 4), (chosen, 2)):
        for i in group:
            for k in range(1, lowest + 1):
                level[i] = k
                if used() <= budget:
                    return done()
    for i in others:
        dropped.add(i)
        level[i] = 4
        if used() <= budget:
            break
    return done()


def degraded(files: DataFrame, group: str, budget: int) -> DataFrame:
    """``degrade`` for many selections: ``group, path, level, tokens``. ``files``: group, path, selected, priority, tokens (at each
    level, an array). A file's loss at a level is a step; all steps of a selection stand in one order (dependencies
    down to stubs, selected ones down to documented, dependencies left out; the least priority first, ties by path), and
    those up to the first that fits the budget hold. Running sums by ranges find it, so a selection has no task of its own."""
    rows = written(files.select(group, "path", "selected", F.coalesce("priority", F.lit(0.0)).cast("double").alias("priority"), F.col("tokens").cast("array<bigint>").alias("t")))
    lower = F.when(F.col("selected"), F.expr("sequence(1, 2)")).otherwise(F.expr("sequence(1, 4)"))
    less = rows.select(group, "path", F.when(F.col("selected"), 2).otherwise(1).alias("phase"), "priority", "t", F.explode(lower).alias("level"))
    less = less.select(group, "path", "phase", "priority", "level", (F.get("t", F.col("level")) - F.get("t", F.col("level") - 1)).alias("delta"))
    gone = rows.where(~F.col("selected")).select(group, "path", F.lit(3).alias("phase"), "priority", F.lit(len(LEVELS)).alias("level"), (-F.get("t", F.lit(4))).alias("delta"))
    key = ["phase", "priority", "path", "level"]
    steps = less.unionByName(gone)
    summed = written(ranking.running(steps.withColumn("before", F.col("delta")), [group], [F.col(k) for k in key], {"before": F.col("delta")}))
    whole = rows.groupBy(group).agg(F.sum(F.get("t", F.lit(0))).alias("whole"))
    fits = summed.join(whole, group).where(F.col("whole") + F.col("before") + F.col("delta") <= budget).groupBy(group).agg(F.min(F.struct(*key)).alias("stop"))
    over = whole.where(F.col("whole") > budget).join(fits, group, "left")
    held = summed.join(over, group).where(F.col("stop").isNull() | (F.struct(*key) <= F.col("stop"))).groupBy(group, "path").agg(F.max("level").alias("level"))
    out = rows.join(held, [group, "path"], "left").select(group, "path", F.coalesce("level", F.lit(0)).alias("level"), "t")
    at = F.least("level", F.lit(4))
    tokens = F.when(F.col("level") == len(LEVELS), 0).otherwise(F.get("t", at))
    return out.select(group, "path", F.get(F.array(*[F.lit(x) for x in LEVELS]), at).alias("level"), tokens.alias("tokens"))
