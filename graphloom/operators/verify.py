"""Changed code held against the conventions of the code base: names, failing, imports.

A symbol is looked at if a changed line lies within its lines (the next changed line from its
beginning comes no later than its end), so a change inside a body counts, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import conventions, intervals

#: Names of styles and severities as reports have them, and kinds that are named like types; fixed values.
STYLES = {"snake": "snake_case", "camel": "camelCase", "pascal": "PascalCase", "screaming_snake": "SCREAMING_SNAKE_CASE", "other": "unknown"}
SEVERITY = {"convention": "high", "trend": "medium", "mixed": "low"}
FUNCTIONS, TYPES = ["function", "method"], ["struct", "class", "enum", "type", "interface", "trait"]


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def snake(name: Column) -> Column:
    """A run of capitals is one word, but its last one begins the next if a small letter follows."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p)))))
    return F.concat(F.lower(parts[0]), F.array_join(rest, ""))


def naming_rules(symbols: DataFrame) -> DataFrame:
    """``rule, dominant, n, total, pct, strength``: the style of most functions (``naming_function``) and types (``naming_type``)."""
    rule = F.when(F.col("kind").isin(FUNCTIONS), "naming_function").when(F.col("kind").isin(TYPES), "naming_type")
    rows = symbols.select(rule.alias("rule"), conventions.style(F.col("name")).alias("style")).where("rule is not null")
    return conventions.dominant(rows, "rule", "style")


def touched_symbols(symbols: DataFrame, lines: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The symbols (path, start_line, end_line) that a changed line (path, line) lies in, and all of the files ``fresh`` (path)."""
    spans = symbols.withColumn("first", F.col("start_line")).withColumn("last", F.col("end_line"))
    if fresh is None:
        return intervals.touched(spans, lines, "path", "line").drop("first", "last")
    new = fresh.select("path").distinct()
    old = intervals.touched(spans.join(new, "path", "left_anti").select(*spans.columns), lines, "path", "line")
    return old.unionByName(spans.join(new, "path", "left_semi").select(*spans.columns)).drop("first", "last")


def _violation(rows: DataFrame, category: str, line: Column, message: Column, suggestion: Column) -> DataFrame:
    count = F.concat(F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), F.format_number("pct", 1), F.lit("%)"))
    return rows.select("path", line.cast("long").alias("line"), F.lit(category).alias("category"), _named(F.col("strength"), SEVERITY).alias("severity"), message.alias("message"), F.col("pattern"), count.alias("count"), "strength", suggestion.alias("suggestion"))


def violations(touched: DataFrame, rules: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``path, line, category, severity, message, pattern, count, strength, suggestion``. ``touched``: path, name, kind, start_line and,
    where failing is to be looked at, body; ``imports``: path, source of changed files; ``rules``: rule, dominant, n, total, pct,
    strength, of which ``naming_function``, ``naming_type``, ``unwrap_in_source`` and ``import_style`` are used: a few rows."""
    few = F.broadcast(rules)  # a row for each rule
    rule = F.when(F.col("kind").isin(FUNCTIONS), "naming_function").when(F.col("kind").isin(TYPES), "naming_type")
    named = touched.withColumn("rule", rule).join(few, "rule").withColumn("found", conventions.style(F.col("name"))).where("found <> dominant")
    named = named.withColumn("pattern", _named(F.col("dominant"), STYLES))
    kind = F.when(F.col("rule") == "naming_function", "Function").otherwise("Type")
    better = F.when((F.col("rule") == "naming_function") & (F.col("dominant") == "snake"), snake(F.col("name"))).when((F.col("rule") == "naming_function") & (F.col("dominant") == "camel"), camel(F.col("name")))
    out = _violation(named, "naming", F.col("start_line"), F.concat(kind, F.lit(" '"), F.col("name"), F.lit("' uses "), _named(F.col("found"), STYLES), F.lit(" but convention is "), F.col("pattern")), F.concat(F.lit("Rename to `"), better, F.lit("`")))
    if "body" in touched.columns:
        fails = touched.where(F.col("kind").isin(FUNCTIONS) & ~F.col("path").contains("test") & F.contains("body", F.lit(".unwrap()"))).withColumn("rule", F.lit("unwrap_in_source")).join(few, "rule").withColumn("pattern", F.col("dominant"))
        out = out.unionByName(_violation(fails, "error_handling", F.col("start_line"), F.lit(".unwrap() used in production code"), F.lit('Replace .unwrap() with .map_err(|e| ...)? or .expect("reason")')))
    if imports is not None:
        near = imports.where(F.startswith("source", F.lit("./")) | F.startswith("source", F.lit("../"))).withColumn("rule", F.lit("import_style")).join(few, "rule").where("dominant = 'absolute'").withColumn("pattern", F.col("dominant"))
        out = out.unionByName(_violation(near, "imports", F.lit(None), F.concat(F.lit("Relative import '"), F.col("source"), F.lit("' but convention is absolute imports")), F.concat(F.lit("Rewrite '"), F.col("source"), F.lit("' as absolute import"))))
    return out


def passed(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The categories that have a rule and no violation."""
    category = F.when(F.col("rule") == "naming_function", "naming").when(F.col("rule").isin("unwrap_in_source", "result_return_type"), "error_handling").when(F.col("rule") == "import_style", "imports")
    return rules.select(category.alias("category")).where("category is not null").distinct().join(found.select("category").distinct(), "category", "left_anti")
