"""Conventions: naming styles, dominance and strength, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import predicates as P


def style(name: Column) -> Column:
    """The naming style of an ASCII identifier."""
    return (
        F.when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "screaming_snake")
        .when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z][A-Za-z0-9]*$"), "camel")
        .otherwise("other")
    )


def style_counts(rows: DataFrame, by: str, text: str) -> DataFrame:
    """``by, style, n`` over the words of a text, counted before anything is shuffled."""
    words = rows.select(by, F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return words.groupBy(by, style(F.translate("word", "\n", " ")).alias("style")).agg(F.count("*").alias("n"))


def strength(pct: Column) -> Column:
    return F.when(pct >= 90, "convention").when(pct >= 70, "trend").when(pct >= 50, "mixed")


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The one most frequent value in each group; none where two tie or it has under half."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    top = n.groupBy(by).agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    best = n.join(top, by).where("n = top").groupBy(by).agg(F.max(value).alias("dominant"), F.count("*").alias("ties"), F.max("n").alias("n"), F.max("total").alias("total")).where("ties = 1")
    pct = F.round(F.col("n") * 100.0 / F.col("total"), 4)
    return best.select(by, "dominant", "n", "total", pct.alias("pct"), strength(pct).alias("strength")).where("strength is not null")


def length_stats(files: DataFrame) -> DataFrame:
    """Mean and exact median of line counts by directory and overall."""
    lines = files.select("source", F.size(F.split("content", "\n")).alias("n"))
    return lines.rollup("source").agg(F.count("*").alias("files"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median")).select(F.coalesce("source", F.lit("(all)")).alias("source"), "files", "mean", "median")


# ---------------------------------------------------------------- patterns of a code base

#: Marks of mocks, and shares of tests for each public function; fixed values.
MOCKS = ["jest.mock", "vi.mock", "unittest.mock", "sinon.stub", "@mock", "mock!("]
DENSE, SOME = 3.0, 1.5


def observation(rows: DataFrame, name: str, dominant: str, n: Column, total: Column) -> DataFrame:
    """``name, dominant, n, total, pct, strength``: one row, or none under half."""
    counts = rows.agg(n.cast("long").alias("n"), total.cast("long").alias("total")).where("total > 0")
    pct = F.col("n") * 100.0 / F.col("total")
    got = counts.select(F.lit(name).alias("name"), F.lit(dominant).alias("dominant"), "n", "total", F.round(pct, 4).alias("pct"), strength(pct).alias("strength"))
    return got.where("strength is not null")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def import_conventions(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Whether imports (path, source) are absolute or relative, files group them in blocks or
    write single ones, and how many are passed on. ``files``: path, language, content."""
    relative = F.col("source").startswith("./") | F.col("source").startswith("../")
    style = imports.agg(_count(~relative).alias("a"), _count(relative).alias("r"))
    styles = style.select(F.lit("import_style").alias("name"), F.when(F.col("a") >= F.col("r"), "absolute").otherwise("relative").alias("dominant"), F.greatest("a", "r").alias("n"), (F.col("a") + F.col("r")).alias("total"))
    lines = F.transform(F.split("content", "\n"), lambda x: F.ltrim(x))
    begins = {"rust": r"^(pub )?use ", "python": r"^(from|import) "}
    of = F.when(F.col("language") == "rust", F.lit(begins["rust"])).when(F.col("language") == "python", F.lit(begins["python"])).when(F.col("language").isin("typescript", "tsx", "javascript", "jsx"), F.lit(r"^(import|export) "))
    rows = files.select("language", "content", lines.alias("ls"), of.alias("begin")).where("begin is not null").withColumn("uses", F.expr("filter(ls, x -> x rlike begin)")).where("size(uses) > 0")
    block = F.when(F.col("language") == "rust", F.col("content").contains("use ") & F.col("content").contains(":{")).when(F.col("language") == "python", F.exists("uses", lambda x: x.startswith("from ") & x.contains("("))).otherwise(F.exists("uses", lambda x: x.contains("{")))
    passed = F.when(F.col("language") == "rust", F.size(F.filter("uses", lambda x: x.startswith("pub use ")))).when(F.col("language") == "python", 0).otherwise(F.size(F.filter("uses", lambda x: x.startswith("export * from") | x.startswith("export {"))))
    sums = rows.agg(_count(block).alias("b"), _count(~block).alias("s"), F.sum(passed).alias("p"), F.sum(F.size("uses")).alias("u"))
    grouping = sums.select(F.lit("import_grouping").alias("name"), F.when(F.col("b") >= F.col("s"), "block").otherwise("single").alias("dominant"), F.greatest("b", "s").alias("n"), (F.col("b") + F.col("s")).alias("total"))
    again = sums.select(F.lit("re_exports").alias("name"), F.lit("pub use").alias("dominant"), F.col("p").alias("n"), F.col("u").alias("total"))
    return _rated(styles.unionByName(grouping).unionByName(again))


def _rated(counts: DataFrame) -> DataFrame:
    pct = F.col("n") * 100.0 / F.col("total")
    rated = counts.where("total > 0").select("name", "dominant", F.col("n").cast("long").alias("n"), F.col("total").cast("long").alias("total"), F.round(pct, 4).alias("pct"), strength(pct).alias("strength"))
    return rated.where("strength is not null")


def error_conventions(symbols: DataFrame) -> DataFrame:
    """How functions outside tests fail: results returned, no unwrapping, no expecting, and the
    question mark. ``symbols``: path, language, kind, signature, body."""
    f = symbols.where(F.col("kind").isin("function", "method") & ~P.test_for_conventions(F.col("path")))
    code = F.regexp_replace("body", r"//[^\n]*", "")
    rows = f.select(
        (F.col("signature").contains("Result<") | F.col("signature").contains("-> Result")).alias("result"),
        F.size(F.regexp_extract_all(code, F.lit(r"\.unwrap\(\)"), F.lit(0))).alias("unwrap"),
        F.size(F.regexp_extract_all(code, F.lit(r"\.expect\("), F.lit(0))).alias("expect"),
        (F.col("language") == "rust").alias("rust"),
        F.col("body").rlike(r"[)\w]\?\s*[;,\n)]").alias("question"),
    )
    c = rows.agg(F.count("*").alias("f"), _count(F.col("result")).alias("r"), F.sum("unwrap").alias("u"), F.sum("expect").alias("e"), _count(F.col("rust")).alias("rust"), _count(F.col("rust") & F.col("question")).alias("q"))
    one = lambda name, dominant, n, total, when=None: (c if when is None else c.where(when)).select(F.lit(name).alias("name"), F.lit(dominant).alias("dominant"), n.alias("n"), total.alias("total"))
    parts = [
        one("result_return_type", "Result<T, E>", F.col("r"), F.col("f")),
        one("unwrap_in_source", "no .unwrap() in src/", F.greatest(F.col("f") - F.col("u"), F.lit(0)), F.col("f")),
        one("expect_in_source", "no .expect() in src/", F.greatest(F.col("f") - F.col("e"), F.lit(0)), F.col("f"), "e > 0"),
        one("question_mark_propagation", "? operator", F.col("q"), F.col("rust"), "q > 0"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _rated(out)


def coverage_by_folder(files: DataFrame, tests: DataFrame) -> DataFrame:
    """``dir, sources, pct``: share of each folder's sources that a test maps to."""
    source = files.where(~P.test_for_conventions(F.col("path"))).select("path", F.regexp_replace(F.when(F.col("path").contains("/"), F.col("path")).otherwise("/"), "/[^/]*$", "").alias("dir"))
    mapped = tests.select(F.col("source").alias("path"), F.lit(1.0).alias("hit")).distinct()
    return source.join(mapped, "path", "left").groupBy("dir").agg(F.count("*").alias("sources"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))) * 100, 6).alias("pct"))


def testing_conventions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Mocks, names of tests, tests for each public function, and tests inside sources."""
    tests = files.where(P.test_for_conventions(F.col("path")))
    mock = observation(tests, "mock_usage", "no mocks", _count(~P.contains_any(F.col("content"), MOCKS)), F.count("*"))
    named = symbols.where((F.col("kind") == "function") & F.col("name").startswith("test_") & P.test_for_conventions(F.col("path")))
    parts = F.size(F.split("name", "_"))
    pattern = F.when(parts >= 4, "test_{fn}_{scenario}_{expected}").when(parts >= 3, "test_{fn}_{scenario}").otherwise("test_{name}")
    naming = dominant(named.select(F.lit("test_naming").alias("name"), pattern.alias("pattern")), "name", "pattern")
    inline = observation(files, "inline_tests", "inline tests present", _count(P.inline_tests(F.col("language"), F.col("content"))), F.count("*"))
    public = symbols.where(~P.test_for_conventions(F.col("path")) & F.col("kind").isin("function", "method") & (F.col("visibility") == "public")).agg(F.count("*").alias("total"))
    ratio = F.col("n") / F.col("total")
    density = named.agg(F.count("*").alias("n")).crossJoin(public).where("n > 0 and total > 0")  # two rows of one
    density = density.select(F.lit("test_density").alias("name"), F.concat(F.format_number(ratio, 1), F.lit(" tests/public fn")).alias("dominant"), "n", "total", F.round(ratio * 100, 4).alias("pct"), F.when(ratio >= DENSE, "convention").when(ratio >= SOME, "trend").otherwise("mixed").alias("strength"))
    return mock.unionByName(naming).unionByName(inline).unionByName(density)


def visibility_conventions(symbols: DataFrame) -> DataFrame:
    """Which visibility is the rule (none on a tie), and whether public symbols are documented.
    ``symbols``: path, language, visibility, body."""
    s = symbols.where(~P.test_for_conventions(F.col("path")))
    body = F.trim("body")
    starts = lambda *marks: P.any_of(body.startswith(m) for m in marks)
    doc = (
        F.when(F.col("language") == "rust", starts("///", "//!"))
        .when(F.col("language") == "python", starts('"""', "'''"))
        .when(F.col("language").isin("javascript", "typescript", "java", "kotlin", "c", "cpp", "csharp"), starts("/**", "///"))
        .when(F.col("language") == "ruby", starts("#"))
        .otherwise(starts("///", "/**", '"""'))
    )
    c = s.agg(_count(F.col("visibility") == "public").alias("a"), _count(F.col("visibility") == "private").alias("b"), _count((F.col("visibility") == "public") & doc).alias("d"))
    rule = c.where("a <> b").select(F.lit("visibility_default").alias("name"), F.when(F.col("a") > F.col("b"), "public").otherwise("private").alias("dominant"), F.greatest("a", "b").alias("n"), (F.col("a") + F.col("b")).alias("total"))
    docs = c.select(F.lit("doc_comment_coverage").alias("name"), F.lit("documented public APIs").alias("dominant"), F.col("d").alias("n"), F.col("a").alias("total"))
    return _rated(rule.unionByName(docs))


def checksum(observed: DataFrame, key: str) -> DataFrame:
    """One hash over observations in order of their key."""
    line = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(observed.columns)]))
    return observed.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("checksum"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change, before, after`` of what two exports say is dominant."""
    a, b = old.select(key, F.col("dominant").alias("before")), new.select(key, F.col("dominant").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change"), "before", "after").where("change is not null")
