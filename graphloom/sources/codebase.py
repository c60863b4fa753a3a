"""Adapters: the tables seen as a code base of files, symbols, imports and tests.

A part is a file; its language follows from its type and its folder from its brand, and a part
of a size over 45 is the test of the part before it. What a supplier delivers of a part is a
symbol of the file, and parts on consecutive lines of an order import each other. ``SQL``
holds the same relations for DuckDB, to put behind WITH."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.tables import table

LANGUAGES = {"STANDARD": ("rust", "rs"), "ECONOMY": ("python", "py"), "MEDIUM": ("typescript", "ts"), "LARGE": ("go", "go"), "SMALL": ("javascript", "js"), "PROMO": ("markdown", "md")}
VERBS = ["load", "save", "parse", "build", "find", "merge", "score", "check"]
NOUNS = ["user", "order", "token", "cache", "index", "graph", "query", "part"]
#: First lines of some files: markers of generated code, tests and documents.
HEADS = ["", "// Code generated by a tool", "#[cfg(test)]", "def test_it():", "describe('x')", "@generated", "/// A document", "latest(1)"]


def _of(value, pairs: dict) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), value)


def _stem() -> F.Column:
    return F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))


#: Rows of a task where rows are dealt out by number.
ROWS = 250_000


def spread(df: DataFrame, *by: str, least: int = 0) -> DataFrame:
    """``df`` dealt out by columns to as many tasks as the session gives a shuffle, and to more where a task would have over ``ROWS`` rows,
    whatever its bytes are: what is made of a short row may be long, so the size of a table says little of the work on it."""
    return df.repartition(max(parts(df), least), *by)


def parts(df: DataFrame) -> int:
    """To how many tasks ``spread`` deals ``df``; the rows of a table are counted from what its files say of themselves."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // ROWS))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, path, dir, language, tokens, content`` of every file."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type"), "p_partkey")
    rows = p.select("p_partkey", "p_brand", "p_size", "p_type", _stem().alias("stem"), _of(F.col("p_type"), {k: v[0] for k, v in LANGUAGES.items()}).alias("language"), _of(F.col("p_type"), {k: v[1] for k, v in LANGUAGES.items()}).alias("ext"))
    # a table of short rows looks small enough to be broadcast when its rows aren't
    before = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("p_partkey"), _stem().alias("tested")).hint("merge")
    rows = rows.join(before, "p_partkey", "left")
    is_test = (F.col("p_size") > 45) & F.col("tested").isNotNull()
    folder = F.when(is_test, "tests").otherwise(F.concat(F.lit("src/b"), F.substring("p_brand", 7, 10)))
    path = F.concat(folder, F.lit("/"), F.when(is_test, F.concat(F.lit("test_"), F.col("tested"))).otherwise(F.col("stem")), F.lit("."), F.col("ext"))
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_size") % len(HEADS) + 1).cast("int"))
    content = F.concat(head, F.lit("\n"), F.col("stem"), F.lit("\n"), F.repeat(F.lit("one two(three)\n"), F.col("p_size")))
    return rows.select(F.col("p_partkey").alias("key"), path.alias("path"), folder.alias("dir"), "language", (F.col("p_size") * 4 + 10).cast("long").alias("tokens"), content.alias("content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, name, kind, visibility, start_line``; a row for each supplier of a part."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_partkey")
    rows = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    noun = F.element_at(F.array(*[F.lit(v) for v in NOUNS]), ((F.col("l_suppkey") + F.col("l_partkey")) % 8 + 1).cast("int"))
    number = F.when(F.col("line") > 2, F.concat(F.lit("_n"), F.col("l_partkey").cast("string"))).otherwise("")
    name = F.when(F.col("flag") == "A", F.concat(F.when(F.col("line") == 2, "_").otherwise(""), verb, F.lit("_"), noun, number)).when(F.col("flag") == "R", F.concat(F.initcap(verb), F.initcap(noun))).otherwise(F.upper(F.concat(verb, F.lit("_"), noun)))
    kind = F.when(F.col("flag") == "A", "function").when(F.col("flag") == "R", "struct").otherwise("constant")
    made = rows.select(F.col("l_partkey").alias("key"), name.alias("name"), kind.alias("kind"), F.when(F.col("status") == "O", "public").otherwise("private").alias("visibility"), F.col("l_suppkey").alias("start_line"))
    return made.join(files(spark, sf_dir).select("key", "path"), "key").select("path", "name", "kind", "visibility", "start_line")


def imports(spark: SparkSession, sf_dir: str, inside: bool = False) -> DataFrame:
    """``src, dst``: files on consecutive lines of an order; ``inside``: those of one folder only."""
    return _consecutive(spark, sf_dir, table(spark, sf_dir, "lineitem"), inside)


def short_imports(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """The imports that stem from orders of at most ``most`` lines: with three there is less than one a file, so there are long
    chains, and some cycles."""
    lines = table(spark, sf_dir, "lineitem")
    short = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return _consecutive(spark, sf_dir, lines.join(short, "l_orderkey", "left_semi"))


def _pairs(lines: DataFrame) -> DataFrame:
    """``a, b``: parts on consecutive lines of an order. Lines are shuffled once, by order, and pairs once, by ``a``, which the joins go by."""
    line = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a")).where("l_orderkey is not null and l_linenumber is not null and a is not null")
    after = F.collect_set("a").over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    return line.select("a", after.alias("after")).select("a", F.explode("after").alias("b")).where("a <> b").repartition("a").distinct()


def keyed_imports(spark: SparkSession, sf_dir: str, named: DataFrame | None = None) -> DataFrame | None:
    """The imports by the files' keys, which are shorter than paths: ``src, dst``, null for a file without a path. None where a key
    stands for several files. ``named``: the files, where the caller has them written."""
    if table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return None
    own = lambda key, end: (files(spark, sf_dir) if named is None else named).select(F.col("key").alias(key), F.when(F.col("path").isNotNull(), F.col("key")).alias(end))
    return _pairs(table(spark, sf_dir, "lineitem")).join(own("a", "src"), "a").join(own("b", "dst"), "b").select("src", "dst")


def _consecutive(spark: SparkSession, sf_dir: str, lines: DataFrame, inside: bool = False) -> DataFrame:
    pairs = _pairs(lines)
    f = files(spark, sf_dir).select("key", "path", "dir")
    ends = pairs.join(f.select(F.col("key").alias("a"), F.col("path").alias("src"), F.col("dir").alias("sd")), "a").join(f.select(F.col("key").alias("b"), F.col("path").alias("dst"), F.col("dir").alias("dd")), "b")
    return (ends.where("sd = dd") if inside else ends).select("src", "dst")


def test_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, test``: each test file with the file before it."""
    f = files(spark, sf_dir).select("key", "path", "dir")
    tests = f.where("dir = 'tests'").select((F.col("key") - 1).alias("key"), F.col("path").alias("test"))
    return tests.join(f.select("key", F.col("path").alias("source")), "key").select("source", "test")


def _case(column: str, pairs: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_VERB, _NOUN = f"{_quoted(VERBS)}[l_suppkey % 8 + 1]", f"{_quoted(NOUNS)}[(l_suppkey + l_partkey) % 8 + 1]"
_CAP = "upper(left({0}, 1)) || substr({0}, 2)"
SQL = {
    "cf": f"""cp AS (SELECT p_partkey, p_brand, p_size, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, {_case("p_type", {k: v[0] for k, v in LANGUAGES.items()})} AS language, {_case("p_type", {k: v[1] for k, v in LANGUAGES.items()})} AS ext FROM part),
    ct AS (SELECT cp.*, b.stem AS tested, cp.p_size > 45 AND b.stem IS NOT NULL AS is_test FROM cp LEFT JOIN cp b ON cp.p_partkey = b.p_partkey + 1),
    fl AS (SELECT p_partkey AS key, (CASE WHEN is_test THEN 'tests' ELSE 'src/b' || substr(p_brand, 7) END) || '/' || (CASE WHEN is_test THEN 'test_' || tested ELSE stem END) || '.' || ext AS path, CASE WHEN is_test THEN 'tests' ELSE 'src/b' || substr(p_brand, 7) END AS dir, language, CAST(p_size * 4 + 10 AS BIGINT) AS tokens,
        {_quoted(HEADS)}[p_size % {len(HEADS)} + 1] || chr(10) || stem || chr(10) || repeat('one two(three)' || chr(10), p_size) AS content FROM ct)""",
    "sy": f"""sr AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS line, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
    sn AS (SELECT *, {_VERB} AS verb, {_NOUN} AS noun FROM sr),
    sy AS (SELECT path, CASE flag WHEN 'A' THEN (CASE WHEN line = 2 THEN '_' ELSE '' END) || verb || '_' || noun || (CASE WHEN line > 2 THEN '_n' || l_partkey ELSE '' END) WHEN 'R' THEN {_CAP.format("verb")} || {_CAP.format("noun")} ELSE upper(verb || '_' || noun) END AS name,
        CASE flag WHEN 'A' THEN 'function' WHEN 'R' THEN 'struct' ELSE 'constant' END AS kind, CASE status WHEN 'O' THEN 'public' ELSE 'private' END AS visibility, l_suppkey AS start_line FROM sn JOIN fl ON l_partkey = key)""",
    "im": """il AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
    im AS (SELECT x.path AS src, y.path AS dst FROM (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM il a JOIN il b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey) JOIN fl x ON a = x.key JOIN fl y ON b = y.key)""",
    "sh": """sl AS (SELECT * FROM il WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 3)),
    sh AS (SELECT x.path AS src, y.path AS dst FROM (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM sl a JOIN sl b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey) JOIN fl x ON a = x.key JOIN fl y ON b = y.key)""",
    "tm": "tm AS (SELECT s.path AS source, t.path AS test FROM fl t JOIN fl s ON s.key = t.key - 1 WHERE t.dir = 'tests')",
}
CODE = f"{SQL['cf']}, {SQL['sy']}, {SQL['im']}, {SQL['tm']}"
