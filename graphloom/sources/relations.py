"""Adapters: the engine's relations as views over the tables.

Parts play the files, orders the commits and line items the files that a commit touches;
documents play the texts of a code base, and nations and regions its modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import codebase
from graphloom.sources.codebase import spread
from graphloom.sources.tables import table


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("message"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey"), "sha")
    return lines.select("sha", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("dir"), F.col("p_size").cast("long").alias("size"), (F.col("p_size") % 2 == 0).alias("tested"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file that a commit touches, with its age in days."""
    log = commits(spark, sf_dir)
    now = F.broadcast(log.agg(F.max("day").alias("now")))  # a row of one
    return commit_files(spark, sf_dir).join(log.crossJoin(now), "sha").select("sha", "path", "day", "message", F.datediff("now", "day").cast("long").alias("age"))


def _nations_of(rows: DataFrame, key: str, owners: DataFrame, other: str) -> DataFrame:
    """``rows`` with what ``owners`` says of their ``key``. Owners are sent to all tasks where they are at most ``ROWS`` short rows; else both
    sides are dealt out by number, so what a task sorts stays, whatever number of partitions the session names."""
    few = owners.count() <= codebase.ROWS
    dealt, sent = (rows, F.broadcast(owners)) if few else (spread(rows, key), owners.hint("merge"))
    return dealt.join(sent, F.col(key) == F.col(other)).drop(key, other)


def _nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    orders = _nations_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    lines = _nations_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    dealt = lines.repartition(codebase.parts(table(spark, sf_dir, "lineitem")), "l_orderkey")
    buys = dealt.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n")).where("c_nationkey < s_nationkey")
    a = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src"), F.col("n_regionkey").alias("ra"))
    b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("rb"))
    return buys.join(a, "c_nationkey").join(b, "s_nationkey").select("src", "dst", F.when(F.col("ra") == F.col("rb"), "import").otherwise("cross_language:HttpCall").alias("edge_type"), "n")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between nations: customers buying from suppliers of a later nation."""
    return _nation_pairs(spark, sf_dir)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"), "doc_id", "source")


#: The same relations for DuckDB, to put behind WITH.
SQL = {
    "log": "log AS (SELECT o_orderkey AS sha, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS message FROM orders)",
    "cf": "cf AS (SELECT DISTINCT l_orderkey AS sha, 'p' || CAST(l_partkey AS VARCHAR) AS path FROM lineitem)",
    "files": "files AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_brand AS dir, CAST(p_size AS BIGINT) AS size, p_size % 2 = 0 AS tested FROM part)",
    "hist": "hist AS (SELECT cf.sha, path, day, message, date_diff('day', day, (SELECT max(day) FROM log)) AS age FROM cf JOIN log USING (sha))",
    "edges": """edges AS (SELECT a.n_name AS src, b.n_name AS dst, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'import' ELSE 'cross_language:HttpCall' END AS edge_type, n
        FROM (SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
              GROUP BY 1, 2 HAVING c_nationkey < s_nationkey) e
        JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey)""",
    "docs": "docs AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang AS language, n_chars AS size_bytes, text AS content, doc_id, source FROM documents)",
}
HISTORY = f"{SQL['log']}, {SQL['cf']}, {SQL['hist']}"
