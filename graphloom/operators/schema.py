"""The schema layer: views, functions, object-relational models, infrastructure, migrations,
column references, and the edges that they give. All extraction is by patterns in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import code

# ---------------------------------------------------------------- fixed values

DB_RESOURCES = ["aws_dynamodb_table", "aws_rds_", "aws_aurora_", "aws_elasticache_", "aws_elasticsearch_", "aws_opensearch_", "google_sql_", "google_bigquery_", "google_bigtable_", "google_datastore_", "google_firestore_", "azurerm_cosmosdb_", "azurerm_mssql_", "azurerm_postgresql_", "azurerm_mysql_", "azurerm_redis_", "mongodbatlas_cluster"]
MEMBER_DECORATORS = ["@Column", "@PrimaryColumn", "@PrimaryGeneratedColumn", "@ManyToOne", "@OneToMany", "@ManyToMany", "@OneToOne"]
NOT_COLUMNS = "select from where and or not null is in as on join inner left right outer full cross natural using group by order having limit offset union all distinct case when then else end true false like between asc desc count sum avg min max coalesce values set into insert update delete create table".split()
#: Kind, folder pattern, file pattern (sequence, name) of migrations, in order of priority.
MIGRATIONS = [
    ("rails", r"db/migrate$|db/migrate/", r"^(\d{14})_(.+)\.rb$"),
    ("alembic", r"alembic/versions", r"^([a-f0-9]+)_(.+)\.py$"),
    ("flyway", r"", r"^V(\d+(?:\.\d+)?)__(.+)\.sql$"),
    ("django", r"migrations$", r"^(\d{4})_(.+)\.py$"),
    ("knex", r"migrations$", r"^(\d{14})_(.+)\.(?:js|ts)$"),
    ("drizzle", r"drizzle$|/drizzle/", r"^(\d{4})_(.+)\.sql$"),
    ("generic", r"", r"^(\d+)_(.+)\.sql$"),
]
GENERIC_LEAST = 3


# ---------------------------------------------------------------- names


def camel_to_snake(name: Column) -> Column:
    """An underscore before a capital that follows a small letter."""
    return F.lower(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", "_"))


def plural(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike(r"(s|sh|ch|x|z)$"), F.concat(n, F.lit("es"))).when(n.rlike(r"[^aeou]y$|^y$"), F.concat(F.regexp_replace(n, "y$", ""), F.lit("ies"))).otherwise(F.concat(n, F.lit("s")))


def _all(c: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


# ---------------------------------------------------------------- views and functions


def view_sources(files: DataFrame) -> DataFrame:
    """``path, kind, name, tab``: the tables behind FROM and JOIN of a view, and also behind
    INTO and UPDATE of a function, without their schema's name."""
    sql = files.where(code.language(F.col("path")) == "sql")
    body = r"(?is)\bcreate\s+(?:or\s+replace\s+)?{}\s+(?:if\s+not\s+exists\s+)?([\w.]+)(.*?)(?:;\s*(?=create\b)|\z)"
    out = None
    for kind, words, verbs in (("view", r"(?:materialized\s+)?view", "from|join"), ("function", "(?:function|procedure)", "from|join|into|update")):
        zipped = F.arrays_zip(_all("content", body.format(words), 1).alias("name"), _all("content", body.format(words), 2).alias("body"))
        rows = sql.select("path", F.inline(zipped)).select("path", F.lit(kind).alias("kind"), "name", F.explode(F.array_distinct(F.transform(_all("body", rf"(?i)\b(?:{verbs})\s+([a-z_][\w.]*)"), lambda t: F.element_at(F.split(t, r"\."), -1)))).alias("tab"))
        out = rows if out is None else out.unionByName(rows)
    return out


def view_edges(sources: DataFrame, columns: DataFrame) -> DataFrame:
    tables = columns.select("tab", F.col("path").alias("dst")).distinct()
    kind = F.when(F.col("kind") == "view", "view_reference").otherwise("function_reference")
    return sources.join(tables, "tab").where("path <> dst").select(F.col("path").alias("src"), "dst", kind.alias("edge_type")).distinct()


# ---------------------------------------------------------------- models


def orm_models(files: DataFrame) -> DataFrame:
    """``path, class, framework, tab, body`` of model classes: the first framework that claims
    a class. ``files``: path, content."""
    text = files.select("path", "content", code.language(F.col("path")).alias("language"))
    py = r"(?m)^class\s+(\w+)\s*\(([^)]*)\)\s*:((?:\n(?:[ \t]+.*)?)*)"
    found = text.where("language = 'python'").select("path", "content", F.inline(F.arrays_zip(_all("content", py, 1).alias("class"), _all("content", py, 2).alias("base"), _all("content", py, 3).alias("body"))))
    own = lambda pattern: F.nullif(F.regexp_extract("body", pattern, 1), F.lit(""))
    django = found.where("base like '%models.Model%'").select("path", "class", F.lit("django").alias("framework"), F.coalesce(own(r"db_table\s*=\s*[\"']([^\"']+)[\"']"), camel_to_snake(F.col("class"))).alias("tab"), "body")
    alchemy = found.where("base in ('Base', 'DeclarativeBase') and base not like '%models.Model%'").where(F.lower("content").rlike(r"(?m)^\s*(from|import)\s+\S*sqlalchemy"))
    alchemy = alchemy.select("path", "class", F.lit("sqlalchemy").alias("framework"), F.coalesce(own(r"__tablename__\s*=\s*[\"']([^\"']+)[\"']"), F.lower("class")).alias("tab"), "body")
    ts = r"(?s)class\s+(\w+)[^{]*\{(.*?)\n\}"
    typed = text.where("language in ('typescript', 'javascript')").select("path", "content", F.inline(F.arrays_zip(_all("content", ts, 1).alias("class"), _all("content", ts, 2).alias("body"))))
    typed = typed.where(F.col("body").rlike("|".join(MEMBER_DECORATORS)))
    typeorm = typed.select("path", "class", F.lit("typeorm").alias("framework"), F.coalesce(F.nullif(F.regexp_extract("content", r"@Entity\([\"']([^\"']+)[\"']\)", 1), F.lit("")), F.lower("class")).alias("tab"), "body")
    rb = r"(?m)^class\s+(\w+)\s*<\s*(?:ActiveRecord::Base|ApplicationRecord)"
    rails = text.where("language = 'ruby'").select("path", F.explode(_all("content", rb)).alias("class")).select("path", "class", F.lit("active_record").alias("framework"), plural(F.col("class")).alias("tab"), F.lit("").alias("body"))
    return django.unionByName(alchemy).unionByName(typeorm).unionByName(rails)


def orm_fields(models: DataFrame) -> DataFrame:
    """``path, class, field, type, is_relation`` of the models that declare their fields."""
    django = r"(\w+)\s*=\s*models\.(\w+)\("
    alchemy = r"(\w+)\s*=\s*Column\(\s*([\w.]+)"
    typeorm = r"@(\w+)\([^)]*\)\s+(\w+)\s*:"
    made = {"django": (django, 1, 2), "sqlalchemy": (alchemy, 1, 2), "typeorm": (typeorm, 2, 1)}
    out = None
    for framework, (pattern, name, kind) in made.items():
        rows = models.where(F.col("framework") == framework).select("path", "class", "body", F.inline(F.arrays_zip(_all("body", pattern, name).alias("field"), _all("body", pattern, kind).alias("type"))))
        out = rows if out is None else out.unionByName(rows)
    related = F.col("type").isin("ForeignKey", "ManyToManyField", "OneToOneField", "ManyToOne", "OneToMany", "ManyToMany", "OneToOne") | F.col("body").rlike("(?s)x^")
    fk = F.regexp_like("body", F.concat(F.lit(r"\b"), F.col("field"), F.lit(r"\s*=\s*Column\([^\n]*ForeignKey\(")))
    return out.select("path", "class", "field", "type", (related | fk).alias("is_relation"))


def orm_edges(models: DataFrame, columns: DataFrame) -> DataFrame:
    """Models to the files that define their tables."""
    tables = columns.select("tab", F.col("path").alias("dst")).distinct()
    return models.join(tables, "tab").where("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("orm_model").alias("edge_type")).distinct()


def column_node(tab: Column, col: Column) -> Column:
    return F.concat(F.lit("col:"), F.lower(tab), F.lit("."), F.lower(col))


def column_edges(models: DataFrame, fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Column nodes to the files that define them, and models to the columns of their fields."""
    anchors = columns.select(column_node(F.col("tab"), F.col("col")).alias("src"), F.col("path").alias("dst"))
    known = columns.select(F.col("tab"), F.lower("col").alias("k"))
    uses = fields.join(models.select("path", "class", "tab"), ["path", "class"]).withColumn("k", F.lower("field")).join(known, ["tab", "k"])
    refs = uses.select(F.col("path").alias("src"), column_node(F.col("tab"), F.col("k")).alias("dst"))
    return anchors.unionByName(refs).withColumn("edge_type", F.lit("column_reference")).distinct()


# ---------------------------------------------------------------- infrastructure and migrations


def terraform_tables(files: DataFrame) -> DataFrame:
    """``path, tab`` of database resources."""
    res = F.explode(F.arrays_zip(_all("content", r"(?m)^resource\s+\"(\w+)\"\s+\"(\w+)\"", 1).alias("kind"), _all("content", r"(?m)^resource\s+\"(\w+)\"\s+\"(\w+)\"", 2).alias("own")))
    rows = files.where(F.col("path").endswith(".tf") | F.col("path").endswith(".hcl")).select("path", res.alias("r"))
    return rows.where(F.col("r.kind").rlike("^(" + "|".join(DB_RESOURCES) + ")")).select("path", F.concat_ws(".", "r.kind", "r.own").alias("tab"))


def migrations(files: DataFrame) -> DataFrame:
    """``directory, framework, path, sequence, name, seq``: of each folder the files of the
    first framework that knows any, in order; plain numbered files need at least three."""
    name, folder = F.element_at(F.split("path", "/"), -1), _folder(F.col("path"))
    out = None
    for priority, (framework, where, pattern) in enumerate(MIGRATIONS):
        rows = files.where(folder.rlike(where) & name.rlike(pattern)).select(folder.alias("directory"), F.lit(framework).alias("framework"), F.lit(priority).alias("priority"), "path", F.regexp_extract(name, pattern, 1).alias("sequence"), F.regexp_extract(name, pattern, 2).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    prisma = r"^(.+/prisma/migrations)/(\d{14})_(.+)/migration\.sql$"
    rows = files.where(F.col("path").rlike(prisma)).select(F.regexp_extract("path", prisma, 1).alias("directory"), F.lit("prisma").alias("framework"), F.lit(4.5).alias("priority"), "path", F.regexp_extract("path", prisma, 2).alias("sequence"), F.regexp_extract("path", prisma, 3).alias("name"))
    out = out.unionByName(rows)
    of = W.partitionBy("directory", "framework")
    out = out.withColumn("n", F.count("*").over(of)).where((F.col("framework") != "generic") | (F.col("n") >= GENERIC_LEAST))
    first = out.withColumn("best", F.min("priority").over(W.partitionBy("directory"))).where("priority = best")
    number = F.when(F.col("framework").isin("flyway", "generic"), F.col("sequence").cast("double"))
    return first.withColumn("seq", F.row_number().over(of.orderBy(number, "sequence", "path"))).select("directory", "framework", "path", "sequence", "name", "seq")


def migration_edges(chains: DataFrame) -> DataFrame:
    """Each migration to the one before it."""
    before = F.lag("path").over(W.partitionBy("directory", "framework").orderBy("seq"))
    return chains.select(F.col("path").alias("src"), before.alias("dst"), F.lit("migration_sequence").alias("edge_type")).where("dst is not null")


# ---------------------------------------------------------------- columns in embedded SQL


def column_refs(files: DataFrame, columns: DataFrame) -> DataFrame:
    """``path, tab, col, inferred``: columns that code names in SQL: all of a known table
    behind ``SELECT *`` (inferred), qualified ones, and bare ones that just one of the known
    tables of the text owns."""
    text = files.where(code.language(F.col("path")) != "sql")
    used = text.select("path", F.explode(F.array_distinct(F.transform(_all("content", r"(?i)\b(?:from|join|into|update)\s+([a-z_]\w*)"), F.lower))).alias("tab")).join(columns.select(F.lower("tab").alias("tab")).distinct(), "tab")
    owned = used.join(columns.select(F.lower("tab").alias("tab"), F.lower("col").alias("col")).distinct(), "tab")
    lists = F.flatten(F.transform(_all("content", r"(?is)\bselect\s+(.+?)\s+from\b"), lambda x: F.split(x, ",")))
    inserts = F.flatten(F.transform(_all("content", r"(?is)\binsert\s+into\s+[a-z_]\w*\s*\(([^)]*)\)"), lambda x: F.split(x, ",")))
    tests = _all("content", r"(?i)([a-z_]\w*(?:\.[a-z_]\w*)?)\s*(?:=|<>|!=|<=|>=|<|>|\blike\b|\bin\b|\bis\b)")
    parts = text.select("path", F.explode(F.concat(lists, inserts, tests)).alias("raw")).select("path", F.lower(F.get(F.split(F.trim("raw"), r"\s+"), F.lit(0))).alias("c")).distinct()
    star = parts.where(F.col("c").rlike(r"^(\*|.*\.\*)$")).select("path").distinct().join(owned, "path").select("path", "tab", "col", F.lit(True).alias("inferred"))
    names = parts.where(F.col("c").rlike(r"^\(*[\w.]+\)*$")).select("path", F.regexp_replace("c", r"[()]", "").alias("c")).where(~F.col("c").isin(NOT_COLUMNS))
    named = names.withColumn("q", F.when(F.col("c").contains("."), F.substring_index("c", ".", 1))).withColumn("col", F.substring_index("c", ".", -1)).join(owned, ["path", "col"])
    owners = F.count("*").over(W.partitionBy("path", "c"))
    right = F.max((F.col("q") == F.col("tab")).cast("int")).over(W.partitionBy("path", "c"))
    first = F.row_number().over(W.partitionBy("path", "c").orderBy("tab"))
    named = named.withColumns({"owners": owners, "right": right, "i": first})
    bare = F.col("q").isNull() & (F.col("owners") == 1)
    qualified = F.col("q").isNotNull() & F.when(F.col("right") == 1, F.col("q") == F.col("tab")).otherwise(F.col("i") == 1)
    return star.unionByName(named.where(bare | qualified).select("path", "tab", "col", F.lit(False).alias("inferred"))).groupBy("path", "tab", "col").agg(F.min("inferred").alias("inferred"))


# ---------------------------------------------------------------- other schema languages


def prisma_models(files: DataFrame) -> DataFrame:
    """``path, model, tab, field, type`` of Prisma models."""
    body = r"(?ms)^model\s+(\w+)\s*\{(.*?)^\}"
    m = files.where(F.col("path").endswith(".prisma")).select("path", F.inline(F.arrays_zip(_all("content", body, 1).alias("model"), _all("content", body, 2).alias("body"))))
    tab = F.coalesce(F.nullif(F.regexp_extract("body", r"@@map\([\"']([^\"']+)[\"']\)", 1), F.lit("")), F.lower("model"))
    line = r"(?m)^\s+(\w+)\s+(\w+[\[\]?]*)"
    return m.select("path", "model", tab.alias("tab"), F.inline(F.arrays_zip(_all("body", line, 1).alias("field"), _all("body", line, 2).alias("type"))))


def cypher_entries(files: DataFrame) -> DataFrame:
    """``path, kind, label``: labels of constraints, indexes and created nodes."""
    patterns = {"constraint": r"(?i)create\s+constraint\b[^;]*?\bfor\s*\(\s*\w*\s*:\s*(\w+)", "index": r"(?i)create\s+index\b[^;]*?\bfor\s*\(\s*\w*\s*:\s*(\w+)", "node": r"(?i)\b(?:create|merge)\s*\(\s*\w*\s*:\s*(\w+)"}
    rows = files.where(F.col("path").rlike(r"\.(cypher|cql)$"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _all("content", p).alias("labels")) for k, p in patterns.items()])
    return rows.select("path", F.explode(kinds).alias("k")).select("path", "k.kind", F.explode("k.labels").alias("label")).distinct()


def index_mapping(files: DataFrame) -> DataFrame:
    """``path, field, type`` of search index mappings: nested properties joined by dots."""

    def run(batches):
        import json

        import pandas as pd

        def walk(node, prefix=""):
            for name, f in (node.get("properties") or {}).items():
                if isinstance(f, dict):
                    if "type" in f:
                        yield prefix + name, str(f["type"])
                    yield from walk(f, prefix + name + ".")

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                try:
                    top = json.loads(text or "")
                except ValueError:
                    continue
                if isinstance(top, dict) and isinstance(top.get("mappings"), dict):
                    rows += [(path, *x) for x in walk(top["mappings"])]
            yield pd.DataFrame(rows, columns=["path", "field", "type"])

    return files.where(F.col("path").endswith(".json") & F.col("content").contains('"mappings"')).select("path", "content").mapInPandas(run, "path string, field string, type string")
