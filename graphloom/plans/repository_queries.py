"""Queries of the schema, surface and scan layers over a small repository, whose files and
expected rows are written out here, and over the tables where they can play the part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code, scan, schema, surface
from graphloom.plans.code_queries import expected_rows as rows
from graphloom.plans.queries import query, written_out
from graphloom.sources import codebase as cb
from graphloom.sources import relations as rel
from graphloom.sources.tables import table

REPOSITORY = [
    ("schema/users.sql", "CREATE TABLE users (\n  id INT PRIMARY KEY,\n  name VARCHAR(20) NOT NULL,\n  team_id INT REFERENCES teams(id)\n);\n"),
    ("schema/teams.sql", "CREATE TABLE teams (id INT, title TEXT, PRIMARY KEY (id));\n"),
    ("schema/views.sql", "CREATE VIEW active AS SELECT u.id FROM users u JOIN public.teams t ON t.id = u.team_id;\nCREATE FUNCTION touch() RETURNS void AS $$ UPDATE users SET name = 'x' $$;\n"),
    ("app/models.py", "from django.db import models\n\nclass UserProfile(models.Model):\n    name = models.CharField(max_length=20)\n    team = models.ForeignKey('Team', on_delete=None)\n\n    class Meta:\n        db_table = 'users'\n\nclass AuditLog(models.Model):\n    at = models.DateField()\n"),
    ("app/alchemy.py", "from sqlalchemy import Column, Integer, ForeignKey\n\nclass Team(Base):\n    __tablename__ = 'teams'\n    id = Column(Integer, primary_key=True)\n    title = Column(String)\n    boss = Column(Integer, ForeignKey('users.id'))\n"),
    ("web/entity.ts", "@Entity('users')\nexport class Person {\n  @PrimaryGeneratedColumn() id: number\n  @Column() name: string\n  @ManyToOne(() => Team) team: Team\n}\n"),
    ("app/company.rb", "class Company < ApplicationRecord\nend\n\nclass Box < ActiveRecord::Base\nend\n"),
    ("infra/db.tf", 'resource "aws_rds_cluster" "main" {\n}\nresource "aws_s3_bucket" "logs" {\n}\nresource "google_sql_database" "db" {\n}\n'),
    ("db/migrate/20240102000000_add_team.rb", "x"),
    ("db/migrate/20240101000000_init.rb", "x"),
    ("flyway/V1__a.sql", "x"),
    ("flyway/V10__c.sql", "x"),
    ("flyway/V2__b.sql", "x"),
    ("app/migrations/0001_initial.py", "x"),
    ("app/migrations/0002_more.py", "x"),
    ("sql/1_a.sql", "x"),
    ("sql/10_c.sql", "x"),
    ("sql/2_b.sql", "x"),
    ("few/1_a.sql", "x"),
    ("prisma/schema.prisma", 'model Account {\n  id Int @id\n  tags String[]\n  @@map("accounts")\n}\n\nmodel Tag {\n  name String\n}\n'),
    ("lib/prisma/migrations/20240101000000_init/migration.sql", "x"),
    ("lib/prisma/migrations/20240201000000_more/migration.sql", "x"),
    ("graph/schema.cypher", "CREATE CONSTRAINT c IF NOT EXISTS FOR (u:User) REQUIRE u.id IS UNIQUE;\nCREATE INDEX i FOR (t:Team) ON (t.title);\nMERGE (x:Thing {id: 1});\n"),
    ("search/mapping.json", '{"mappings": {"properties": {"title": {"type": "text"}, "by": {"properties": {"name": {"type": "keyword"}}}}}}'),
    ("api/user.proto", "service Users {\n  rpc GetUser (Id) returns (User);\n  rpc ListUsers (Page) returns (Users);\n}\nservice Teams {\n  rpc GetTeam (Id) returns (Team);\n}\n"),
    ("cmd/client.go", 'package main\nfunc run() {\n  userClient.GetUser(ctx)\n  teamClient.GetTeam(ctx)\n  exec.Command("bin/report.sh")\n}\n'),
    ("api/schema.graphql", "type User {\n  id: ID\n}\nquery Everyone {\n  users\n}\n"),
    ("web/query.ts", "const q = gql`query Everyone { id }`\n"),
    ("src/native.rs", 'extern "C" {\n    fn add_nums(a: i32, b: i32) -> i32;\n    fn missing(a: i32);\n}\n'),
    ("native/add.c", "int add_nums(int a, int b) {\n  return a + b;\n}\n"),
    ("scripts/report.sh", "echo\n"),
    ("api/server.py", "from flask import Flask\n\n@app.route('/users/<id>')\ndef show(id):\n    return login_required(id)\n"),
    ("api/server.js", "const e = require('express')\napp.get('/teams/:id', showTeam)\nrouter.post('/teams', addTeam)\n"),
    ("src/http.rs", 'use axum::Router;\nfn r() { Router::new().route("/health", get(health)).route("/jobs", post(jobs)) }\n'),
    ("config/routes.rb", "Rails.application.routes.draw do\n  get '/posts', to: 'posts#index'\nend\n"),
    ("docs/api.md", "app.get('/not/a/route', x) require('express')\n"),
    ("app/raw.py", 'q = f"SELECT * FROM users WHERE id = {x}"\nok = "SELECT 1"\ncur.execute("SELECT name FROM users WHERE id = %s" % x)\n'),
    ("web/raw.ts", "const q = `DELETE FROM teams WHERE id = ${id}`\n"),
    ("src/input.rs", "pub fn save(name: String) {\n    store(name);\n}\n\n\n\npub fn put(name: &str) {\n    validate(name);\n}\n"),
    ("app/report.py", "a = 'select title, name from teams join users on teams.id = users.team_id'\n"),
    ("app/all.py", "b = 'select * from teams'\n"),
]


def repository(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPOSITORY, "path string, content string")




def _columns(spark):
    return code.db_columns(repository(spark))


# ---------------------------------------------------------------- schema


@written_out(rows("path, tab, col, in_key, fk_table", ("schema/users.sql", "users", "id", True, None), ("schema/users.sql", "users", "name", False, None), ("schema/users.sql", "users", "team_id", False, "teams"), ("schema/teams.sql", "teams", "id", True, None), ("schema/teams.sql", "teams", "title", False, None)))
def table_columns(spark, d):
    return _columns(spark).select("path", "tab", "col", "in_key", "fk_table")


@written_out(rows("path, kind, name, tab", ("schema/views.sql", "view", "active", "users"), ("schema/views.sql", "view", "active", "teams"), ("schema/views.sql", "function", "touch", "users")))
def view_sources(spark, d):
    return schema.view_sources(repository(spark))


@written_out(rows("src, dst, edge_type", ("schema/views.sql", "schema/users.sql", "view_reference"), ("schema/views.sql", "schema/teams.sql", "view_reference"), ("schema/views.sql", "schema/users.sql", "function_reference")))
def view_edges(spark, d):
    return schema.view_edges(schema.view_sources(repository(spark)), _columns(spark))


_MODELS = [("app/models.py", "UserProfile", "django", "users"), ("app/models.py", "AuditLog", "django", "audit_log"), ("app/alchemy.py", "Team", "sqlalchemy", "teams"), ("web/entity.ts", "Person", "typeorm", "users"), ("app/company.rb", "Company", "active_record", "companies"), ("app/company.rb", "Box", "active_record", "boxes")]


@written_out(rows("path, class, framework, tab", *_MODELS))
def orm_models(spark, d):
    return schema.orm_models(repository(spark)).drop("body")


_FIELDS = [("app/models.py", "UserProfile", "name", "CharField", False), ("app/models.py", "UserProfile", "team", "ForeignKey", True), ("app/models.py", "AuditLog", "at", "DateField", False), ("app/alchemy.py", "Team", "id", "Integer", False), ("app/alchemy.py", "Team", "title", "String", False), ("app/alchemy.py", "Team", "boss", "Integer", True), ("web/entity.ts", "Person", "id", "PrimaryGeneratedColumn", False), ("web/entity.ts", "Person", "name", "Column", False)]


@written_out(rows("path, class, field, type, is_relation", *_FIELDS))
def orm_fields(spark, d):
    return schema.orm_fields(schema.orm_models(repository(spark)))


@written_out(rows("src, dst, edge_type", ("app/models.py", "schema/users.sql", "orm_model"), ("app/alchemy.py", "schema/teams.sql", "orm_model"), ("web/entity.ts", "schema/users.sql", "orm_model")))
def orm_edges(spark, d):
    return schema.orm_edges(schema.orm_models(repository(spark)), _columns(spark))


_COLUMN_EDGES = [("col:users.id", "schema/users.sql"), ("col:users.name", "schema/users.sql"), ("col:users.team_id", "schema/users.sql"), ("col:teams.id", "schema/teams.sql"), ("col:teams.title", "schema/teams.sql"), ("app/models.py", "col:users.name"), ("app/alchemy.py", "col:teams.id"), ("app/alchemy.py", "col:teams.title"), ("web/entity.ts", "col:users.id"), ("web/entity.ts", "col:users.name")]


@written_out(rows("src, dst, edge_type", *[(*e, "column_reference") for e in _COLUMN_EDGES]))
def column_edges(spark, d):
    models = schema.orm_models(repository(spark))
    return schema.column_edges(models, schema.orm_fields(models), _columns(spark))


@written_out(rows("path, hops, category", ("app/models.py", 1, "medium"), ("web/entity.ts", 1, "medium")))
def column_blast_radius(spark, d):
    from graphloom.operators import graphs

    models = schema.orm_models(repository(spark))
    edges = schema.column_edges(models, schema.orm_fields(models), _columns(spark))
    return graphs.column_blast_radius(edges, "users", "name").select("path", "hops", "category")


@written_out(rows("path, tab", ("infra/db.tf", "aws_rds_cluster.main"), ("infra/db.tf", "google_sql_database.db")))
def terraform_tables(spark, d):
    return schema.terraform_tables(repository(spark))


_CHAINS = [
    ("db/migrate", "rails", "db/migrate/20240101000000_init.rb", "20240101000000", "init", 1),
    ("db/migrate", "rails", "db/migrate/20240102000000_add_team.rb", "20240102000000", "add_team", 2),
    ("flyway", "flyway", "flyway/V1__a.sql", "1", "a", 1),
    ("flyway", "flyway", "flyway/V2__b.sql", "2", "b", 2),
    ("flyway", "flyway", "flyway/V10__c.sql", "10", "c", 3),
    ("app/migrations", "django", "app/migrations/0001_initial.py", "0001", "initial", 1),
    ("app/migrations", "django", "app/migrations/0002_more.py", "0002", "more", 2),
    ("sql", "generic", "sql/1_a.sql", "1", "a", 1),
    ("sql", "generic", "sql/2_b.sql", "2", "b", 2),
    ("sql", "generic", "sql/10_c.sql", "10", "c", 3),
    ("lib/prisma/migrations", "prisma", "lib/prisma/migrations/20240101000000_init/migration.sql", "20240101000000", "init", 1),
    ("lib/prisma/migrations", "prisma", "lib/prisma/migrations/20240201000000_more/migration.sql", "20240201000000", "more", 2),
]


@written_out(rows("directory, framework, path, sequence, name, seq", *_CHAINS))
def migration_chains(spark, d):
    return schema.migrations(repository(spark))


@written_out(rows("src, dst, edge_type", *[(b[2], a[2], "migration_sequence") for a, b in zip(_CHAINS, _CHAINS[1:], strict=False) if a[0] == b[0]]))
def migration_edges(spark, d):
    return schema.migration_edges(schema.migrations(repository(spark)))


_REFS = [("app/report.py", "teams", "title", False), ("app/report.py", "users", "name", False), ("app/report.py", "teams", "id", False), ("app/all.py", "teams", "id", True), ("app/all.py", "teams", "title", True)]
_REFS += [("app/raw.py", "users", c, True) for c in ("team_id", "name")] + [("app/raw.py", "users", "id", False)] + [("web/raw.ts", "teams", "id", False)]


@written_out(rows("path, tab, col, inferred", *_REFS))
def embedded_column_refs(spark, d):
    return schema.column_refs(repository(spark), _columns(spark))


@written_out(rows("path, model, tab, field, type", ("prisma/schema.prisma", "Account", "accounts", "id", "Int"), ("prisma/schema.prisma", "Account", "accounts", "tags", "String[]"), ("prisma/schema.prisma", "Tag", "tag", "name", "String")))
def prisma_models(spark, d):
    return schema.prisma_models(repository(spark))


@written_out(rows("path, kind, label", ("graph/schema.cypher", "constraint", "User"), ("graph/schema.cypher", "index", "Team"), ("graph/schema.cypher", "node", "Thing")))
def cypher_schema(spark, d):
    return schema.cypher_entries(repository(spark))


@written_out(rows("path, field, type", ("search/mapping.json", "title", "text"), ("search/mapping.json", "by.name", "keyword")))
def search_mapping(spark, d):
    return schema.index_mapping(repository(spark))


# ---------------------------------------------------------------- surface

_ROUTES = [
    ("api/server.py", "flask", "GET", "/users/<id>", "show"),
    ("api/server.js", "express", "GET", "/teams/:id", "showTeam"),
    ("api/server.js", "express", "POST", "/teams", "addTeam"),
    ("src/http.rs", "axum", "GET", "/health", "health"),
    ("src/http.rs", "axum", "GET", "/jobs", "jobs"),
    ("config/routes.rb", "rails", "GET", "/posts", "posts#index"),
]


@written_out(rows("path, framework, method, route, handler", *_ROUTES))
def api_routes(spark, d):
    return surface.routes(repository(spark))


@written_out(rows("path, framework, method, route, handler", *_ROUTES[1:]))
def unprotected_endpoints(spark, d):
    files = repository(spark)
    return surface.unprotected(files, surface.routes(files))


@written_out(rows("path, language, kind, snippet", ("app/raw.py", "python", "f-string", "SELECT * FROM users WHERE id = {x}"), ("app/raw.py", "python", "percent-format", "SELECT name FROM users WHERE id = %s"), ("web/raw.ts", "typescript", "template-literal", "DELETE FROM teams WHERE id = ${id}")))
def sql_injection(spark, d):
    return surface.sql_injection(repository(spark))


@written_out("SELECT 'src/input.rs' AS path, 'save' AS function")
def validation_gaps(spark, d):
    rank = spark.createDataFrame([("src/input.rs", 0.6), ("src/http.rs", 0.1)], "node string, score double")
    return surface.validation_gaps(repository(spark), rank)


@written_out(rows("path, service, method", ("api/user.proto", "Users", "GetUser"), ("api/user.proto", "Users", "ListUsers"), ("api/user.proto", "Teams", "GetTeam")))
def grpc_services(spark, d):
    return surface.grpc_methods(repository(spark))


@written_out(rows("path, kind, name", ("api/schema.graphql", "type", "User"), ("api/schema.graphql", "query", "Everyone")))
def graphql_types(spark, d):
    return surface.graphql_types(repository(spark))


@written_out(
    rows(
        "src, dst, symbol, edge_type",
        ("cmd/client.go", "api/user.proto", "Users.GetUser", "cross_language:GrpcCall"),
        ("cmd/client.go", "api/user.proto", "Teams.GetTeam", "cross_language:GrpcCall"),
        ("web/query.ts", "api/schema.graphql", "Everyone", "cross_language:GraphqlCall"),
        ("src/native.rs", "native/add.c", "add_nums", "cross_language:FfiBinding"),
        ("cmd/client.go", "app/report.py", "report", "cross_language:CommandExec"),
    )
)
def language_bridges(spark, d):
    files = repository(spark)
    return surface.grpc_bridges(files).unionByName(surface.graphql_bridges(files)).unionByName(surface.ffi_bridges(files)).unionByName(surface.exec_bridges(files))


TOUCH = "tch AS (SELECT DISTINCT dir || ':' || (tokens % 40) AS target, language, path FROM fl), tfi AS (SELECT target, language, min(path) AS f FROM tch GROUP BY 1, 2)"


@query(f"WITH {cb.SQL['cf']}, {TOUCH} SELECT DISTINCT least(path, f) AS src, greatest(path, f) AS dst, 'cross_language:SharedSchema' AS edge_type FROM tch JOIN tfi ON tch.target = tfi.target AND tch.language <> tfi.language WHERE path <> f")
def shared_schema_bridges(spark, d):
    f = cb.files(spark, d)
    return surface.shared_schema_bridges(f.select("path", "language", F.concat_ws(":", "dir", (F.col("tokens") % 40).cast("string")).alias("target")))


# ---------------------------------------------------------------- scans, caches, diffs

CACHE = "fs AS (SELECT path, key AS mtime, tokens AS size_bytes, content FROM fl), ca AS (SELECT path, CASE WHEN size_bytes % 24 = 2 THEN mtime + 1 ELSE mtime END AS mtime, size_bytes FROM fs WHERE size_bytes > 50)"


def _files(spark, d):
    return cb.files(spark, d).select("path", F.col("key").alias("mtime"), F.col("tokens").alias("size_bytes"), "content")


def _cache(spark, d):
    return _files(spark, d).where("size_bytes > 50").select("path", F.when(F.col("size_bytes") % 24 == 2, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size_bytes")


@query(f"WITH {cb.SQL['cf']}, {CACHE} SELECT path, EXISTS (SELECT 1 FROM ca WHERE ca.path = fs.path AND ca.mtime = fs.mtime AND ca.size_bytes = fs.size_bytes) AS hit FROM fs")
def parse_cache_split(spark, d):
    hits, misses = scan.cache_split(_files(spark, d), _cache(spark, d))
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


@query(f"WITH {cb.SQL['cf']}, {CACHE} SELECT fs.path, CASE WHEN ca.path IS NOT NULL THEN 'known' ELSE sha256(CASE WHEN ends_with(fs.path, '.md') THEN regexp_replace(content, '^---\\n[\\s\\S]*?\\n---\\n', '') ELSE content END) END AS hash FROM fs LEFT JOIN ca USING (path, mtime, size_bytes)")
def stat_hashes(spark, d):
    known = _cache(spark, d).withColumn("hash", F.lit("known"))
    return scan.stat_hashes(_files(spark, d), known).select("path", "hash")


@query(f"WITH {cb.SQL['cf']}, h AS (SELECT path, sha256(CASE WHEN ends_with(path, '.md') THEN regexp_replace(content, '^---\\n[\\s\\S]*?\\n---\\n', '') ELSE content END) AS hash FROM fl), b AS (SELECT substr(sha256(path), 1, 2) AS b, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS h FROM h GROUP BY 1) SELECT sha256('head' || chr(10) || string_agg(b || ':' || h, chr(10) ORDER BY b)) AS fingerprint FROM b")
def content_fingerprint(spark, d):
    hashes = _files(spark, d).select("path", scan.content_hash(F.col("path"), F.col("content")).alias("hash"))
    return scan.fingerprint(hashes, "head")


@query("SELECT item_id, text AS body FROM benchmark")
def front_matter(spark, d):
    docs = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("---\ntitle: x\ntags: [a]\n---\n"), "text").alias("content"))
    return docs.select("item_id", scan.without_header(F.lit("a.md"), F.col("content")).alias("body"))


OLDNEW = "o AS (SELECT doc_id, path, content FROM docs WHERE doc_id % 5 <> 0), n AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN content || chr(10) || 'one more line' ELSE content END AS content FROM docs)"


@query(f"WITH {rel.SQL['docs']}, {OLDNEW}, j AS (SELECT n.path, o.path IS NULL AS is_new, string_split(n.content, chr(10)) AS b, string_split(coalesce(o.content, ''), chr(10)) AS a, o.path IS NULL OR o.content <> n.content AS changed FROM n LEFT JOIN o USING (path)) SELECT path, is_new, CASE WHEN is_new THEN len(b) ELSE len(list_filter(b, lambda x: NOT list_contains(a, x))) END AS added, CASE WHEN is_new THEN 0 ELSE len(list_filter(a, lambda x: NOT list_contains(b, x))) END AS removed FROM j WHERE changed")
def changed_lines(spark, d):
    docs = rel.documents(spark, d)
    new = docs.select("path", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\none more line"))).otherwise(F.col("content")).alias("content"))
    return scan.changed_lines(docs.where("doc_id % 5 <> 0").select("path", "content"), new).select("path", "is_new", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))


@query("WITH l AS (SELECT o_orderkey AS sha, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS age FROM orders) SELECT coalesce((SELECT sha FROM l WHERE age > 7 ORDER BY age, sha DESC LIMIT 1), (SELECT sha FROM l WHERE age <= 7 ORDER BY age DESC, sha LIMIT 1)) AS base")
def since_resolution(spark, d):
    log = rel.commits(spark, d)
    now = log.agg(F.max("day").alias("now"))
    return scan.since(log.crossJoin(F.broadcast(now)).select("sha", F.datediff("now", "day").alias("age")), 7)


@query("WITH h AS (SELECT max(l_orderkey) AS k FROM lineitem) SELECT 'p' || l_partkey AS path, CASE WHEN max(l_linestatus) = 'O' THEN 'changed' ELSE 'removed' END AS change FROM lineitem, h WHERE l_orderkey = k GROUP BY 1")
def head_changes(spark, d):
    lines = table(spark, d, "lineitem")
    head = lines.agg(F.max("l_orderkey").alias("l_orderkey"))
    return lines.join(F.broadcast(head), "l_orderkey").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")).agg(F.when(F.max("l_linestatus") == "O", "changed").otherwise("removed").alias("change"))


@query(f"WITH {cb.SQL['cf']} SELECT path FROM fl WHERE path = 'src/b2' OR starts_with(path, 'src/b2/')")
def workspace_scan(spark, d):
    return scan.workspace(cb.files(spark, d), "./src//b2/").select("path")


@query("SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1 ORDER BY commits DESC, author LIMIT 20")
def contributors(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(20)


@query(f"WITH {rel.SQL['docs']}, a AS (SELECT path FROM docs WHERE doc_id % 3 = 0), b AS (SELECT path FROM docs WHERE doc_id % 2 = 0) SELECT 'union' AS kind, count(*) AS n FROM (SELECT path FROM a UNION SELECT path FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT path FROM a INTERSECT SELECT path FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT path FROM a EXCEPT SELECT path FROM b)")
def set_operations(spark, d):
    docs = rel.documents(spark, d).select("path", "doc_id")
    a, b = docs.where("doc_id % 3 = 0").select("path"), docs.where("doc_id % 2 = 0").select("path")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.subtract(b)}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- sinks

_QN = "'''' || {0} || ''''"


@query(f"WITH {rel.SQL['edges']} SELECT DISTINCT 'MERGE (:File {{path: ''' || node || '''}});' AS line FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT DISTINCT 'MATCH (a:File {{path: ''' || src || '''}}), (b:File {{path: ''' || dst || '''}}) MERGE (a)-[:' || upper(regexp_replace(edge_type, '[^A-Za-z0-9]+', '_', 'g')) || ']->(b);' FROM edges")
def graph_cypher(spark, d):
    return scan.to_cypher(rel.trade_edges(spark, d))


@query(f"""WITH {rel.SQL['edges']} SELECT '<node id="' || node || '"/>' AS line FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT DISTINCT '<edge source="' || src || '" target="' || dst || '"><data key="type">' || edge_type || '</data></edge>' FROM edges""")
def graph_graphml(spark, d):
    return scan.to_graphml(rel.trade_edges(spark, d))


LINES = "ln AS (SELECT src || chr(9) || dst || chr(9) || edge_type AS line FROM edges)"


@query(f"WITH {rel.SQL['edges']}, {LINES} SELECT DISTINCT line FROM ln")
def canonical_merge(spark, d):
    lines = code.canonical(rel.trade_edges(spark, d))
    ours = lines.where("line < 'NATION_2'").unionByName(spark.createDataFrame([("<<<<<<< ours",), ("",), ("=======",)], "line string"))
    theirs = lines.where("line >= 'NATION_1'").unionByName(spark.createDataFrame([(">>>>>>> theirs",)], "line string"))
    return scan.union_merge(ours, theirs)
