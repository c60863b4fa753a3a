"""The operations of the engine under their names, with their parameters and defaults.

A ``Codebase`` holds the relations; ``call(codebase, op, **params)`` runs an operation and gives a
dict of DataFrames (and plain values where a result is one). Files over the parse cap, noise
folders and the like are the business of the scan that made the relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import architecture, blast, code, context, conventions, flow, graphs, health, history, intervals, layout, order, packing, retrieval, scan, schema, signals, surface
from graphloom.operators import predicates as P
from graphloom.operators import verify as checks
from graphloom.operators.lineage import cut


@dataclass
class Codebase:
    """Files (path, content) and change history (sha, path, age, day, message), with all that
    follows from them, computed when it is first asked for."""

    files: DataFrame
    history: DataFrame | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def of(spark: SparkSession, root: str, ignore: list[str] = ()) -> Codebase:
        """The files under a folder."""
        return Codebase(scan.scan(spark, root, ignore).where("content is not null").select("path", "content"))

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def text(self) -> DataFrame:
        rows = self.files.select("path", code.language(F.col("path")).alias("language"), "content")
        return cut(rows.withColumn("tokens", packing.total(packing.line_tokens(packing.lines_of(F.col("content"))))))

    @cached_property
    def parsed(self) -> DataFrame:
        return cut(code.parse(self.files))

    @cached_property
    def symbols(self) -> DataFrame:
        return code.symbols(self.parsed)

    @cached_property
    def imports(self) -> DataFrame:
        return code.imports(self.parsed).select("path", "source")

    @cached_property
    def columns(self) -> DataFrame:
        return cut(code.db_columns(self.files))

    @cached_property
    def models(self) -> DataFrame:
        return cut(schema.orm_models(self.files))

    @cached_property
    def bridges(self) -> DataFrame:
        made = [code.http_bridges(self.files)] + [f(self.files).drop("symbol") for f in (surface.ffi_bridges, surface.grpc_bridges, surface.graphql_bridges, surface.exec_bridges)]
        touches = code.embedded_sql_edges(self.files, self.columns).join(self.text.select(F.col("path").alias("src"), "language"), "src").select(F.col("src").alias("path"), "language", F.col("dst").alias("target"))
        out = surface.shared_schema_bridges(touches)
        for x in made:
            out = out.unionByName(x)
        return out

    @cached_property
    def import_edges(self) -> DataFrame:
        return cut(code.import_edges(self.parsed).withColumn("edge_type", F.lit("import")))

    @cached_property
    def edges(self) -> DataFrame:
        """The typed graph: imports, schema, models, migrations, bridges."""
        parts = [
            code.foreign_key_edges(self.columns),
            code.embedded_sql_edges(self.files, self.columns),
            schema.view_edges(schema.view_sources(self.files), self.columns),
            schema.orm_edges(self.models, self.columns),
            schema.column_edges(self.models, schema.orm_fields(self.models), self.columns),
            schema.migration_edges(schema.migrations(self.files)),
            self.bridges,
        ]
        out = self.import_edges
        for p in parts:
            out = out.unionByName(p.select("src", "dst", "edge_type"))
        return cut(out.distinct())

    @cached_property
    def calls(self) -> DataFrame:
        return cut(code.call_edges(self.parsed, self.import_edges.select("src", "dst")))

    @cached_property
    def tests(self) -> DataFrame:
        return cut(code.test_map(self.files, self.import_edges.select("src", "dst")))

    @cached_property
    def rank(self) -> DataFrame:
        return cut(graphs.pagerank(self.edges.where("src not like 'col:%' and dst not like 'col:%'")))

    @cached_property
    def past(self) -> DataFrame:
        return self.history if self.history is not None else self.spark.createDataFrame([], "sha string, path string, age long, day date, message string")

    @cached_property
    def churn(self) -> DataFrame:
        return cut(history.churn(self.past))

    @cached_property
    def last_change(self) -> DataFrame:
        return self.past.groupBy("path").agg(F.min("age").alias("age"))

    @cached_property
    def modules(self) -> DataFrame:
        return self.text.select(F.col("path").alias("node"), P.module_of_folders(F.col("path")).alias("module"))

    @cached_property
    def dead(self) -> DataFrame:
        return cut(code.dead_code(self.parsed, self.calls, self.tests, self.rank))

    @cached_property
    def observed(self) -> DataFrame:
        s = self.symbols
        naming = conventions.dominant(s.where("kind in ('function', 'method', 'class', 'struct', 'constant')").select(F.concat(F.col("kind"), F.lit("_style")).alias("name"), conventions.style(F.col("name")).alias("value")), "name", "value")
        out = naming.unionByName(conventions.visibility_conventions(s)).unionByName(conventions.import_conventions(self.text, self.imports)).unionByName(conventions.error_conventions(s))
        return cut(out.unionByName(conventions.testing_conventions(self.text, s)))

    def co_changes(self, least: int = 1) -> DataFrame:
        return history.co_changes(self.past, threshold=least)

    def named(self, paths: list[str]) -> DataFrame:
        """Paths that a caller named, in that order."""
        return self.spark.createDataFrame([(P.normal_path(p), k) for k, p in enumerate(paths)], "path string, turn int")

    def missing(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(P.normal_path(p),) for p in paths], "path string")


OPERATIONS: dict[str, Callable[..., dict]] = {}


def operation(f):
    """Register under the function's name; a trailing underscore keeps modules reachable."""
    OPERATIONS[f.__name__.rstrip("_")] = f
    return f


def call(base: Codebase, op: str, **params) -> dict:
    """Run an operation by its name."""
    if op not in OPERATIONS:
        raise ValueError(f"not an operation: {op!r}; there are {', '.join(sorted(OPERATIONS))}")
    return OPERATIONS[op](base, **params)


def _focus(df: DataFrame, focus: str | None, column: str = "path") -> DataFrame:
    return df.where(P.focused(F.col(column), focus)) if focus else df


# ---------------------------------------------------------------- context


def scored(base: Codebase, task: str, limit: int = 15) -> DataFrame:
    words = signals.expand(signals.query_tokens(task), base.synonyms)
    return signals.score_all(base.text, base.symbols, base.imports, base.last_change, base.rank, words).orderBy(F.desc("score"), "path").limit(limit)


@operation
def context_(base: Codebase, task: str, tokens: int = 50_000, focus: str | None = None, include_tests: bool = True, mode: str = "full") -> dict:
    packed = context.context(base.text, base.symbols, base.imports, base.import_edges, base.tests, base.last_change, base.rank, task, tokens, focus, include_tests, base.synonyms)
    if mode == "full":
        packed = packed.join(base.files, "path")
    return {"files": packed, "mentions": context.mentions(task)}


@operation
def briefing(base: Codebase, task: str, tokens: int = 50_000, focus: str | None = None) -> dict:
    return OPERATIONS["context"](base, task, tokens, focus, mode="briefing")


@operation
def context_for_task(base: Codebase, task: str, limit: int = 15, focus: str | None = None) -> dict:
    best = _focus(scored(base, task, 1 << 30 if focus else limit), focus).limit(limit)
    deps = base.import_edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    rows = best.join(base.text.select("path", "tokens"), "path").join(deps, "path", "left").withColumn("score", F.round("score", 4))
    return {"candidates": rows.orderBy(F.desc("score"), "path"), "total_files_scored": base.text.count()}


@operation
def pack_context(base: Codebase, files: list[str], tokens: int = 50_000, include_dependencies: bool = False, include_tests: bool = True, focus: str | None = None) -> dict:
    packed, missing = context.pack_context(_focus(base.files, focus), base.import_edges, files, tokens, include_dependencies, include_tests)
    return {"files": packed, "not_found": missing, "budget": tokens}


@operation
def retrieval_(base: Codebase, retrieval_op: str, target: str, limit: int = 20, depth: int = 1) -> dict:
    if retrieval_op == "search":
        return {"matches": context.search(base.text, base.symbols, base.rank, target, limit)}
    if retrieval_op == "references":
        return {"references": context.references(base.text, base.symbols, target)}
    if retrieval_op == "expand":
        return {"edges": graphs.subgraph(base.edges, [target], depth)}
    raise ValueError(f"not a retrieval: {retrieval_op!r}")


@operation
def search(base: Codebase, pattern: str, limit: int = 20, context_lines: int = 2, focus: str | None = None) -> dict:
    if len(pattern) > 1000 or context_lines > 1000:
        raise ValueError("a pattern has at most 1000 characters, and a match 1000 lines around it")
    found = cut(retrieval.search_lines(_focus(base.files, focus), pattern, context_lines))
    total = found.count()
    return {"matches": found.orderBy("path", "line_no").limit(limit), "total_matches": total, "truncated": total > limit}


@operation
def stats(base: Codebase, focus: str | None = None) -> dict:
    rows = _focus(base.text, focus)
    return {"languages": rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length("content")).alias("bytes"))}


@operation
def overview(base: Codebase, focus: str | None = None) -> dict:
    rows = _focus(base.text, focus)
    return stats(base, focus) | {"key_files": rows.where(P.key_file(F.col("path"))).select("path"), "modules": rows.groupBy(P.module_of_folders(F.col("path")).alias("module")).agg(F.count("*").alias("files"))}


# ---------------------------------------------------------------- graph


@operation
def graph(base: Codebase, graph_op: str, **params) -> dict:
    return {"result": graphs.query(base.edges, graph_op, **params)}


@operation
def trace(base: Codebase, target: str, focus: str | None = None) -> dict:
    found = _focus(context.trace(base.text, base.symbols, base.import_edges, target), focus)
    return {"files": found}


@operation
def blast_radius(base: Codebase, files: list[str], depth: int = 3, focus: str | None = None) -> dict:
    found = cut(blast.radius(base.edges, base.named(files), base.rank, base.tests.select("source", "test"), depth, focus))
    return {"affected": found, "summary": blast.summary(found)}


@operation
def call_graph(base: Codebase, target: str | None = None, depth: int = 1, focus: str | None = None) -> dict:
    return {"edges": graphs.call_graph(base.calls, target, depth, focus), "unresolved": base.calls.where("callee_path is null").select("caller_path", "caller", "callee")}


@operation
def dead_code(base: Codebase, focus: str | None = None, limit: int = 50) -> dict:
    rows = _focus(base.dead, focus)
    return {"dead_symbols": rows.orderBy(F.desc("liveness"), "path", "start_line").limit(limit), "total": rows.count()}


@operation
def api_surface(base: Codebase, focus: str | None = None, include: str = "all", tokens: int = 20_000) -> dict:
    out = {}
    if include in ("all", "symbols"):
        public = _focus(base.symbols.where("visibility = 'public'"), focus)
        sizes = public.groupBy("path").agg(F.sum(F.size(F.split(F.trim("signature"), r"\s+")) + 2).alias("tokens"))
        ranked = sizes.join(base.rank.select(F.col("node").alias("path"), "score"), "path", "left").withColumn("g", F.lit(0))
        kept = packing.greedy_skip(ranked, "g", -F.coalesce("score", F.lit(0.0)), tokens).select("path")
        out["symbols"] = public.join(kept, "path", "left_semi").drop("body")
    if include in ("all", "routes"):
        out["routes"] = surface.routes(_focus(base.files, focus))
    if include == "all":
        out |= {"grpc": surface.grpc_methods(base.files), "graphql": surface.graphql_types(base.files)}
    return out


@operation
def data_flow(base: Codebase, symbol: str, sink: str | None = None, depth: int = 10) -> dict:
    """Paths from all symbols of a name to sinks."""
    sources = base.symbols.where(F.col("name") == P.normal_symbol(symbol)).select("path", F.col("name").alias("symbol"))
    paths = cut(flow.trace(base.calls, sources, sink, depth, base.text))
    return {"paths": paths, "truncated": paths.agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))}


@operation
def cross_lang(base: Codebase, file: str | None = None, focus: str | None = None) -> dict:
    rows = base.bridges if file is None else base.bridges.where((F.col("src") == file) | (F.col("dst") == file))
    return {"edges": rows.where(P.focused(F.col("src"), focus) | P.focused(F.col("dst"), focus)) if focus else rows}


@operation
def predict(base: Codebase, files: list[str], depth: int = 3, focus: str | None = None) -> dict:
    changed = base.missing(files)
    structural = blast.radius(base.edges, base.named(files), base.rank, base.tests.select("source", "test"), depth).select("path")
    by_call = history.call_impact(base.calls.where("callee_path is not null").select(F.col("caller_path").alias("caller"), F.col("callee_path").alias("callee"), (F.col("confidence") == "exact").alias("exact")), changed)
    past = history.historical_impact(base.co_changes(), changed)
    hit = _focus(history.predict(structural, by_call, past), focus)
    return {"impact": hit, "tests": _focus(history.predict_tests(changed, structural, by_call, past, base.tests.select("source", "test")), focus, "test")}


# ---------------------------------------------------------------- data, reviews


@operation
def data(base: Codebase, focus: str | None = None) -> dict:
    return {"summary": context.data_summary(_focus(base.columns, focus), schema.view_sources(_focus(base.files, focus)), _focus(base.models, focus), schema.migrations(_focus(base.files, focus)))}


@operation
def diff(base: Codebase, old: DataFrame, focus: str | None = None) -> dict:
    return {"files": _focus(scan.changed_lines(old, base.files), focus), "changes": _focus(retrieval.snapshot_diff(old, base.files), focus)}


@operation
def review(base: Codebase, old: DataFrame, focus: str | None = None) -> dict:
    """What changed since a snapshot (path, content): files, symbols, and who depends on them."""
    before = Codebase(old)
    changes = cut(_focus(retrieval.snapshot_diff(old, base.files), focus))
    sets = retrieval.set_diff(before.symbols.select("path", "name"), base.symbols.select("path", "name"))
    return {"changes": changes, "symbols": _focus(sets, focus), "affected": blast.radius(base.edges, changes.where("change <> 'new'"), base.rank, base.tests.select("source", "test"))}


@operation
def verify(base: Codebase, old: DataFrame, focus: str | None = None) -> dict:
    """What changed since a snapshot held against the conventions: names, unwrapping and imports of the symbols and files
    that changed lines lie in; a new file counts as a whole."""
    lines = cut(_focus(scan.changed_lines(old, base.files), focus).select("path", F.explode("added").alias("line")))
    fresh = base.files.join(old.select("path"), "path", "left_anti").select("path")
    rules = cut(checks.naming_rules(base.symbols).unionByName(base.observed.select(F.col("name").alias("rule"), "dominant", "n", "total", "pct", "strength").where("name in ('unwrap_in_source', 'result_return_type', 'import_style')")))
    found = cut(checks.violations(checks.touched_symbols(base.symbols, lines, _focus(fresh, focus)), rules, base.imports.join(lines.select("path").distinct(), "path", "left_semi")))
    return {"violations": found, "passed": checks.passed(found, rules)}


# ---------------------------------------------------------------- judgements


@operation
def health_(base: Codebase, focus: str | None = None) -> dict:
    files = _focus(base.text, focus)
    edges = base.import_edges
    coupled = architecture.coupling_score(architecture.module_coupling(edges, base.modules))
    dims = {
        "conventions": health.conventions_score(base.observed.where(F.col("name").isin("function_style", "class_style", "struct_style", "constant_style", "import_style", "result_return_type", "visibility_default"))),
        "test_coverage": health.coverage_score(files, base.tests),
        "churn_stability": health.stability_score(files, base.churn),
        "coupling": coupled,
        "cycles": health.cycles_score(graphs.components(edges)),
        "dead_code": health.dead_code_score(base.symbols, base.dead),
    }
    return {"score": health.health(dims)}


@operation
def risks(base: Codebase, limit: int = 20, focus: str | None = None) -> dict:
    inline = P.inline_tests(F.col("language"), F.col("content"))
    mapped = base.tests.select(F.col("source").alias("path"), F.lit(True).alias("m")).distinct()
    files = base.text.join(mapped, "path", "left").select("path", (F.coalesce("m", F.lit(False)) | inline).alias("tested"))
    deg = base.import_edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    return {"risks": _focus(history.risk_ranking(files, base.churn, deg), focus).orderBy(F.desc("risk"), "path").limit(limit)}


@operation
def architecture_(base: Codebase, focus: str | None = None) -> dict:
    modules = base.modules.where(P.focused(F.col("node"), focus)) if focus else base.modules
    inbound = base.import_edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).join(modules, "node")
    return {
        "modules": architecture.architecture_map(base.import_edges, modules, base.rank),
        "circular": graphs.components(base.import_edges),
        "god_files": architecture.god_files(inbound.select("node", "module", "n")),
        "layers": architecture.layers(base.import_edges, modules),
        "violations": P.boundary_edges(base.import_edges),
    }


@operation
def conventions_(base: Codebase, category: str = "all", strength: str = "all", tokens: int = 5_000) -> dict:
    least = {"convention": 90, "trend": 70, "mixed": 50, "all": 0}[strength]
    rows = base.observed.where(F.col("pct") >= least)
    rows = rows if category == "all" else rows.where(F.col("name").startswith(category))
    sized = rows.select(F.lit(0).alias("g"), F.col("name").alias("path"), F.lit(20).alias("tokens"), "pct")
    kept = packing.greedy_skip(sized, "g", -F.col("pct"), tokens).select(F.col("path").alias("name"))
    return {"observations": rows.join(kept, "name", "left_semi"), "coverage": conventions.coverage_by_folder(base.text, base.tests), "lengths": code.function_density(base.parsed)}


@operation
def security_surface(base: Codebase, focus: str | None = None) -> dict:
    files = _focus(base.files, focus)
    return {
        "secrets": retrieval.secrets(files.where(~P.test_for_dead_code(F.col("path")))),
        "sql_injection": surface.sql_injection(files),
        "validation_gaps": surface.validation_gaps(files, base.rank),
        "unprotected": surface.unprotected(files, surface.routes(files)),
        "exposure": _focus(health.exposure(base.text, base.symbols, base.import_edges, base.tests), focus),
    }


@operation
def drift(base: Codebase, snapshots: DataFrame | None = None, focus: str | None = None) -> dict:
    """Metrics of now, hotspots, and the trend over earlier snapshots (ts and the metrics)."""
    modules = cut(health.module_metrics(_focus(base.text, focus), base.import_edges))
    now = health.snapshot(modules)
    out = {"metrics": now, "hotspots": health.hotspots(modules)}
    return out | ({"trend": health.trend(snapshots)} if snapshots is not None else {})


@operation
def visual(base: Codebase, type: str = "graph", format: str = "graphml") -> dict:  # noqa: A002
    """The data behind the pictures; drawing them is no business of this engine."""
    if type == "graph":
        return {"lines": {"graphml": scan.to_graphml, "cypher": scan.to_cypher, "canonical": code.canonical}[format](base.edges)}
    if type == "layout":
        edges = base.import_edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
        drawing = layout.layout(base.text.select(F.col("path").alias("id")), edges, layout.LAYER_LIMIT)
        return {"nodes": drawing.nodes, "edges": drawing.edges, "extents": drawing.extents}
    if type == "heatmap":
        return risks(base, 1 << 30)
    raise ValueError(f"not a picture: {type!r}")


@operation
def onboard(base: Codebase, focus: str | None = None) -> dict:
    edges, files = base.import_edges.select("src", "dst"), _focus(base.text, focus).select("path", "tokens")
    ordered = cut(order.reading_order(edges, files))
    symbols = base.symbols.select("path", "name", F.col("start_line").alias("ord"))
    return {"order": ordered, "phases": order.phases(ordered, edges, files, base.rank, symbols), "reading_time": files.agg(order.reading_time(F.coalesce(F.sum("tokens"), F.lit(0))).alias("reading_time"))}
