"""Predicates over paths, contents, symbols and edges, as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

KEY_FILES = ["readme.md", "readme", "cargo.toml", "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "pyproject.toml", "setup.py", "setup.cfg", "makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example"]
KEY_ENDINGS = ["main.rs", "main.go", "main.py", "main.java", "app.py", "index.ts", "index.js"]
NOISE_DIRS = ["vendor", "node_modules", "third_party", "external", "dist", "build", "target", ".next", "__pycache__", "out"]
NOISE_SUFFIXES = [".min.js", ".min.css", ".generated.ts", ".generated.js", "_generated.ts", "_generated.js", ".gen.go", "_pb.go", "_pb2.py", ".pb.cc", ".pb.h", ".js.map", ".css.map"]
NOISE_PARTS = [".generated.", "_generated.", ".gen."]
NOISE_FILES = ["package-lock.json", "yarn.lock", "Cargo.lock", "pnpm-lock.yaml", "poetry.lock", "Gemfile.lock", "composer.lock"]
GENERATED = ["// Code generated", "# AUTO-GENERATED", "/* DO NOT EDIT */", "// DO NOT EDIT", "@generated", "# This file is auto-generated"]
CODE_LANGUAGES = ["rust", "typescript", "javascript", "java", "python", "go", "c", "cpp", "ruby", "csharp", "swift", "kotlin", "bash", "php", "dart", "scala", "lua", "clojure", "elixir", "zig", "haskell", "groovy", "objc", "r", "julia", "ocaml", "ocaml_interface", "matlab"]
SCHEMA_EDGES = ["foreign_key", "embedded_sql", "orm_model", "view_reference", "trigger_target", "index_target", "column_reference"]
ROOT_FILES = ["mod.rs", "lib.rs", "index.ts", "index.js", "__init__.py"]
TEST_DIRS = ["tests", "test", "spec", "__tests__"]
#: Endings of test files: for the test map, for bridges, and for dead code.
MAPPED_ENDINGS = ["test.rs", "test.py", "test.go", "test.ts", "test.js", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "test.java", "tests.java"]
BRIDGE_ENDINGS = ["_test.rs", "_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx"]
DEAD_ENDINGS = ["_test.rs", "_test.py", "_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
INLINE_RUST = ["#[cfg(test)]", "#[test]", "#[tokio::test", "#[async_std::test", "#[rstest", "#[actix_rt::test"]


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, values: list[str]) -> Column:
    return any_of(c.contains(v) for v in values)


def ends_any(c: Column, values: list[str]) -> Column:
    return any_of(c.endswith(v) for v in values)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------- files


def key_file(path: Column) -> Column:
    low = F.lower(path)
    return name_of(low).isin(KEY_FILES) | ends_any(low, KEY_ENDINGS)


def focused(path: Column, prefix: str) -> Column:
    return path.startswith(prefix)


def in_workspace(path: Column, workspace: str) -> Column:
    """Whole components only: ``a/b`` holds ``a/b/c`` and not ``a/bc``."""
    return (path == workspace) | path.startswith(workspace.rstrip("/") + "/")


def noise_reason(path: Column) -> Column:
    """What puts a path on the block list: an exact name, the first folder, an ending, or a
    part of the path; null where nothing does."""
    first = lambda values, hit: F.coalesce(*[F.when(hit(v), F.lit(v)) for v in values])
    folder = F.filter(F.split(path, "/"), lambda s: s.isin(NOISE_DIRS))
    reason = F.coalesce(
        F.when(name_of(path).isin(NOISE_FILES), name_of(path)),
        F.when(F.size(folder) > 0, F.concat(F.get(folder, 0), F.lit("/"))),
        first(NOISE_SUFFIXES, lambda v: path.endswith(v)),
        first(NOISE_PARTS, lambda v: path.contains(v)),
    )
    return F.concat(F.lit("blocklist: "), reason)


def generated(content: Column) -> Column:
    return contains_any(F.array_join(F.slice(F.split(content, "\n"), 1, 5), "\n"), GENERATED)


def code_language(language: Column) -> Column:
    return F.coalesce(language.isin(CODE_LANGUAGES), F.lit(False))


def inline_tests(language: Column, content: Column) -> Column:
    js = content.contains("describe(") | content.contains(" it(") | content.rlike(r"(^|[^A-Za-z0-9_])test\(")
    return (
        F.when(language == "rust", contains_any(content, INLINE_RUST))
        .when(language == "python", contains_any(content, ["def test_", "class Test"]))
        .when(language.isin("typescript", "javascript", "tsx", "jsx"), js)
        .when(language == "go", content.contains("func Test"))
        .otherwise(F.lit(False))
    )


# ---------------------------------------------------------------- the seven notions of a test path


def _test_name(name: Column) -> Column:
    return name.contains("_test.") | name.contains("_spec.") | name.startswith("test_")


def test_for_blast(path: Column) -> Column:
    low = F.lower(path)
    name = name_of(low)
    return F.arrays_overlap(F.split(low, "/"), strings(TEST_DIRS)) | _test_name(name) | ends_any(name, ["test", "spec"]) | contains_any(name, [".test.", ".spec."])


def test_for_map(path: Column) -> Column:
    name = F.lower(name_of(path))
    return F.arrays_overlap(folders_of(path), strings(TEST_DIRS)) | _test_name(name) | ends_any(name, MAPPED_ENDINGS)


def test_for_bridges(path: Column) -> Column:
    low = F.lower(path)
    return low.startswith("tests/") | low.contains("/tests/") | low.contains("/__tests__/") | name_of(low).startswith("test_") | ends_any(name_of(low), BRIDGE_ENDINGS)


def test_for_dead_code(path: Column) -> Column:
    return any_of(path.startswith(d) for d in ("tests/", "test/", "spec/")) | contains_any(path, ["/tests/", "/test/", "/spec/", "__tests__"]) | ends_any(path, DEAD_ENDINGS)


def test_for_conventions(path: Column) -> Column:
    return path.contains("/test") | path.startswith("tests/") | path.contains("_test.")


def test_for_onboarding(path: Column) -> Column:
    return path.startswith("tests/") | path.startswith("test/") | path.contains("/tests/") | path.contains("/test/")


def test_for_health(path: Column) -> Column:
    return contains_any(path, ["/tests/", "/test/", "/spec/", "_test.", ".test.", "_spec.", ".spec."])


TEST_PATHS = {"blast": test_for_blast, "map": test_for_map, "bridges": test_for_bridges, "dead_code": test_for_dead_code, "conventions": test_for_conventions, "onboarding": test_for_onboarding, "health": test_for_health}


# ---------------------------------------------------------------- modules and edges


def module_of_folders(path: Column, depth: int = 2) -> Column:
    """The first folders, without the file; a file at the top is its own module."""
    return F.when(path.contains("/"), F.array_join(F.slice(folders_of(path), 1, depth), "/")).otherwise(path)


def module_of_segments(path: Column, depth: int = 2) -> Column:
    """The first segments, the file among them."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def boundary_violation(path: Column, module: Column) -> Column:
    """A file that isn't at the surface of its module: neither a root file right in it nor
    any other file right in it."""
    parent = F.array_join(folders_of(path), "/")
    rest = F.when(F.startswith(path, F.concat(module, F.lit("/"))), F.substring(path, F.length(module) + 2, F.length(path)))
    return F.when(name_of(path).isin(ROOT_FILES), parent != module).otherwise(F.coalesce(rest.contains("/"), F.lit(True)))


def schema_edge(edge_type: Column) -> Column:
    return edge_type.isin(SCHEMA_EDGES)


def entry_point(path: Column, name: Column, signature: Column, public: Column, has_routes: Column) -> Column:
    root = ends_any(path, ROOT_FILES)
    implements = (signature.contains("impl ") & signature.contains(" for ")) | signature.contains("@Override") | signature.contains("override ")
    return (name == "main") | name.startswith("test_") | contains_any(signature, ["#[test]", "@Test", "def test_"]) | (public & root) | implements | (has_routes & public)


def boundary_edges(edges: DataFrame, depth: int = 2) -> DataFrame:
    """``src, dst`` of edges into another module, past its surface."""
    rows = edges.withColumn("a", module_of_folders(F.col("src"), depth)).withColumn("b", module_of_folders(F.col("dst"), depth))
    return rows.where((F.col("a") != F.col("b")) & boundary_violation(F.col("dst"), F.col("b"))).select("src", "dst")


# ---------------------------------------------------------------- parameters


def normal_path(path: str) -> str:
    """A path parameter as the relations write it: forward slashes, no leading ``./`` or
    ``/``, no empty or ``.`` parts. Raises where it is empty or leaves the root."""
    parts = [p for p in path.strip().replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or "\0" in path:
        raise ValueError(f"not a path inside the root: {path!r}")
    return "/".join(parts)


def normal_symbol(name: str) -> str:
    """The last part of a qualified name, without the brackets of a call."""
    last = name.strip().removesuffix("()").replace("::", ".").split(".")[-1]
    if not last:
        raise ValueError(f"not a symbol: {name!r}")
    return last
