"""Parsers: source text to symbols, imports and exports. Python goes through its own
grammar; other languages through declarative patterns, one table for each."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd

SYMBOLS = "array<struct<ord:int,name:string,kind:string,visibility:string,signature:string,body:string,start_line:int,end_line:int>>"
IMPORTS = "array<struct<ord:int,source:string,names:array<string>>>"
PARSED = f"path string, language string, symbols {SYMBOLS}, imports {IMPORTS}"

#: kind and pattern (group 1 is the name) of declarations, and patterns of imports (group 1 is
#: the source); fixed values.
PATTERNS = {
    "rust": ([("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"(?:pub\s+)?struct\s+(\w+)"), ("enum", r"(?:pub\s+)?enum\s+(\w+)"), ("trait", r"(?:pub\s+)?trait\s+(\w+)")], r"^\s*use\s+([\w:]+)"),
    "javascript": ([("function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("constant", r"export\s+const\s+(\w+)")], r"^\s*import\s+(?:.*?\s+from\s+)?['\"]([^'\"]+)"),
    "go": ([("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"type\s+(\w+)\s+struct"), ("interface", r"type\s+(\w+)\s+interface")], r"^\s*(?:import\s+)?\"([\w./-]+)\"\s*$"),
    "java": ([("class", r"(?:public\s+|private\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("interface", r"(?:public\s+)?interface\s+(\w+)"), ("method", r"(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(")], r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"),
    "ruby": ([("function", r"def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"class\s+(\w+)"), ("module", r"module\s+(\w+)")], r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
    "sql": ([("table", r"(?i:create\s+table)\s+(?i:if\s+not\s+exists\s+)?([\w.]+)"), ("view", r"(?i:create)\s+(?:or\s+replace\s+)?(?i:view)\s+([\w.]+)")], r"(?!x)x"),
}
PATTERNS["typescript"] = PATTERNS["javascript"]

#: file name or extension to language; fixed values.
FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile"}
EXTENSIONS = {
    "py": "python", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby", "sql": "sql", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala", "php": "php", "sh": "bash", "lua": "lua", "hs": "haskell", "ex": "elixir", "exs": "elixir", "dart": "dart", "zig": "zig", "jl": "julia", "proto": "proto", "graphql": "graphql",
    "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "tf": "hcl", "prisma": "prisma", "txt": "text",
}


def parse_python(text: str) -> tuple[list, list]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    lines, symbols, imports = text.split("\n"), [], []

    def walk(body, inside: str | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if inside else "function"
                end = n.end_lineno or n.lineno
                symbols.append((len(symbols), n.name, kind, "private" if n.name.startswith("_") else "public", lines[n.lineno - 1].strip(), "\n".join(lines[n.lineno - 1 : end]), n.lineno, end))
                if isinstance(n, ast.ClassDef):
                    walk(n.body, n.name)
            elif isinstance(n, ast.ImportFrom):
                imports.append((len(imports), "." * n.level + (n.module or ""), [a.name for a in n.names]))
            elif isinstance(n, ast.Import):
                imports.append((len(imports), "", [a.name for a in n.names]))

    walk(tree.body, None)
    return symbols, imports


def parse_patterns(text: str, language: str) -> tuple[list, list]:
    kinds, importing = PATTERNS[language]
    lines, symbols, imports = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if line.lstrip().startswith(("//", "#", "--", "*")):
            continue
        if m := re.search(importing, line):
            source = m[1]
            imports.append((len(imports), source, [re.split(r"[/.:]+", source)[-1]]))
            continue
        for kind, pattern in kinds:
            if m := re.match(r"\s*" + pattern, line):
                depth, end = 0, i
                for j in range(i, len(lines)):  # to the closing brace, where there is one
                    depth += lines[j].count("{") - lines[j].count("}")
                    end = j
                    if depth <= 0 and ("{" in "".join(lines[i : j + 1]) or j > i + 1):
                        break
                public = "pub" in line or "export" in line or "public" in line or (language == "go" and m[1][:1].isupper()) or language in ("ruby", "sql")
                symbols.append((len(symbols), m[1], kind, "public" if public else "private", line.strip(), "\n".join(lines[i : end + 1]), i + 1, end + 1))
                break
    return symbols, imports


def parse(text: str | None, language: str | None) -> tuple[list, list]:
    if not text or language is None:
        return [], []
    return parse_python(text) if language == "python" else parse_patterns(text, language) if language in PATTERNS else ([], [])


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s = ["ord", "name", "kind", "visibility", "signature", "body", "start_line", "end_line"]
    for b in batches:
        got = [parse(t, x) for t, x in zip(b["content"], b["language"], strict=True)]
        yield pd.DataFrame(
            {
                "path": b["path"],
                "language": b["language"],
                "symbols": [[dict(zip(s, x, strict=True)) for x in a] for a, _ in got],
                "imports": [[{"ord": o, "source": src, "names": names} for o, src, names in i] for _, i in got],
            }
        )


COLUMN = re.compile(r"^\s*[\"`\[]?(\w+)[\"`\]]?\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)(.*)$", re.S)


def table_columns(ddl: str) -> list[tuple]:
    """(table, ord, column, type, nullable, default, foreign table, foreign column, in key) of
    each CREATE TABLE in a text."""
    out = []
    for m in re.finditer(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)[\"`]?\s*\(", ddl):
        depth, at, parts, start = 1, m.end(), [], m.end()
        while at < len(ddl) and depth:
            c = ddl[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or depth == 0:
                parts.append(ddl[start:at])
                start = at + 1
            at += 1
        keys, foreign, cols = set(), {}, []
        for p in parts:
            if k := re.match(r"(?is)\s*(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", p):
                keys |= {x.strip(' "`') for x in k[1].split(",")}
            elif f := re.match(r"(?is)\s*(?:constraint\s+\w+\s+)?foreign\s+key\s*\(\s*[\"`]?(\w+)[\"`]?\s*\)\s*references\s+[\"`]?([\w.]+)[\"`]?\s*(?:\(\s*[\"`]?(\w+))?", p):
                foreign[f[1]] = (f[2], f[3])
            elif re.match(r"(?i)\s*(unique|check|constraint|index|key)\b", p):
                continue
            elif c := COLUMN.match(p):
                cols.append((c[1], re.sub(r"\s+", "", c[2]), c[3]))
        for i, (name, kind, rest) in enumerate(cols):
            ref = re.search(r"(?i)references\s+[\"`]?([\w.]+)[\"`]?\s*(?:\(\s*[\"`]?(\w+))?", rest)
            fk = (ref[1], ref[2]) if ref else foreign.get(name, (None, None))
            default = re.search(r"(?i)\bdefault\s+('[^']*'|[\w.()]+)", rest)
            key = name in keys or bool(re.search(r"(?i)primary\s+key", rest))
            out.append((m[1].split(".")[-1].lower(), i, name.lower(), kind.lower(), not key and not re.search(r"(?i)not\s+null", rest), default[1] if default else None, fk[0].split(".")[-1].lower() if fk[0] else None, fk[1].lower() if fk[1] else None, key))
    return out
