"""Hooks for code of one's own: detectors that look at files, analysers that look at relations,
and scorers. A plug-in declares which files it sees, and whether it needs their content;
what it doesn't declare never reaches it, and what it returns is bounded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Bytes of findings that a plug-in may return for one file.
RETURN_CAP = 1 << 20
FINDINGS = "path string, plugin string, message string, line int"


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` and ``?`` stay within a folder, ``**`` doesn't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


class Detector(Protocol):
    """Looks at one file at a time."""

    name: str
    needs_content: bool

    def detect(self, path: str, content: str | None) -> Iterator[tuple[str, int]]:
        """(message, line) of each finding."""


class Scorer(Protocol):
    def score(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        """``path, score``."""


class Analyser(Protocol):
    """Looks at the relations of a code base."""

    name: str

    def analyse(self, relations: dict[str, DataFrame]) -> DataFrame:
        """Rows of ``FINDINGS``."""


@dataclass
class Markers:
    """Finds words."""

    words: list[str]
    name: str = "markers"
    needs_content: bool = True
    _pattern: re.Pattern | None = field(default=None, repr=False)

    def detect(self, path: str, content: str | None) -> Iterator[tuple[str, int]]:
        for i, line in enumerate((content or "").split("\n"), 1):
            for w in self.words:
                for _ in range(line.count(w)):
                    yield w, i


@dataclass
class SymbolScorer:
    """The symbol match as a scorer of its own."""

    words: list[str]

    def score(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        from graphloom.operators import signals

        return signals.symbol_match(symbols, self.words).select("path", F.col("symbol_match").alias("score"))


def run(detectors: list[Detector], files: DataFrame, patterns: list[str] = ("**",)) -> DataFrame:
    """The findings of some detectors in the files that a pattern matches; findings beyond
    ``RETURN_CAP`` bytes for a file raise an error rather than being cut."""
    seen = F.lit(False)
    for p in patterns:
        seen = seen | F.col("path").rlike(glob_pattern(p))
    content = "content" if any(x.needs_content for x in detectors) else F.lit(None).cast("string").alias("content")
    scoped = files.where(seen).select("path", content)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                for x in detectors:
                    found = list(x.detect(path, text if x.needs_content else None))
                    if sum(len(m.encode()) + 8 for m, _ in found) > RETURN_CAP:
                        raise ValueError(f"plug-in {x.name} returns too much for {path}")
                    rows += [(path, x.name, m, i) for m, i in found]
            yield pd.DataFrame(rows, columns=["path", "plugin", "message", "line"])

    return scoped.mapInPandas(work, FINDINGS)


def score(scorer: Scorer, files: DataFrame, symbols: DataFrame) -> DataFrame:
    return scorer.score(files, symbols).where("score > 0")


def as_table_function(spark: SparkSession, detector: Detector, name: str) -> None:
    """Register a detector as a table function of SQL: ``SELECT * FROM name(TABLE(SELECT path, content ...) PARTITION BY path)``
    gives ``path, plugin, message, line``. Rows of a partition come one after the other and none is kept, so any partitioning will do;
    partitions are what the cap holds for. The call names the columns that the detector sees: without ``content``
    it sees none. Rows without a path are passed over."""

    class Findings:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            columns = {f.name: f.dataType.simpleString() for f in table.dataType.fields} if table.isTable else {}
            if columns.get("path") != "string" or columns.get("content", "string") != "string":
                raise ValueError(f"{name} takes a table with a text column path and, if it is to be seen, a text column content")
            return AnalyzeResult(StructType().add("path", StringType()).add("plugin", StringType()).add("message", StringType()).add("line", IntegerType()))

        def __init__(self) -> None:
            self.returned = 0

        def eval(self, row: Row) -> Iterator[tuple[str, str, str, int]]:
            path = row["path"]
            if path is None:
                return
            for message, line in detector.detect(path, row["content"] if detector.needs_content and "content" in row else None):
                self.returned += len(message.encode()) + 8
                if self.returned > RETURN_CAP:
                    raise ValueError(f"plug-in {detector.name} returns too much for {path}")
                yield path, detector.name, message, line

    spark.udtf.register(name, udtf(Findings))
