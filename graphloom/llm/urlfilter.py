"""URL filter: a sort-merge range join of urls with nested host rules.

A host's canonical key is its labels reversed and joined, with a dot behind: all
subdomains of a host share its key as a prefix, so a rule is an interval of keys. Urls and
rules are dealt into key ranges by sampled splitters, with a hash behind the key so that
one host may span many ranges; a rule goes to every range that its interval meets. A
sorted sweep of a range keeps a stack of the rules whose interval is open. Of those whose
path begins the url's, the longest text (host and path) wins, the longer host among equals.

Defined results: a null url or one without ``://`` has an empty host and path and no rule;
without a rule the verdict is ``allow``. Repeated rows are judged each for itself; rules
given twice count once, and ``block`` wins between equal texts; rules with nulls are left
out; empty tables give an empty result; columns beside page_id and url are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, ship

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows from which the splitters are drawn, at most.
SAMPLE = 4096
LEAST = -(1 << 63)


def split_url(url: str = "url"):
    """(host, path) columns of a url column."""
    at = F.locate("://", F.col(url))
    rest = F.substring(F.col(url), at + 3, F.length(F.col(url)))
    host = F.when(at > 0, F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")
    path = F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.translate(host, UPPER, LOWER), path


def host_key(host: str = "host"):
    return F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.")), "."), F.lit("."))


class Active:
    """The stack of open intervals in a sweep; rules of one host stand together."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, key, {}, []))
        rules, sizes = self.stack[-1][2:]
        if path not in rules or verdict == "block":
            rules[path] = (rule, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self.close(key)
        best: tuple[int, int, str, str] | None = None
        for own, _, rules, sizes in self.stack:
            for n in sizes:
                if n <= len(path) and (hit := rules.get(path[:n])):
                    found = (len(hit[0]), len(own), *hit)
                    best = found if best is None or found[:2] > best[:2] else best
                    break  # longer paths came first
        return best[2:] if best else (None, DEFAULT)


def judge(pages: DataFrame, rules: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``rules`` has host, path, verdict."""
    spark = ship(pages.sparkSession)
    n_ranges = n_ranges or partitions(spark)
    host, path = split_url()
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key()).withColumn("salt", F.xxhash64("path", "page_id"))
    # thinned by hash first, so that the tasks together send about SAMPLE rows
    place_in = F.pmod(F.xxhash64("salt"), F.lit(1 << 30))
    share = min(1.0, 1.5 * SAMPLE / max(1, pages.count()))
    sample = sorted((r.key, r.salt) for r in urls.select("key", "salt").where(place_in <= int(share * (1 << 30))).orderBy(place_in, "salt").limit(SAMPLE).collect())
    cuts = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)] if sample else []
    cuts = sorted(set(cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(cuts, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["range", *b.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = r["key"]
                first, last = bisect_right(cuts, (key, LEAST)), bisect_left(cuts, (key[:-1] + chr(ord(".") + 1), LEAST))
                out += [(i, key, r["path"], r["host"] + r["path"], r["verdict"]) for i in range(first, last + 1)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int32()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["range", "key", "path", "rule", "verdict"])

    placed = urls.mapInArrow(place, "range int, page_id long, host string, path string, key string, salt long")
    known = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").withColumn("host", F.translate("host", UPPER, LOWER))
    known = known.withColumn("key", host_key()).mapInArrow(spread, "range int, key string, path string, rule string, verdict string")
    both = placed.withColumn("kind", F.lit(1)).unionByName(known.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, active = None, Active()
        for b in batches:
            out = []
            for rng, kind, key, page, host, path, rule, verdict in zip(*(b.column(c).to_pylist() for c in ("range", "kind", "key", "page_id", "host", "path", "rule", "verdict")), strict=True):
                if rng != now:
                    now, active = rng, Active()
                if kind == 0:
                    active.open(key, path, rule, verdict)
                else:
                    out.append((page, host, path, *active.judge(key, path)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    dealt = both.repartition(n_ranges, "range").sortWithinPartitions("range", "key", "kind")
    return dealt.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
