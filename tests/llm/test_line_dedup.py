"""Line dedup against a plain version, with and without frequent keys."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import line_dedup
from graphloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, least=10):
    """Rows of (doc_id, text) to (doc_id, lines, dropped, digest)."""
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                first[key(line)] = min(first[key(line)], i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or first[key(x)] >= i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=str)


def test_op12_equals_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_line_dedup"](spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == plain(rows) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("sample, often", [(1 << 17, 128), (1 << 17, 3), (50, 2)])
def test_random_documents_whatever_counts_as_frequent(spark, sample, often):
    r = random.Random(5)
    pool = [f"Shared line number {k} of the pool" for k in range(40)] + ["short", "", "  \t", "ÄÖÜ äöü words", "ten chars!", "nine char"]
    rows = []
    for i in range(150):
        lines = [r.choice(pool) if r.random() < 0.5 else f"own line {i} {k} of this document" for k in range(r.randint(0, 200))]
        rows.append((i, "\n".join(f"{r.choice(['', ' ', chr(9)])}{x.upper() if r.random() < 0.2 else x}{r.choice(['', chr(13)])}" for x in lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.keep_bitmaps(df, sample=sample, often=often)
    assert digests(line_dedup.apply(df, found)) == plain(rows)


def test_bitmaps_are_compressed_and_say_what_stays(spark):
    texts = ["\n".join(f"line {k} of the first text" for k in range(300)), "\n".join(f"line {k} of the first text" if k in (5, 200, 263) else f"another line {k}" for k in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(df).collect()
    assert (row.doc, row.n_dropped) == (1, 3)
    words, gone = [], []
    for r in row.keep:
        words += [-1] * r.full + [r.word]
    for place in range(len(words) * 64):
        if not words[place // 64] >> place % 64 & 1:
            gone.append(place)
    assert gone == [5, 200, 263] and [r.full for r in row.keep] == [0, 2, 0]


def test_odd_rows(spark):
    long = "\n".join(f"a line that only this text has, number {k}" for k in range(70_000)) + "\nthe line of all documents"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "the line of all documents"), (5, "The Line of all documents \nmore of it"), (6, long), (None, "the line of all documents"), (None, None), (-7, "x" * 100_000)]
    rows += [(5, "The Line of all documents \nmore of it"), (5, "another text of one id\nmore of it, and more\nthe line of all documents"), (8, "more of it, and more"), (9, "\n".join(["the line of all documents"] * 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'a' as n_dropped", "2 as doc", "3 as row", "4 as keep", "5 as a", "6 as place")
    got = line_dedup.apply(df, line_dedup.keep_bitmaps(df))
    assert got.columns == ["doc_id", "text", "doc", "row", "keep", "a", "place", "n_lines", "n_dropped", "kept"]
    assert digests(got) == plain(rows)
    assert line_dedup.apply(df.limit(0), line_dedup.keep_bitmaps(df.limit(0))).count() == 0
