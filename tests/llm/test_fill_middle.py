"""Fill-in-the-middle against patterns that list the units."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle
from graphloom.llm.fill_middle import Plan
from graphloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]+[^ \t-\r]*|[^ \t-\r]+", "char": r"(?s:.)"}


def plain(i, text, plan):
    """n, form, prefix, middle, output"""
    text = text or ""
    units = re.findall(UNITS[plan.unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{plan.seed}{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in plan.sentinels) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < plan.suffix_first:
        return n, "spm", len(p), len(m), plan.suffix + s + plan.prefix + p + plan.middle + m
    return n, "psm", len(p), len(m), plan.prefix + p + plan.suffix + s + plan.middle + m


def test_op13_equals_a_plain_version(spark):
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    forms = set()
    for r in QUERIES["op13_fill_middle"](spark, SMALL).collect():
        n, form, p, m, out = plain(r.doc_id, texts[r.doc_id], Plan())
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id] or ""))
        forms.add(form)
    assert {"psm", "spm"} <= forms


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("rate, first, marks", [(100, 50, ("<P>", "<S>", "<M>")), (60, 0, ("<|prefix|>", "<|suffix|>", "<|middle|>")), (100, 100, ("\x01", "\x02", "\x03"))])
def test_units_rates_and_sentinels(spark, unit, rate, first, marks):
    plan = Plan(*marks, unit=unit, rate=rate, suffix_first=first, seed="s")
    r = random.Random(unit)
    pieces = ["a", "Bc", "é", "𝄞", "é", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " ", " ", "<", "P>", "<P", "|>"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(900, f"x{marks[0]}y"), (901, f"{marks[2]}"), (902, f"\n{marks[1]}\n"), (903, None), (904, ""), (None, "no id\nbut lines\n"), (None, None), (905, "one line only"), (905, "one line only"), (906, "\n"), (907, "é\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as output", "2 as restored", "3 as form")
    got = fill_middle.restore(fill_middle.rearrange(df, plan), plan)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    have = sorted(((r.doc_id, *r[1:]) for r in got.collect()), key=str)
    want = sorted(((i, *plain(i, t, plan), t or "") for i, t in rows), key=str)
    assert have == want
    assert fill_middle.rearrange(df.limit(0), plan).count() == 0


def test_sentinels_that_would_be_mistaken_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("", "b", "c"), ("a", "a", "c"), ("ab", "abc", "d"), ("aba", "x", "y"), ("ab", "bc", "z"), ("\n", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.rearrange(df, Plan(*marks))


def test_ranks_are_looked_up_among_events():
    units = fill_middle.Units([1, 2, 6], 9, "line")
    assert units.count() == 4 and [units.end(k) for k in range(5)] == [0, 2, 3, 7, 9]
    assert [units.rank(p) for p in (0, 1, 2, 3, 8, 9)] == [0, 0, 1, 2, 3, 4]
    assert fill_middle.Units([], 5, "char").count() == 5 and fill_middle.Units([], 5, "char").end(3) == 3


def test_every_row_keeps_its_id_type(spark):
    df = spark.createDataFrame([("k1", "a\nb\n")], "doc_id string, text string")
    (row,) = fill_middle.rearrange(df).select("doc_id", F.length("output").alias("size")).collect()
    assert row.doc_id == "k1" and row.size == 4 + 9
