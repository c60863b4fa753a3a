"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit borders, and rearranged
between sentinels.

One automaton (Aho-Corasick) holds the sentinels and the ASCII characters at which a unit may
begin or end; one pass over the text gives its events and nothing else. What lies between two
events has no border in it, or one behind every character: how many units a gap holds is
arithmetic, so the rank of a unit is looked up among the few events instead of listing units.
Kinds of unit: ``line`` (up to and with a newline; ``[^\\n]*\\n|[^\\n]+``), ``word`` (white space of
ASCII and what follows up to the next, or what stands before the first; ``\\s+\\S*|\\S+``) and ``char`` (code points).
Two integers of a hash of the document's id choose the ranks of both cuts, two more whether
and in which order (prefix, suffix, middle or suffix, prefix, middle) it is rearranged.

Texts are handled one by one in Arrow batches, whole, without a shuffle; nothing is kept from
row to row, so a lost task is simply run again.

Defined results: null counts as an empty text; empty texts, and texts that contain a sentinel,
stay as they are (``plain``). A row without an id is hashed as if its id were the empty text. Equal
rows have equal results. Cuts may coincide, and any part may be empty. An empty table stays empty.
``rearrange`` gives the id and its own columns alone, so names of other columns can't clash."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.llm.common import row_slices, ship

#: Characters at which units of a kind may begin or end; white space of ASCII is a fixed list.
BORDERS = {"line": "\n", "word": "\t\n\x0b\x0c\r ", "char": ""}
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of texts that are handled at once (a longer text stands alone).
PIECE = 8 << 20


@dataclass(frozen=True)
class Plan:
    """Sentinels; the unit; of a hundred texts, how many are rearranged, and how many of these
    begin with the suffix; and what goes into the hash in front of the id."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    rate: int = 100
    suffix_first: int = 50
    seed: str = "7:"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def automaton(plan: Plan) -> ahocorasick.Automaton:
    """Events: (True, length) for a sentinel, (False, 1) for a border character."""
    found = ahocorasick.Automaton()
    for c in BORDERS[plan.unit]:
        found.add_word(c, (False, 1))
    for s in plan.sentinels:
        found.add_word(s, (True, len(s)))
    found.make_automaton()
    return found


class Units:
    """Ranks of the units of a text, from its events."""

    def __init__(self, events: list[int], length: int, unit: str):
        """``events``: places of border characters, ascending."""
        self.unit, self.length = unit, length
        if unit == "line":
            # an event ends a unit; what stands behind the last one is one more
            self.ends = [e + 1 for e in events]
            if (self.ends[-1] if events else 0) < length:
                self.ends.append(length)
        elif unit == "word":
            # the first of adjacent events begins a unit, so it ends the one before, if there is one
            starts = [e for e, before in zip(events, [-2, *events], strict=False) if e != before + 1 and e > 0]
            self.ends = [*starts, length] if length else []
        else:
            self.ends = []

    def count(self) -> int:
        return self.length if self.unit == "char" else len(self.ends)

    def end(self, rank: int) -> int:
        """How many characters the first ``rank`` units have."""
        if self.unit == "char":
            return rank
        return self.ends[rank - 1] if rank else 0

    def rank(self, place: int) -> int:
        """How many units end at or before a place."""
        return place if self.unit == "char" else bisect_right(self.ends, place)


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four integers for a document: the first 32 digits of a hash, eight each."""
    h = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, doc_id: int | None, plan: Plan, found: ahocorasick.Automaton) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the rearranged text."""
    borders, marked = [], False
    for at, (sentinel, _) in found.iter(text):
        if sentinel:
            marked = True
        else:
            borders.append(at)
    units = Units(borders, len(text), plan.unit)
    n = units.count()
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if not text or marked or h3 % 100 >= plan.rate:
        return n, PLAIN, None, None, text
    a, b = sorted(units.end(h % (n + 1)) for h in (h1, h2))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.suffix_first:
        return n, SPM, a, b - a, f"{plan.suffix}{s}{plan.prefix}{p}{plan.middle}{m}"
    return n, PSM, a, b - a, f"{plan.prefix}{p}{plan.suffix}{s}{plan.middle}{m}"


def join(output: str, form: str, plan: Plan, found: ahocorasick.Automaton) -> str:
    """The text that was cut, from the rearranged one: what stands between its sentinels."""
    if form == PLAIN:
        return output
    ends = [(at + 1 - size, at + 1) for at, (sentinel, size) in found.iter(output) if sentinel]
    (_, a), (b, c), (d, e) = ends
    first, second, middle = output[a:b], output[c:d], output[e:]
    p, s = (second, first) if form == SPM else (first, second)
    return p + middle + s


def _check(plan: Plan) -> None:
    """A rearranged text must tell its sentinels from anything else."""
    marks = plan.sentinels
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlaps = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or a in BORDERS[plan.unit] or overlaps or (i != j and a in b):
                raise ValueError("sentinels must be texts that aren't borders of units, don't hold each other and don't overlap")


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi in row_slices(np.r_[0, np.cumsum(sizes, dtype=np.int64)], PIECE):
        yield batch.slice(lo, hi - lo)


def _sentinels_only(plan: Plan) -> ahocorasick.Automaton:
    return automaton(Plan(plan.prefix, plan.suffix, plan.middle, "char"))


def rearrange(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row the id, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code points, null if plain)
    and ``output``, the rearranged text."""
    ship(docs.sparkSession)
    _check(plan)
    out = StructType([StructField(doc_id, docs.schema[doc_id].dataType), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(plan)
        for b in batches:
            for part in _slices(b, 1):
                ids, texts = part.column(0), part.column(1)
                rows = [cut(t.as_py() or "", i.as_py(), plan, found) for i, t in zip(ids, texts, strict=True)]
                n, form, p, m, o = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(o)], names=out.names)

    return docs.select(doc_id, text).mapInArrow(run, out)


def restore(done: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """What ``rearrange`` gave, with ``restored``: the exact text, from ``output`` and ``form`` alone."""
    ship(done.sparkSession)
    out = StructType([*[f for f in done.schema.fields if f.name != "restored"], StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _sentinels_only(plan)
        for b in batches:
            for part in _slices(b, b.schema.get_field_index("output")):
                texts = [join(o.as_py(), f.as_py(), plan, found) for o, f in zip(part.column("output"), part.column("form"), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in out.names[:-1]], pa.array(texts)], names=out.names)

    return done.select(*[f.name for f in out.fields[:-1]]).mapInArrow(run, out)
