"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once (presence): hashed words, word pairs and pairs
with one word skipped, over lower-cased runs of letters, digits and non-ASCII bytes.
The model is fitted with per-coordinate rates and L1; the few weights that are not zero
are a compact table, bounded by the number of buckets, that travels with the tasks.

Defined results: without labels of both kinds every text scores under one half; null or empty
text has no feature and scores the bias alone; repeated
rows are scored each for itself; rows of an empty table give an empty result; columns
beside ``doc_id`` and ``text`` are ignored (``classify`` passes them through untouched).
Labels that are null or whose doc_id is null don't take part; if a doc_id has several
labels, the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, distinct, flat, mix, prefix_sums, release, row_of, row_slices, ship, span_hash, spans

BITS = 20
#: At most so many labelled texts are fitted on, half of each label where there are enough.
TRAIN_ROWS = 8000
SEGMENT = 1 << 19
#: The bias of a model that has seen no labels of both kinds: every text counts as clean.
UNKNOWN = -2.0

_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128:
        _LOWER[_c] = ord(chr(_c).lower())
    elif _c >= 128:
        _LOWER[_c] = _c


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word in order."""
    low = _LOWER[data]
    lo, hi = spans(low > 0, off)
    return span_hash(prefix_sums(low), lo, hi), row_of(off, lo)


def features(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word, word pair and pair with a word skipped."""
    shift = U64(64 - BITS)
    out = [(mix(h + U64(1)) >> shift, row)]
    for gap, k in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(h[:-gap] * U64(k) + h[gap:])[same] >> shift
            out.append((pair, row[gap:][same]))
    return np.concatenate([x for x, _ in out]).astype(np.int64), np.concatenate([r for _, r in out])


def segments(data: np.ndarray, off: np.ndarray, overlap: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) pieces of bounded size that cover all texts. A text
    longer than the bound is cut between words, and the next piece starts two words
    earlier: as features are a set, no pair is lost and none counts twice. Without
    ``overlap`` the pieces only follow each other."""
    for lo, hi in row_slices(off, SEGMENT):
        if hi - lo > 1 or off[hi] - off[lo] <= 2 * SEGMENT:
            yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo
            continue
        text = data[off[lo] : off[hi]]
        at = 0
        while at < len(text):
            end = min(len(text), at + SEGMENT)
            while end < len(text) and _LOWER[text[end]] > 0:
                end += 1
            yield text[at:end], np.array([0, end - at]), lo
            if end == len(text):
                break
            if not overlap:
                at = end
                continue
            back, seen = end, 0
            while back > at + 1 and seen < 2:
                while back > at + 1 and _LOWER[text[back - 1]] == 0:
                    back -= 1
                while back > at + 1 and _LOWER[text[back - 1]] > 0:
                    back -= 1
                seen += 1
            at = back if back > at + 1 else end


@dataclass
class FTRL:
    """FTRL-proximal with per-coordinate learning rates over binary sparse features."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    dims: int = 1 << BITS

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4, seed: int = 7) -> Model:
        z, n = np.zeros(self.dims), np.zeros(self.dims)
        bias_z = bias_n = 0.0
        rng = np.random.default_rng(seed)

        def weights(zi, ni):
            w = -(zi - np.sign(zi) * self.l1) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2)
            return np.where(np.abs(zi) <= self.l1, 0.0, w)

        def bias():
            return -bias_z / ((self.beta + np.sqrt(bias_n)) / self.alpha)

        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                f = rows[i]
                w = weights(z[f], n[f])
                b = bias()
                p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
                g = p - labels[i]
                if abs(g) < 1e-6:
                    continue
                s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / self.alpha
                z[f] += g - s * w
                n[f] += g * g
                bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / self.alpha * b
                bias_n += g * g
        w = weights(z, n)
        at = np.flatnonzero(w)
        return Model(at, w[at], float(bias()))


@dataclass
class Model:
    """The weights that are not zero."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
        pairs = []
        for seg, seg_off, first in segments(data, off):
            f, r = features(*words(seg, seg_off))
            hit = table[f] != 0
            pairs.append((r[hit] + first << BITS) | f[hit])
        total = np.zeros(len(off) - 1)
        if pairs:
            once = distinct(np.concatenate(pairs))
            np.add.at(total, once >> BITS, table[once & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BITS)
        t[self.at] = self.weight
        return t


def held_out(doc_id="doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> list[tuple[int, int]]:
    """At most ``rows`` training ids with their label, by hash order, half of each label
    where there are enough; never a held-out id."""
    one = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    # thinned by hash first, so that the tasks together send about ``rows`` ids of each label
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    count = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    share = {y: min(1.0, 1.5 * rows / max(1, count.get(y, 0))) for y in (0, 1)}
    got = {y: one.where((F.col("y") == y) & (place <= int(share[y] * (1 << 30)))).orderBy(place, "doc_id").limit(rows).collect() for y in (0, 1)}
    least = min(len(got[0]), len(got[1]))
    take = {y: max(rows // 2, rows - least) for y in (0, 1)}
    return [(int(r.doc_id), y) for y in (0, 1) for r in got[y][: take[y]]]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = flat(b.column("text"))
        found: dict[int, list[np.ndarray]] = {}
        for seg, seg_off, first in segments(data, off):
            f, r = features(*words(seg, seg_off))
            order = np.argsort(r, kind="stable")
            f, r = f[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for part, k in zip(np.split(f, cut), r[np.r_[0, cut]] if len(r) else [], strict=False):
                found.setdefault(int(k) + first, []).append(part)
        bags = [np.unique(np.concatenate(found[i])).astype("<u4").tobytes() if i in found else b"" for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary())], ["doc_id", "bag"])
    release()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **settings) -> Model:
    """Fit on at most ``rows`` labelled texts. Only ids and hashed bags of that bounded
    sample reach the driver."""
    spark = ship(docs.sparkSession)
    ids = labelled_sample(labels, "toxic", rows)
    y = dict(ids)
    if len(set(y.values())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), UNKNOWN)
    # bounded: at most ``rows`` ids
    picked = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": np.array(sorted(y), np.int64)})))
    bags = docs.select("doc_id", "text").join(picked, "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, bag binary").collect()
    bags.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    return FTRL(**settings).fit([np.frombuffer(r.bag, "<u4") for r in bags], np.array([y[r.doc_id] for r in bags], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(*flat(b.column("text")), table))], ["doc_id", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score under ``threshold``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            yield b.filter(pa.array(model.scores(*flat(b.column("text")), table) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
