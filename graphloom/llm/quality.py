"""Quality: Bradley-Terry pairwise ranking of documents, thresholded by score quantile.

A document's strength is a linear function of statistics of its whole text (shares of
character classes, word shapes, repetition). Training pairs all labelled rows (one labelled
good against one labelled bad), and fits the strengths by logistic loss on the
differences of their features. The threshold is a quantile of the scores of all training
rows: the share of bad rows among them. Scores are squashed so that this threshold
falls on ``CUT``.

Defined results: a text's statistics are those of the whole text at every length (a line of
over ``SEGMENT`` bytes is counted in one); null or empty text has all-zero statistics and gets that row's score;
repeated rows are scored each for itself; an empty table gives an empty result; further
columns are ignored. Without labels of both kinds every score is ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, distinct, flat, forget, materialise, mix, prefix_sums, row_of, row_slices, ship, span_hash, spans
from graphloom.llm.toxicity import held_out

#: Labelled rows of a group, the least of each label that a group should have, and draws of
#: pairs; ranges of a count of strengths, and the most strengths that are sent.
GROUP, LEAST, DRAWS = 8000, 50, 8
BINS, SENT = 4096, 10_000
CUT = 0.3
SEGMENT = 1 << 20

# classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 plain punctuation, 6 odd punctuation, 7 non-ASCII
_CLASS = np.zeros(256, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    if _ch.islower():
        _CLASS[_c] = 1
    elif _ch.isupper():
        _CLASS[_c] = 2
    elif _ch.isdigit():
        _CLASS[_c] = 3
    elif _ch in " \t\n\r\f\v":
        _CLASS[_c] = 4
    elif _ch in ".,;:'\"?()-":
        _CLASS[_c] = 5
    elif _c > 32:
        _CLASS[_c] = 6
_CLASS[128:] = 7
N_FEATURES = 18


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each row."""
    key = distinct((mix(h) & ~U64((1 << 20) - 1)) | row.astype(U64))
    return np.bincount((key & U64((1 << 20) - 1)).astype(np.int64), minlength=n)


def _raw(data: np.ndarray, off: np.ndarray, seen: tuple[list, list] | None = None) -> np.ndarray:
    """Counts over each row; additive over pieces of a text that cut no word and no line, but
    for the distinct counts: where ``seen`` is given, it takes the hashes in their place."""
    n = len(off) - 1
    cls = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(row * 8 + cls, minlength=8 * n).reshape(n, 8)
    s = prefix_sums(data)
    lo, hi = spans(cls != 4, off)
    wr = row_of(off, lo)
    size = hi - lo
    line_lo, line_hi = spans(data != 10, off)
    lr = row_of(off, line_lo)
    by = lambda r, w=None: np.bincount(r, weights=w, minlength=n)
    last = cls[hi - 1] if len(hi) else cls[:0]
    upper = cls[lo] == 2 if len(lo) else np.zeros(0, bool)
    second = np.where(size > 1, cls[np.minimum(lo + 1, len(cls) - 1)] if len(lo) else 0, 0)
    word, line = span_hash(s, lo, hi), span_hash(s, line_lo, line_hi)
    if seen:
        seen[0].append(distinct(word))
        seen[1].append(distinct(line))
    return np.column_stack(
        [
            counts,
            by(wr),
            by(wr, size),
            by(wr, size > 20),
            by(wr, last == 6),
            by(wr, size == 1),
            by(wr, upper & (second == 2)),
            by(lr),
            np.zeros(n) if seen else _distinct(wr, word, n),
            np.zeros(n) if seen else _distinct(lr, line, n),
            by(wr, upper),
            by(wr, (size > 1) & (last == 5)),
        ]
    )


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``N_FEATURES`` statistics for each text."""
    out = np.zeros((len(off) - 1, 19))
    for lo, hi in row_slices(off, SEGMENT):
        if hi - lo == 1 and off[hi] - off[lo] > 4 * SEGMENT:  # in pieces, cut behind line ends
            text = data[off[lo] : off[hi]]
            ends = np.flatnonzero(text == 10) + 1
            seen: tuple[list, list] = ([], [])
            at = 0
            while at < len(text):
                # the last line end in reach, else the first after it: no line is cut
                k = int(np.searchsorted(ends, at + SEGMENT, side="right"))
                end = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[k]) if k < len(ends) else len(text)
                out[lo] += _raw(text[at:end], np.array([0, end - at]), seen)[0]
                at = end
            out[lo, 15:17] = [len(np.unique(np.concatenate(x))) for x in seen]
        else:
            out[lo:hi] = _raw(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
    c, rest = out[:, :8], out[:, 8:]
    total = np.maximum(c.sum(1), 1)[:, None]
    w = np.maximum(rest[:, 0], 1)
    shares = c / total
    words, size, long, odd, single, caps, lines, distinct, distinct_lines, cap1, plain_end = rest.T
    return np.column_stack(
        [
            shares[:, [0, 1, 2, 3, 4, 5, 6, 7]],
            size / w / 10,
            long / w,
            odd / w,
            single / w,
            caps / w,
            1 - distinct / w,
            1 - distinct_lines / np.maximum(lines, 1),
            np.log1p(words) / 10,
            cap1 / w,
            plain_end / w,
        ]
    )


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics with their square roots, so that small shares weigh too."""
    return np.hstack([x, np.sqrt(np.abs(x))])


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    threshold: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.centre) / self.spread) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _pairs(z: np.ndarray, y: np.ndarray, group: int) -> np.ndarray:
    """Differences of the features of a group's pairs, ``DRAWS`` times as many as it has rows
    of the larger label: each draw goes through all rows of that label, and through those of
    the other in an order of its own, so that every row takes part."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, z.shape[1]))
    rng, n = np.random.default_rng((5, group)), max(len(good), len(bad))
    through = lambda x: np.concatenate([np.resize(rng.permutation(x), n) for _ in range(DRAWS)])
    return z[through(good)] - z[through(bad)]


def _each(groups: DataFrame, f) -> list[np.ndarray]:
    """``f(group, x, y)`` of every group, a short vector each, in order of the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, x, y in zip(*(b.column(k).to_pylist() for k in ("g", "x", "y")), strict=True):
                out = f(g, np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(y, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([out], pa.list_(pa.float64()))], ["g", "v"])

    return [np.array(r.v) for r in sorted(groups.mapInArrow(run, "g long, v array<double>").collect(), key=lambda r: r.g)]


def fit(groups: DataFrame, l2: float = 1e-3, steps: int = 25) -> Model:
    """Bradley-Terry by Newton steps on the logistic loss of feature differences, summed over
    all groups (g, x, y); a vector of fixed size for each group reaches the driver."""
    k = 2 * N_FEATURES
    sums = lambda g, x, y: np.r_[expand(x).sum(0), len(y), (y == 0).sum()]
    total = np.sum(_each(groups, sums), axis=0)
    n, n_bad = int(total[k]), int(total[k + 1])
    centre = total[:k] / n
    spread = np.sqrt(np.sum(_each(groups, lambda g, x, y: ((expand(x) - centre) ** 2).sum(0)), axis=0) / n) + 1e-9
    w = np.zeros(k)

    def slope(g, x, y, w):
        d = _pairs((expand(x) - centre) / spread, y, g)
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        return np.r_[d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel(), len(d)]

    for _ in range(steps):
        got = np.sum(_each(groups, lambda g, x, y, w=w: slope(g, x, y, w)), axis=0)
        grad = got[:k] / got[-1] + l2 * w
        step = np.linalg.solve(got[k:-1].reshape(k, k) / got[-1] + l2 * np.eye(k), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    m = Model(centre, spread, w)
    # as many rows as are bad lie under the threshold
    at = min(max(n_bad - 1, 0), n - 2)
    m.threshold = (_smallest(groups, m, at) + _smallest(groups, m, at + 1)) / 2
    return m


def _smallest(groups: DataFrame, m: Model, at: int) -> float:
    """The strength of the row at place ``at``, from 0, of all in ascending order: counts of
    ``BINS`` ranges, narrowed until few enough strengths are left in one to be sent."""
    ends = np.array(_each(groups, lambda g, x, y: np.r_[m.strength(x).min(), m.strength(x).max()]))
    lo, hi = ends[:, 0].min(), ends[:, 1].max()
    while True:
        edges = np.linspace(lo, hi, BINS + 1)[1:-1]

        def places(x, lo=lo, hi=hi, edges=edges):
            s = m.strength(x)
            return s[(s >= lo) & (s <= hi)], (s < lo).sum(), edges

        def count(g, x, y):
            s, under, e = places(x)
            return np.r_[under, np.bincount(np.searchsorted(e, s, side="right"), minlength=BINS)]

        got = np.sum(_each(groups, count), axis=0)
        upto = got[0] + np.cumsum(got[1:])
        i = int(np.searchsorted(upto, at, side="right"))
        low, high = (lo if i == 0 else edges[i - 1]), (hi if i == BINS - 1 else edges[i])
        if (low, high) == (lo, hi) or not low < high:
            return float(low)  # no number lies between: all are equal
        if got[1 + i] <= SENT:
            break
        lo, hi = low, high

    def inside(g, x, y):
        s = m.strength(x)
        return s[(s >= low) & ((s < high) if i < BINS - 1 else (s <= high))]

    found = np.sort(np.concatenate(_each(groups, inside)))
    return float(found[at - int(upto[i] - got[1 + i])])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(*flat(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def _packed(rows: pa.Table) -> pa.Table:
    """A group of rows (g, doc_id, y, x) as one."""
    x = np.asarray(rows.column("x").combine_chunks().values).reshape(-1, N_FEATURES)
    y, ids = rows.column("y").to_numpy().astype(np.int8), rows.column("doc_id").to_numpy()
    order = np.lexsort((*x.T[::-1], ids))
    return pa.table({"g": rows.column("g").slice(0, 1), "x": pa.array([x[order].tobytes()], pa.binary()), "y": pa.array([y[order].tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all labelled texts that aren't held out. Their statistics are dealt by doc_id
    into groups of some ``GROUP`` rows; the driver gets sums over these."""
    spark = ship(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y")).where("y in (0, 1)")
    text = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # statistics before the join: they are small beside the texts
    rows = materialise(text.mapInArrow(_rows, "doc_id long, x array<double>").join(known, "doc_id"), "quality")
    count = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(count) < 2:
        forget(rows)
        return None
    n = max(1, min(-(-sum(count.values()) // GROUP), min(count.values()) // LEAST))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long")).select("g", "doc_id", "y", "x")
    groups = materialise(dealt.groupBy("g").applyInArrow(_packed, "g long, x binary, y binary"), "quality")
    model = fit(groups)
    forget(rows, groups)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(statistics(*flat(b.column("text")))) if model else np.full(b.num_rows, CUT)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
