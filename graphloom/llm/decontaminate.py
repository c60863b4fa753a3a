"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs of letters and digits. All documents are cut into passages, and
passage frequencies of hashed terms give the TF-IDF weights. A distributed randomised SVD
of the passage-term matrix (one pass for the sketch, one for the small Gram matrix) gives a
latent space; its matrices are bounded by terms and rank, never by the corpus. Windows of
every document and probes of every benchmark item meet there by cosine. That may miss some
(an item of common words is nowhere in that space), so any stretch of two lengths of an item
that holds enough of the item's rarest words is a candidate too: a common subsequence of the
share asked for must have so many of them, wherever other words stand between.
Candidates are verified on the words themselves: the longest common subsequence with the item, and with
its answer (the last sentence), in the neighbourhood of the window.

Defined results: null or empty texts and items match nothing; rows of one doc_id, or
without one, are judged each for itself and reported once for an item, with the best of
their shares; so are the texts of an item_id given several times; empty tables give an
empty result; further columns are ignored. Items are searched in blocks of about ``ITEMS``,
dealt by hash, so the benchmark may be large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, distinct, flat, materialise, release, ship
from graphloom.llm.toxicity import segments, words

TERMS = 1 << 13
RANK, EXTRA = 64, 8
#: Words of a passage, of a block, and of the windows for short and long items.
PASSAGE, BLOCK, SHORT, LONG = 48, 8, 16, 32
COSINE = 0.6
#: Shares of an item's words, and of its answer's, that must stand in a document in order.
STRONG, WEAK, ANSWER = 0.8, 0.6, 0.6
ITEMS = 4096
#: Share of passages beyond which a term weighs nothing.
COMMON = 0.005
#: Seconds of a hit of a rare word and of a verification; they steer how many rare words
#: of an item are looked for, never what is found.
HIT_COST, VERIFY_COST = 1.5e-7, 1.5e-4
#: Share of a probe's words that a candidate's window must hold to be verified.
OVERLAP = 0.4
#: Probes whose words are counted together.
GROUP = 512
#: Words that are worked on at once.
AT_ONCE = 1 << 16


def tokens(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    data, off = flat(pa.array([text], pa.string()))
    return (words(data, off)[0] >> U64(32)).astype("<u4")


def tokenised(docs: DataFrame) -> DataFrame:
    """``doc_id, words``: the hashes of each text's words in order, packed."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            out: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for seg, seg_off, first in segments(data, off, overlap=False):
                h, row = words(seg, seg_off)
                h = (h >> U64(32)).astype("<u4")
                ends = np.searchsorted(row, np.arange(len(seg_off)))
                for i in range(len(seg_off) - 1):
                    out[first + i].append(h[ends[i] : ends[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([b"".join(x) for x in out], pa.binary())], ["doc_id", "words"])
        release()

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, words binary")


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(words, offsets, first row) of about AT_ONCE words; a longer text stands alone."""
    held, at, first = [], [0], 0
    for i, x in enumerate(b.column("words")):
        w = np.frombuffer(x.as_py(), "<u4")
        held.append(w)
        at.append(at[-1] + len(w))
        if at[-1] >= AT_ONCE or i == b.num_rows - 1:
            yield np.concatenate(held), np.array(at), first
            held, at, first = [], [0], i + 1


def _starts(off: np.ndarray, size: int) -> np.ndarray:
    """Where pieces of ``size`` words start; none spans two texts."""
    return np.concatenate([np.arange(a, z, size) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)


def _parts(w: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, passage starts) of bounded pieces that never cut a passage."""
    start = _starts(off, PASSAGE)
    step = AT_ONCE // PASSAGE
    for i in range(0, len(start), step):
        lo = start[i]
        hi = start[i + step] if i + step < len(start) else len(w)
        yield (w[lo:hi] % TERMS).astype(np.int64), start[i : i + step] - lo


def _frequencies(table: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that hold each term, passages), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for b in batches:
            for w, off, _ in _chunks(b):
                for t, start in _parts(w, off):
                    passage = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(t)]))
                    df[:TERMS] += np.bincount(distinct(passage * TERMS + t) % TERMS, minlength=TERMS)
                    n += len(start)
        df[TERMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    rows = table.select("words").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1, np.int64)
    for r in rows:  # bounded: a row for each term
        df[r.term] = r.n
    return df[:TERMS], int(df[TERMS])


def _rare(t: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms that weigh something, piece of each, first term of each piece that has any)."""
    piece = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
    keep = weight[t] > 0
    t, piece = t[keep], piece[keep]
    return t, piece, np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]][: len(piece)])


def _sums(x: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` that are named, over the pieces that begin at ``first``: all
    pieces take a row at a time, the longest first; what long ones have left is added by itself."""
    n = np.diff(np.r_[first, len(rows)])
    order = np.argsort(-n, kind="stable")
    begin, n = first[order], n[order]
    some = np.take(x, rows[begin], axis=0)
    for k in range(1, int(min(n[0], PASSAGE)) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))
        some[:m] += np.take(x, rows[begin[:m] + k], axis=0)
    for i in range(int(np.searchsorted(-n, -PASSAGE))):
        some[i] += np.take(x, rows[begin[i] + PASSAGE : begin[i] + n[i]], axis=0).sum(0)
    out = np.empty_like(some)
    out[order] = some
    return out


def _summed(table: DataFrame, idf: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """A'A @ basis, or basis'A'A @ basis where ``gram`` holds, for the TF-IDF matrix A."""
    wide = basis.shape[1]
    weighted = (idf[:, None] * basis).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide if gram else TERMS, wide))
        for b in batches:
            for w, off, _ in _chunks(b):
                for t, start in _parts(w, off):
                    t, piece, first = _rare(t, start, idf)
                    if not len(t):
                        continue
                    y = _sums(weighted, t, first)
                    if gram:
                        total += y.T @ y
                        continue
                    own = np.cumsum(np.r_[False, piece[1:] != piece[:-1]])
                    order = np.argsort(t.astype(np.uint16), kind="stable")  # by radix
                    t = t[order]
                    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                    total[t[at]] += _sums(y, own[order], at)
        rows = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(total[rows, i].astype(np.float32)) for i in range(wide)]], ["row", *[f"c{i}" for i in range(wide)]])
        del total
        release()

    schema = "row long, " + ", ".join(f"c{i} float" for i in range(wide))
    sums = table.select("words").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(wide)])
    out = np.zeros((wide if gram else TERMS, wide))
    for r in sums.collect():  # bounded: a row for each term
        out[r[0]] = r[1:]
    return out if gram else idf[:, None] * out


def latent_space(table: DataFrame, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rank): weights that map counts of terms to latent coordinates, and the share
    of words that each term is about. Terms of many passages say nothing about one and weigh
    nothing there."""
    df, n = _frequencies(table)
    idf = np.where(df > max(COMMON * n, 20), 0.0, np.log((n + 1) / (df + 1)) + 0.1)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(_summed(table, idf, rng.standard_normal((TERMS, rank + EXTRA)), False))
    value, turn = np.linalg.eigh(_summed(table, idf, q, True))
    basis = q @ turn[:, np.argsort(-value)[:rank]]
    return (idf[:, None] * basis).astype(np.float32), df / max(n * PASSAGE, 1)


def places(a: list[int]) -> dict[int, int]:
    """The places of each word, in bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs(a: list[int], b: list[int], where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of the table at a time in bits;
    ``where`` may hold the places of the words of ``a``."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rarest(words: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, int]:
    """(rare words of an item, how many of its stretch must be such). A common subsequence of
    at least ``WEAK`` of the n words, so of m at least, leaves out n - m of them: of any
    n - m + c words it has c or more. The c with the least expected work is taken."""
    n = len(words)
    m = max(1, int(np.ceil(WEAK * n - 1e-9)))
    order = words[np.argsort(share[(words % TERMS).astype(np.int64)], kind="stable")]
    best = None
    for c in range(1, m + 1):
        some = np.unique(order[: n - m + c])
        rate = float(share[(some % TERMS).astype(np.int64)].sum())
        often = 6 * n * rate  # in a stretch of 2n words; words of a language come together
        term, under = np.exp(-min(often, 700.0)), 0.0
        for k in range(1, c):
            under += term
            term *= often / k
        cost = rate * (HIT_COST + VERIFY_COST * max(0.0, 1.0 - under) / c)
        if best is None or cost < best[0]:
            best = (cost, some, c)
    return best[1], best[2]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


_LOW = 1 << 18


def _some(known: np.ndarray) -> np.ndarray:
    """A table over the low bits of words: a known word that has them, or -1."""
    out = np.full(_LOW, -1, np.int32)
    out[known.astype(np.int64) & (_LOW - 1)] = np.arange(len(known))
    return out


def _places_of(w: np.ndarray, known: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that are known, which they are); ``known`` is sorted."""
    word = np.take(some, w & np.uint32(_LOW - 1))
    at = np.flatnonzero(word >= 0)
    if not len(at):
        return at, at
    word, own = word[at].astype(np.int64), w[at]
    other = np.flatnonzero(known[word] != own)  # of several known words the table has one
    word[other] = np.minimum(np.searchsorted(known, own[other]), len(known) - 1)
    hit = known[word] == own
    return at[hit], word[hit]


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three bits, in every bit at once."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers in bits, the lowest first, of as many bits each: their sums, of one more."""
    out, carry = [a[0] ^ b[0]], a[0] & b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        one, carry = _three(x, y, carry)
        out.append(one)
    return [*out, carry]


def _eight(x: list[np.ndarray]) -> list[np.ndarray]:
    """How many of eight bits are set, in four bits."""
    one, two = _three(*x[:3])
    other, more = _three(*x[3:6])
    one, last = _three(one, other, x[6])
    one, most = one ^ x[7], one & x[7]
    twos, four = _three(two, more, last)
    twos, other = twos ^ most, twos & most
    return [one, twos, four ^ other, four & other]


class Members:
    """Counts, for some probes of one size at once, how many words of a window each has: a
    word is a row of bits with one for each probe, and rows are added bit by bit."""

    def __init__(self, size: int, words_: list[np.ndarray]):
        self.size, self.n = size, len(words_)
        both = np.concatenate(words_)
        probe = np.repeat(np.arange(self.n), [len(x) for x in words_])
        self.known, word = np.unique(both, return_inverse=True)
        self.some = _some(self.known)
        bits = np.zeros((len(self.known) + 1, 64 * -(-self.n // 64)), bool)  # the last row: no probe's word
        bits[word, probe] = True
        self.rows = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        need = np.ceil(OVERLAP * np.array([len(x) for x in words_])).astype(np.int64)
        # with what a count must be increased for a carry beyond its last bit
        self.top = (size // BLOCK).bit_length() + 3
        less = np.zeros((self.top, bits.shape[1]), bool)
        less[:, : self.n] = ((1 << self.top) - need)[None, :] >> np.arange(self.top)[:, None] & 1
        self.less = np.packbits(less, axis=1, bitorder="little").view("<u8")

    def enough(self, w: np.ndarray, slot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, probe) of all windows, from that block on, with enough of a probe's words;
        ``slot`` has the place of each word in blocks that are all full."""
        n = len(row)
        at, word = _places_of(w, self.known, self.some)
        which = np.full(n * BLOCK, len(self.known), np.int64)
        which[slot[at]] = word
        which = which.reshape(n, BLOCK)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        beyond = self.size // BLOCK - 1
        step = max(256, (1 << 14) // self.rows.shape[1])  # what is added at once stays in the cache
        for lo in range(0, n, step):
            own = row[lo : lo + step + beyond]
            count = _eight([np.take(self.rows, which[lo : lo + step + beyond, k], axis=0) for k in range(BLOCK)])
            k = 1
            while k <= beyond:  # a count of twice as many blocks, within a text
                same = np.zeros(len(own), bool)
                same[:-k] = own[k:] == own[:-k]
                mask = np.where(same, ~U64(0), U64(0))[:, None]
                next_ = []
                for x in count:
                    y = np.zeros_like(x)
                    np.bitwise_and(x[k:], mask[:-k], out=y[:-k])
                    next_.append(y)
                count = _added(count, next_)
                k *= 2
            carry = count[0] & self.less[0]
            for x, y in zip(count[1:], self.less[1:], strict=True):
                carry = (x & y) | (carry & (x | y))
            carry = carry[:step]
            hit = np.flatnonzero(carry.any(axis=1))
            if len(hit):
                b, p = np.nonzero(np.unpackbits(carry[hit].view(np.uint8), axis=1, bitorder="little"))
                found.append((lo + hit[b], p))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(2))


class Probes:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], space: np.ndarray, share: np.ndarray):
        self.ids, self.words, self.answers = [], [], []
        vectors: dict[int, list[np.ndarray]] = {SHORT: [], LONG: []}
        owners: dict[int, list[int]] = {SHORT: [], LONG: []}
        probes: dict[int, list[np.ndarray]] = {SHORT: [], LONG: []}
        for item_id, text in items:
            w = tokens(text)
            if not len(w):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(w.tolist())
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if len(tokens(s))]
            self.answers.append(tokens(sentences[-1]).tolist() if sentences else w.tolist())
            size = SHORT if len(w) < LONG - 4 else LONG
            last = max(0, len(w) - size)
            for at in sorted({*range(0, last + 1, size // 2), last}):
                vectors[size].append(space[(w[at : at + size] % TERMS).astype(np.int64)].sum(0))
                owners[size].append(k)
                probes[size].append(w[at : at + size])
        self.probes = {s: [np.unique(x) for x in texts] for s, texts in probes.items()}
        self._members: dict[int, list[Members]] = {}
        self.weight = np.abs(space).sum(1)
        self.where, self.answer_where = [places(x) for x in self.words], [places(x) for x in self.answers]
        rare = [rarest(np.array(x, "<u4"), share) for x in self.words]
        self.need = np.array([c for _, c in rare], np.int64)
        self.within = np.array([2 * len(x) for x in self.words], np.int64)
        both = np.concatenate([x for x, _ in rare]) if rare else np.zeros(0, "<u4")
        item = np.repeat(np.arange(len(rare)), [len(x) for x, _ in rare])
        order = np.argsort(both, kind="stable")
        self.rare, first = np.unique(both[order], return_index=True)
        self.rare_item, self.rare_at = item[order].astype(np.int16), np.r_[first, len(both)]
        self.matrix = {s: _unit(np.array(v)).astype(np.float32).T if v else np.zeros((space.shape[1], 0), np.float32) for s, v in vectors.items()}
        self.rows = {s: np.ascontiguousarray(m.T) for s, m in self.matrix.items()}
        self.some_rare = _some(self.rare)
        self.owner = {s: np.array(o, np.int64) for s, o in owners.items()}

    def candidates(self, w: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the window, item, cosine) where a window is near a probe in the
        latent space, or where enough rare words of an item stand."""
        both = self.latent(w, off, space), self.counted(w, off)
        return tuple(np.concatenate([f[i] for f in both]) for i in range(3))

    def members(self) -> dict[int, list[Members]]:
        """The probes of each size in groups; each worker makes its own."""
        if not self._members:
            self._members = {s: [Members(s, x[i : i + GROUP]) for i in range(0, len(x), GROUP)] for s, x in self.probes.items()}
        return self._members

    def latent(self, w: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the window, item, cosine) where a window holds enough of a probe's
        words and its cosine is enough. The words are counted first, for all windows and
        probes; only the windows that pass are summed in the latent space."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        start = _starts(off, BLOCK)
        row = np.searchsorted(off, start, side="right") - 1
        short = BLOCK - np.diff(np.r_[start, len(w)])
        slot = np.arange(len(w)) + np.repeat(np.cumsum(short) - short, BLOCK - short)
        for size, groups in self.members().items() if len(start) else ():
            for g, group in enumerate(groups):
                at, probe = group.enough(w, slot, row)
                if not len(at):
                    continue
                probe += g * GROUP
                some = distinct(at)
                window = self.windows(w, off, start, row, some, size, space)
                length = np.maximum(np.linalg.norm(window, axis=1), 1e-9)
                for i in range(0, len(at), AT_ONCE):
                    a, p = at[i : i + AT_ONCE], probe[i : i + AT_ONCE]
                    own = np.searchsorted(some, a)
                    near = np.einsum("ij,ij->i", window[own], self.rows[size][p]) / length[own]
                    enough = near >= COSINE
                    found.append((start[a[enough]], self.owner[size][p[enough]], near[enough]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def windows(self, w: np.ndarray, off: np.ndarray, start: np.ndarray, row: np.ndarray, some: np.ndarray, size: int, space: np.ndarray) -> np.ndarray:
        """Latent coordinates of the windows that begin at some blocks; they end with their text."""
        near = some[:, None] + np.arange(size // BLOCK)
        same = row[np.minimum(near, len(row) - 1)] == row[some][:, None]
        same &= near < len(row)
        blocks = distinct(near[same])
        place = start[blocks][:, None] + np.arange(BLOCK)
        inside = place < off[row[blocks] + 1][:, None]
        n = inside.sum(1)
        t, piece, first = _rare((w[place[inside]] % TERMS).astype(np.int64), np.cumsum(n) - n, self.weight)
        sums = np.zeros((len(blocks), space.shape[1]), np.float32)
        if len(t):
            sums[piece[first]] = _sums(space, t, first)
        out = np.zeros((len(some), space.shape[1]), np.float32)
        for k in range(size // BLOCK):
            out[same[:, k]] += sums[np.searchsorted(blocks, near[same[:, k], k])]
        return out

    def counted(self, w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ends of all runs of as many rare words of an item as it needs, within twice
        its length: nothing that has a long enough common subsequence there is left out."""
        z = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not len(w) or not len(self.rare):
            return z
        at, word = _places_of(w, self.rare, self.some_rare)
        lo, hi = self.rare_at[word], self.rare_at[word + 1]
        n = hi - lo
        item = self.rare_item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        item, at = item[order].astype(np.int64), np.repeat(at, n)[order]
        k = np.arange(len(item))
        end = k + self.need[item] - 1
        k, end = k[end < len(item)], end[end < len(item)]
        near = (item[end] == item[k]) & (at[end] - at[k] < self.within[item[k]])
        k, end = k[near], end[near]
        same = np.searchsorted(off, at[k], side="right") == np.searchsorted(off, at[end], side="right")
        k, end = k[same], end[same]
        return np.r_[at[k], at[end]], np.r_[item[k], item[k]], np.zeros(2 * len(k), np.float32)

    def verify(self, doc: np.ndarray, at: np.ndarray, item: int) -> tuple[float, float]:
        """Best (share of the item, share of its answer) around windows at ``at``."""
        own, answer, where = self.words[item], self.answers[item], self.where[item]
        n = len(own)
        best = (False, 0.0, 0.0)  # what is accepted goes before a greater share that isn't
        reach: list[list[int]] = []
        for a in np.unique(at).tolist():
            lo, hi = max(0, a - 2 * n), min(len(doc), a + LONG + 2 * n)
            if reach and lo <= reach[-1][1]:
                reach[-1][1] = hi
            else:
                reach.append([lo, hi])
        for lo, hi in reach:
            step = max(1, n // 4)
            # other words can't be common ones
            known = [(i, x) for i, x in enumerate(doc[lo:hi].tolist(), lo) if x in where]
            if len(known) < WEAK * n or lcs(own, [x for _, x in known], where) < WEAK * n:
                continue  # no part of it can have more
            for x in range(lo, max(lo + 1, hi - n), step):  # no part longer than two items
                end = min(hi, x + 2 * n)
                part = [word for i, word in known if x <= i < end]
                if len(part) < WEAK * n:
                    continue
                share = lcs(own, part, where) / n
                if share >= WEAK:
                    of_answer = lcs(answer, part, self.answer_where[item]) / max(1, len(answer))
                    best = max(best, (share >= STRONG or of_answer >= ANSWER, share, of_answer))
        return best[1:]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, share, answer_share`` for every document that holds an
    item of the benchmark, or most of one in order."""
    spark = ship(docs.sparkSession)
    table = materialise(tokenised(docs), "words")
    space, share = latent_space(table)
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double"
    items = items.distinct()
    blocks = -(-items.count() // ITEMS)
    out = None
    for k in range(blocks):  # about ITEMS items each, dealt by hash
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = _search(table, Probes([(r.item_id, r.text) for r in block], space, share), space, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct(((F.col("share") >= STRONG) | (F.col("answer_share") >= ANSWER)).alias("sure"), "share", "answer_share", "cosine"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.share", "b.answer_share")


def _search(table: DataFrame, probes: Probes, space: np.ndarray, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id")
            out = []
            for w, off, first in _chunks(b):
                hits = []
                for lo, hi in _slices(off):
                    at, item, cos = probes.candidates(w[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], space)
                    at = at + off[lo]
                    row = np.searchsorted(off, at, side="right") - 1
                    hits.append((row, item, at, cos))
                row, item, at, cos = (np.concatenate([h[k] for h in hits]) for k in range(4))
                order = np.lexsort((item, row))
                row, item, at, cos = row[order], item[order], at[order], cos[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])][: len(row)])
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for x, y in zip(new.tolist(), [*new[1:].tolist(), len(row)], strict=False):
                    r, i = int(row[x]), int(item[x])
                    share, answer = probes.verify(w[off[r] : off[r + 1]], at[x:y] - off[r], i)
                    if share >= STRONG or (share >= WEAK and answer >= ANSWER):
                        key = (r, probes.ids[i])
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, answer, float(cos[x:y].max())))
                out += [(first + r, i, c, s, a) for (r, i), (s, a, c) in sorted(best.items())]
            at, item, cos, share, answer = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.float64())],
                ["doc_id", "item_id", "cosine", "share", "answer_share"],
            )
        release()

    return table.mapInArrow(run, schema)


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about AT_ONCE words."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + AT_ONCE, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
