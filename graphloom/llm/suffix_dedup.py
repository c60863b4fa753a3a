"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

A byte goes if a string of ``length`` bytes around it also starts earlier: in a smaller
doc_id, or earlier in the same document.

Not every suffix is sorted. In each window of ``length`` bytes the 16-byte token with the
least hash is its anchor, so equal windows have equal anchors at equal places, and only
suffixes that start at anchors matter; an anchor also carries the bytes before it that its
windows reach. Four passes:

1. Packed hashes of anchors are dealt by hash. Anchors whose token occurs once in the corpus
   are dropped; of those with equal tokens and equal surroundings (two independent 64-bit hashes) all
   but the first are settled; what is left comes back as requests.
2. The documents answer the requests with the bytes around those anchors.
3. The suffixes are dealt by their leading 16 bytes into ranges between sampled splitters;
   equal leading bytes never straddle a boundary, so that suffixes are compared across
   boundaries by sharing a side of it. A bucket sorts its windows by multikey quicksort on
   8-byte tokens: in every round only those still tied with another are split by their
   next token. Of equal windows the first stays.
4. The documents drop what was covered.

Tokens that many sampled documents share are hot: their windows travel one by one and are
dealt by their whole content, so that no bucket grows with them. The sample only steers
where work is done, never what is found.

Defined results: null text is empty and loses nothing; texts shorter than ``length`` lose
nothing; rows of one doc_id count as one document, so repeated rows don't remove each
other; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.common import U64, flat, partitions, prefix_sums, release, row_slices, ship, span_hash

LENGTH = 100
TOKEN = 16
SEGMENT = 1 << 18
#: Low bits of a sort key that hold the place in a piece; more than twice SEGMENT fits.
PLACE_BITS = 24
#: Documents in the sample that steers, and in how many of them a token must be to be hot.
SAMPLE_DOCS = 512
HOT_DOCS = 5
#: Bytes of suffixes that a bucket sorts at once.
SORT_BYTES = 2 << 20

_LEAST = -(1 << 63)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(token hash, position, bytes before, bytes behind, hash of all these) for each anchor:
    the windows that it stands for start from ``before`` bytes in front of it, and the last
    of them ends ``behind`` bytes further on. Positions are in ``data``."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z, z.astype(U64)
    bits = U64(PLACE_BITS)
    s = prefix_sums(data)
    at = np.arange(n - TOKEN + 1)
    h = span_hash(s, at, at + TOKEN)
    key = (h >> bits << bits) | at.astype(U64)
    width, span, low = length - TOKEN + 1, 1, key
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    ends = np.repeat(off[1:], np.diff(off))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + length <= ends)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z, z.astype(U64)
    anchor = (low[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(start) - 1]
    a = anchor[first]
    lo, hi = start[first], start[last] + length
    return h[a], a, a - lo, hi - a, span_hash(prefix_sums(data, 1), lo, hi, 1)


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, first byte in that row) so that every window of every
    text is in exactly one piece."""
    for lo, hi in row_slices(off, SEGMENT):
        if hi - lo > 1 or off[hi] - off[lo] <= 2 * SEGMENT:
            yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, 0
            continue
        size = int(off[hi] - off[lo])
        for at in range(0, max(1, size - length + 1), SEGMENT):
            end = min(size, at + SEGMENT + length - 1)
            yield data[off[lo] + at : off[lo] + end], np.array([0, end - at]), lo, at


_PACK = {"kg": "<u8", "sh": "<u8", "db": "<i4", "did": "<i8", "th": "<i8", "pos": "<u4", "l": "u1", "r": "u1", "hot": "u1"}


def _packed(to: np.ndarray, cols: dict[str, np.ndarray], name: str = "to", spans: list | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each value of ``to``, its entries packed column by column."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order])) + 1
    parts = np.split(order, cut)
    arrays = [pa.array(to[[p[0] for p in parts]], pa.int32())]
    names = [name]
    for k, v in cols.items():
        v = v.astype(_PACK[k])
        arrays.append(pa.array([v[p].tobytes() for p in parts], pa.binary()))
        names.append(k)
    if spans is not None:
        arrays.append(pa.array([b"".join([spans[i] for i in p]) for p in parts], pa.binary()))
        names.append("span")
    yield pa.RecordBatch.from_arrays(arrays, names)


def _unpacked(rows, names) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(x.as_py() for x in rows.column(k)), _PACK[k]) for k in names}


def _sort_windows(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the windows at ``start`` within their groups, token by token of
    8 bytes; returns (window, class) of those that equal another one."""
    word = np.zeros(max(0, len(buf) - 7), U64)
    for t in range(8):
        word |= buf[t : t + len(word)].astype(U64) << U64(56 - 8 * t)
    idx, cls = np.arange(len(start)), group
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] != length - 8:
        offsets.append(length - 8)
    for o in [None, *offsets]:
        if not len(idx):
            break
        if o is None:
            order = np.argsort(cls, kind="stable")
            idx, cls = idx[order], cls[order]
            new = np.r_[True, cls[1:] != cls[:-1]]
        else:
            w = word[start[idx] + o]
            order = np.lexsort((w, cls))
            idx, cls, w = idx[order], cls[order], w[order]
            new = np.r_[True, (cls[1:] != cls[:-1]) | (w[1:] != w[:-1])]
        cls = np.cumsum(new)
        many = np.bincount(cls)[cls] > 1
        idx, cls = idx[many], cls[many]
    return idx, cls


def _later(cls: np.ndarray, did: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which members of the classes stand later than the first of theirs."""
    order = np.lexsort((pos, did, cls))
    c, d, p = cls[order], did[order], pos[order]
    new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    head = np.repeat(new, np.diff(np.r_[new, len(c)]))
    out = np.zeros(len(cls), bool)
    out[order] = (d > d[head]) | (p > p[head])
    return out


def _same_spans(e: dict[str, np.ndarray], spans: list[bytes]) -> np.ndarray:
    """A class for each entry: equal bytes with the anchor at the same place."""
    seen: dict[tuple[int, bytes], int] = {}
    return np.fromiter((seen.setdefault(k, len(seen)) for k in zip(e["l"].tolist(), spans, strict=True)), np.int64, len(spans))


def _covers(db, did, th, lo, hi) -> Iterator[pa.RecordBatch]:
    yield from _packed(db, {"did": did, "th": th, "lo": lo, "hi": hi}, "db")


_PACK |= {"lo": "<u4", "hi": "<u4"}


def _settle(e: dict[str, np.ndarray], spans: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """The covered intervals that the suffixes of a bucket give."""
    if not spans:
        return
    cls = _same_spans(e, spans)
    pos, did = e["pos"].astype(np.int64), e["did"]
    late = _later(cls, did, pos)
    lo, hi = pos - e["l"], pos + e["r"]
    yield from _covers(e["db"][late], did[late], e["th"][late], lo[late], hi[late])
    order = np.lexsort((pos, did, cls))
    reps = order[np.r_[True, cls[order][1:] != cls[order][:-1]]]
    lead = np.array([spans[i][l : l + TOKEN] for i, l in zip(reps.tolist(), e["l"][reps].tolist(), strict=True)], f"S{TOKEN}")
    order = np.argsort(lead, kind="stable")
    reps, lead = reps[order], lead[order]
    new = np.r_[True, lead[1:] != lead[:-1]]
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    reps, group = reps[many], group[many]
    if not len(reps):
        return
    size = np.fromiter((len(spans[i]) for i in reps), np.int64, len(reps))
    # whole groups, about SORT_BYTES at once
    block = np.cumsum(size) // SORT_BYTES
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    block = np.repeat(block[first], np.diff(np.r_[first, len(reps)]))
    found = []
    for x in np.unique(block):
        own = block == x
        r, g, sz = reps[own], group[own], size[own]
        buf = np.frombuffer(b"".join([spans[i] for i in r]), np.uint8)
        at = np.r_[0, np.cumsum(sz)[:-1]]
        left = e["l"][r].astype(np.int64)
        count = sz - length + 1
        who = np.repeat(np.arange(len(r)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # window number in its span
        idx, same = _sort_windows(buf, at[who] + step, g[who] * 256 + (left[who] - step), length)
        p = pos[r[who[idx]]] - left[who[idx]] + step[idx]
        w = r[who[idx]]
        late = _later(same, did[w], p)
        found.append((w[late], p[late]))
    w, p = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    if not len(w):
        return
    order = np.lexsort((p, w))
    w, p = w[order], p[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(w) - 1]
    who = w[first]
    yield from _covers(e["db"][who], did[who], e["th"][who], p[first], p[last] + length)


def _split(span: bytes, size: np.ndarray) -> list[bytes]:
    at = np.r_[0, np.cumsum(size)].tolist()
    return [span[at[i] : at[i + 1]] for i in range(len(size))]


COVER = "db int, did binary, th binary, lo binary, hi binary"
REQUEST = "db int, did binary, th binary, pos binary, l binary, r binary, hot binary, lo binary, hi binary"
ENTRY = "to int, db binary, did binary, th binary, pos binary, l binary, r binary, span binary, lo binary, hi binary"


def _steer(docs: DataFrame, length: int, sample_docs: int, hot_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, hot token hashes) from a bounded sample of documents."""
    # thinned by hash first, so that the tasks together send about ``sample_docs`` texts
    place = F.pmod(F.xxhash64("did", "th"), F.lit(1 << 30))
    share = min(1.0, 1.5 * sample_docs / max(1, docs.count()))
    picked = docs.where(place <= int(share * (1 << 30))).orderBy(place, "did").limit(sample_docs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            for seg, seg_off, first, _ in _pieces(data, off, length):
                h, a, _, _, _ = anchors(seg, seg_off, length)
                row = np.searchsorted(seg_off, a, side="right") - 1 + first
                pick = np.arange(0, len(a), max(1, len(a) // 4096))
                lead = [seg[i : i + TOKEN].tobytes() for i in a[pick]]
                yield pa.RecordBatch.from_arrays([pa.array([lead], pa.list_(pa.binary())), pa.array([np.unique(np.column_stack([h.view(np.int64), row]), axis=0)[:, 0].tolist()], pa.list_(pa.int64()))], ["lead", "kg"])

    rows = picked.mapInArrow(look, "lead array<binary>, kg array<long>").collect()
    lead = np.sort(np.array([bytes(x) for r in rows for x in r.lead], f"S{TOKEN}"))
    kg, count = np.unique(np.array([x for r in rows for x in r.kg], np.int64).view(U64), return_counts=True)
    cuts = lead[[i * len(lead) // n for i in range(1, n)]] if len(lead) else lead
    return np.unique(cuts), kg[count >= hot_docs]


def deduplicate(docs: DataFrame, length: int = LENGTH, sample_docs: int = SAMPLE_DOCS, hot_docs: int = HOT_DOCS, in_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (all its columns) with ``kept`` (the bytes that stay), and
    ``removed``, the maximal removed runs as packed unsigned 32-bit (start, end) pairs.
    A table's own columns of these two names give way to them. ``in_text``: the same rows, all
    their columns, with what stays as their text instead, without characters that are cut
    apart; a null text stays null."""
    spark = ship(docs.sparkSession)
    n = partitions(spark)
    columns = [c for c in docs.columns if c != "text" and (in_text or c not in ("kept", "removed"))]
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("did"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    whole = whole.select(F.pmod(F.xxhash64("did"), F.lit(2 * n)).cast("int").alias("db"), "did", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text", "row")
    slim = whole.select("db", "did", "th", "text")
    cuts, hot = _steer(slim, length, sample_docs, hot_docs, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            ids = {k: np.asarray(b.column(k)) for k in ("db", "did", "th")}
            for seg, seg_off, first, shift in _pieces(data, off, length):
                kg, a, l, r, sh = anchors(seg, seg_off, length)
                if not len(a):
                    continue
                row = np.searchsorted(seg_off, a, side="right") - 1
                e = {"kg": kg, "sh": sh, **{k: v[row + first] for k, v in ids.items()}, "pos": a - seg_off[row] + shift, "l": l, "r": r}
                is_hot = np.isin(kg, hot)
                e["hot"] = is_hot
                # what is hot needs no count; it goes on by its document
                to = np.where(is_hot, e["db"] + n, (kg >> U64(33)).astype(np.int64) % n).astype(np.int32)
                yield from _packed(to, e)
        release()

    keys = ["did", "th", "pos", "l", "r", "hot"]
    names = ["kg", "sh", "db", *keys]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            is_hot = np.asarray(b.column("to")) >= n
            if is_hot.any():
                e = _unpacked(b.filter(pa.array(is_hot)), names)
                yield from _as(_packed(e["db"], {k: e[k] for k in keys}, "db"), _REQUEST)
            parts.append(b.filter(pa.array(~is_hot)))
        if parts:
            e = _unpacked(pa.Table.from_batches(parts), names)
            _, back, times = np.unique(e["kg"], return_inverse=True, return_counts=True)
            many = times[back] > 1
            e = {k: v[many] for k, v in e.items()}
            # equal token, equal surroundings: copies, of which the first stays
            order = np.lexsort((e["pos"], e["did"], e["l"], e["sh"], e["kg"]))
            e = {k: v[order] for k, v in e.items()}
            new = np.r_[True, (e["kg"][1:] != e["kg"][:-1]) | (e["sh"][1:] != e["sh"][:-1]) | (e["l"][1:] != e["l"][:-1])][: len(order)]
            pos = e["pos"].astype(np.int64)
            late = _later(np.cumsum(new), e["did"], pos)
            lo, hi = pos - e["l"], pos + e["r"]
            yield from _as(_covers(e["db"][late], e["did"][late], e["th"][late], lo[late], hi[late]), _REQUEST)
            # other surroundings of one token: their windows are to be compared
            group = np.cumsum(np.r_[True, e["kg"][1:] != e["kg"][:-1]][: len(order)])
            some = new & (np.bincount(group[new], minlength=(group[-1] if len(group) else 0) + 1)[group] > 1)
            e = {k: v[some] for k, v in e.items()}
            yield from _as(_packed(e["db"], {k: e[k] for k in keys}, "db"), _REQUEST)
            del e
        release()

    requests = slim.mapInArrow(scan, "to int, " + ", ".join(f"{k} binary" for k in names)).repartition(n, "to").mapInArrow(count, REQUEST)

    def answer(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        told = asked.filter(pc.is_valid(asked.column("lo")))  # already settled
        out += told.select(["db", "did", "th", "lo", "hi"]).to_batches()
        asked = asked.filter(pc.is_null(asked.column("lo")))
        if asked.num_rows and texts.num_rows:
            where: dict[tuple[int, int], pa.Scalar] = {}
            for d, t, x in zip(texts.column("did").to_pylist(), texts.column("th").to_pylist(), texts.column("text"), strict=True):
                where.setdefault((d, t), x)
            e = _unpacked(asked, keys)
            e["db"] = np.full(len(e["did"]), asked.column("db")[0].as_py(), np.int32)
            order = np.lexsort((e["pos"], e["th"], e["did"]))
            e = {k: v[order] for k, v in e.items()}
            spans, last, raw = [], None, b""
            for d, t, p, l, r in zip(*(e[k].tolist() for k in ("did", "th", "pos", "l", "r")), strict=True):
                if (d, t) != last:
                    last, raw = (d, t), (where[d, t].as_py() or "").encode("utf-8")
                spans.append(raw[p - l : p + r])
            cls = _same_spans(e, spans)
            pos = e["pos"].astype(np.int64)
            late = _later(cls, e["did"], pos)
            out += list(_covers(e["db"][late], e["did"][late], e["th"][late], pos[late] - e["l"][late], pos[late] + e["r"][late]))
            order = np.lexsort((pos, e["did"], cls))
            reps = order[np.r_[True, cls[order][1:] != cls[order][:-1]]] if len(order) else order
            cool = reps[e["hot"][reps] == 0]
            lead = np.array([spans[i][l : l + TOKEN] for i, l in zip(cool.tolist(), e["l"][cool].tolist(), strict=True)], f"S{TOKEN}")
            to = np.searchsorted(cuts, lead, side="right").astype(np.int32)
            sent = ("db", "did", "th", "pos", "l", "r")
            out += list(_packed(to, {k: e[k][cool] for k in sent}, "to", [spans[i] for i in cool]))
            warm = reps[e["hot"][reps] == 1]
            if len(warm):  # window by window, dealt by their whole content
                seen: dict[bytes, tuple] = {}
                late_w = []
                for i in warm[np.lexsort((pos[warm], e["did"][warm]))].tolist():
                    d, t, p0 = int(e["did"][i]), int(e["th"][i]), int(pos[i]) - int(e["l"][i])
                    for k in range(len(spans[i]) - length + 1):
                        w = spans[i][k : k + length]
                        got = seen.setdefault(w, (d, t, p0 + k))
                        if got[0] != d or got[2] != p0 + k:
                            late_w.append((d, t, p0 + k))
                if late_w:
                    d, t, p = (np.array(x, np.int64) for x in zip(*late_w, strict=True))
                    new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)]
                    a = np.flatnonzero(new)
                    z = np.r_[a[1:] - 1, len(d) - 1]
                    out += list(_covers(np.full(len(a), e["db"][0], np.int32), d[a], t[a], p[a], p[z] + length))
                spans_w = list(seen)
                d, t, p = (np.array(x, np.int64) for x in zip(*seen.values(), strict=True))
                buf = np.frombuffer(b"".join(spans_w), np.uint8)
                at = np.arange(len(spans_w)) * length
                to = ((span_hash(prefix_sums(buf), at, at + length) >> U64(33)).astype(np.int64) % n + n).astype(np.int32)
                z = np.zeros(len(spans_w), np.int64)
                out += list(_packed(to, {"db": z + e["db"][0], "did": d, "th": t, "pos": p, "l": z, "r": z + length}, "to", spans_w))
        tables = []
        for b in out:
            if "lo" in b.schema.names:  # passes through the next step
                to = pa.array([-1 - x for x in b.column("db").to_pylist()], pa.int32())
                b = pa.RecordBatch.from_arrays([to, *[b.column(k) for k in ("did", "th", "lo", "hi")]], ["to", "did", "th", "lo", "hi"])
            tables += [pa.Table.from_batches([x]) for x in _as([b], _ENTRY)]
        release()
        return pa.concat_tables(tables) if tables else _ENTRY.empty_table()

    entries = whole.groupBy("db").cogroup(requests.groupBy("db")).applyInArrow(answer, ENTRY)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            to = b.column("to").to_pylist()
            past = [i for i, x in enumerate(to) if x < 0]
            if past:
                c = b.take(pa.array(past))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - to[i] for i in past], pa.int32()), *[c.column(k) for k in ("did", "th", "lo", "hi")]], ["db", "did", "th", "lo", "hi"])
            for i, x in enumerate(to):
                if x >= 0:
                    held.setdefault(x, []).append(b.slice(i, 1))
        for parts in held.values():
            rows = pa.Table.from_batches(parts)
            e = _unpacked(rows, ("db", "did", "th", "pos", "l", "r"))
            spans = _split(b"".join(x.as_py() for x in rows.column("span")), e["l"].astype(np.int64) + e["r"])
            yield from _settle(e, spans, length)
        held = {}
        release()

    covers = entries.repartition(n, "to").mapInArrow(settle, COVER)
    result = StructType([*(docs.schema[c] for c in columns), StructField("text", StringType())])
    if not in_text:
        result = result.add("kept", "binary").add("removed", "binary")

    def drop(texts: pa.Table, gone: pa.Table) -> pa.Table:
        e = _unpacked(gone, ("did", "th", "lo", "hi")) if gone.num_rows else {k: np.zeros(0, np.int64) for k in ("did", "th", "lo", "hi")}
        order = np.lexsort((e["lo"], e["th"], e["did"]))
        e = {k: v[order].astype(np.int64) for k, v in e.items()}
        new = np.flatnonzero(np.r_[True, (e["did"][1:] != e["did"][:-1]) | (e["th"][1:] != e["th"][:-1])]) if len(order) else order
        ends = np.r_[new[1:], len(order)]
        at = {(int(e["did"][i]), int(e["th"][i])): (int(i), int(j)) for i, j in zip(new, ends, strict=False)}
        kept, removed = [], []
        for d, t, x in zip(texts.column("did").to_pylist(), texts.column("th").to_pylist(), texts.column("text"), strict=True):
            raw = (x.as_py() or "").encode("utf-8")
            runs: list[list[int]] = []
            if (d, t) in at:
                i, j = at[d, t]
                lo, hi = e["lo"][i:j], np.maximum.accumulate(e["hi"][i:j])
                first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                last = np.r_[first[1:] - 1, len(lo) - 1]
                runs = [[int(a), int(b)] for a, b in zip(lo[first], hi[last], strict=True)]
            out, last_end = [], 0
            for a, b in runs:
                out.append(raw[last_end:a])
                last_end = b
            kept.append(b"".join([*out, raw[last_end:]]) if runs else raw)
            removed.append(np.array(runs, "<u4").tobytes())
        release()
        row = texts.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        if in_text:
            given = texts.column("text").is_valid().to_pylist()
            whole = [k.decode("utf-8", "ignore") if v else None for k, v in zip(kept, given, strict=True)]
            return pa.Table.from_arrays([*[row.field(i) for i in range(len(columns))], pa.array(whole, pa.string())], names=[*columns, "text"])
        return pa.Table.from_arrays([*[row.field(i) for i in range(len(columns))], texts.column("text"), pa.array(kept, pa.binary()), pa.array(removed, pa.binary())], names=[*columns, "text", "kept", "removed"])

    return whole.groupBy("db").cogroup(covers.groupBy("db")).applyInArrow(drop, result)


def _as(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batches with all columns of ``schema``, null where they have none."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(f.name) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in schema], schema=schema)


_REQUEST = pa.schema([("db", pa.int32()), *[(k, pa.binary()) for k in ("did", "th", "pos", "l", "r", "hot", "lo", "hi")]])
_ENTRY = pa.schema([("to", pa.int32()), *[(k, pa.binary()) for k in ("db", "did", "th", "pos", "l", "r", "span", "lo", "hi")]])


def digests(done: DataFrame) -> DataFrame:
    """Counts and the digest of what ``deduplicate`` returns."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        (F.octet_length("removed") / 8).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
