"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit for each bit position that is set in over half of the hashes of
the text's word shingles. To find fingerprints at most r bits apart, the 64 bits are cut
into r // 2 + 1 segments: of any such pair, one segment differs by at most one bit. Each
segment is indexed once for every bit of it, with that bit deleted; equal variants bring
candidates together, and the whole fingerprints verify them. Only distinct fingerprints
are indexed, and a bucket returns links that span its groups rather than all pairs.

Defined results: null or empty text (no words) has the fingerprint zero, linked like any
other; fewer words than a shingle are hashed as one; repeated rows share a class; a row
without a doc_id gets a fingerprint and links nothing by itself but is linked; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import U64, distinct, filter_places, flat, id_filter, in_filter, materialise, mix, partitions, powers, prefix_sums, release, row_of, row_slices, ship, span_hash, spans
from graphloom.llm.graph import components

SEED = 42
BLOCK = 1 << 16
#: Buckets up to this size are compared pair by pair, larger ones by looking up neighbours.
PAIRWISE = 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    lo = np.r_[0, ends[:-1]][:n].tolist()
    hi = (ends[-n:] - 1).tolist() if len(tokens) >= words else [len(line)]
    total = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(lo[at : at + BLOCK], hi[at : at + BLOCK], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, fp long")


def cuts(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = radius // 2 + 1
    edge = [64 * i // n for i in range(n + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(n)]


def variants(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of all one-wildcard variants of all segments."""
    keys = []
    for s, (lo, size) in enumerate(cuts(radius)):
        seg = (fp >> np.uint64(lo)) & np.uint64((1 << size) - 1)
        for w in range(size):
            low = seg & np.uint64((1 << w) - 1)
            high = seg >> np.uint64(w + 1) << np.uint64(w)
            keys.append((low | high) | np.uint64((s * 64 + w) << (size - 1 if size > 1 else 1)) if size < 50 else (low | high) ^ np.uint64((s * 64 + w) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return np.concatenate(keys), np.tile(fp, len(keys))


def bucket_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``radius`` bits in one bucket: a forest, with the
    same groups as all pairs would give."""
    fp = np.unique(fp)
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(fp[i]), int(fp[j])))

    if n <= PAIRWISE:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            join(int(i), int(j))
        return out
    # every fingerprint looks up those within the radius, by bits in which the bucket differs
    differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << b for b in range(64) if differ >> b & 1]
    masks = [0]
    for _ in range(radius):
        masks = list(dict.fromkeys(masks + [m ^ b for m in masks for b in bits if not m & b]))
    if len(masks) > n:
        for i in range(n):
            for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius):
                join(i, i + 1 + int(j))
        return out
    for m in masks[1:]:
        q = fp ^ np.uint64(m)
        at = np.minimum(np.searchsorted(fp, q), n - 1)
        for i in np.flatnonzero((fp[at] == q) & (at > np.arange(n))):
            join(int(i), int(at[i]))
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column fp) at most ``radius`` bits
    apart, enough to connect all that such pairs connect."""
    spark = ship(fps.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            for at in range(0, len(fp), 8192):
                key, own = variants(fp[at : at + 8192], radius)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(key, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(key)]
            size = hi - lo
            two = lo[size == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            got = [np.column_stack([fp[two][near], fp[two + 1][near]])]
            for i, j in zip(lo[size > 2], hi[size > 2], strict=True):
                found = bucket_links(fp[i:j].view(np.uint64), radius)
                if found:
                    got.append(np.array(found, np.uint64).view(np.int64))
            all_ = np.unique(np.concatenate(got), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1])], ["a", "b"])

        for b in batches:
            key = np.concatenate([key, np.asarray(b.column("key"))])
            fp = np.concatenate([fp, np.asarray(b.column("fp"))])
            if len(key) and key[0] != key[-1]:
                done = int(np.searchsorted(key, key[-1]))
                yield groups(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield groups(key, fp)
        release()

    n = partitions(spark)
    spread_out = fps.select("fp").mapInArrow(spread, "key long, fp long")
    return spread_out.repartition(n, "key").sortWithinPartitions("key").mapInArrow(gather, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest doc_id that it reaches."""
    fps = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = components(links(classes, radius))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    of_group = named.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    label = named.join(of_group, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- by similarity

#: Segments of the signature, symbols of a segment. At a similarity of 0.8 one of six
#: segments of five symbols differs in one symbol at most with probability 0.9996.
SEGMENTS, SYMBOLS = 6, 5
SHINGLE, SIMILARITY = 5, 0.8
#: Buckets up to this size are compared pair by pair, larger ones with a hub.
SMALL = 16
#: Texts of a class from which on it is hot, as a share of all: such classes are at most
#: the inverse of this, so they may travel with every task.
HOT = 0.001
#: Sizes within this factor of each other stand in one size class.
SIZES = 1.05
_MULTIPLY = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xD1B54A32D192ED03 * (i + 7))) & (2**64 - 1) | 1 for i in range(SEGMENTS * SYMBOLS)], U64)
PIECE = 1 << 18
_WORD = np.array([0 if c in (32, 9, 10, 11, 12, 13) else _LOWER[c] for c in range(256)], np.uint8)
_WORD[0] = 1


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, row, hash of all words in order by row); a text of fewer words is one
    shingle, one of none has none."""
    low = _WORD[data]
    lo, hi = spans(low > 0, off)
    h = span_hash(prefix_sums(low), lo, hi)
    row = row_of(off, lo)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    place = np.arange(len(h)) - first[row]
    p, _ = powers(len(h) + size)
    whole = np.zeros(n, U64)
    full = np.flatnonzero(count)
    if len(full):
        whole[full] = np.add.reduceat(h * p[place], first[full]) + mix(count[full].astype(U64))
    keep = place + size <= count[row]
    out = np.zeros(len(h), U64)
    for k in range(min(size, len(h))):
        out[: len(h) - k] += mix(h[k:] + U64(k)) * p[k]
    short = full[count[full] < size]
    return np.concatenate([mix(out[keep]), mix(whole[short])]), np.concatenate([row[keep], short]), whole


def _whole(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    data, off = flat(b.column("text"))
    for lo, hi in row_slices(off, PIECE):
        yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, cls, keys``: equal ``cls`` for equal word sequences; the one-wildcard keys
    of all segments of the min-wise signature over five-word shingles."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, keys = [], []
            for data, off, _ in _whole(b):
                s, row, whole = shingles(data, off)
                n = len(off) - 1
                order = np.argsort(row, kind="stable")
                s, row = s[order], row[order]
                full, first = np.unique(row, return_index=True)
                sig = np.zeros((n, SEGMENTS * SYMBOLS), U64)
                for i, m in enumerate(_MULTIPLY):
                    if len(full):
                        sig[full, i] = np.minimum.reduceat(mix(s * m) if i % 4 == 0 else s * m ^ (s >> U64(29)) * m, first)
                own = []
                for g in range(SEGMENTS):
                    part = mix(sig[:, g * SYMBOLS : (g + 1) * SYMBOLS] + np.arange(SYMBOLS, dtype=U64))
                    total = part.sum(axis=1, dtype=U64)
                    own += [mix(total - part[:, w] + U64(g * 64 + w)) for w in range(SYMBOLS)]
                cls.append(whole)
                keys.append(np.stack(own, axis=1))
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, SEGMENTS * SYMBOLS), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), pa.array(k.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(cls).view(np.int64) if cls else np.zeros(0, np.int64)), lists], ["doc_id", "cls", "keys"])
        release()

    return docs.mapInArrow(run, "doc_id long, cls long, keys array<long>")


def buckets(reps: DataFrame) -> DataFrame:
    """``key, a, b``: all pairs (a < b, key 0) of the buckets of up to ``SMALL`` texts; of
    larger ones a row for each text a, with b null. A bucket is never held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = None  # the key whose bucket is known to be large already

        def settle(key: np.ndarray, doc: np.ndarray, done: bool) -> pa.RecordBatch:
            nonlocal held, large
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            size = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
            big = (size > SMALL) | (key == large if large is not None else False)
            wait = np.zeros(len(key), bool) if done or not len(key) else (key == key[-1]) & ~big
            if len(key):
                large = key[-1] if big[-1] else None
            held = key[wait], doc[wait]
            got = [np.zeros((0, 2), np.int64)]
            few = ~big & ~wait
            for d in range(1, min(SMALL, len(key))):
                i = np.flatnonzero(few[: len(key) - d])
                i = i[key[i] == key[i + d]]
                got.append(np.column_stack([doc[i], doc[i + d]]))
            x = np.concatenate(got)
            x = np.unique(np.sort(x[x[:, 0] != x[:, 1]], axis=1), axis=0)
            none = np.r_[np.zeros(len(x), bool), np.ones(big.sum(), bool)]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(x), np.int64), key[big]]), pa.array(np.r_[x[:, 0], doc[big]]), pa.array(np.r_[x[:, 1], doc[big]], mask=none)], ["key", "a", "b"])

        for batch in batches:
            yield settle(np.concatenate([held[0], np.asarray(batch.column("key"))]), np.concatenate([held[1], np.asarray(batch.column("a"))]), False)
        yield settle(*held, True)
        release()

    rows = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("a"))
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def hub_pairs(big: DataFrame) -> DataFrame:
    """``a, b``: every text of a large bucket (key, a) with the bucket's hub, the text that
    stands in the most large buckets."""
    centre = big.groupBy("a").agg(F.count("*").alias("centre"))
    hubs = big.join(centre, "a").groupBy("key").agg(F.max_by("a", F.struct("centre", (-F.col("a")).alias("first"))).alias("hub"))
    return big.join(hubs, "key").where("a <> hub").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct()


def unsettled(big: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, comp, probe``: the texts of large buckets that aren't one component yet, with
    their components. Those outside the largest of a bucket are probes: of two texts of one
    bucket in different components one is."""
    rows = big.join(groups.select(F.col("node").alias("a"), "component"), "a", "left").select("key", "a", F.coalesce("component", "a").alias("comp"))
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("comp", F.struct("n", "comp")).alias("top")).where("kinds > 1").select("key", "top")
    return rows.join(tops, "key").groupBy("a", "comp").agg(F.max((F.col("comp") != F.col("top")).cast("int")).alias("probe"))


def prefix_pairs(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: candidates among ``texts`` (a, comp, probe) in different components, one of
    them a probe, with none left out that is similar enough: two sets with the overlap that
    the similarity asks for share one of the rarest elements of each, as far from the end of
    both as that overlap is long. Sizes are dealt into classes, so that an element that many
    texts hold meets only those whose size leaves room for the overlap."""
    share = similarity / (1 + similarity)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                raw = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in part.column("s")]
                size = np.array([len(x) for x in raw], np.int64)
                wide = np.zeros((size.sum(), 8), np.uint8)
                wide[:, :5] = np.concatenate(raw) if len(raw) else wide[:, :5]
                columns = [np.repeat(np.asarray(part.column(c)), size) for c in ("a", "comp", "probe")]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(np.repeat(size, size)), pa.array(wide.view("<i8").reshape(-1))], ["a", "comp", "probe", "size", "token"])
        release()

    held = texts.join(sets.select(F.col("doc_id").alias("a"), "s"), "a").select("a", "comp", "probe", "s")
    rows = materialise(held.mapInArrow(explode, "a long, comp long, probe int, size long, token long"), "tokens")
    often = rows.groupBy("token").agg(F.count("*").alias("df"))
    order = W.partitionBy("a").orderBy("df", "token")
    placed = rows.join(often, "token").withColumn("place", F.row_number().over(order) - 1)
    placed = placed.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9)) & (F.col("df") > 1))
    size_class = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(SIZES))).cast("int")
    rest = F.col("size") - F.col("place")
    least, most = F.col("size") * similarity, F.least(rest / share - F.col("size"), F.col("size") / similarity)
    of_probes = placed.where("probe = 1").where(most >= least - 1e-9)
    x = of_probes.select("token", F.explode(F.sequence(size_class(F.floor(least)), size_class(F.ceil(most)))).alias("k"), F.col("a").alias("p"), F.col("comp").alias("pc"), F.col("size").alias("ps"), rest.alias("pr"))
    y = placed.select("token", size_class(F.col("size")).alias("k"), F.col("a").alias("q"), F.col("comp").alias("qc"), F.col("size").alias("qs"), rest.alias("qr"))
    room = F.least("pr", "qr") >= (F.col("ps") + F.col("qs")) * share - 1e-9
    alike = F.least("ps", "qs") >= F.greatest("ps", "qs") * similarity - 1e-9
    met = x.join(y, ["token", "k"]).where((F.col("pc") != F.col("qc")) & room & alike)
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``doc_id, cls, s``: the distinct shingle hashes of the texts that a filter lets pass,
    packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(b, bits)))
            for data, off, lo in _whole(b):
                s, row, whole = shingles(data, off)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(off)))
                sets = [distinct((s[order[ends[i] : ends[i + 1]]] >> U64(24)).astype("<u8")) for i in range(len(off) - 1)]
                packed = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(off) - 1), pa.array(whole.view(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "cls", "s"])
        release()

    return docs.select("*", *filter_places()).mapInArrow(run, "doc_id long, cls long, s binary")


def _jaccard(pairs: DataFrame, similarity: float) -> DataFrame:
    def unpack(x: bytes) -> np.ndarray:
        raw = np.zeros((len(x) // 5, 8), np.uint8)
        raw[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
        return raw.view("<u8").reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = x.as_py(), y.as_py()
                n, m = len(x) // 5, len(y) // 5
                if min(n, m) < similarity * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([unpack(x), unpack(y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (n + m - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return pairs.mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (doc_id, s) are similar enough."""
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    return _jaccard(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), similarity)


def settle(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, component`` over all similar pairs that share a bucket. Pairs of small buckets,
    and of large ones those with the hub, are compared first; what they leave apart in a
    large bucket is searched by its rarest shingles."""
    big = dealt.where("b is null").select("key", "a").distinct()
    first = dealt.where("b is not null").select("a", "b").unionByName(hub_pairs(big)).distinct()
    groups = materialise(components(similar(first, sets, similarity)), "groups")
    left = materialise(unsettled(big, groups), "unsettled")
    found = similar(materialise(prefix_pairs(left, sets, similarity), "candidates"), sets, similarity)
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(found.unionByName(stars))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` for the documents that have an equal or near copy, that is,
    a Jaccard similarity of their sets of five-word shingles (by 40-bit hashes) of at least
    ``similarity``; components of such links, named by their smallest doc_id.

    The index is the one of ``links``, with min-wise symbols in the place of bits: at 0.8
    some 10 of 64 SimHash bits differ, where one-bit segments would be too short to tell
    texts apart. Equal word sequences (by a 64-bit hash) are one entry of the index.

    Defined results: texts without words, null or empty, are copies of each other; texts of
    fewer words than a shingle are one shingle; case and white space don't count; rows
    without a doc_id take no part; rows of one doc_id are one document, of which the text
    with the least hash counts; an empty table gives an empty result; further columns,
    whatever their names, are ignored."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sigs = materialise(signatures(cut), "signatures")
    one = sigs.groupBy("doc_id").agg(F.min("cls").alias("cls"))
    classes = materialise(one.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") > F.lit(max(1.0, HOT * total))).select("cls", F.col("rep").alias("hot_rep"))
    marked = one.join(F.broadcast(hot), "cls", "left")  # at most 1 / HOT classes
    cool = marked.where("hot_rep is null").select("doc_id", "cls").join(classes.select("cls", "rep"), "cls").select("doc_id", "rep")
    named = materialise(marked.where("hot_rep is not null").select("doc_id", F.col("hot_rep").alias("rep")).unionByName(cool), "named")
    reps = sigs.join(classes.select(F.col("rep").alias("doc_id"), "cls"), ["doc_id", "cls"], "left_semi").groupBy("doc_id").agg(F.first("keys").alias("keys"))
    dealt = materialise(buckets(reps), "buckets")
    ids = dealt.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null")
    sets = materialise(_sets(cut, id_filter(ids)), "sets").groupBy("doc_id").agg(F.min_by("s", "cls").alias("s"))
    groups = settle(dealt, sets, similarity)
    label = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    sizes = label.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    return label.join(sizes, "component_id", "left_semi").select("doc_id", "component_id")
