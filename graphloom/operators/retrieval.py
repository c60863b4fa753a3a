"""Text and retrieval: terms, signals, fusion, search, packing, recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import ranking
from graphloom.operators.lineage import cut, written

#: Of the set similarity join, fixed sizes: buckets of the counts that put terms in order,
#: places of the filter of paths, blocks of a class, pairs that are looked at at once.
COUNTS, PLACES, BLOCKS, AT_ONCE = 1 << 22, 1 << 22, 64, 1 << 19
#: Of its inverted index: buckets of terms that are counted, entries of a group, entries that are dealt out at once, pairs that a group keeps.
FINE, ENTRIES, DEALT, KEPT = 1 << 16, 1 << 19, 1 << 16, 1 << 20
#: Of families of sets that are counted: terms and texts of a block.
HELD, TEXTS = 1 << 19, 1 << 11
#: Bytes of text whose words are looked at at once.
TEXT = 1 << 22


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 2)


def terms(files: DataFrame) -> DataFrame:
    """``path, term, n``"""
    return files.select("path", F.explode(words(F.col("content"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("n"))


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


def top_terms(files: DataFrame, limit: int) -> DataFrame:
    """The most frequent terms: counted at once, with partial counts before the shuffle."""
    return files.select(F.explode(words(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)


def term_signal(files: DataFrame, query: list[str]) -> DataFrame:
    """Share of a file's term occurrences that are terms of the query, within the row."""
    all_ = words(F.col("content"))
    hit = F.size(F.filter(all_, lambda w: w.isin(query)))
    return files.select("path", F.when(F.size(all_) > 0, F.round(hit / F.size(all_), 6)).otherwise(0.0).alias("score")).where("score > 0")


def path_signal(files: DataFrame, query: list[str]) -> DataFrame:
    """0.7 of the query's terms that the path has, and 0.3 of the path's that the query has."""
    parts = F.array_distinct(F.filter(F.split(F.lower("path"), r"[/._-]+"), lambda w: F.octet_length(w) >= 2))
    both = F.size(F.array_intersect(parts, F.array(*[F.lit(q) for q in query])))
    return files.select("path", F.round(0.7 * both / len(query) + 0.3 * F.when(F.size(parts) > 0, both / F.size(parts)).otherwise(0.0), 6).alias("score")).where("score > 0")


def fuse(signals: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: competition ranks of every weighted signal, summed as
    w * (k + 1) / (k + rank)."""
    total = F.lit(0.0)
    for c, w in weights.items():
        if w:
            signals = ranking.competition_rank(signals, c, f"_rank_{c}")
            total = total + F.lit(float(w)) * (k + 1) / (k + F.col(f"_rank_{c}"))
    return signals.select("path", F.round(total, 6).alias("score"))


def weighted(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.col(c) * float(w) for c, w in weights.items()), F.lit(0.0))
    return signals.select("path", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6).alias("score"))


def search_symbols(names: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """Names that equal (3), begin with (2), or contain (1) the target; ties by name."""
    n, t = F.lower("name"), target.lower()
    tier = F.when(n == t, 3).when(n.startswith(t), 2).when(n.contains(t), 1)
    return names.withColumn("tier", tier).where("tier is not null").orderBy(F.desc("tier"), "name", "path").limit(limit)


def search_lines(files: DataFrame, pattern: str, context: int = 2) -> DataFrame:
    """Lines that match, with the lines around them; the array of lines stays in the row."""
    lines = files.select("path", F.split("content", "\n").alias("ls")).select("path", "ls", F.posexplode("ls").alias("i", "line")).where(F.col("line").rlike(pattern))
    before = F.slice("ls", F.greatest(F.col("i") - context + 1, F.lit(1)), F.least(F.col("i"), F.lit(context)))
    after = F.slice("ls", F.col("i") + 2, context)
    return lines.select("path", (F.col("i") + 1).alias("line_no"), "line", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def cosine_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col("vec")
    sim = dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    return vectors.select("id", F.round(sim, 4).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def holders(files: DataFrame, items: DataFrame) -> DataFrame:
    """``query, path``: the files whose content holds an item's text (query, text) as it is.
    An item's longest inner word stands whole in such a file, so the two meet by a word; items
    without an inner word are the only ones compared with every file."""
    inner = F.expr("filter(slice(split(text, '\\\\s+'), 2, greatest(size(split(text, '\\\\s+')) - 2, 0)), w -> w <> '')")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)
    keyed = items.where("text is not null").withColumn("w", F.when(F.size(inner) > 0, longest["w"]))
    words_ = files.select("path", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("w"))
    met = words_.join(keyed.where("w is not null").select("query", "w"), "w").select("query", "path").distinct()
    held = met.join(files.select("path", "content"), "path").join(items, "query").where(F.contains("content", "text")).select("query", "path")
    short = keyed.where("w is null").select("query", "text")
    return held.unionByName(files.join(short, F.contains("content", "text")).select("query", "path")).distinct()


def recall_mrr(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: share of the truth that is ranked, and the reciprocal of the first hit's rank."""
    hits = ranked.join(truth, ["query", "path"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    size = truth.groupBy("query").agg(F.count("*").alias("n"))
    return size.join(hits, "query", "left").select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def term_sets(files: DataFrame) -> DataFrame:
    """``path, terms``: the distinct terms of each path (those of ``words``), by their 64-bit hashes; a path that
    comes more than once has the terms of all its rows."""
    at_once = TEXT

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if len(b)):
            text = b.column("text")
            upto = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, side="right")) - 1)
                found = pc.split_pattern_regex(text.slice(lo, hi - lo), r"[^\p{L}\p{N}_]+")
                doc, word = pc.list_parent_indices(found).to_numpy().astype(np.int64), pc.list_flatten(found)
                long = pc.greater_equal(pc.binary_length(word), 2)
                doc, coded = doc[long.to_numpy(zero_copy_only=False)], word.filter(long).dictionary_encode()
                if len(doc):
                    # a word is hashed once for all texts that are looked at together
                    size, hashes = len(coded.dictionary), pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
                    key = np.unique(doc * size + coded.indices.to_numpy())
                    rows, starts = np.unique(key // size, return_index=True)
                    terms = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(hashes[key % size]))
                    yield pa.RecordBatch.from_arrays([b.column("path").take(pa.array(rows + lo)), terms], ["path", "terms"])
                lo = hi

    rows = files.select("path", F.lower("content").alias("text")).mapInArrow(hashed, "path string, terms array<long>")
    if files.groupBy("path").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return rows


def _described(sets: DataFrame, threshold: float) -> DataFrame:
    """What the join needs of each set: ``n``, ``k1, k2`` (equal for equal sets: two sums of
    hashes), ``signature`` (the parity of the terms in each of its bits, at least 0.75 bits a
    term, so two sets differ in at least as many terms as their signatures in bits), and the rarest terms with their places
    in the order of all terms, without those that no other set has."""
    spark = sets.sparkSession
    bucket = F.pmod(F.col("t"), F.lit(COUNTS)).cast("int").alias("b")
    found = sets.select(F.explode("terms").alias("t")).groupBy(bucket).agg(F.count("*").alias("n")).toArrow()  # COUNTS rows at most
    held = np.zeros(COUNTS, np.uint32)
    held[found.column("b").to_numpy()] = np.minimum(found.column("n").to_numpy(), 0xFFFFFFFF)
    counts, buckets = spark.sparkContext.broadcast(held), COUNTS

    def describe(batches):
        u64 = np.uint64
        kinds = {"n": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "signature": pa.binary(), "rare": pa.list_(pa.int64()), "place": pa.list_(pa.int32())}
        for b in batches:
            seen, terms = counts.value, b.column("terms")
            off, flat = np.asarray(terms.offsets), np.asarray(terms.values)
            out = {k: [] for k in kinds}
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                h, n = flat[lo:hi], int(hi - lo)
                one = (h.view(u64) ^ (h.view(u64) >> u64(29))) * u64(0xBF58476D1CE4E5B9)
                two = (h.view(u64) ^ (h.view(u64) >> u64(32))) * u64(0x94D049BB133111EB)
                df = seen[h & (buckets - 1)]
                # of n terms a similar set shares so many that one is among the first
                order = np.lexsort((h, df))[: n - int(np.ceil(n * threshold - 1e-9)) + 1]
                place = np.flatnonzero(df[order] > 1)
                out["n"].append(n)
                out["k1"].append(int(np.sum(one ^ (one >> u64(32)), dtype=u64).view(np.int64)))
                out["k2"].append(int(np.sum(two ^ (two >> u64(31)), dtype=u64).view(np.int64)))
                bits = 64 << max(0, int(np.ceil(np.log2(n * 0.75 / 64))))
                out["signature"].append(np.packbits(np.bincount((one >> u64(40)).astype(np.int64) % bits, minlength=bits) & 1 == 1).tobytes())
                out["rare"].append(h[order][place])
                out["place"].append((place + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array(out[k], kind) for k, kind in kinds.items()]], ["path", *kinds])

    return cut(sets.select("path", "terms").mapInArrow(describe, "path string, n int, k1 long, k2 long, signature binary, rare array<long>, place array<int>"))


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose path may be among ``ids``, by a filter of fixed size."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("path")), F.lit(PLACES))
    one = ids.select(F.explode(F.array(place(1), place(2))).alias("p"))
    found = one.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).collect()  # PLACES / 64 rows at most
    held = np.zeros(PLACES // 64, np.int64)
    for r in found:
        held[r.w] = r.b

    def keep(batches):
        for b in batches:
            p, q = np.asarray(b.column("p1")), np.asarray(b.column("p2"))
            yield b.select(["path", "terms"]).filter(pa.array((held[p >> 6] >> (p & 63) & held[q >> 6] >> (q & 63) & 1) == 1))

    return sets.select("path", "terms", place(1).alias("p1"), place(2).alias("p2")).mapInArrow(keep, "path string, terms array<long>")


def _connected() -> Callable:
    """A function that travels with tasks: labels (of each of a group the first that it is connected to) after further pairs."""

    def connected(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                return label
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := label[label], label):
                label = further

    return connected


def _tools() -> tuple:
    """Two functions that travel with tasks: the bucket of each term, and of a column of bytes how many values of a kind each row holds and
    all of them, without a Python object for each row."""

    def fine(terms: np.ndarray) -> np.ndarray:
        return (terms.view(np.uint64) >> np.uint64(48)).astype(np.int64)

    def raw(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        a = column.combine_chunks().cast(pa.binary())
        _, off, data = a.buffers()
        off = np.frombuffer(off, np.int32)[a.offset : a.offset + len(a) + 1]
        values = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        return np.diff(off).astype(np.int64) // np.dtype(kind).itemsize, values.view(kind)

    return fine, raw


def _groups(first: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket of terms its part and the number of its blocks. Buckets are put together to ``parts`` parts, or to more, so that none has over
    twice ``ENTRIES`` entries; one that is larger by itself (a frequent term) has its sets in blocks, of which two at a time are a group."""

    fine, _ = _tools()

    def weigh(batches):
        w = np.zeros(FINE, np.int64)
        for b in (b for b in batches if len(b)):
            off, flat, signs = np.asarray(b.column("rare").offsets), np.asarray(b.column("rare").values), np.asarray(b.column("bytes"))
            # an entry of a long signature counts as several
            w += np.bincount(fine(flat[off[0] : off[-1]]), np.repeat(1 + signs // 128, np.diff(off)), FINE).astype(np.int64)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(w[some])], ["b", "w"])

    found = first.select("rare", F.octet_length("signature").alias("bytes")).mapInArrow(weigh, "b int, w long").groupBy("b").agg(F.sum("w").alias("w")).toArrow()  # FINE rows at most
    w = np.zeros(FINE, np.int64)
    w[found.column("b").to_numpy()] = found.column("w").to_numpy()
    heavy = w > ENTRIES
    light = np.where(heavy, 0, w)
    part = (np.cumsum(light) - light) // max(1, min(ENTRIES, -(-int(light.sum()) // parts)))
    part[heavy] = part.max() + 1 + np.arange(heavy.sum())
    return part, np.where(heavy, -(-2 * w // ENTRIES), 1)


def _met(first: DataFrame, threshold: float, spanning: bool = False) -> DataFrame:
    """``p, q``: pairs that share one of their rarest terms and keep all bounds. Terms are dealt
    by hash to parts of bounded size, and with those of a set its signature, once for each part. The first of
    the terms that two sets share lies so far in front that as many as must be common follow;
    pairs that don't keep this, or whose signatures differ too much, become no rows. A pair may come more than once.
    ``spanning``: each group gives only a row for each set that such pairs connect to others, with the smallest path of those, so there
    are no more rows than sets in a group, however many pairs they make."""
    spark = first.sparkSession
    first, (fine, raw) = written(first), _tools()
    at_once, dealt_at_once, kept, t, connected = AT_ONCE, DEALT, KEPT, threshold, _connected()
    ids = spark.sparkContext.broadcast(_groups(first, max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 2)))
    kind = "g long, second boolean, path string, n int, signature binary, terms binary, places binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def deal(batches):
        part_of, blocks_of = ids.value
        for b in (b for b in batches if len(b)):
            off, flat, spots = np.asarray(b.column("rare").offsets).astype(np.int64), np.asarray(b.column("rare").values), np.asarray(b.column("place").values)
            spots = spots[b.column("place").offsets[0].as_py() :][: off[-1] - off[0]]
            flat, off = flat[off[0] : off[-1]], off - off[0]
            bucket, spread = fine(flat), np.asarray(b.column("spot")).view(np.uint64)
            upto = np.r_[0, np.cumsum(blocks_of[bucket])][off]
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + dealt_at_once, side="right")) - 1)
                doc, own = np.repeat(np.arange(lo, hi), np.diff(off[lo : hi + 1])), np.arange(off[lo], off[hi])
                blocks = blocks_of[bucket[own]]
                other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                doc, own, blocks = np.repeat(doc, blocks), np.repeat(own, blocks), np.repeat(blocks, blocks)
                block = (spread[doc] % blocks.astype(np.uint64)).astype(np.int64)
                # a group: a part, and two of its blocks in order
                g = part_of[bucket[own]] << 32 | np.minimum(block, other) << 16 | np.maximum(block, other)
                order = np.lexsort((g, doc))
                doc, own, g, second = doc[order], own[order], g[order], (block > other)[order]
                starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])]) if len(doc) else np.zeros(0, np.int64)
                ends = np.r_[starts, len(doc)].astype(np.int32)
                bytes_ = lambda v: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(v.itemsize)), pa.py_buffer(np.ascontiguousarray(v))])  # noqa: B023, E731
                rows = pa.array(doc[starts])
                yield pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array(second[starts]), *[b.column(c).take(rows) for c in ("path", "n", "signature")], bytes_(flat[own]), bytes_(spots[own])], names)
                lo = hi

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        n, g, path = table.column("n").to_numpy().astype(np.int64), table.column("g")[0].as_py(), table.column("path").combine_chunks()
        signs, second = table.column("signature").combine_chunks(), table.column("second").to_numpy()
        level = np.log2(raw(table.column("signature"), np.uint64)[0]).astype(np.int64)
        at, words_, folded = np.zeros(len(n), np.int64), {}, {}
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            at[own] = np.arange(len(own))
            words_[k] = raw(pa.chunked_array([signs.take(pa.array(own))]), np.uint64)[1].reshape(len(own), -1)
            half = words_[k].shape[1] // 2
            folded[k] = words_[k][:, :half] ^ words_[k][:, half:] if half else words_[k]
        held, term = raw(table.column("terms"), np.int64)
        doc, place = np.repeat(np.arange(len(n)), held), raw(table.column("places"), np.int32)[1].astype(np.int64)
        del table, signs
        term = np.unique(term, return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((n[doc], term))
        doc, term, place = doc[order], term[order], place[order]
        # partners of an entry: those behind it with its term that aren't too large, of two blocks those of the other one
        most = int(n.max()) * 4 + 4 if t <= 0.25 else int(n.max() / t) + 2
        key, top = term * most + n[doc], term * most + np.floor(n[doc] / t + 1e-6).astype(np.int64)
        if g >> 16 & 0xFFFF == g & 0xFFFF:
            all_ = np.arange(len(doc))
            passes = [(all_, all_, all_ + 1)]
        else:
            a, b = np.flatnonzero(~second[doc]), np.flatnonzero(second[doc])
            passes = [(a, b, np.searchsorted(key[b], key[a], side="left")), (b, a, np.searchsorted(key[a], key[b], side="right"))]
        pairs, label = [], np.arange(len(n))

        def out(one):
            for some in np.array_split(one, -(-len(one) // (1 << 17))) if len(one) else []:
                yield pa.RecordBatch.from_arrays([path.take(pa.array(some // len(n))), path.take(pa.array(some % len(n)))], ["p", "q"])

        for mine_, theirs, begin in passes:
            count = np.maximum(np.searchsorted(key[theirs], top[mine_], side="right") - begin, 0)
            upto, lo = np.r_[0, np.cumsum(count)], 0
            while lo < len(mine_):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, side="right")) - 1)
                x = np.repeat(np.arange(lo, hi), count[lo:hi])
                x, y = mine_[x], theirs[begin[x] + np.arange(upto[lo], upto[hi]) - upto[x]]
                both = n[doc[x]] + n[doc[y]]
                need = both * (t / (1 + t)) - 1e-6
                good = (place[x] <= n[doc[x]] - need + 1) & (place[y] <= n[doc[y]] - need + 1)
                if spanning:
                    good &= label[doc[x]] != label[doc[y]]
                x, y, apart = doc[x[good]], doc[y[good]], both[good] * ((1 - t) / (1 + t)) + 1e-6
                for k in np.unique(level[x]):
                    for above in (False, True):
                        mine = np.flatnonzero((level[x] == k) & (level[y] == k + above))
                        for part in np.array_split(mine, max(1, (len(mine) << int(k)) >> 20)):
                            other = (folded[k + 1] if above else words_[k])[at[y[part]]] if len(part) else words_[k][:0]
                            near = part[np.bitwise_count(words_[k][at[x[part]]] ^ other).sum(1, dtype=np.int64) <= apart[part]]
                            pairs.append(x[near] * len(n) + y[near])
                    far = np.flatnonzero((level[x] == k) & (level[y] > k + 1))  # no bound for a low threshold
                    pairs.append(x[far] * len(n) + y[far])
                if spanning:
                    one = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                    label, pairs = connected(label, one // len(n), one % len(n)), []
                if len(pairs) > 64 or sum(map(len, pairs)) > kept:
                    pairs = [np.unique(np.concatenate(pairs))]
                    if len(pairs[0]) > kept // 2:
                        yield from out(pairs.pop())
                lo = hi
        if spanning:
            some = np.flatnonzero(np.bincount(label, minlength=len(n))[label] > 1)
            names = path.take(pa.array(some)).to_numpy(zero_copy_only=False)
            order = np.lexsort((np.unique(names, return_inverse=True)[1], label[some]))
            begins = np.unique(label[some][order], return_index=True)[1]
            least = np.repeat(names[order][begins], np.diff(np.r_[begins, len(order)]))
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.string()), pa.array(names[order], pa.string())], ["p", "q"])
            return
        yield from out(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64))

    dealt = first.withColumn("spot", F.xxhash64("path")).mapInArrow(deal, kind)
    met = dealt.groupBy("g").applyInArrow(meet, "p string, q string")
    return met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))


def similar_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``p, q, jaccard``: all pairs whose term sets have a Jaccard similarity over the
    threshold. ``sets``: path, terms (distinct hashes). Of equal sets the one of the smallest
    path is searched for all. Two similar sets share one of their rarest terms (an inverted
    index with prefix filtering); two that do must keep the bounds by sizes, places and
    signatures before a row is made of them, and the common terms of what is left are counted.
    A pair of classes of equal sets then stands for all pairs of their members."""
    return _members(*_alike(sets, threshold), threshold)


def similar_classes(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``path, class, links``: for each text the smallest path with an equal term set, and how many other texts have a similarity over
    the threshold with it (those of its class among them). Candidates are those of ``similar_pairs``, but only whom they connect is handed on, not
    the pairs: what is connected meets in blocks, in which common terms are counted for all pairs and summed to a row for each set. So
    the rows grow with the texts, also where a family of near copies grows with them, and only the counting goes by pairs."""
    sets = written(sets)  # texts are split once
    rows = _described(sets, threshold)
    key = ["n", "k1", "k2"]
    sized = cut(rows.groupBy(*key).agg(F.min("path").alias("path"), F.count("*").alias("size")))
    first = rows.join(sized, [*key, "path"], "left_semi").select("path", "n", "signature", "rare", "place")
    links = cut(_met(first, threshold, spanning=True).where("p <> q").distinct())
    near = _near(sets, sized.select("path", "size"), _families(links), threshold)
    own = F.when(F.lit(threshold < 1.0), F.col("size") - 1).otherwise(0)
    linked = sized.join(near, "path", "left").select(*key, F.col("path").alias("class"), (own + F.coalesce("near", F.lit(0))).alias("links"))
    return rows.join(linked, key).select("path", "class", "links")


def _families(links: DataFrame) -> DataFrame:
    """``path, family``: the smallest path that each path of the pairs (p, q) is connected to. Every round takes the smallest family
    of the neighbours, then that family's own."""
    both = cut(links.unionByName(links.select(F.col("q").alias("p"), F.col("p").alias("q"))))
    now = cut(both.groupBy(F.col("p").alias("path")).agg(F.least(F.col("path"), F.min("q")).alias("family")))
    while True:
        of = now.select(F.col("path").alias("q"), F.col("family").alias("near"))
        new = both.join(of, "q").groupBy(F.col("p").alias("path")).agg(F.min("near").alias("near")).join(now, "path").select("path", "family", F.least("family", "near").alias("near"))
        above = now.select(F.col("path").alias("near"), F.col("family").alias("above"))
        new = cut(new.join(above, "near").select("path", "family", F.least("near", "above").alias("new")))
        if not new.where("new <> family").limit(1).count():
            return now
        now = new.select("path", F.col("new").alias("family"))


def _near(sets: DataFrame, sized: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """``path, near``: for each path of the families the sizes (path, size) of the others of its family that are similar to it. A family of more than
    ``HELD`` terms or ``TEXTS`` texts is dealt into blocks, and each two of them meet in a task; smaller families are put together."""
    t = threshold
    some = _among(sets, families.select("path")).join(families, "path").join(sized, "path")
    some = written(some.withColumn("n", F.size("terms")))
    of = some.groupBy("family").agg(F.sum("n").alias("terms_of"), F.count("*").alias("texts_of"))
    of = of.select("family", F.greatest(F.ceil(F.col("terms_of") / HELD), F.ceil(F.col("texts_of") / TEXTS)).cast("int").alias("blocks"))
    whole = some.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-int(whole[0]) // HELD), -(-int(whole[1]) // TEXTS))
    dealt = some.join(of, "family").withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = F.concat_ws("/", F.least("block", "other"), F.greatest("block", "other"), "family")
    group = F.when(F.col("blocks") > 1, large).otherwise(F.pmod(F.xxhash64("family"), F.lit(parts)).cast("string"))
    dealt = dealt.select(group.alias("g"), F.when(F.col("blocks") > 1, F.col("block") != F.col("other")).alias("apart"), (F.col("block") > F.col("other")).alias("second"), "family", "path", "size", "terms")

    def shared(term: np.ndarray, doc: np.ndarray, texts: int, split: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The numbers of common terms of texts, of a piece of the first ``split`` with all behind them; without a split, of a piece with all."""
        codes, count = np.unique(term, return_inverse=True, return_counts=True)[1:]
        # a term that one text has is common to none
        keep = count[codes] > 1
        codes, doc = np.unique(codes[keep], return_inverse=True)[1], doc[keep]
        order = np.argsort(codes, kind="stable")
        codes, doc = codes[order], doc[order]
        size = int(codes[-1]) + 1 if len(codes) else 0
        step = max(64, min(-(-size // 64) * 64, (1 << 25) // max(1, texts) // 64 * 64))
        rows, most = (split or texts), max(1, (1 << 22) // max(1, texts))
        for lo in range(0, rows, most):
            hi = min(rows, lo + most)
            found = np.zeros((hi - lo, texts - split), np.int32)
            for v in range(0, size, step):
                a, b = np.searchsorted(codes, [v, v + step])
                has = np.zeros((texts, step), bool)
                has[doc[a:b], codes[a:b] - v] = True
                bits = np.packbits(has, axis=1).view(np.uint64)
                del has
                for i in range(lo, hi):
                    found[i - lo] += np.bitwise_count(bits[i] & bits[split:]).sum(1, dtype=np.int32)
            yield lo, hi, found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        second = table.column("second").to_numpy(zero_copy_only=False)
        codes = table.column("family").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((second, codes))
        table, second, codes = table.take(pa.array(order)), second[order], codes[order]
        apart = bool(table.column("apart")[0].as_py())
        if apart and (second.all() or not second.any()):
            return  # the other block is empty
        terms = table.column("terms").combine_chunks()
        off, flat = np.asarray(terms.offsets).astype(np.int64), np.asarray(terms.values)
        flat, off = flat[off[0] : off[-1]], off - off[0]
        n, size, near = np.diff(off), table.column("size").to_numpy(), np.zeros(len(table), np.int64)
        edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            split = int((~second[a:b]).sum()) if apart else 0
            for lo, hi, common in shared(flat[off[a] : off[b]], np.repeat(np.arange(b - a), n[a:b]), b - a, split):
                both = n[a + lo : a + hi, None] + n[None, a + split : b]
                alike = np.round(common / (both - common), 6) > t
                if not apart:
                    alike[np.arange(hi - lo), np.arange(lo, hi)] = False
                near[a + lo : a + hi] += alike @ size[a + split : b]
                if apart:
                    near[a + split : b] += size[a + lo : a + hi] @ alike
        yield pa.RecordBatch.from_arrays([table.column("path").combine_chunks(), pa.array(near)], ["path", "near"])

    return dealt.groupBy("g").applyInArrow(count, "path string, near long").groupBy("path").agg(F.sum("near").alias("near"))


def _alike(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets, their classes by the smallest path, and the similar pairs of classes: ``p, q, jaccard``."""
    sets = written(sets)  # texts are split once
    rows = _described(sets, threshold)
    classes = rows.groupBy("n", "k1", "k2").agg(F.min("path").alias("path"))
    first = rows.join(classes, ["n", "k1", "k2", "path"], "left_semi").select("path", "n", "signature", "rare", "place")
    found = cut(_met(first, threshold).distinct())
    some = _among(sets, found.select(F.explode(F.array("p", "q")).alias("path")))
    held = found.join(some.select(F.col("path").alias("p"), F.col("terms").alias("x")), "p").join(some.select(F.col("path").alias("q"), F.col("terms").alias("y")), "q")
    n = F.size(F.array_intersect("x", "y"))
    similar = held.select("p", "q", F.round(n / (F.size("x") + F.size("y") - n), 6).alias("jaccard")).where(F.col("jaccard") > threshold)
    return rows, classes, similar


def _members(rows: DataFrame, classes: DataFrame, similar: DataFrame, threshold: float) -> DataFrame:
    """The pairs of all members of similar classes and of each class. Members are dealt into
    blocks, and pairs of blocks to tasks, so that no task has a large class for itself."""
    key = ["n", "k1", "k2"]
    members = rows.select(*key, "path").join(classes.withColumnRenamed("path", "rep"), key)
    blocks = cut(members.groupBy("rep", F.pmod(F.xxhash64("path"), F.lit(BLOCKS)).alias("block")).agg(F.collect_list("path").alias("paths")))
    of = lambda c: blocks.select(F.col("rep").alias(c), F.col("block").alias(f"{c}_block"), F.col("paths").alias(f"{c}_paths"))
    inside = of("p").join(of("q"), F.col("p") == F.col("q")).where("p_block <= q_block and (p_block < q_block or size(p_paths) > 1)").withColumn("jaccard", F.lit(1.0)).where(F.col("jaccard") > threshold)
    across = similar.join(of("p"), "p").join(of("q"), "q")
    both = across.unionByName(inside.select(*across.columns)).repartition("p", "q", "p_block", "q_block")
    pairs = both.select("jaccard", (F.col("p") == F.col("q")).alias("one"), (F.col("p_block") == F.col("q_block")).alias("same"), F.explode("p_paths").alias("x"), "q_paths").select("jaccard", "one", "same", "x", F.explode("q_paths").alias("y"))
    return pairs.where("not one or not same or x < y").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "jaccard")


def pack(files: DataFrame, group: str, budget: int) -> DataFrame:
    """Greedy packing by group: best score first, whole if it fits, else cut to what is left;
    an action per group, run in its own task. ``files``: group, path, score, tokens."""
    import pandas as pd

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in rows.sort_values(["score", "path"], ascending=[False, True]).itertuples():
            used = min(int(r.tokens), left)
            if used <= 0:
                continue
            left -= used
            out.append((getattr(r, group), r.path, used, used < r.tokens))
        return pd.DataFrame(out, columns=[group, "path", "used", "truncated"])

    kind = dict(files.dtypes)[group]
    return files.groupBy(group).applyInPandas(fill, f"{group} {kind}, path string, used long, truncated boolean")


def budget_prefix(rows: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group's rows that fits the budget."""
    run = F.sum(tokens).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("running", run).where(F.col("running") <= budget)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: new, deleted or modified by content hash."""
    a, b = old.select("path", F.sha2("content", 256).alias("ha")), new.select("path", F.sha2("content", 256).alias("hb"))
    kind = F.when(F.col("ha").isNull(), "new").when(F.col("hb").isNull(), "deleted").when(F.col("ha") != F.col("hb"), "modified")
    return a.join(b, "path", "full").select("path", kind.alias("change")).where("change is not null")


#: Name and pattern of the secret scan; fixed values.
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_pat": r"ghp_[a-zA-Z0-9]{36}",
    "password_assignment": r"""(?i)(password|secret|api_key|token)\s*[:=]\s*["'][^"']{8,}["']""",
    "connection_string": r"://[^:]+:[^@]+@",
    "slack_token": r"xox[baprs]-[0-9a-zA-Z-]{10,}",
}


def secrets(files: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("hits")) for k, p in SECRETS.items()])
    return files.select("path", F.explode(kinds).alias("k")).select("path", "k.kind", F.col("k.hits").cast("long").alias("hits")).where("hits > 0")


def gate(base: DataFrame, now: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``metric, change, ok``: no metric (metric, value) may fall by more than the tolerance; one
    that is missing now fails."""
    both = base.join(now.select("metric", F.col("value").alias("now")), "metric", "left")
    return both.select("metric", F.round(F.col("now") - F.col("value"), 6).alias("change"), F.coalesce(F.col("now") >= F.col("value") - tolerance, F.lit(False)).alias("ok"))


def set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change`` and the columns of two sets of rows: what came and what went."""
    a, b = old.distinct(), new.select(*old.columns).distinct()
    return b.subtract(a).select(F.lit("added").alias("change"), "*").unionByName(a.subtract(b).select(F.lit("removed").alias("change"), "*"))


#: Rows of a block of queries or vectors: a task holds one of each, and their product in pieces of so many numbers.
BLOCK, PIECE = 1 << 15, 1 << 21


def cosine_batch(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4, block: int = BLOCK) -> DataFrame:
    """``query, rank, id, similarity``: for each query (``query``, ``vec``) the ``k`` nearest of all vectors (``id``, ``vec``) by cosine, rounded
    to ``digits``, ties to the smaller id. Both sides are dealt into blocks, and each block of queries meets each block of vectors in a task, so
    either side travels once for each block of the other; a product leaves ``k`` rows for each query, which are merged by rank. Vectors
    that are null, or hold a null or a number that isn't finite, and those of another length than a query's, don't meet it; with a vector of
    zeros the similarity is 0, and a query of zeros finds nothing."""
    own = written(_usable(vectors.select("id", "vec")))
    asked = written(_usable(queries.select("query", "vec")))
    blocks = {side: max(1, -(-df.count() // block)) for side, df in (("v", own), ("q", asked))}
    numbered = lambda df, key, n, other, name: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))))
    left = numbered(own, "id", blocks["v"], ("_q", blocks["q"]), "_v")
    right = numbered(asked, "query", blocks["q"], ("_v", blocks["v"]), "_q")
    ids, keys = own.schema["id"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()

    def product(key: tuple, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _nearest(v, q, k, digits)

    met = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(product, f"query {keys}, id {ids}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def _nearest(v: pd.DataFrame, q: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """``query, id, similarity`` of the ``k`` nearest of a block of vectors for each query of another. A product is made for as many queries
    at once as give ``PIECE`` numbers, and changed in place; what is found is kept in arrays, not in a table for each query."""
    query, ids, found = [], [], []
    for size, some in q.groupby(q["vec"].map(len)):
        near = v[v["vec"].map(len) == size]
        if near.empty:
            continue
        a, at, keys = np.stack(near["vec"].to_numpy()).astype(float), near["id"].to_numpy(), some["query"].to_numpy()
        length = np.sqrt((a * a).sum(1))
        rows = max(1, PIECE // len(a))
        for lo in range(0, len(some), rows):
            b = np.stack(some["vec"].iloc[lo : lo + rows].to_numpy()).astype(float)
            norm = np.sqrt((b * b).sum(1))
            sim = b @ a.T
            with np.errstate(invalid="ignore", divide="ignore"):
                sim /= norm[:, None] * length[None, :]
            np.round(np.nan_to_num(sim, copy=False), digits, out=sim)
            sim += 0.0
            for i in np.flatnonzero(norm):
                best = np.lexsort((at, -sim[i]))[:k] if len(at) <= 4 * k else _best(sim[i], at, k)
                query.append(np.repeat(keys[lo + i : lo + i + 1], len(best)))
                ids.append(at[best])
                found.append(sim[i][best])
    if not found:
        return pd.DataFrame({"query": [], "id": [], "similarity": []})
    return pd.DataFrame({"query": np.concatenate(query), "id": np.concatenate(ids), "similarity": np.concatenate(found)})


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _best(sim: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, ties to the smaller id: all that reach the k-th value are ordered."""
    least = np.partition(sim, len(sim) - k)[len(sim) - k]
    some = np.flatnonzero(sim >= least)
    return some[np.lexsort((at[some], -sim[some]))[:k]]
