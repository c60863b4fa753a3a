"""Approximate nearest neighbours by additive quantisation.

Each vector is approximated by a sum of full-dimensional codewords, one from each codebook.
Codebooks are fitted on a bounded sample: k-means on residuals, then a joint least-squares
step for all codebooks given the codes. Encoding is a beam search over the codebooks that
keeps the best partial sums; the squared norm of each sum and the length of what it leaves
are stored with the codes. A query looks its inner products with all codewords up in a
table and adds them up for every code. The best of these are scored exactly, and the
``k``-th of them sets a bar: further entries are scored exactly where the sum, plus what the
rest of the vector may add (``SIGMAS`` standard deviations of an inner product with a
residual of the stored length in any direction), reaches it, and where the stored norms
allow such a product at all. So the shortlist has no fixed length.

Rows with equal vectors are one entry of the index with the ids that can matter (the
``k`` + 1 smallest), so copies never crowd a shortlist. Queries and index meet in blocks of
bounded size; each cell reranks its own shortlist, and the cells' results are merged.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id, nor those whose length differs from the most
common one (the smaller of two as common). A row given twice counts once; a query's own id
is never among its results. Ties go to the smaller id. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, partitions, ship

CODEBOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8000
#: Distinct vectors of the index, and queries, in a block.
BLOCK, QUERIES = 16_384, 2048
#: Entries of each cell of blocks that are reranked first for a query, and how far beyond
#: its estimate an entry's product is looked for, in standard deviations.
SHORTLIST, SIGMAS = 100, 2.0
#: Queries that are scored at once, to bound memory.
AT_ONCE = 128


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[filled])[:-1]], axis=0) / n[filled, None]
        if len(filled) < k:
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


@dataclass
class Quantiser:
    """codebooks: (codebooks, words, dims)."""

    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, books: int = CODEBOOKS, words: int = WORDS, seed: int = 3) -> Quantiser:
        x = x.astype(np.float32)
        rng = np.random.default_rng(seed)
        left, found = x.copy(), []
        for _ in range(books):
            c = _kmeans(left, words, rng)
            found.append(c)
            left -= c[np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)]
        q = Quantiser(np.stack(found))
        # all codebooks together, given the codes
        codes = q.encode(x)[0].astype(np.int64) + np.arange(books) * words
        one = np.zeros((books * words,) * 2, np.float32)
        for a in range(books):
            for b in range(books):
                np.add.at(one, (codes[:, a], codes[:, b]), 1)
        rhs = np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(rhs, codes[:, a], x)
        # stays near the old words where few vectors speak
        old = q.books.reshape(books * words, -1)
        one.flat[:: len(one) + 1] += np.float32(1.0)
        rhs += old
        solved = np.linalg.solve(one, rhs)
        del one
        better = Quantiser(solved.reshape(q.books.shape).astype(np.float32))
        return better if better.loss(x) < q.loss(x) else q

    def loss(self, x: np.ndarray) -> float:
        return float(self.encode(x)[2].mean())

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared norm of the sum, squared length of the residual)."""
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        gram = flat @ flat.T
        out = []
        for lo in range(0, max(1, len(x)), 2048):
            v = x[lo : lo + 2048].astype(np.float32)
            n = len(v)
            dots = v @ flat.T
            cost = np.zeros((n, 1), np.float32)
            codes = np.zeros((n, 1, 0), np.int64)
            for b in range(m):
                own = slice(b * k, (b + 1) * k)
                step = np.diagonal(gram)[own] - 2 * dots[:, own]
                total = cost[:, :, None] + step[:, None, :]
                for a in range(b):
                    total += 2 * gram[codes[:, :, a] + a * k, own]
                total = total.reshape(n, -1)
                keep = min(beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                rows = np.arange(n)[:, None]
                codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], axis=2)
                cost = total[rows, best]
            at = np.argmin(cost, axis=1)
            chosen = codes[np.arange(n), at]
            low = cost[np.arange(n), at]
            residual = np.maximum((v * v).sum(1) + low, 0)
            made = sum(self.books[b][chosen[:, b]] for b in range(m))
            out.append((chosen.astype(np.uint8 if k <= 256 else np.uint16), (made * made).sum(1), residual))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: (codebooks, words, queries)."""
        return np.ascontiguousarray((self.books @ q.T.astype(np.float32)))


def approximate(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of coded vectors with queries, by looking up and adding: (codes, queries)."""
    out = tables[0][codes[:, 0]]
    for b in range(1, len(tables)):
        out += tables[b][codes[:, b]]
    return out


def search_cell(quantiser: Quantiser, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray], members: list[list[int]], k: int, shortlist: int) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of the ``k`` nearest found for each query in one block; ``coded``:
    codes, squared norms and squared lengths of the residuals of its entries."""
    codes, norm, left = coded
    out_q, out_v, out_s = [], [], []
    size = np.fromiter(map(len, members), np.int64, len(members))
    flat_ids = np.fromiter((i for m in members for i in m), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    take = min(max(shortlist, k + 1), len(codes))
    spread = np.sqrt(left / max(1, vectors.shape[1])).astype(np.float32) * SIGMAS
    longest = np.sqrt(norm) + np.sqrt(left)
    for lo in range(0, len(queries), AT_ONCE):
        q = queries[lo : lo + AT_ONCE].astype(np.float64)
        rough = approximate(quantiser.tables(q), codes).T
        first = np.argpartition(-rough, take - 1, axis=1)[:, :take]
        length = np.linalg.norm(q, axis=1)
        for row, (own, one) in enumerate(zip(ids[lo : lo + AT_ONCE].tolist(), q, strict=True)):
            who = first[row]
            exact = vectors[who].astype(np.float64) @ one
            if take < len(codes):  # the query's own entry may be among the k + 1
                bar = np.partition(exact, -(k + 1))[-(k + 1)]
                more = (rough[row] + length[row] * spread >= bar) & (length[row] * longest >= bar)
                more[who] = False
                more = np.flatnonzero(more)
                who, exact = np.r_[who, more], np.r_[exact, vectors[more].astype(np.float64) @ one]
            if len(who) > k + 1:
                best = exact >= np.partition(exact, -(k + 1))[-(k + 1)]
                who, exact = who[best], exact[best]
            n = size[who]
            at = np.repeat(start[who], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            v, s = flat_ids[at], np.repeat(exact, n)
            v, s = v[v != own], s[v != own]
            order = np.lexsort((v, -s))[:k]
            out_q.append(np.full(len(order), own))
            out_v.append(v[order])
            out_s.append(s[order])
    z = [np.zeros(0)]
    return np.concatenate(out_q or z).astype(np.int64), np.concatenate(out_v or z).astype(np.int64), np.concatenate(out_s or z)


def valid(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.col(vec).cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (common.d if common else 0))


def nearest(rows: DataFrame, is_query, k: int = 20, vec: str = "embedding", shortlist: int = SHORTLIST, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` (a column)
    holds, its ``k`` nearest others found by largest inner product."""
    spark = ship(rows.sparkSession)
    found = valid(rows, vec)
    # copies: the smallest ids are enough, as no other can be among k results
    first = W.partitionBy("v").orderBy("vec_id")
    members = found.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    entries = members.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    # thinned by hash first, so that the tasks together send about ``sample`` vectors
    share = min(1.0, 1.5 * sample / max(1, found.count()))
    thin = found.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).distinct()
    picked = thin.orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = Quantiser.fit(np.array([r.v for r in picked]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
            codes, norm, left = quantiser.encode(x)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32()), pa.array(left, pa.float32())], ["v", "ids", "codes", "norm", "residual"])

    index = materialise(entries.mapInArrow(encode, "v array<double>, ids array<long>, codes binary, norm float, residual float"), "ann-index")
    asked = found.where(is_query).distinct()
    n_index, n_asked = index.count(), asked.count()
    blocks, query_blocks = -(-n_index // block), max(1, -(-n_asked // query_block))
    all_queries, all_blocks = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (query_blocks, blocks))
    left = index.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b"), all_queries.alias("qb"), "v", "ids", "codes", "norm", "residual")
    right = asked.select(all_blocks.alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), "vec_id", "v")

    def cell(own: pa.Table, queries: pa.Table) -> pa.Table:
        q = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if own.num_rows and queries.num_rows:
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(own.num_rows, -1)
            coded = codes, np.asarray(own.column("norm")), np.asarray(own.column("residual"))
            q = search_cell(quantiser, matrix(queries), np.asarray(queries.column("vec_id")), matrix(own), coded, own.column("ids").to_pylist(), k, shortlist)
        return pa.table({"query_id": pa.array(q[0], pa.int64()), "vec_id": pa.array(q[1], pa.int64()), "score": pa.array(q[2], pa.float64())})

    cells = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(cell, "query_id long, vec_id long, score double")
    # an id given with several vectors can come from several cells; its best counts
    best = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
