"""A content-addressed store of token ids.

Documents are encoded with a tokenizer file of the ``tokenizers`` library, and an end id is
put behind each. A rolling hash over the last ids cuts a document's ids into chunks, so
that equal stretches give equal chunks; a chunk is named by the hash of its bytes and stored
once, in the row of the first document that holds it. Recipes, in ascending doc_id order
and in numbered shards, name the chunks of each document; a Merkle tree over a shard's
recipes, and one over the shards, verify the store.

The store is two tables in a folder that all executors share (any store that Spark writes):
``documents`` (shard, ordinal, rid, doc_id, start in the shard, n_tokens, the names and sizes
of its chunks, the chunks it owns in a row, which of its chunks others own, and which of its
own others use) and ``manifest`` (shard, n_docs, n_tokens, root). Ids are packed as
little-endian unsigned integers of 16 bits, or 32 where the vocabulary is larger. As most
chunks stand in the row of their document, reading back moves only those that several share.

Defined results: null or empty text is the end id alone; special-token strings are ordinary
text; rows without a doc_id come first, and repeated rows are stored one after the other,
sharing their chunks; an empty table gives an empty store; further columns are ignored. A
damaged chunk, recipe or manifest raises ValueError when it is read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.bpe import AT_ONCE, Stretches
from graphloom.llm.common import KEPT, U64, flat, forget, materialise, mix, partitions, release, row_slices, shared_dir, ship

WINDOW = 8
#: Mean, least and largest ids of a chunk.
MEAN_BITS, LEAST, MOST = 8, 48, 4096
ID_BYTES = 16
_ROLL = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], U64)
#: Uses of a chunk that are sent it from one place.
USES = 1000
#: Stretches that a worker's memo holds, and of a row.
MEMO, ROW = 780_000, 4096


#: The letters by which byte-level vocabularies write bytes: printable ones stand for
#: themselves, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {c: (c if c in _SELF else 256 + sum(x not in _SELF for x in range(c))) for c in range(256)}


def _letters_alone(tok: Tokenizer) -> bool:
    """Whether the tokenizer makes one match of a space and letters, and codes it by its
    model alone: byte-level, by the usual pattern, with no added token of letters."""
    told = json.loads(tok.to_str())
    split = told["pre_tokenizer"] or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return usual and told["normalizer"] is None and told["model"]["type"] == "BPE" and not any(t["content"].strip().isalpha() for t in told["added_tokens"])


_encoders: dict[str, Stretches] = {}
KEPT.append(_encoders)


def encoder(path: str) -> Stretches:
    """The memo of a worker. Stretches that aren't known go to the library in rows; the
    lengths of the tokens tell them apart."""
    if path not in _encoders:
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        vocabulary = tok.get_vocab(with_added_tokens=False)
        width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for letters, i in vocabulary.items():  # a letter of a byte-level vocabulary is a byte
            length[i] = len(letters)

        def ids_of(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def code(stretches: list[str]) -> list[bytes]:
            return [np.array(ids, f"<u{width}").tobytes() for ids in ids_of(stretches)]

        one = tok.model.tokenize
        dtype = f"<u{width}"
        plain = _letters_alone(tok)

        def code_words(keys: list[bytes]) -> list[bytes]:
            """Of stretches as below: those of letters alone are one match each, which goes to
            the library's model as it is; the others go to the library in rows."""
            out, rest, letters, which = [b""] * len(keys), [], [], []
            for i, k in enumerate(keys):
                if plain and k[1:].isalpha():  # of ASCII
                    letters.append("\u0120" + k[1:].decode())
                elif plain and (s := k[1:].decode()).isalpha() and max(s) < "\u0250":
                    letters.append(k.decode("latin-1").translate(_LETTERS))
                else:
                    rest.append(i)
                    continue
                which.append(i)
            ids, ends = [], [0]
            for s in letters:
                ids += [t.id for t in one(s)]
                ends.append(width * len(ids))
            packed = np.array(ids, dtype).tobytes()
            for i, a, z in zip(which, ends, ends[1:], strict=False):
                out[i] = packed[a:z]
            for i, v in zip(rest, code_rows([keys[i] for i in rest]), strict=True):
                out[i] = v
            return out

        def code_rows(keys: list[bytes]) -> list[bytes]:
            """Of stretches with one space in front and no white space at their ends: that
            space always begins a match, so the encoding of a row of them is the row of
            their encodings."""
            out: list[bytes] = []
            for lo in range(0, len(keys), ROW):
                parts = keys[lo : lo + ROW]
                ids = np.array(ids_of([b"".join(parts).decode()])[0], np.int64)
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
                at = (np.searchsorted(np.cumsum(length[ids]), ends, side="left") + 1) * width
                packed, at = ids.astype(f"<u{width}").tobytes(), [0, *at.tolist()]
                out += [packed[a:z] for a, z in zip(at, at[1:], strict=False)]
            return out

        _encoders[path] = Stretches(code, width, MEMO, code_words)
    return _encoders[path]


def boundaries(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of documents whose ids stand in a row from ``at`` on, each with an
    end id behind it: where the rolling hash of the last ``WINDOW`` ids of the document says
    so, at least ``LEAST`` and at most ``MOST`` ids after the previous end."""
    # WINDOW zeros in front of each document; sums over 1, 2, 4 ids give those over 2, 4, 8
    place = np.arange(len(ids)) + np.repeat(WINDOW * np.arange(1, len(at)), np.diff(at))
    h = np.zeros(len(ids) + WINDOW * (len(at) - 1), U64)
    h[place] = ids.astype(U64) + U64(1)
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] * _ROLL[k - 1]
        k *= 2
    cut = np.flatnonzero(mix(h[place] * _ROLL[0]) >> U64(64 - MEAN_BITS) == 0)
    first = np.searchsorted(cut, at).tolist()
    cuts, begin = (cut + 1).tolist(), at.tolist()
    out = []
    for d in range(len(begin) - 1):
        n, own, last = begin[d + 1] - begin[d] + 1, [], 0
        for c in [*[c - begin[d] for c in cuts[first[d] : first[d + 1]]], n]:
            while c - last > MOST:
                last += MOST
                own.append(last)
            if c - last >= LEAST or (c == n and c > last):
                own.append(c)
                last = c
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree whose inner nodes hash their two children; a lone node moves up."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@dataclass
class Store:
    """A written store."""

    spark: SparkSession
    path: str
    width: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def offsets(self) -> list[tuple[int, int]]:
        """(shard, ids in all shards before it); a row for each shard."""
        rows = sorted((r.shard, r.n_tokens) for r in self.table("manifest").select("shard", "n_tokens").collect())
        total, out = 0, []
        for shard, n in rows:
            out.append((shard, total))
            total += n
        return out


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row for each document: its ids, and the names and sizes of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)
        width = memo.width
        end = end_id.to_bytes(width, "little")
        for b in batches:
            data, off = flat(b.column("text"))
            for lo, hi in row_slices(off, AT_ONCE):
                all_ids, at = memo.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n, names, sizes, ids = [], [], [], []
                for a, z, stops in zip(at.tolist(), at[1:].tolist(), boundaries(all_ids, at), strict=False):
                    raw = all_ids[a:z].tobytes() + end
                    names.append(b"".join([_name(raw[x * width : y * width]) for x, y in zip([0, *stops], stops, strict=False)]))
                    sizes.append(struct.pack(f"<{len(stops)}H", *[y - x for x, y in zip([0, *stops], stops, strict=False)]))
                    n.append(len(raw) // width)
                    ids.append(raw)
                keys = b.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (names, sizes, ids)]], ["doc_id", "n_tokens", "names", "sizes", "ids"])
        release(keep=True)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, n_tokens long, names binary, sizes binary, ids binary")


def _name(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:ID_BYTES]


def _leaf(doc_id: int | None, n: int, names: bytes) -> bytes:
    return hashlib.sha256(f"{doc_id} {n} ".encode() + names).digest()


def _named() -> list:
    """(seq, name) columns of a document's chunks."""
    size = ID_BYTES
    parts = F.expr(f"transform(sequence(0, greatest(cast(octet_length(names) / {size} as int) - 1, 0)), i -> substring(names, i * {size} + 1, {size}))")
    return [F.posexplode(parts).alias("seq", "name")]


def _shared(encoded: DataFrame) -> DataFrame:
    """``name, o_doc, o_rid, o_seq, salts`` of the chunks that are used more than once. The first use,
    by doc_id and row, owns a chunk."""
    uses = encoded.select("doc_id", "rid", *_named())
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "rid", "seq"))
    owner = uses.groupBy("name").agg(F.count("*").alias("n"), first.alias("o")).where("n > 1")
    return owner.select("name", F.nullif(F.col("o.d"), F.lit(-(1 << 63))).alias("o_doc"), F.col("o.rid").alias("o_rid"), F.col("o.seq").alias("o_seq"), F.expr(f"cast(n div {USES} + 1 as int)").alias("salts"))


def _marks(encoded: DataFrame, owner: DataFrame) -> DataFrame:
    """``doc_id, rid, kind, parts``: for each document that shares chunks, the places of its
    chunks that others own (kind 0) and of its own that others use (kind 1), each with the
    number of salts its uses are dealt over."""
    uses = encoded.select("doc_id", "rid", *_named())
    own = owner.select(F.col("o_doc").alias("doc_id"), F.col("o_rid").alias("rid"), F.lit(1).alias("kind"), F.struct(F.col("o_seq").alias("seq"), "salts").alias("p"))
    others = uses.join(owner, "name").where("rid <> o_rid or seq <> o_seq").select("doc_id", "rid", F.lit(0).alias("kind"), F.struct("seq", "salts").alias("p"))
    return own.unionByName(others).groupBy("doc_id", "rid", "kind").agg(F.array_sort(F.collect_list("p")).alias("parts"))


#: Ids of a shard, where that gives fewer shards than partitions. Each file that Spark's
#: writers open in a local folder starts two processes (chmod), whatever it holds.
SHARD_IDS = 1 << 20
#: Rows for each shard, of which the splitters between shards are drawn.
PER_SHARD = 32


def _part(encoded: DataFrame, n: int, count: int) -> Column:
    """The shard of a document, as an expression of its doc_id and row: by splitters from a
    bounded sample, so that ids are read, but no payload."""
    key = lambda: F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("rid").alias("r"))
    place = F.pmod(F.xxhash64("rid"), F.lit(1 << 30))
    share = min(1.0, 1.5 * n * PER_SHARD / max(1, count))
    some = encoded.select("doc_id", "rid").where(place <= int(share * (1 << 30))).select(key().alias("k"), place.alias("p")).orderBy("p").limit(n * PER_SHARD)
    sample = sorted(tuple(r.k) for r in some.collect())
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    if not cuts:
        return F.lit(0)
    known = F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(r).cast("long").alias("r")) for d, r in cuts])
    return F.size(F.filter(known, lambda c: c <= key()))


def write(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> Store:
    """Encode ``docs`` and write the store into ``folder`` (a new one in the shared folder)."""
    spark = ship(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    width = _width(path)
    # the row id is written with the row, so it stays what it is
    encoded = materialise(_encoded(docs, path, end_id).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    count, ids = encoded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n = min(partitions(spark), ids // SHARD_IDS + 1)
    few = lambda df: df.repartition(n) if n < partitions(spark) else df
    owner = materialise(few(_shared(encoded)), "shared-chunks")
    marks = materialise(few(_marks(encoded, owner)), "marks")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, ordinal = None, 0, 0
        marked: dict[int, list] = {}
        for b in batches:
            out = []
            for part, kind, rid, doc_id, size, names, sizes, ids, parts in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "rid", "doc_id", "n_tokens", "names", "sizes", "ids", "parts")), strict=True):
                if part != shard:
                    shard, start, ordinal = part, 0, 0
                if kind < 2:
                    marked[kind] = [rid, parts]
                    continue
                mine = [marked[k][1] if k in marked and marked[k][0] == rid else [] for k in (0, 1)]
                own, foreign = ids, {p["seq"] for p in mine[0]}
                if foreign:
                    ends = np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64)) * width
                    own = b"".join([ids[a:z] for i, (a, z) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) if i not in foreign])
                marks_ = [np.array([(p["seq"], p["salts"]) for p in m], "<u4").tobytes() if m else b"" for m in mine]
                out.append((shard, ordinal, rid, doc_id, start, size, names, sizes, own, *marks_))
                start, ordinal = start + size, ordinal + 1
            cols = list(zip(*out, strict=True)) if out else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)
        release()

    rows = encoded.withColumn("kind", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    dealt = rows.withColumn("part", _part(encoded, n, count)).repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "rid", "kind")
    dealt.mapInArrow(shards, ROWS).write.option("compression", "zstd").parquet(f"{folder}/documents")
    store = Store(spark, folder, width)
    _roots(store).repartition(1).write.parquet(f"{folder}/manifest")  # a row for each shard
    forget(encoded, marks, owner)
    return store


def _width(path: str) -> int:
    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def _roots(store: Store) -> DataFrame:
    """The manifest that the recipes as they are give: one row for each shard. A leaf is
    the hash of a recipe's doc_id, count and chunk names, computed afresh."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, leaves, total, now = [], [], 0, None
        for b in batches:
            for shard, doc_id, size, names in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "names")), strict=True):
                if shard != now and now is not None:
                    out.append((now, len(leaves), total, merkle(leaves)))
                    leaves, total = [], 0
                now = shard
                leaves.append(_leaf(doc_id, size, names))
                total += size
        if now is not None:
            out.append((now, len(leaves), total, merkle(leaves)))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "n_docs", "n_tokens", "root"])

    rows = store.table("documents").select("shard", "ordinal", "doc_id", "n_tokens", "names")
    return rows.repartition(partitions(store.spark), "shard").sortWithinPartitions("shard", "ordinal").mapInArrow(roots, "shard int, n_docs long, n_tokens long, root binary")


def verify(store: Store) -> bytes:
    """The root over all shards; raises if the recipes don't give the manifest."""
    told = {r.shard: (r.n_docs, r.n_tokens, bytes(r.root)) for r in store.table("manifest").collect()}
    found = {r.shard: (r.n_docs, r.n_tokens, bytes(r.root)) for r in _roots(store).collect()}
    if told != found:
        raise ValueError("the recipes don't match the manifest")
    return merkle([told[k][2] for k in sorted(told)])


def _starts(store: Store) -> DataFrame:
    """shard and ids before it: one small row for each shard."""
    return F.broadcast(store.spark.createDataFrame(store.offsets() or [(-1, 0)], "shard int, before long"))


def _places(raw: bytes) -> list[list[int]]:
    return np.frombuffer(raw, "<u4").reshape(-1, 2).tolist()


def _chunks_of(row: dict, width: int, lent: dict[int, bytes] | None = None) -> list[bytes | None]:
    """The chunks of a row in order: its own, held against their names, and those lent to
    it; None where a chunk of another isn't given."""
    names, sizes, own = row["names"], np.frombuffer(row["sizes"], "<u2").tolist(), row["own"]
    foreign = {i for i, _ in _places(row["foreign"])}
    out, at = [], 0
    for i, n in enumerate(sizes):
        if i in foreign:
            part = (lent or {}).get(i)
        else:
            part = own[at : at + n * width]
            at += n * width
        if part is not None and _name(part) != names[i * ID_BYTES : (i + 1) * ID_BYTES]:
            raise ValueError("a chunk doesn't match its name")
        out.append(part)
    if at != len(own) or len(sizes) * ID_BYTES != len(names):
        raise ValueError("a document's chunks don't match its recipe")
    return out


def reconstruct(store: Store, crc: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, put together again from its chunks,
    each held against its name; ids as packed in the store, or where ``crc`` holds only
    ``ids_crc32``, the crc32 of the ids as little-endian unsigned 32-bit integers. Rows that
    hold all their chunks are read where they stand; the others are sent the chunks they share."""
    spark, width = store.spark, store.width
    rows = store.table("documents")
    last = "ids_crc32" if crc else "ids"
    done = f"shard int, doc_id long, start long, n_tokens long, {last} {'long' if crc else 'binary'}"

    def told(ids: list[bytes]) -> pa.Array:
        if crc:
            return pa.array([zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in ids], pa.int64())
        return pa.array(ids, pa.binary())

    def finish(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)], told(cols[4])], ["shard", "doc_id", "start", "n_tokens", last])

    def whole(row: dict, lent: dict[int, bytes] | None = None) -> tuple:
        parts = _chunks_of(row, width, lent)
        if None in parts:
            raise ValueError("a chunk of a document is missing")
        ids = b"".join(parts)
        if len(ids) != row["n_tokens"] * width:
            raise ValueError("a document doesn't have the length that its recipe tells")
        return row["shard"], row["doc_id"], row["start"], row["n_tokens"], ids

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256
        for b in batches:
            packed = b.column("own").to_pylist()
            for n, names, sizes, own in zip(*(b.column(c).to_pylist() for c in ("n_tokens", "names", "sizes")), packed, strict=True):
                view = memoryview(own)
                ends = (np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64)) * width).tolist()
                named = b"".join([digest(view[x:y]).digest()[:ID_BYTES] for x, y in zip([0, *ends], ends, strict=False)])
                at = ends[-1] if ends else 0
                if named != names:
                    raise ValueError("a chunk doesn't match its name")
                if at != len(own) or at != n * width:
                    raise ValueError("a document doesn't have the length that its recipe tells")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("shard", "doc_id", "start", "n_tokens")], told(packed) if crc else b.column("own")], ["shard", "doc_id", "start", "n_tokens", last])

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = _chunks_of(r, width)
                for i, salts in _places(r["lent"]):
                    name = r["names"][i * ID_BYTES : (i + 1) * ID_BYTES]
                    out += [(name, salt, parts[i]) for salt in range(salts)]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary()), strict=True)], ["name", "salt", "payload"])

    def borrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, names, foreign in zip(*(b.column(c).to_pylist() for c in ("rid", "names", "foreign")), strict=True):
                out += [(names[i * ID_BYTES : (i + 1) * ID_BYTES], rid % salts, rid, i) for i, salts in _places(foreign)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["name", "salt", "rid", "seq"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lent = None, {}
        for b in batches:
            docs = {i: r for i, r in zip(np.flatnonzero(~np.asarray(b.column("seq").is_valid())).tolist(), b.filter(b.column("seq").is_null()).to_pylist(), strict=True)}
            out = []
            for i, (rid, seq, payload) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rid", "seq", "payload")), strict=True)):
                if rid != now:
                    now, lent = rid, {}
                if seq is not None:
                    lent[seq] = payload
                else:
                    out.append(whole(docs[i], lent))
            yield finish(out)
        release()

    complete = rows.where("octet_length(foreign) = 0").select("shard", "doc_id", "start", "n_tokens", "names", "sizes", "own").mapInArrow(alone, done)
    sent = rows.where("octet_length(lent) > 0").select("names", "sizes", "own", "foreign", "lent").mapInArrow(lend, "name binary, salt int, payload binary")
    partial = rows.where("octet_length(foreign) > 0")
    wanted = partial.select("rid", "names", "foreign").mapInArrow(borrow, "name binary, salt int, rid long, seq int")
    got = wanted.join(sent, ["name", "salt"]).select("rid", "seq", "payload")
    both = got.unionByName(partial.select("rid", "shard", "doc_id", "start", "n_tokens", "names", "sizes", "own", "foreign"), allowMissingColumns=True)
    dealt = both.repartition(partitions(spark), "rid").sortWithinPartitions("rid", F.asc_nulls_last("seq"))
    # a row of one document each, so few shards need no more tasks
    read = complete.unionByName(dealt.mapInArrow(join, done).coalesce(max(1, len(store.offsets()))))
    return read.join(_starts(store), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", last)


def checksums(store: Store) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its reconstructed ids
    as little-endian unsigned 32-bit integers, after the recipes have been verified."""
    verify(store)
    return reconstruct(store, crc=True)


ROWS = "shard int, ordinal long, rid long, doc_id long, start long, n_tokens long, names binary, sizes binary, own binary, foreign binary, lent binary"
_ROWS = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in ROWS.split(", ")])
