"""The token store: reading back, sharing, and damage."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import token_store
from graphloom.llm.bpe import Stretches

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    w = [f"{a}{b} " for a in ("the", "of", "wo", "zi") for b in range(60)]
    texts = ["".join(r.choice(w) for _ in range(r.randint(0, 2500))) for _ in range(30)]
    texts += texts[:6] * 3 + [texts[2] + texts[3], texts[0] * 3, None, ""]
    return spark.createDataFrame([(i if i != 7 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)], "doc_id long, text string, names int").repartition(5)


@pytest.fixture(scope="module")
def store(docs):
    return token_store.write(docs, JSON)


def brute(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    out, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_reads_back_what_the_library_gives(docs, store):
    got = sorted((tuple(r) for r in token_store.checksums(store).collect()), key=lambda r: r[1])
    assert got == brute(docs)


def test_a_chunk_is_stored_once(store):
    names, lent = [], 0
    for r in store.table("documents").collect():
        foreign = {i for i, _ in token_store._places(r.foreign)}
        own = [r.names[i : i + 16] for i in range(0, len(r.names), 16)]
        names += [bytes(x) for i, x in enumerate(own) if i not in foreign]
        lent += len(foreign)
    assert len(names) == len(set(names)) and lent > 50


def files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_files_go_by_what_they_hold(spark, docs, monkeypatch, tmp_path):
    """Every file starts processes beside its executor, so partitions alone make none."""
    shared = []

    def kept(df, name, real=token_store.materialise):
        out = real(df, name)
        shared.append((name, len(files(out._graphloom_path.removeprefix("file:")))))
        return out

    monkeypatch.setattr(token_store, "materialise", kept)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        store = token_store.write(docs, JSON, folder=str(tmp_path / "store"))
        token_store.checksums(store).write.parquet(str(tmp_path / "read"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "read")).collect()), key=lambda r: r[1]) == brute(docs)
    assert len(files(tmp_path / "store" / "documents")) == len(files(tmp_path / "store" / "manifest")) == 1
    assert len(files(tmp_path / "read")) == 2  # whole rows, and those put together
    assert [(name, n) for name, n in shared if name != "encoded"] == [("shared-chunks", 1), ("marks", 1)]


def test_many_shards_in_one_manifest(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "SHARD_IDS", 100)
    store = token_store.write(docs, JSON, folder=str(tmp_path / "store"))
    assert store.table("manifest").count() == 4
    assert len(files(tmp_path / "store" / "manifest")) == 1
    assert sorted((tuple(r) for r in token_store.checksums(store).collect()), key=lambda r: r[1]) == brute(docs)


def test_hot_chunks_are_dealt_over_salts(docs, monkeypatch):
    monkeypatch.setattr(token_store, "USES", 2)
    store = token_store.write(docs, JSON)
    assert sorted((tuple(r) for r in token_store.checksums(store).collect()), key=lambda r: r[1]) == brute(docs)


def damaged(spark, store, change, tmp_path, table="documents"):
    folder = str(tmp_path / "store")
    for name in ("documents", "manifest"):
        df = store.table(name)
        (change(df) if name == table else df).write.parquet(f"{folder}/{name}")
    return token_store.Store(spark, folder, store.width)


FLIP = "concat(substring(own, 1, 10), unhex('ff'), substring(own, 12, octet_length(own)))"


@pytest.mark.parametrize(
    "table, change",
    [
        ("documents", lambda d: d.withColumn("own", F.when(F.col("doc_id") == 4, F.expr(FLIP)).otherwise(F.col("own")))),
        ("documents", lambda d: d.withColumn("doc_id", F.col("doc_id") + 1)),
        ("documents", lambda d: d.withColumn("names", F.when(F.col("doc_id") == 4, F.expr("concat(substring(names, 17, 16), substring(names, 1, 16), substring(names, 33, octet_length(names)))")).otherwise(F.col("names")))),
        ("documents", lambda d: d.where("doc_id <> 5")),
        ("manifest", lambda d: d.withColumn("n_tokens", F.col("n_tokens") + 1)),
        ("manifest", lambda d: d.withColumn("root", F.unhex(F.sha2("root", 256)))),
    ],
)
def test_damage_is_found(spark, store, tmp_path, table, change):
    with pytest.raises(Exception, match="match|missing|length"):
        token_store.checksums(damaged(spark, store, change, tmp_path, table)).collect()


def test_boundaries_depend_on_their_document_alone():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 50, n) for n in (0, 1, 7, 40, 900, 9000, 3, 20_000)] + [np.zeros(10_000, np.int64)]
    at = np.r_[0, np.cumsum([len(x) for x in docs])]
    together = token_store.boundaries(np.concatenate(docs).astype(np.uint16), at)
    for x, got in zip(docs, together, strict=True):
        assert token_store.boundaries(x.astype(np.uint16), np.array([0, len(x)])) == [got]
        sizes = np.diff([0, *got])
        assert got[-1] == len(x) + 1 and (sizes[:-1] >= token_store.LEAST).all() and (sizes <= token_store.MOST).all()
    assert len(together[7]) > 20


def bytes_of(coded=None):
    """A code that gives each byte as an id, so that a text's encoding is its bytes."""

    def code(texts):
        if coded is not None:
            coded.extend(texts)
        return [np.frombuffer(t.encode(), np.uint8).astype("<u2").tobytes() for t in texts]

    return code


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def test_a_full_memo_keeps_what_was_met_again():
    coded = []
    memo = Stretches(bytes_of(coded), 2, 300)
    often = [f" often{i}" for i in range(100)]
    for r in range(40):
        texts = ["x" + "".join(often) + "".join(f" once{r}a{i}" for i in range(40)) + " y"]
        ids, _ = memo.encode(*arrays(texts))
        assert ids.astype(np.uint8).tobytes().decode() == texts[0]
        assert memo.known <= 300 + 142
    assert max(coded.count(x) for x in often) == 1
    assert len(set(coded)) == 40 * 40 + 102


@pytest.mark.parametrize("size", [20, 5000])
def test_stretches_of_any_length_are_told_apart(size):
    r = random.Random(3)
    memo = Stretches(bytes_of(), 2, size)
    long = "a" * 150
    some = [long[:n] for n in (*range(1, 20), 63, 64, 65, 66, 72, 80, 150)]
    some += [x[:-1] + c for x in some for c in ("b", "\0", "\0\0", "é")] + [x[:k] + "b" + x[k + 1 :] for x in some for k in (7, 8, 63, 64) if k < len(x)]
    for _ in range(12):
        texts = [" ".join(r.choice(some) for _ in range(r.randint(0, 30))) for _ in range(20)] + ["", " ", ". a", " a b　 c", "é. a.b,c"]
        data, off = arrays(texts)
        ids, at = memo.encode(data, off)
        assert [ids[a:z].astype(np.uint8).tobytes().decode() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)] == texts


def test_words_of_letters_are_coded_as_in_their_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    r = random.Random(4)
    letters = [chr(c) for c in range(1, 0x300)] + list("abcdeinorst" * 40) + list("'’ʼ٣五ǅªº́‍😀")
    texts = ["".join((r.choice(" \n.") if r.random() < 0.1 else " ") + "".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(200)) for _ in range(60)]
    texts += ["<|endoftext|> a<|endoftext|>b", " don't I'LL 'tis", "  a  b ", " ÀÉ ß× ÷ø"]
    ids, at = token_store.encoder(JSON).encode(*arrays(texts))
    assert [ids[a:z].tolist() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_tokenizer_that_splits_otherwise_gets_rows():
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    plain, lower, prefix, added = (Tokenizer.from_file(JSON) for _ in range(4))
    lower.normalizer = normalizers.Lowercase()
    prefix.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    added.add_tokens([" word"])
    assert [token_store._letters_alone(t) for t in (plain, lower, prefix, added)] == [True, False, False, False]


def test_boundaries_are_those_of_the_rolling_sum():
    r = np.random.default_rng(6)
    docs = [r.integers(0, 50_000, n).astype(np.uint16) for n in (3, 0, 9, 4000, 2500)]
    for x, got in zip(docs, token_store.boundaries(np.concatenate(docs), np.r_[0, np.cumsum([len(x) for x in docs])]), strict=True):
        h = [sum((int(x[i - k]) + 1) * int(token_store._ROLL[k]) for k in range(token_store.WINDOW) if i >= k) % (1 << 64) for i in range(len(x))]
        cut = (np.flatnonzero(token_store.mix(np.array(h, np.uint64)) >> np.uint64(64 - token_store.MEAN_BITS) == 0) + 1).tolist()
        own, last = [], 0
        for c in [*cut, len(x) + 1]:
            if c - last >= token_store.LEAST or c == len(x) + 1:
                own.append(c)
                last = c
        assert got == own
