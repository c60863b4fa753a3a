"""The Merkle manifest against a plain tree built in one place."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle
from graphloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return H(one(r["doc_id"]), one(r["source"]), one(r["lang"]), one(r["n_chars"]), one(text))


def grow(nodes):
    """Root of a list of digests, and for each the pairs of left and right siblings."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        runs = [now[k : k + 3] for k in range(0, len(now), 3)]
        for j, k in enumerate(at):
            run = runs[k // 3]
            paths[j].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[j] = k // 3
        now = [H(*run) for run in runs]
    return now[0], paths


def plain(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, upper = grow([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            proof = path + above
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            d = leaf_of(r, text)
            for left, right in proof:
                d = H(left, d, right)
            out.append((r["doc_id"], leaf, trees[s][0], root, H(*[a + b for a, b in proof]), d, d == root))
    return out


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_op11_equals_a_plain_tree(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = columns(QUERIES["op11_merkle_manifest"](spark, SMALL))
    assert sorted(got) == sorted(plain(rows))
    assert {r[-1] for r in got} == {True, False}


def test_op11_on_odd_rows(spark, tmp_path):
    """Nulls in each column, empty and long texts, repeated rows, a group of most rows, groups of one."""
    rows = [(i, f"line {i}\nend", "en", "hot", i) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, "é" * 300_000 + "\n", "fr", "Z", 1), (103, "a\nb", None, "z", None), (104, "\n\n", "de", "é", 2)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, "no id either", None, None, None), (7, "line 7\nend", "en", "hot", 7), (7, "other\n", "en", "hot", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as leaf", "2 as root", "'y' as proof", "1 as above")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = columns(QUERIES["op11_merkle_manifest"](spark, str(tmp_path)))
    want = plain([r.asDict() for r in df.collect()])
    # rows that are equal in all fields share a leaf; which of their proofs each has, is open
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [3], [4], [9, 1, 10], [28, 3]])
def test_sizes_of_groups(spark, sizes):
    rows = [{"doc_id": 100 * g + i, "text": f"t{i}", "lang": None, "source": f"s{g}", "n_chars": i} for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.verify(merkle.manifest(df))
    want = {w[0]: w for w in plain(rows)}
    for r in got.collect():
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][1:4] and r.verified
        assert H(*[s.left + s.right for s in r.proof]) == want[r.doc_id][4]


def test_columns_of_leaves_stay_and_own_ones_replace_theirs(spark):
    leaves = spark.range(5).select(F.col("id").alias("k"), F.lit("g").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(1).alias("root"), F.lit("w").alias("weight"))
    got = merkle.tree(leaves, "part", "k")
    assert got.columns == ["k", "part", "leaf", "weight", "subroot", "root", "proof"]
    root, _ = grow([hashlib.sha256(str(i).encode()).hexdigest() for i in range(5)])
    assert {(r.subroot, r.root, r.weight) for r in got.collect()} == {(root, root, "w")}  # a lone subroot is the root
