"""The pipeline's stages on odd tables, and the stages' decisions against plain versions."""

import random

import pytest


import corpus_pipeline
from graphloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, removed long, _maybe string, score double, component_id long, cls long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", 1, "m", 0.5, 9, 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(1)
    bench = [" ".join(f"b{r.randint(0, 300)}" for _ in range(30)) for _ in range(5)]
    spark.createDataFrame([*enumerate(bench), (7, None), (None, "x"), (8, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), bench


@pytest.fixture(scope="module")
def odd(spark, folder):
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 40_000)}" for _ in range(150_000))
    rows = [(i, " ".join(f"w{r.randint(0, 900)}" for _ in range(40)) + (" scum" if i % 2 else "")) for i in range(1, 60)]
    rows += [(100, None), (101, None), (102, ""), (103, " \n\t"), (104, "one two"), (105, "one two"), (106, "One  TWO"), (107, long), (108, long), (109, long[: len(long) // 2] + " more " + long[len(long) // 2 :])]
    rows += [(None, "no id at all here"), (None, "no id at all here"), (None, None), (110, "same id"), (110, "same id"), (111, "x" * 300_000), (112, folder[1][0]), (112, folder[1][0])]
    return table(spark, rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, folder, odd, name, stage):
    got = stage(spark, odd, folder[0])
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert stage(spark, odd.limit(0), folder[0]).count() == 0
    if name == "byte_level_bpe":
        assert len(ids) == odd.count()
        return
    assert got.columns == odd.columns
    for c in ("kept", "removed", "_maybe", "component_id", "cls"):
        assert got.select(c).distinct().count() == 1
    assert ids.count(None) == 3
    if name == "simhash_near_dedup":
        assert not {101, 102, 103, 105, 106, 108, 109} & set(ids) and {100, 104, 107} <= set(ids) and ids.count(110) == 2
    if name == "suffix_array_dedup":
        texts = {r.doc_id: r.text for r in got.collect()}
        assert texts[100] is None and texts[108] == "" and texts[104] == "one two" and len(ids) == odd.count()
        assert all(r.n_chars == len(r.text) for r in got.where("text is not null and doc_id is not null").collect())
    if name == "decontamination":
        assert 112 not in ids and len(ids) == odd.count() - 2
    if name == "toxicity":
        assert {100, 101, 102, 103, 107} <= set(ids)


@pytest.mark.parametrize("tables", ["labels", "benchmark"])
def test_stages_without_labels_or_items(spark, folder, odd, tmp_path, tables):
    stage = dict(corpus_pipeline.STAGES)["toxicity" if tables == "labels" else "decontamination"]
    spark.read.parquet(f"{folder[0]}/{tables}.parquet").limit(0).write.parquet(f"{tmp_path}/{tables}.parquet")
    assert stage(spark, odd, str(tmp_path)).count() == odd.count()


def test_near_copies_equal_all_pairs(spark):
    """Groups of every size, chains, shared passages and lone texts, against all pairs."""
    r = random.Random(3)
    texts = []
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(90)]
        for k in range(r.choice([2, 5, 30, 60])):
            own = list(base)
            for j in r.sample(range(90), r.choice([0, 1, 2, 3, 5, 9])):
                own[j] = f"e{r.randint(0, 10**6)}"
            texts.append(own)
    shared = [f"p{i}" for i in range(60)]
    texts += [shared + [f"l{k}w{i}" for i in range(r.randint(5, 80))] for k in range(40)]
    texts += [[f"c{i}" for i in range(8 * k, 8 * k + 110)] for k in range(25)]
    r.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    n = len(texts)
    label = list(range(n))
    near = [[j for j in range(n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    for _ in range(n):
        new = [min(label[j] for j in near[i]) for i in range(n)]
        if new == label:
            break
        label = new
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs).collect()}
    assert {i: got.get(i, i) for i in range(n)} == dict(enumerate(label))


def test_prefix_pairs_leave_out_no_similar_pair(spark):
    r = random.Random(4)
    sets = []
    for k in range(120):
        base = set(range(100 * (k % 4), 100 * (k % 4) + r.randint(40, 90)))
        sets.append((base | {r.randint(1000, 9000) for _ in range(r.randint(0, 20))}) - set(r.sample(sorted(base), r.randint(0, 6))))
    packed = [(i, b"".join(x.to_bytes(5, "little") for x in sorted(s))) for i, s in enumerate(sets)]
    texts = spark.createDataFrame([(i, i, 1 if i % 3 else 0) for i in range(120)], "a long, comp long, probe int")
    got = {(x.a, x.b) for x in simhash.prefix_pairs(texts, spark.createDataFrame(packed, "doc_id long, s binary"), 0.8).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (i % 3 or j % 3) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 30
