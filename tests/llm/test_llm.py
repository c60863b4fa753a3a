"""The corpus operators: odd rows, and brute-force versions on small tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import additive_ann, bpe, decontaminate, html_extract, quality, simhash, suffix_dedup, token_store, toxicity, urlfilter
from graphloom.llm.common import drop_ids
from graphloom.llm.graph import components

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE), special_tokens={})


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None, None, "x", 1.0) for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(r.randint(0, 300)) for _ in range(250_000))
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "same text of six words here"), (5, "same text of six words here"), (None, "no id"), (6, long), (7, "  \n\t "), (8, "x" * 5000)]
    return spark.createDataFrame([(i, t, None, "src0", None, "x", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(1, 400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    w = [f"w{i}" for i in range(300)]
    out = []
    for i in range(1, 400):
        t = [r.choice(w) for _ in range(60)]
        if i % 4 == 0:
            t.insert(r.randint(0, 60), r.choice(["idiot", "moron", "scum"]))
        out.append((i, " ".join(x.upper() + "!!" if i % 3 == 0 else x for x in t)))
    return spark.createDataFrame(out, "doc_id long, text string")


def test_classifiers_on_odd_rows(spark, labelled, labels):
    for train, score in ((toxicity.train, toxicity.score), (quality.train, quality.score)):
        model = train(labelled, labels)
        got = score(odd(spark), model).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
        assert score(odd(spark).limit(0), model).count() == 0
        none = train(labelled, labels.limit(0))
        assert score(odd(spark), none).count() == 10


def test_classifiers_held_out(spark, labelled, labels):
    for train, score, label, cut in ((toxicity.train, toxicity.score, "toxic", 0.5), (quality.train, quality.score, "quality", 0.3)):
        got = score(labelled, train(labelled, labels)).join(labels, "doc_id").where(toxicity.held_out() & F.col(label).isNotNull())
        right = got.agg(F.avg(((F.col("score") >= cut).cast("int") == F.col(label)).cast("int"))).first()[0]
        assert right > 0.9


def test_quality_statistics_of_a_long_text_are_those_of_the_whole(monkeypatch):
    r = random.Random(31)
    line = " ".join(f"w{r.randint(0, 400)}" for _ in range(40))
    for text in (f"{line}\n" * 60, " ".join(f"w{i % 90}" for i in range(3000)), "x" * 9000, "\n" * 40 + (f"{line}. Ab CD\n" * 3 + "y" * 700 + " ") * 20):
        data = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(data)])
        monkeypatch.setattr(quality, "SEGMENT", 1 << 30)
        want = quality.statistics(data, off)
        monkeypatch.setattr(quality, "SEGMENT", 512)
        assert np.array_equal(quality.statistics(data, off), want)


def test_toxicity_sees_the_end_of_a_long_text(spark, labelled, labels):
    model = toxicity.train(labelled, labels)
    text = "w1 w2 w3 " * 250_000
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [text, text + " idiot moron scum"]), model).collect()}
    assert got[1] > got[0]


def test_bpe_equals_library(spark):
    r = random.Random(3)
    bits = ["a", "th", "ing", "é", "中", "م", "0", " ", "  ", "\n", "'s", "!", "\x1c", "\x85", "²", "x" * 60, "ab" * 50, "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(200)] + ["a" * 9000, " " * 3000 + "x", "", None]
    got = {x.doc_id: x for x in bpe.encode(frame(spark, texts), BPE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = TIK.encode_ordinary(t or "")
        assert bytes(got[i].ids) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.digests(bpe.encode(odd(spark), BPE, public_tokenizers.PATTERN)).count() == 10


def test_bpe_join_is_a_monoid():
    m = bpe.MonoidBPE(bpe.load_ranks(BPE))
    r = random.Random(4)
    for _ in range(200):
        s = "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 120))).encode()
        k = r.randint(0, len(s))
        assert m.join(m.encode(s[:k]), m.encode(s[k:])) == m.encode(s) == TIK.encode_ordinary(s.decode())


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    r = random.Random(5)
    w = ["the ", "word", "é ", "中", "12", "  ", "\n", "!", "<|endoftext|>"]
    texts = ["".join(r.choice(w) for _ in range(r.randint(0, 900))) for _ in range(60)]
    texts += texts[:10] + [None, ""]
    store = token_store.write(frame(spark, texts).repartition(5), JSON)
    rows, start = {x.doc_id: x for x in token_store.checksums(store).collect()}, 0
    whole = {x.doc_id: x for x in token_store.reconstruct(store).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(raw))
        assert np.frombuffer(bytes(whole[i].ids), "<u2").tolist() == ids
        start += len(ids)
    assert token_store.checksums(token_store.write(odd(spark), JSON)).count() == 10
    assert token_store.checksums(token_store.write(odd(spark).limit(0), JSON)).count() == 0


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[i] = hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("hot", [1, 5])
def test_suffix_dedup_equals_brute_force(spark, hot):
    r = random.Random(6)
    phrases = ["".join(r.choice("abcdé \n") for _ in range(r.randint(20, 300))) for _ in range(20)]
    texts = ["".join(r.choice(phrases) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(5, 150))) for _ in range(r.randint(0, 6))) for _ in range(150)]
    texts += [None, "", "a" * 1000, "x" * 99, "x" * 100, texts[3]]
    got = suffix_dedup.digests(suffix_dedup.deduplicate(frame(spark, texts).repartition(4), hot_docs=hot))
    assert {x.doc_id: x.kept_sha256 for x in got.collect()} == brute_repeats(enumerate(texts))


def test_suffix_dedup_odd_rows(spark):
    done = suffix_dedup.deduplicate(odd(spark)).collect()
    assert len(done) == 10
    assert suffix_dedup.deduplicate(odd(spark).limit(0)).count() == 0
    assert all(len(r.removed) == 0 for r in done if r.doc_id in (1, 2, 3, 4, 5))


def test_simhash_equals_brute_force(spark):
    r = random.Random(7)
    base = [" ".join(r.choice(["ab", "cd", "Ef", "gh", "ij"]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    texts = base + base[:30] + [None, "", "one", "one two"]
    fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([label[near[i]].min() for i in range(len(fp))])
        if (new == label).all():
            break
        label = new
    got = {x.doc_id: x for x in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(fp))] == label.tolist()
    assert simhash.near_duplicates(odd(spark)).count() == 10
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_bucket_links_large_bucket_connects_like_pairs():
    r = np.random.default_rng(8)
    fp = np.unique(r.integers(0, 1 << 14, 700).astype(np.uint64))

    def groups(pairs):
        root = {int(x): int(x) for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return sorted(sorted(y for y in root if find(y) == x) for x in {find(x) for x in root})

    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    every = [(int(fp[i]), int(fp[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert groups(simhash.bucket_links(fp, 2)) == groups(every)


def test_near_copies_finds_similar_and_spares_others(spark):
    r = random.Random(9)
    w = [f"w{i}" for i in range(2000)]
    texts, want = [], []
    for g in range(25):
        own = [r.choice(w) for _ in range(120)]
        texts.append(" ".join(own))
        edited = own.copy()
        edited[60] = "changed"  # five of 116 shingles
        texts.append(" ".join(edited))
        want.append((2 * g + 1, 2 * g))
    texts += [" ".join(r.choice(w) for _ in range(100)) for _ in range(40)] + [None, ""]
    got = {(x.doc_id, x.component_id) for x in simhash.near_copies(frame(spark, texts)).where("doc_id <> component_id").collect()}
    assert got == {*want, (91, 90)}


def test_near_copies_join_many_copies_that_only_resemble_their_original(spark):
    r = random.Random(8)
    n, words = 2000, [f"w{i}" for i in range(300)]
    texts, has = [], np.ones((n + 1, 296), np.float32)
    for i in range(n + 1):
        own = list(words)
        if i != n // 2:  # the original stands in the middle
            for j in sorted(r.sample(range(5, 295), 5)):
                own[j] = f"x{i}y{j}"
                has[i, max(0, j - 4) : j + 1] = 0
        texts.append(" ".join(own))
    common = has @ has.T  # edited words are unique, so only the original's shingles are shared
    jaccard = common / (2 * 296 - common)
    alike = np.argwhere(np.triu(jaccard >= 0.8, 1))
    root = n // 2
    assert (jaccard[root] >= 0.8).all() and len(alike) < 1.02 * n + n * n / 100
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, texts)).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)


def test_large_buckets_equal_all_pairs(spark):
    """One large bucket: groups, chains and lone texts end as all pairs would."""
    r = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(12):
            own = list(base)
            for j in r.sample(range(100), k % 4):
                own[j] = f"e{g}x{k}y{j}"
            texts.append(own)
    for k in range(20):  # each resembles the next
        texts.append([f"c{i}" for i in range(10 * k, 10 * k + 120)])
    texts += [[f"lone{k}w{i}" for i in range(80)] for k in range(15)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    packed = [(i, b"".join(int(ids[s]).to_bytes(5, "little") for s in sorted(x, key=ids.get))) for i, x in enumerate(sets)]
    n = len(texts)
    dealt = spark.createDataFrame([(7, i, None) for i in range(n)], "key long, a long, b long")
    got = {x.node: x.component for x in simhash.settle(dealt, spark.createDataFrame(packed, "doc_id long, s binary"), 0.8).collect()}
    assert got == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_ids(spark):
    docs = frame(spark, ["t"] * 50)
    assert {r.doc_id for r in drop_ids(docs, docs.select("doc_id").where("doc_id % 2 = 0")).collect()} == set(range(1, 50, 2))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/y?q", "https://a.b.net/es/#z", "http://net", "http://com/x", "http://xcom/x", "http://example.com", "http://notexample.com/en/", "http://com.net/fr/a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules, 5).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")).alias("rule"), "verdict").collect())
    assert got == sorted(
        [(0, "", "", "-", "allow"), (1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "example.com", "/en/x", "example.com/en/", "block"), (3, "example.com", "/en/x", "example.com/en/", "block"),
         (4, "www.example.com", "/en/y", "www.example.com/en/", "allow"), (5, "a.b.net", "/es/", "net/es/", "block"), (6, "net", "", "-", "allow"), (7, "com", "/x", "com/", "allow"), (8, "xcom", "/x", "-", "allow"),
         (9, "example.com", "", "-", "allow"), (10, "notexample.com", "/en/", "com/", "allow"), (11, "com.net", "/fr/a", "net/fr/", "block")]
    )
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert urlfilter.judge(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 13


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>x</a></ul></nav>
<div class="cookie-notice">We use cookies on this long notice that goes on and on for a while, please accept.</div><article><h1>Real &amp; title</h1><p>One two three four
five six seven.<p>Short.<div class="ad-slot">Buy now!</div><p><b>Bold text &lt;here&gt;.<br>End.</p><section id="comments"><p>Great read, I agree with all that was said above.</p></section></article>
<aside><p>Some other story teaser text that is long enough to look like content.</p></aside><form><label>Name</label></form><footer>&copy; 2020</footer><script>var x="<p>no</p>";</script></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<nav><a>x</a></nav>"), (5, None, "<article><p>cut off in the mid"), (5, None, "<article><p>cut off in the mid"), (6, "u", "<p" + "<div>" * 3000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[2] == by[3] == by[4] == "" and by[5] == "cut off in the mid"
    assert by[1] == "Real & title One two three four five six seven. Short. Bold text <here>. End."


def test_minimum_cut_is_minimal():
    r = random.Random(10)
    for _ in range(60):
        n = r.randint(1, 7)
        logit = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]

        def cost(side, logit=logit, edges=edges):
            return sum(max(x, 0) if not s else max(-x, 0) for s, x in zip(side, logit, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.minimum_cut(logit, edges)) == pytest.approx(best)


def test_ann_recall_and_odd_rows(spark):
    r = np.random.default_rng(11)
    v = r.standard_normal((1500, 16))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, 2.0]), (None, v[0].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in additive_ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, shortlist=80, block=600).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    hits = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:10]
        hits += len(set(want) & {i for i, _ in got[q].values()})
        assert [i for i, _ in (got[q][k] for k in sorted(got[q]))] == sorted((i for i, _ in got[q].values()), key=lambda i: (-(v[i] @ v[q]), i))
    assert set(got) == set(range(0, 1500, 20)) and hits / 750 > 0.9
    few = additive_ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, k=10).collect()
    assert len(few) == 2
    assert additive_ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_decontamination(spark):
    r = random.Random(12)
    w = [f"{a}{b}" for a in "bcdfg" for b in range(400)]
    items = [" ".join(r.choice(w) for _ in range(n)) for n in (15, 24, 40, 59)]
    text = lambda n: [r.choice(w) for _ in range(n)]
    docs, want = [], set()
    for i in range(120):
        t = text(150)
        if i % 4 == 0:
            k = i // 4 % 4
            own = items[k].split()
            if i % 8 == 0:
                own[3] = "other"
                own[9] = "words"
            t[60:60] = own
            want.add((i, k))
        docs.append(" ".join(t))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == want
    assert decontaminate.leaks(odd(spark), bench).count() == 0
    assert decontaminate.leaks(odd(spark).limit(0), bench).count() == 0
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_equals_brute_force_without_word_runs(spark):
    """Items of common words, with words replaced or put in so that few stay in a row."""
    r = random.Random(21)
    common = [f"c{i}" for i in range(150)]
    items = [[r.choice(common) for _ in range(r.randint(15, 50))] for _ in range(12)]
    docs = []
    for k in range(120):
        own = [r.choice(common) for _ in range(r.randint(60, 140))]
        x = list(items[k % 12])
        if k % 4 == 0:  # each sixth word replaced
            x = [r.choice(common) if j % 6 == 5 else t for j, t in enumerate(x)]
        elif k % 4 == 1:  # a word put in after each fourth
            x = [t for j, y in enumerate(x) for t in ([y, r.choice(common)] if j % 4 == 3 else [y])]
        elif k % 4 == 2:  # after each third, and each twelfth replaced
            x = [t for j, y in enumerate(x) for t in ([r.choice(common) if j % 12 == 7 else y] + [r.choice(common)] * (j % 3 == 2))]
        else:
            x = []
        at = r.randint(0, len(own))
        docs.append(own[:at] + x + own[at:])
    code = {t: i for i, t in enumerate(common)}
    want = set()
    for d, doc in enumerate(docs):
        doc = [code[t] for t in doc]
        for i, item in enumerate(items):
            own, n = [code[t] for t in item], len(item)
            if max(decontaminate.lcs(own, doc[a : a + 3 * n // 2]) for a in range(len(doc))) >= decontaminate.STRONG * n:
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, [" ".join(x) for x in docs]), bench).collect()}
    assert len(want) >= 90 and want <= got


def test_lcs():
    assert decontaminate.lcs([1, 2, 3, 4, 5], [9, 1, 3, 9, 5]) == 3


def test_pipeline_stages_keep_the_columns(spark, tmp_path, labelled, labels):
    docs = labelled.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    item = labelled.where("doc_id = 37").first().text
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "byte_level_bpe":
            assert now.columns == docs.columns
        now = now.persist()
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    toxic = {i for i in range(1, 400) if i % 4 == 0}
    assert len(kept["toxicity"] & toxic) < 0.1 * len(toxic)
    assert not any(i > 1000 for i in kept["simhash_near_dedup"]) and kept["suffix_array_dedup"] == kept["simhash_near_dedup"]
    assert kept["suffix_array_dedup"] - kept["decontamination"] == {37}
    assert kept["byte_level_bpe"] == kept["decontamination"]
