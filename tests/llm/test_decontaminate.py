"""Decontamination: what the latent space finds by itself, and items in several blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as d

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def planted(spark):
    """(documents, items, links): each item stands in some texts with every fifth word
    replaced, so that no six words in a row are left."""
    r = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "bcdfgklm" for b in range(300)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(18, 45))) for _ in range(30)]
    docs, links = [], set()
    for i in range(240):
        t = [r.choice(vocabulary) for _ in range(160)]
        if i % 2:
            k = i % 30
            t[70:70] = [r.choice(vocabulary) if j % 5 == 4 else w for j, w in enumerate(items[k].split())]
            links.add((i, k))
        docs.append((i, " ".join(t)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), links


def test_latent_candidates_alone_find_paraphrases_without_long_runs(planted):
    docs, items, links = planted
    space, share = d.latent_space(d.tokenised(docs))
    probes = d.Probes([(r.item_id, r.text) for r in items.collect()], space, share)
    found = set()
    for r in docs.collect():
        w = d.tokens(r.text)
        at, item, cosine = probes.latent(w, np.array([0, len(w)]), space)
        assert (cosine >= d.COSINE).all()
        found |= {(r.doc_id, probes.ids[i]) for i in item.tolist()}
    assert len(found & links) >= 0.5 * len(links)
    assert len(found - links) <= 0.02 * len(links)


def test_candidates_by_words_are_those_of_all_pairs(planted):
    """The index in front of the cosine leaves out no pair that would be kept."""
    docs, items, _ = planted
    space, share = d.latent_space(d.tokenised(docs))
    probes = d.Probes([(r.item_id, r.text) for r in items.collect()], space, share)
    texts = [d.tokens(r.text) for r in docs.limit(60).collect()]
    w, off = np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])]
    some = {tuple(x) for x in zip(*(c.tolist() for c in probes.latent(w, off, space)[:2]), strict=True)}
    start = d._starts(off, d.BLOCK)
    row = np.searchsorted(off, start, side="right") - 1
    for size, m in probes.matrix.items():
        for s, t in zip(start.tolist(), row.tolist(), strict=True):
            part = w[s : min(s + size, off[t + 1])]
            v = space[(part % d.TERMS).astype(np.int64)].sum(0)
            for p in range(m.shape[1]):
                own = probes.words[probes.owner[size][p]]
                if v @ m[:, p] >= (d.COSINE + 1e-4) * np.linalg.norm(v) and len(set(part.tolist()) & set(own)) >= 0.9 * len(own):
                    assert (s, int(probes.owner[size][p])) in some


@pytest.mark.parametrize("even", [False, True])
def test_latent_candidates_are_those_of_all_windows_and_probes(planted, even):
    """Every window with enough of a probe's words, repeats included, and a cosine that is
    enough, whichever words of the probe it has; short last blocks and short texts too. In
    an even space all cosines are one, so that the words alone decide."""
    docs, items, _ = planted
    space, share = d.latent_space(d.tokenised(docs))
    space = np.ones_like(space) if even else space
    probes = d.Probes([(r.item_id, r.text) for r in items.collect()], space, share)
    texts = [d.tokens(r.text) for r in docs.limit(20).collect()]
    texts = [t[: len(t) - i] for i, t in enumerate(texts)]
    for own in probes.words:  # the commonest words of an item, again and again
        own = np.array(own, "<u4")
        size = d.SHORT if len(own) < d.LONG - 4 else d.LONG
        common = np.unique(own[:size])
        common = common[np.argsort(share[common % d.TERMS], kind="stable")]
        few = int(np.ceil(d.OVERLAP * len(common))) - 1  # fewer than enough of them, but often
        texts += [np.tile(common[len(common) - few :], 9), own[:9]]
    texts.insert(3, np.zeros(0, "<u4"))
    w, off = np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])]
    got = {tuple(x) for x in zip(*(c.tolist() for c in probes.latent(w, off, space)[:2]), strict=True)}
    sure, maybe = set(), set()
    for k, own in enumerate(probes.words):
        own = np.array(own, "<u4")
        size = d.SHORT if len(own) < d.LONG - 4 else d.LONG
        last = max(0, len(own) - size)
        for at in sorted({*range(0, last + 1, size // 2), last}):
            probe = own[at : at + size]
            v = space[(probe % d.TERMS).astype(np.int64)].sum(0)
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                for s in range(lo, hi, d.BLOCK):
                    part = w[s : min(s + size, hi)]
                    if np.isin(part, probe).sum() < d.OVERLAP * len(np.unique(probe)):
                        continue
                    x = space[(part % d.TERMS).astype(np.int64)].sum(0)
                    cosine = x @ v / max(np.linalg.norm(x) * np.linalg.norm(v), 1e-9)
                    sure |= {(s, k)} if cosine >= d.COSINE + 1e-4 else set()
                    maybe |= {(s, k)} if cosine >= d.COSINE - 1e-4 else set()
    assert sure <= got <= maybe and len(sure) > 20


def test_found_pairs_are_all_planted_ones(planted):
    docs, items, links = planted
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    assert got == links


def test_items_in_blocks_with_shared_ids(planted, monkeypatch):
    docs, items, links = planted
    want = {(x, k % 7) for x, k in links}
    shared = items.withColumn("item_id", F.col("item_id") % 7)
    for most in (4, 5000):
        monkeypatch.setattr(d, "ITEMS", most)
        rows = [(r.doc_id, r.item_id) for r in d.leaks(docs.unionByName(docs.where("doc_id < 9")), shared.unionByName(shared.limit(3))).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
