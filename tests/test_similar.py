"""The set similarity join against brute force, and how much it hands on to be counted."""

import random

from graphloom.operators import retrieval

KIND = "path string, content string"


def _files():
    """Long texts over one vocabulary of rare words, so that many pairs share a few of them;
    near copies of some, and one large group of copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(f"a{i}", rng.sample(words, 900)) for i in range(150)]
    rows += [(f"b{i}", [w if rng.random() > 0.06 else f"x{i}{w}" for w in rows[i][1]]) for i in range(20)]
    rows += [(f"c{i}", rng.sample(rows[149][1], 900)) for i in range(150)]
    rows += [("s1", ["one"]), ("s2", ["one", "one"]), ("s3", ["one", "two"]), ("s4", ["a"])]
    return [(p, " ".join(w)) for p, w in rows] + [("n", None), ("e", "")]


def _brute(rows):
    sets = {}
    for p, text in rows:
        if found := {w for w in (text or "").split(" ") if len(w) > 1}:
            sets.setdefault(p, set()).update(found)
    paths = sorted(sets)
    all_ = ((p, q, round(len(sets[p] & sets[q]) / len(sets[p] | sets[q]), 6)) for i, p in enumerate(paths) for q in paths[i + 1 :])
    return sorted(x for x in all_ if x[2] > 0.8)


def test_pairs_equal_brute_force_and_few_that_are_not_alike_are_counted(spark, monkeypatch):
    counted, among = [], retrieval._among

    def seen(sets, ids):
        counted.append(ids.count() // 2)
        return among(sets, ids)

    monkeypatch.setattr(retrieval, "_among", seen)
    rows = _files()
    got = sorted(map(tuple, retrieval.similar_pairs(retrieval.term_sets(spark.createDataFrame(rows, KIND))).collect()))
    assert got == _brute(rows) and len(got) > 11000
    # 20 near copies: no pair of copies and none of texts that only share some rare words
    assert counted[0] <= 25


def test_pairs_of_a_path_that_comes_twice_and_of_nothing(spark):
    rows = [("a", "one two three"), ("a", "four five"), ("b", "one two three four five"), ("c", "one two three")]
    got = retrieval.similar_pairs(retrieval.term_sets(spark.createDataFrame(rows, KIND))).collect()
    assert [tuple(r) for r in got] == [("a", "b", 1.0)]
    assert retrieval.similar_pairs(retrieval.term_sets(spark.createDataFrame([], KIND))).count() == 0


def test_other_thresholds_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"p{i:03}", " ".join(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 12)))) for i in range(120)]
    sets = {p: set(t.split()) for p, t in rows}
    for t in (0.5, 0.8, 0.9):
        want = sorted((p, q) for p in sets for q in sets if p < q and round(len(sets[p] & sets[q]) / len(sets[p] | sets[q]), 6) > t)
        got = sorted((r.p, r.q) for r in retrieval.similar_pairs(retrieval.term_sets(spark.createDataFrame(rows, KIND)), t).collect())
        assert got == want


def test_classes_and_links_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [*_files()[:60], *_files()[150:200]] + [(f"e{i:02}", " ".join(rng.sample([f"w{k}" for k in range(9)], rng.randint(1, 9)))) for i in range(90)]
    sets = {p: frozenset(w for w in t.split(" ") if len(w) > 1) for p, t in rows}
    got = {r.path: (r["class"], r.links) for r in retrieval.similar_classes(retrieval.term_sets(spark.createDataFrame(rows, KIND))).collect()}
    assert set(got) == set(sets)
    for p, own in sets.items():
        links = sum(q != p and round(len(own & o) / len(own | o), 6) > 0.8 for q, o in sets.items())
        assert got[p] == (min(q for q, o in sets.items() if o == own), links)
    assert len({c for c, _ in got.values()}) < len(got)


def test_every_document_has_a_row(spark, tmp_path):
    """A document without terms stands alone; until round 4 it had no row."""
    from graphloom import catalog

    rows = [(1, "one two", "en", "web"), (2, "one two", "en", "web"), (3, "", "en", "web"), (4, None, "en", "web"), (5, "a - b", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.path, r["class"], r.links) for r in catalog.QUERIES["similar_pairs_jaccard"](spark, str(tmp_path)).collect()}
    name = lambda i: f"web/en/{i}.txt"
    assert got == {(name(1), name(1), 1), (name(2), name(1), 1)} | {(name(i), name(i), 0) for i in (3, 4, 5)}


def test_no_group_of_the_join_is_large(spark, monkeypatch):
    """F16: a task held all sets that have a term of its part, and all pairs that it found."""
    rng = random.Random(7)
    rows = [*_files()[:40], *_files()[140:180]] + [(f"e{i:02}", " ".join(["all", *rng.sample([f"w{k}" for k in range(9)], rng.randint(1, 9))])) for i in range(90)]
    groups, seen = retrieval._groups, []

    def spied(first, parts):
        part, blocks = groups(first, parts)
        entries = {}
        for r in first.collect():
            for t in r.rare:
                b = (t % (1 << 64)) >> 48
                entries[b] = entries.get(b, 0) + 1 + len(r.signature) // 128
        sums = {}
        for b, n in entries.items():
            sums[part[b]] = sums.get(part[b], 0) + n
        seen.append((max(blocks), max(n / blocks[part == p].max() for p, n in sums.items())))
        return part, blocks

    monkeypatch.setattr(retrieval, "_groups", spied)
    for entries in (1 << 19, 60, 9):
        for name, n in {"ENTRIES": entries, "KEPT": entries, "DEALT": entries, "AT_ONCE": entries}.items():
            monkeypatch.setattr(retrieval, name, n)
        for t in (0.5, 0.8):
            got = sorted((r.p, r.q) for r in retrieval.similar_pairs(retrieval.term_sets(spark.createDataFrame(rows, KIND)), t).collect())
            sets = {p: {w for w in text.split(" ") if len(w) > 1} for p, text in rows}
            assert got == sorted((p, q) for p in sets for q in sets if p < q and round(len(sets[p] & sets[q]) / len(sets[p] | sets[q]), 6) > t)
    # the mean of a block is half of what a group may hold; a group of light buckets holds up to twice that
    assert seen[0][0] == 1 and seen[-1][0] > 3 and all(most <= 2 * n for (_, most), n in zip(seen, (1 << 19, 1 << 19, 60, 60, 9, 9), strict=True))


def test_families_meet_in_blocks_and_no_row_is_made_of_a_pair(spark, monkeypatch):
    """each pair of near copies was a row for each part of the terms that both have, and moved both its sets to be counted."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    base = rng.sample(words, 60)
    family = [(f"f{i:02}", [w if rng.random() > 0.05 else f"x{i}{w}" for w in base]) for i in range(60)]
    # a chain: each is similar to the next ones only
    chain = [(f"g{i:02}", [f"c{k}" for k in range(i, i + 30)]) for i in range(30)]
    rows = [(p, " ".join(w)) for p, w in [*family, *chain, *((f"z{i}", rng.sample(words, 40)) for i in range(30)), *((f"y{i}", family[i][1]) for i in range(9))]]
    rows += [("o1", "Éa éa ÜB_c"), ("o2", "éA übÜ üB_C x"), ("o3", "x y")]
    sets = {p: frozenset(w for w in t.lower().split(" ") if len(w.encode()) > 1) for p, t in rows}
    want = {p: (min(q for q, o in sets.items() if o == own), sum(q != p and round(len(own & o) / len(own | o), 6) > 0.8 for q, o in sets.items())) for p, own in sets.items() if own}
    met, handed = retrieval._met, []

    def seen(first, threshold, spanning=False):
        out = met(first, threshold, spanning)
        handed.append((out.count(), sum(len(r.rare) for r in first.collect())))
        return out

    monkeypatch.setattr(retrieval, "_met", seen)
    for held, texts, text in ((1 << 19, 1 << 11, 1 << 22), (300, 1 << 11, 64), (1 << 19, 7, 1)):
        monkeypatch.setattr(retrieval, "HELD", held)
        monkeypatch.setattr(retrieval, "TEXTS", texts)
        monkeypatch.setattr(retrieval, "TEXT", text)
        got = {r.path: (r["class"], r.links) for r in retrieval.similar_classes(retrieval.term_sets(spark.createDataFrame(rows, KIND))).collect()}
        assert got == want
    assert sum(n for _, n in want.values()) > 3000 and all(n <= 60 * 4 + 30 * 4 + 9 for n, _ in handed)
