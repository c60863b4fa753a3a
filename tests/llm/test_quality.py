"""Quality is learnt from every labelled row that isn't held out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity


def _rows(n):
    rng = np.random.default_rng(1)
    good = rng.random(n) < 0.6
    return good, pd.DataFrame({"doc_id": np.arange(n), "text": [" ".join(rng.choice(["Plain", "words", "stand", "here."] if g else ["$$$", "9", "buy|", "##x"], 3 + i % 7)) for i, g in enumerate(good)]})


def test_all_labelled_rows_are_fitted_on(spark, monkeypatch):
    n, seen, fit = 11000, [], quality.fit

    def watched(groups, *more, **settings):
        seen.append((groups.agg(F.sum(F.length("y"))).first()[0], groups.count()))
        return fit(groups, *more, **settings)

    monkeypatch.setattr(quality, "fit", watched)
    good, rows = _rows(n)
    docs = spark.createDataFrame(rows)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": rows["doc_id"], "quality": good.astype(int)}))
    model = quality.train(docs, labels)
    held = labels.where(toxicity.held_out()).count()
    assert seen == [(n - held, 2)] and n - held > 8000
    got = quality.score(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    assert got.where((F.col("score") >= quality.CUT).cast("int") == F.col("quality")).count() > 0.99 * held


@pytest.mark.parametrize("bins, sent", [(4, 3), (4096, 10_000)])
def test_places_equal_those_of_all_strengths_sorted(spark, monkeypatch, bins, sent):
    monkeypatch.setattr(quality, "BINS", bins)
    monkeypatch.setattr(quality, "SENT", sent)
    rng = np.random.default_rng(2)
    k = quality.N_FEATURES
    x = [np.round(rng.random((m, k)), 2) for m in (40, 1, 25)]
    x[2][:] = x[2][0]  # more equal ones than may be sent
    model = quality.Model(np.zeros(2 * k), np.ones(2 * k), rng.normal(size=2 * k))
    groups = spark.createDataFrame([(g, v.tobytes(), np.zeros(len(v), np.int8).tobytes()) for g, v in enumerate(x)], "g long, x binary, y binary")
    want = np.sort(np.concatenate([model.strength(v) for v in x]))
    for at in (0, 7, 33, len(want) - 1):
        assert abs(quality._smallest(groups, model, at) - want[at]) < 1e-12
