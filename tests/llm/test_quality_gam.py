import random

import numpy as np
import pytest

from riskloom.llm import quality_gam as qg


def test_features_of_odd_texts():
    assert qg.features(None) == qg.features("") == [0.0] * len(qg.FEATURES)
    for t in ("   ", "\n\n", "a", "é" * 100, "x" * 300_000, "a b " * 50_000, "\ud800"):
        row = qg.features(t)
        assert len(row) == len(qg.FEATURES) and np.isfinite(row).all()


def test_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .5)).astype(float)               # no feature alone tells anything
    check = np.arange(6000) % 5 == 0
    model = qg.boost(x[:5000], y[:5000], check[:5000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[5000:]) > .5) == y[5000:]).mean() > .95


def test_score_is_the_sum_of_bin_entries():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((800, 5)), 2)
    y = (x[:, 2] + .3 * rng.random(800) > .6).astype(float)
    model = qg.boost(x, y, np.arange(800) % 5 == 0)
    for row, margin in zip(x[:50], model.margin(x[:50])):
        plain = model.intercept
        for j, e in enumerate(model.edges):
            plain += model.tables[j][sum(v <= row[j] for v in e)]
        for (a, b), t in zip(model.pairs, model.pair_tables):
            plain += t[sum(v <= row[a] for v in model.pair_edges[a]), sum(v <= row[b] for v in model.pair_edges[b])]
        assert abs(plain - margin) < 1e-9


def test_learns_from_documents(spark, make_docs):
    rng = random.Random(4)
    pairs, labels = [], []
    for i in range(800):
        words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(10, 150))]
        bad = i % 6 == 0
        pairs.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        labels.append((i, int(not bad), 0))
    pairs += [(9001, None), (9002, ""), (9003, "WORD!! " * 40_000), (1, pairs[1][1]), (None, "ok then.")]
    frame = spark.createDataFrame(labels + [(9001, None, None)], "doc_id long, quality int, toxic int")
    docs = make_docs(pairs, extra=True)
    model = qg.fit(docs, frame, qg.train_rows())
    got = {r.doc_id: r.s for r in docs.select("doc_id", qg.score_column(model)("text").alias("s")).collect()}
    assert sum((got[i] >= qg.THRESHOLD) == (i % 6 == 0) for i in range(800)) <= 4
    assert got[9001] == got[9002] and got[9003] < qg.THRESHOLD
    kept = qg.reject(make_docs(pairs), frame)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.filter("doc_id = 1").count() == 2 and kept.filter("doc_id = 9003").count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)]])
def test_without_labels_nothing_is_rejected(spark, make_docs, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert qg.reject(make_docs([(1, "a b"), (2, "c"), (3, None)]), frame).count() == 3
    assert qg.reject(make_docs([]), frame).count() == 0


def test_rejecting_keeps_every_column(spark, make_docs):
    from riskloom.llm import quality_gam
    docs = make_docs([(1, "a b"), (2, None)], extra=True)
    out = quality_gam.reject(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == docs.columns and all(r["_QUALITY"] == "x" for r in out.collect())
