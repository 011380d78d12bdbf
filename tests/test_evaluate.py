"""Metrics against straightforward numpy implementations of the same definitions."""
import numpy as np
import pandas as pd
import pytest

from riskloom.operators import evaluate


def _np_metrics(y, s):
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    distinct = np.r_[np.flatnonzero(np.diff(ss)), len(ss) - 1]
    tp = np.cumsum(ys)[distinct]
    fp = (distinct + 1) - tp
    P, N = y.sum(), len(y) - y.sum()
    prec, rec = tp / (tp + fp), tp / P
    ap = np.sum(np.diff(np.r_[0, rec]) * prec)
    fpr = fp / N
    ks = np.max(np.abs(rec - fpr))
    # rank-based ROC AUC with ties counted one half
    ranks = pd.Series(s).rank(method="average").to_numpy()
    auc = (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    return ap, auc, ks


@pytest.mark.parametrize("seed", [0, 1])
def test_summary_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    y = (rng.random(n) < 0.1).astype(int)
    s = np.round(rng.normal(y * 0.8, 1.0), 2)          # rounded -> many ties
    df = spark.createDataFrame(pd.DataFrame({"is_fraud": y, "score": s}))
    r = evaluate.summary(df).first()
    ap, auc, ks = _np_metrics(y, s)
    assert r["auc_pr"] == pytest.approx(ap, abs=2e-6)
    assert r["auc_roc"] == pytest.approx(auc, abs=2e-6)
    assert r["ks"] == pytest.approx(ks, abs=2e-6)
    assert r["gini"] == pytest.approx(2 * auc - 1, abs=4e-6)


def test_at_threshold_zero_division(spark):
    df = spark.createDataFrame(pd.DataFrame({"is_fraud": [0, 0, 1], "score": [0.1, 0.2, 0.3]}))
    r = evaluate.at_threshold(df, threshold=0.9).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def test_class_histogram_against_numpy(spark, sf_small):
    import numpy as np
    from riskloom.operators import eda
    from riskloom.plans import models
    rng = np.random.default_rng(4)
    rows = [(int(x < 0.3), float(s)) for x, s in zip(rng.random(800), rng.normal(600, 40, 800).round(1))]
    df = spark.createDataFrame(rows + [(None, 9999.0), (0, None)], "y int, s double")
    got = eda.class_histogram(df, "s", "y").collect()
    edges = np.linspace(min(s for _, s in rows), max(s for _, s in rows), 40)
    for y in (0, 1):
        counts, _ = np.histogram([s for c, s in rows if c == y], edges)
        density, _ = np.histogram([s for c, s in rows if c == y], edges, density=True)
        mine = {r.bin: r for r in got if r.y == y}
        assert {b: r.n for b, r in mine.items()} == {b: int(n) for b, n in enumerate(counts) if n}
        assert all(abs(r.density - density[b]) < 1e-6 and abs(r.bin_start - edges[b]) < 1e-6 for b, r in mine.items())
    assert [(r.n, r.density) for r in eda.class_histogram(spark.createDataFrame([(1, 5.0)] * 3, "y int, s double"), "s", "y").collect()] == [(3, None)]
    assert eda.class_histogram(df.limit(0), "s", "y").count() == 0
    cards = models.card_score_histogram(spark, sf_small).collect()
    assert {r.is_fraud for r in cards} == {0, 1} and max(r.bin for r in cards) == 38 and min(r.bin for r in cards) == 0
