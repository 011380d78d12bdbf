"""Newton fit against a plain optimiser over the rows; exact shares of a split against a sort."""
import hashlib

import numpy as np
import pytest

from riskloom.operators import features as FE
from riskloom.operators import logistic as LO


def rows_of(seed, n=400, k=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, k)) * 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - x @ np.arange(1, k + 1)))).astype(int)
    return x, y


def gradient(beta, x, y, C):
    z = np.column_stack([np.ones(len(x)), x])
    n, bad = len(y), y.sum()
    w = np.where(y == 1, n / (2 * bad), n / (2 * (n - bad)))
    return z.T @ (w * (1 / (1 + np.exp(-z @ beta)) - y)) + np.r_[0, beta[1:]] / C


@pytest.mark.parametrize("C", [0.01, 1.0, 100.0])
def test_gradient_vanishes(spark, C):
    x, y = rows_of(3)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int")
    got = LO.fit(df.repartition(5), ["a", "b", "c"], "y", C)
    beta = np.r_[got["intercept"], got["coef"]]
    assert np.abs(gradient(beta, x, y, C)).max() / len(y) < 1e-8 and got["gradient_norm"] <= LO.TOLERANCE and got["passes"] < 15


def test_separable_constant_and_null_features(spark):
    df = spark.createDataFrame([(float(i), None, 1.0, int(i > 4)) for i in range(10)] + [(2.0, None, 1.0, None)],
                               "a double, b double, one double, y int")
    got = LO.fit(df, ["a", "b", "one"], "y", 1e4)
    assert got["coef"][1] == 0 and got["coef"][0] > 0 and np.isfinite(got["intercept"])
    for broken in (df.where("y = 1"), df.where("false")):
        with pytest.raises(ValueError, match="both classes"):
            LO.fit(broken, ["a"], "y")
    with pytest.raises(ValueError, match="not converged"):
        LO.fit(df, ["a"], "y", max_iter=2)


def plain_split(pairs, share, valid, seed=42):
    out = {}
    for label in {lab for _, lab in pairs}:
        def order(p):
            text = "|".join(str(v) for v in (p[1], p[0]) if v is not None)
            return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)
        mine = sorted((p for p in pairs if p[1] == label), key=order)
        marks = [int(len(mine) * f + 0.5) for f in (share, share + valid)]
        for i, p in enumerate(mine):
            out[p] = "test" if i < marks[0] else "valid" if i < marks[1] else "train"
    return out


@pytest.mark.parametrize("share,valid", [(0.2, 0.0), (0.2, 0.2), (0.0, 0.5), (0.5, 0.5), (0.013, 0.4)])
def test_split_shares_are_exact(spark, share, valid):
    pairs = [(f"k{i}", None if i % 11 == 0 else i % 7 == 0) for i in range(3000)] + [("only", True), (None, False)]
    pairs = [(k, None if lab is None else int(lab)) for k, lab in pairs]
    df = spark.createDataFrame(pairs, "k string, y int").repartition(7)
    got = FE.stratified_split(df, "k", "y", share, valid_fraction=valid).collect()
    assert {(r["k"], r["y"]): r["split"] for r in got} == plain_split(pairs, share, valid) and len(got) == len(pairs)


def test_split_of_repeated_keys_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 1)], "k string, y int")
    got = {(r["k"], r["split"]) for r in FE.stratified_split(df, "k", "y", 0.3).collect()}
    assert len(got) == 2                                            # copies of a key share one split
    assert FE.stratified_split(df.limit(0), "k", "y").count() == 0
    with pytest.raises(ValueError, match="more than"):
        FE.stratified_split(spark.range(100).selectExpr("id AS k", "id AS y"), "k", "y")
