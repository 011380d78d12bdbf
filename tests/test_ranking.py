import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import cumulative_by_value, exact_quantiles, percent_rank


def _data(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, n)
    v = np.round(rng.lognormal(3, 1, n), 1)
    v[rng.random(n) < 0.3] = 5.0                      # a value held by a third of the rows
    return pd.DataFrame({"g": g, "v": v}), spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))


@pytest.mark.parametrize("n_edges", [None, 8, 64])
def test_percent_rank_equals_native(spark, n_edges):
    _, df = _data(spark)
    got = percent_rank(df.withColumn("id", F.monotonically_increasing_id()), "v", "pr", n_edges)
    exp = got.withColumn("e", F.percent_rank().over(Window.orderBy("v")))
    assert exp.where(F.abs(F.col("pr") - F.col("e")) > 1e-12).count() == 0


@pytest.mark.parametrize("n_edges", [None, 8])
def test_exact_quantiles_match_pandas(spark, n_edges):
    pdf, df = _data(spark)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(df, "v", probs, by=["g"], n_edges=n_edges).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(sub["v"].quantile(p), rel=1e-12)


def test_cumulative_totals(spark):
    pdf, df = _data(spark)
    c = cumulative_by_value(df, "v", {"n": F.count(F.lit(1))}, descending=True, by=["g"]).toPandas()
    for g, sub in c.groupby("g"):
        sub = sub.sort_values("v", ascending=False)
        assert (sub["before_n"].to_numpy() == np.concatenate([[0], np.cumsum(sub["n"].to_numpy())[:-1]])).all()
        assert (sub["total_n"] == (pdf["g"] == g).sum()).all()


@pytest.mark.parametrize("n_edges", [1, 2, 7, 64, 1000])
def test_bucket_of_matches_searchsorted(spark, n_edges):
    from riskloom.operators.timewindow import bucket_of
    rng = np.random.default_rng(n_edges)
    edges = np.unique(np.round(rng.normal(size=n_edges), 2))
    xs = np.concatenate([rng.normal(size=300), edges[:5], [-10.0, 10.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).crossJoin(
        spark.createDataFrame([(edges.tolist(),)], "edges array<double>"))
    got = df.select("x", bucket_of(F.col("x"), F.col("edges"), n_edges).alias("b")).toPandas()
    exp = np.searchsorted(edges, got["x"].to_numpy(), side="left")
    assert (got["b"].to_numpy() == exp).all()


@pytest.mark.parametrize("limit", [500_000, 300, 30])
def test_exact_quantiles_narrow_brackets_to_the_pandas_result(spark, monkeypatch, limit):
    """Ties, one value only, null groups, NaN; with little room the brackets must be cut again."""
    from riskloom.operators import ranking
    rng = np.random.default_rng(6)
    n = 20_000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "v": np.round(rng.lognormal(2, 2, n), 3)})
    pdf.loc[pdf["g"] == "b", "v"] = 7.0
    pdf.loc[rng.random(n) < 0.4, "v"] = 1.25                     # a value that many rows share
    monkeypatch.setattr(ranking, "MAX_BRACKETED", limit)
    monkeypatch.setattr(ranking, "ACCURACY", 100)
    probs = {f"p{i}": p for i, p in enumerate((0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.995, 1))}
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "c", F.col("g")))
    df = df.unionByName(spark.createDataFrame([("a", float("nan")), ("a", None)], "g string, v double"))
    got = {r["g"]: r for r in ranking.exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g, rows in pdf.groupby("g"):
        want = rows["v"].quantile(list(probs.values()))
        np.testing.assert_allclose([got[None if g == "c" else g][k] for k in probs], want, rtol=1e-12)
    whole = ranking.exact_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(pdf["v"].median())
    assert ranking.exact_quantiles(df.limit(0), "v", {"m": 0.5}, by=["g"]).count() == 0
