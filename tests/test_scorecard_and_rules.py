from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators import features as FE
from riskloom.operators import scorecard as S
from riskloom.sources import adapter


def test_woe_invariants(spark, sf_small):
    t = adapter.transactions_table(spark, sf_small).withColumn("is_night", X.is_night("hour"))
    m = S.fit_woe(t, S.SCORECARD_FEATURES)
    b = m["bins"].toPandas()
    n = t.count()
    for feat, g in b.groupby("feature"):
        assert g["n_total"].sum() == n, feat                  # every row in exactly one bin
        assert (g["iv_contrib"] >= -1e-12).all()
        cont = g[g["kind"] == "continuous"]
        if len(cont) > 1:
            assert (cont["n_bad"].iloc[:-1] >= S.MIN_BADS).all()
    w = S.apply_woe(t, m, S.SCORECARD_FEATURES)
    assert w.where(F.col("woe_amount").isNull()).count() == 0


def test_validation_cases(spark):
    df = spark.createDataFrame([(1.0, None), (-5.0, 3), (0.0, 25), (10.0, 12)], "amount double, hour int")
    got = FE.validate_records(df).orderBy("amount").collect()
    assert [r["valid"] for r in got] == [False, False, True, True]
    assert "amount must be > 0" in got[0]["reasons"]
    assert "hour must be <= 23" in got[1]["reasons"]
    assert got[2]["hour"] == 12 and got[2]["velocity_24h"] == 5


def test_feature_names():
    class D:
        columns = ["V1", "V2", "amount"]
    assert FE.feature_names(D()) == ["V1", "V2", "amount"]


def test_bins_by_plain_comparisons_equal_bins_by_filter(spark):
    from pyspark.sql import functions as F
    from riskloom.operators.eda import bin_index

    nan = float("nan")
    edges = [[0.0, 1.0, 2.5], [0.0], [-1.0, 0.0, 1.0, 3.0, 9.0], None, [0.0, nan]]
    rows = [(e, x) for e in edges for x in (-2.0, -1.0, 0.0, .5, 1.0, 2.5, 2.6, 9.0, 10.0, nan, None)]
    got = spark.createDataFrame(rows, "edges array<double>, x double").select(
        bin_index(F.col("x")).alias("a"), bin_index(F.col("x"), most=5).alias("b"))
    assert "lambda" not in got.select("b")._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.a == r.b for r in got.collect())
