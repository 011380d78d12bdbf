import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X


@pytest.mark.parametrize("score,tier", [(0.0, "LOW"), (0.1, "LOW"), (0.3, "MEDIUM"), (0.45, "MEDIUM"),
                                        (0.6, "HIGH"), (0.75, "HIGH"), (0.85, "CRITICAL"), (0.9, "CRITICAL"),
                                        (1.0, "CRITICAL")])
def test_tier_boundaries(spark, score, tier):
    r = spark.range(1).select(X.risk_tier(F.lit(score)).alias("t")).first()
    assert r["t"] == tier


def test_tier_actions(spark):
    rows = spark.createDataFrame([(t,) for t in X.TIER_ACTIONS], ["t"]).select(
        "t", X.tier_action("t").alias("a")).collect()
    for r in rows:
        assert r["a"] == X.TIER_ACTIONS[r["t"]]
    assert "Financial Crime" in X.TIER_ACTIONS["CRITICAL"]


@pytest.mark.parametrize("hour,night", [(23, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 0), (7, 0),
                                        (9, 0), (12, 0), (17, 0), (20, 0), (22, 0)])
def test_night_hours(spark, hour, night):
    assert spark.range(1).select(X.is_night(F.lit(hour)).alias("n")).first()["n"] == night


@pytest.mark.parametrize("amount", [0.0, 9.0, 99.0])
def test_log_amount(spark, amount):
    import math
    v = spark.range(1).select(X.log_amount(F.lit(amount)).alias("v")).first()["v"]
    assert v == pytest.approx(math.log1p(amount))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 50, 203])
def test_ntile_formula_matches_native(spark, n):
    df = spark.range(n).withColumn("pos", F.col("id") + 1)
    got = df.select("pos", X.ntile_of_position(F.col("pos"), F.lit(n), 4).alias("b"),
                    F.ntile(4).over(Window.orderBy("id")).alias("nat")).collect()
    assert all(r["b"] == r["nat"] for r in got)


def test_time_window_labels(spark):
    got = {r["h"]: r["w"] for r in spark.range(24).select(F.col("id").cast("int").alias("h"))
           .select("h", X.time_window("h").alias("w")).collect()}
    assert got[6].startswith("1_") and got[11].startswith("1_") and got[12].startswith("2_")
    assert got[18].startswith("3_") and got[22].startswith("3_") and got[23].startswith("4_") and got[5].startswith("4_")


def test_bounded_broadcast_only_under_the_bound(spark):
    small = spark.range(10)
    big = spark.range(50)
    j_small = spark.range(100).join(X.bounded_broadcast(small, max_rows=20), "id")
    j_big = spark.range(100).join(X.bounded_broadcast(big, max_rows=20), "id")
    assert "broadcast" in j_small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in j_big._jdf.queryExecution().analyzed().toString().lower()
    assert j_small.count() == 10 and j_big.count() == 50
