"""The bucketed, skew-safe operators equal Spark's single-partition windows exactly."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.timewindow import rank_of, rank_within_key, sequence, trailing_stats


def _events(spark, n=3000, seed=7):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randint(1, 20)          # one hot key with 40 % of rows
        if i % 61 == 5:
            key = None                                                 # NULL keys form their own group
        ts = t0 + dt.timedelta(seconds=rng.randint(0, 40 * 86400))
        if i % 97 == 0 and rows:                                       # exact timestamp ties
            ts = rows[-1][2]
        val = None if i % 53 == 0 else round(rng.uniform(1, 500), 2)
        rows.append((i, key, ts, val))
    return spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")


def test_trailing_stats_equals_native(spark):
    e = _events(spark)
    widths = {"h1": 3600, "d1": 86400, "d30": 30 * 86400}
    got = trailing_stats(e, "k", "ts", "v", widths, grain_seconds=3600)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    base = e.withColumn("us", us)
    exp = base
    for name, w in widths.items():
        win = Window.partitionBy("k").orderBy("us").rangeBetween(-w * 10**6, 0)
        exp = (exp.withColumn(f"e_{name}_n", F.count(F.lit(1)).over(win))
                  .withColumn(f"e_{name}_s", F.sum("v").over(win))
                  .withColumn(f"e_{name}_c", F.count("v").over(win)))
    j = got.join(exp.drop("k", "ts", "v"), "id")
    assert j.count() == e.count()
    for name in widths:
        bad = j.where((F.col(f"{name}_n") != F.col(f"e_{name}_n")) | (F.col(f"{name}_c") != F.col(f"e_{name}_c"))
                      | (F.abs(F.coalesce(F.col(f"{name}_s"), F.lit(0.0)) - F.coalesce(F.col(f"e_{name}_s"), F.lit(0.0)))
                         > 1e-6)).count()
        assert bad == 0, name


def test_trailing_stats_multi_value(spark):
    e = _events(spark, 800).withColumn("one", F.lit(1))
    got = trailing_stats(e, "k", "ts", ["v", "one"], {"d1": 86400}, grain_seconds=3600)
    r = got.where(F.col("d1_c__one") != F.col("d1_n")).count()
    assert r == 0


def test_sequence_equals_native(spark):
    e = _events(spark)
    got = sequence(e, "k", "ts", "id", ["ts", "v"], lead_cols=["id"], row_number="rn", grain_seconds=86400)
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = e.select("id", F.lag("ts").over(w).alias("e_ts"), F.lag("v").over(w).alias("e_v"),
                   F.lead("id").over(w).alias("e_next"), F.row_number().over(w).alias("e_rn"))
    j = got.join(exp, "id")
    bad = j.where(~F.col("prev_ts").eqNullSafe(F.col("e_ts")) | ~F.col("prev_v").eqNullSafe(F.col("e_v"))
                  | ~F.col("next_id").eqNullSafe(F.col("e_next")) | (F.col("rn") != F.col("e_rn"))).count()
    assert bad == 0


def test_rank_within_key_equals_native(spark):
    e = _events(spark)
    for desc in (True, False):
        got = rank_within_key(e, "k", "v", "r", descending=desc, n_edges=16)
        o = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        exp = e.select("id", F.rank().over(Window.partitionBy("k").orderBy(o)).alias("e"))
        assert got.join(exp, "id").where(F.col("r") != F.col("e")).count() == 0


def test_rank_of_a_few_rows_equals_the_window(spark):
    rows = [("a", i, v) for i, v in enumerate([5.0, 7.0, 7.0, None, 1.0, 9.0, None])] + [(None, 20, 3.0), (None, 21, 8.0), ("b", 30, None)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    want = {r["id"]: r["r"] for r in df.select("id", F.rank().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("v"))).alias("r")).collect()}
    few = df.where("id in (0, 2, 3, 5, 20, 30)")
    got = {r["id"]: r["r"] for r in rank_of(few, df, "k", "v", "r", "id").collect()}
    assert got == {i: want[i] for i in (0, 2, 3, 5, 20, 30)}


def test_trailing_stats_deals_a_known_number_of_rows_to_bounded_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from riskloom.operators import timewindow as tw

    monkeypatch.setattr(tw, "ROWS_PER_TASK", 100)
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 977).alias("t"),
                                 F.col("id").cast("decimal(18,2)").alias("v"))
    widths = {"a": 3600, "b": 86400}
    plain = tw.trailing_stats(df, "k", "t", "v", widths)
    dealt = tw.trailing_stats(df, "k", "t", "v", widths, rows=500)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") > 1 and all(
        line.rstrip().endswith(", 15") for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
