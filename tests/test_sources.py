import pytest
from pyspark.sql import functions as F

from riskloom.sources import files, synthetic


def test_synthetic_is_exact_and_partition_independent(spark):
    a = synthetic.generate_transactions(spark, 5000, 0.02, seed=42)
    b = synthetic.generate_transactions(spark, 5000, 0.02, seed=42).repartition(7)
    assert a.count() == 5000
    assert a.where("is_fraud = 1").count() == 100
    assert a.select("transaction_id").distinct().count() == 5000
    pa = a.orderBy("transaction_id").toPandas()
    pb = b.orderBy("transaction_id").toPandas()
    assert pa.equals(pb)
    g = pa.groupby("is_fraud")
    assert g["amount"].median()[1] > 3 * g["amount"].median()[0]          # fraud amounts are larger
    assert g["velocity_1h"].mean()[1] == pytest.approx(5.0, abs=0.6)
    assert g["velocity_1h"].mean()[0] == pytest.approx(1.5, abs=0.1)
    assert pa["hour"].between(0, 23).all()


def test_enrich_keeps_tier(spark):
    t = synthetic.generate_transactions(spark, 2000, 0.05)
    cat = spark.createDataFrame([(f"m{i}", "cat", i % 3, i) for i in range(12)],
                                "merchant_name string, merchant_category string, risk_tier int, position int")
    m = synthetic.merchants_from_catalogue(cat)
    e = synthetic.enrich(t, m).join(m.select("merchant_id", "risk_tier"), "merchant_id")
    assert e.count() == 2000
    assert e.where(F.col("risk_tier") != F.col("merchant_risk_tier")).count() == 0
    assert e.where(F.hour("txn_timestamp") != F.col("hour")).count() == 0
    acc = synthetic.accounts_for(spark, 200)
    assert acc.select("account_id").distinct().count() == 200


def test_csv_and_text_dir(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("transaction_id,amount,hour,merchant_risk_tier,velocity_1h,velocity_24h,high_risk_country,"
                 "amount_vs_avg_ratio,days_since_account_open,is_weekend,is_fraud\n"
                 "TXN-1,12.5,3,2,1,4,0,1.1,100,0,1\nTXN-2,40.0,13,0,0,2,1,0.9,2000,1,0\n")
    df = files.load_transactions(spark, str(p))
    assert df.count() == 2 and dict(df.dtypes)["velocity_1h"] == "bigint"
    assert files.load_report(df).first()["fraud_rate_pct"] == 50.0
    w = tmp_path / "wide.csv"
    w.write_text("Time," + ",".join(f"V{i}" for i in range(1, 29)) + ",Amount,Class\n"
                 + "0," + ",".join("0.1" for _ in range(28)) + ",5.0,0\n")
    wd = files.load_transactions(spark, str(w))
    assert {"time", "amount", "is_fraud", "V1"} <= set(wd.columns)
    d = tmp_path / "policies"
    (d / "sub").mkdir(parents=True)
    (d / "aml_policy.txt").write_text("Rule one.\n\nRule two.")
    (d / "sub" / "other.txt").write_text("Another.")
    (d / "skip.md").write_text("no")
    docs = files.read_text_dir(spark, str(d))
    assert docs.count() == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.md").write_text("x")
    with pytest.raises(ValueError):
        files.read_text_dir(spark, str(empty))


def test_forest_persistence_roundtrip(spark, tmp_path):
    from riskloom.operators import forest as FO
    t = synthetic.generate_transactions(spark, 500, 0.05)
    cols = ["amount", "hour", "velocity_1h"]
    m = FO.fit_forest(t, cols, "transaction_id", n_trees=5, psi=64)
    files.save_forest(m, str(tmp_path / "forest"))
    m2 = files.load_forest(spark, str(tmp_path / "forest"))
    a = FO.score_forest(t, m).select("transaction_id", "anomaly_score").orderBy("transaction_id").toPandas()
    b = FO.score_forest(t, m2).select("transaction_id", "anomaly_score").orderBy("transaction_id").toPandas()
    assert a.equals(b)
    with pytest.raises(FileNotFoundError):
        files.load_forest(spark, str(tmp_path / "missing"))
