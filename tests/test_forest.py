import numpy as np
import pandas as pd
import pytest

from riskloom.operators import forest as FO

FEATS = ["amount", "hour", "merchant_risk_tier", "velocity_1h", "velocity_24h", "high_risk_country",
         "amount_vs_avg_ratio", "days_since_account_open", "is_weekend"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    n = 600
    pdf = pd.DataFrame({"transaction_id": [f"T{i}" for i in range(n)],
                        "amount": rng.lognormal(3.5, 1.2, n), "hour": rng.integers(0, 24, n),
                        "merchant_risk_tier": rng.integers(0, 3, n), "velocity_1h": rng.poisson(1.5, n),
                        "velocity_24h": rng.poisson(8, n), "high_risk_country": rng.integers(0, 2, n),
                        "amount_vs_avg_ratio": rng.lognormal(0, 0.5, n),
                        "days_since_account_open": rng.integers(0, 3000, n), "is_weekend": rng.integers(0, 2, n)})
    pdf.loc[0, ["amount", "velocity_1h", "amount_vs_avg_ratio"]] = [9800.0, 9, 8.5]   # an obvious outlier
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def model(sample):
    return FO.fit_forest(sample, FEATS, "transaction_id", n_trees=20, psi=128, seed=1)


def test_fit_is_deterministic(sample, model):
    again = FO.fit_forest(sample.repartition(3), FEATS, "transaction_id", n_trees=20, psi=128, seed=1)
    a = model["nodes"].orderBy("tree", "node").toPandas()
    b = again["nodes"].orderBy("tree", "node").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_scores_and_tiers(sample, model):
    s = FO.score_batch(sample, model).toPandas()
    assert s["risk_score"].between(0, 1).all()
    assert s["risk_score"].max() == pytest.approx(1.0) and s["risk_score"].min() == pytest.approx(0.0)
    assert set(s["risk_tier"]) <= {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    top = s.sort_values("risk_score", ascending=False).iloc[0]
    assert top["transaction_id"] == "T0"
    assert set(sample.columns) <= set(s.columns)


def test_attributions_are_additive(sample, model):
    s = FO.score_forest(sample, model, attributions=True).toPandas()
    nodes = model["nodes"].toPandas()
    root_mean = nodes[nodes["node"] == 0]["value"].mean()
    cpsi = float(FO.c_factor([model["psi"]])[0])
    eh = -np.log2(s["anomaly_score"].to_numpy()) * cpsi             # E[h(x)]
    total = np.array([np.sum(a) for a in s["attributions"]])
    np.testing.assert_allclose(total, root_mean - eh, atol=1e-9)


@pytest.mark.parametrize("raw,expected", [
    ([-0.5, -0.2, 0.0, 0.1, 0.3], None), ([0.2, 0.2, 0.2], [0.0, 0.0, 0.0]), ([0.7], [0.0])])
def test_normalise(spark, raw, expected):
    df = spark.createDataFrame([(float(x),) for x in raw], ["a"])
    got = [r["r"] for r in FO.normalise(df, "a", "r").orderBy("a").collect()]
    assert min(got) >= 0 and max(got) <= 1
    if expected is not None:
        assert got == expected
    else:
        assert got[0] == 0.0 and got[-1] == 1.0


def test_top_drivers_text(spark):
    names = ["amount", "velocity_1h", "high_risk_country", "unknown_xyz_feature"]
    df = spark.createDataFrame([([0.1, -0.5, 0.3, 0.05],), ([0.0, 0.0, 0.0, 0.9],)], ["attributions"])
    rows = FO.top_drivers(df, names).collect()
    lines = rows[0]["top_drivers"].split("\n")
    assert len(lines) == 3
    assert lines[0].startswith("1. velocity_1h (-0.500)")
    assert lines[1].startswith("2. high_risk_country (+0.300)") and "jurisdiction" in lines[1]
    assert lines[2].startswith("3. amount (+0.100)")
    assert "unknown_xyz_feature (+0.900): unknown_xyz_feature contributed to the anomaly score" in rows[1]["top_drivers"]
    one = FO.top_drivers(df, names, n=1).first()["top_drivers"]
    assert len(one.split("\n")) == 1
