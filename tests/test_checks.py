"""Audits must fail on broken output; rules, splitter and lift grid against plain versions."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate, features
from riskloom.operators import scorecard as S
from riskloom.operators import text as TX
from riskloom.plans import checks, models


def _broken(df):
    return {r["rule"].split(": ")[1] for r in df.collect() if r["violations"]}


def test_forest_audit_sees_every_kind_of_damage(spark, sf_small):
    s, forest = models.forest_scored(spark, sf_small, attributions=True), models.trained_forest(spark, sf_small)
    assert not _broken(checks.audit_forest(s, forest))
    assert "tier follows score" in _broken(checks.audit_forest(s.withColumn("risk_tier", F.lit("HIGH")), forest))
    moved = s.withColumn("attributions", F.transform("attributions", lambda x: x + 0.01))
    assert "attributions add up" in _broken(checks.audit_forest(moved, forest))
    short = s.withColumn("attributions", F.slice("attributions", 1, 3))
    assert "an attribution per feature" in _broken(checks.audit_forest(short, forest))
    assert "risk score in [0, 1]" in _broken(checks.audit_forest(s.withColumn("risk_score", F.lit(None).cast("double")), forest))
    assert "one row per transaction" in _broken(checks.audit_forest(s.unionByName(s.limit(1)), forest))


def test_shapley_audit_sees_broken_axioms(spark):
    good = spark.createDataFrame([("x", [1.0, 2.0, 3.0, 0.0], [3.0, 2.0, 1.0, 0.0])], "transaction_id string, a array<double>, b array<double>")
    assert not _broken(checks.audit_shapley(good, 0, 2))
    assert _broken(checks.audit_shapley(good.withColumn("a", F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 0.1)])), 0, 2)) >= {
        "a feature without splits gets nothing"}
    assert _broken(checks.audit_shapley(good.withColumn("b", F.col("a")), 0, 2)) == {"exchanged features exchange attributions", "other features keep theirs"}
    assert _broken(checks.audit_shapley(good.withColumn("b", F.array(*[F.lit(v) for v in (3.0, 2.5, 1.0, 0.0)])), 0, 2)) == {"other features keep theirs"}


def test_rule_violations_counts_each_rule(spark):
    df = spark.createDataFrame([(1.0, 3), (float("nan"), 3), (None, 3), (-5.0, 30), (2.0, -1), (2.0, None)], "amount double, hour int")
    got = {r["rule"]: r["violations"] for r in features.rule_violations(df).collect()}
    assert got["amount missing"] == 1 and got["amount must be > 0"] == 2
    assert got["hour must be >= 0"] == 1 and got["hour must be <= 23"] == 1
    assert got["is_weekend must be <= 1"] == 0
    assert not features.validate_records(df).where("isnan(amount)").first()["valid"]


@pytest.mark.parametrize("seed", [0, 1])
def test_coarse_groups_match_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    for _ in range(5):
        bads = rng.integers(0, 5, rng.integers(1, 9)).tolist()
        df = spark.createDataFrame([([(i, i, b, 10) for i, b in enumerate(bads)],)], "fine " + S._GROUPS)
        got = [tuple(g) for g in df.select(S.coarse_groups(F.col("fine"), 3).alias("g")).first()["g"]]
        want, total = [], 0
        for i, b in enumerate(bads):                      # a group ends with the bin that brings it to three
            if total == 0 and (not want or want[-1][2] >= 3):
                want.append([i, i, 0, 0])
            want[-1][1], want[-1][2], want[-1][3] = i, want[-1][2] + b, want[-1][3] + 10
        if len(want) > 1 and want[-1][2] < 3:
            tail = want.pop()
            want[-1] = [want[-1][0], tail[1], want[-1][2] + tail[2], want[-1][3] + tail[3]]
        assert got == [tuple(w) for w in want]


def test_lift_grid_agrees_with_lift(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(777) < 0.2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"is_fraud": y, "score": np.round(rng.normal(y, 1.0), 1)}))
    grid = {round(r["review_rate"], 2): r["fraud_caught_pct"] for r in evaluate.lift_grid(df).collect()}
    assert len(grid) == 100 and grid[1.0] == 100.0
    for r in evaluate.lift(df).collect():
        assert grid[r["review_rate"]] == pytest.approx(r["fraud_caught_pct"], abs=1e-3)


def test_analyse_one_row_per_input_row_and_own_vectors(spark, sf_small):
    from riskloom.plans.analyse import analyse
    from riskloom.sources import adapter
    t = adapter.transactions_table(spark, sf_small).limit(20)
    t = t.unionByName(t.limit(5))                         # repeated ids
    docs = adapter.read(spark, sf_small, "documents").limit(10)

    def embed(corpus, queries):
        vector = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
        return corpus.withColumn("embedding", vector("text")), queries.withColumn("embedding", vector("retrieval_query"))

    got = analyse(t, models.trained_forest(spark, sf_small), docs, retrieve_tiers=None, embed=embed)
    assert got["results"].count() == 25
    assert got["summary"].first()["total"] == 25
    assert got["results"].where(F.length("policy_context") == 0).count() == 0


def test_split_text_windows_repeat_the_end_of_the_last():
    text = " ".join(f"w{i:03d}" for i in range(300))
    chunks = TX.split_text(text, 100, 20)
    assert all(len(c) <= 100 for c in chunks) and chunks[0].startswith("w000") and chunks[-1].endswith("w299")
    for a, b in zip(chunks, chunks[1:]):
        assert b.split()[0] in a.split()[-4:]


def test_unreadable_store_is_an_error(spark, tmp_path):
    from riskloom.sources.files import chunk_store
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("not parquet")
    docs = spark.createDataFrame([(1, "one two", "s")], "doc_id long, text string, source string")
    with pytest.raises(Exception):
        chunk_store(spark, docs, str(tmp_path / "store")).count()
    assert (tmp_path / "store" / "part-0.parquet").read_text() == "not parquet"
