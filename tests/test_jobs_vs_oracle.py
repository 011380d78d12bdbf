"""Registered jobs against their DuckDB SQL at sf0.001 (the driver does the same at sf0.01)."""
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
FAST = ["adapter_transactions", "r01_fraud_overview", "r02_rolling_fraud_rate", "r03_velocity_bursts",
        "r04_account_tiers", "r05_merchant_exposure", "r06_time_of_day", "r07_alert_queue", "r08_cohorts",
        "d13_rate_by_quantile_bin", "j01_summary", "j09_lift", "c10_vector_topk", "m_rule_flags", "i10_woe_bins", "l2_stream_velocity", "d24_queue_by_sla",
        "a09_constraints", "d25_ratio_bands", "m05_ratio_escalated", "m10_ratio_volume", "j09_lift_grid", "e04_next_transactions", "h07_split_labels", "l5_stream_alerts"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def _canon(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 9)
        if hasattr(v, "isoformat"):
            import pandas as pd
            return str(pd.Timestamp(v))
        return v
    rows = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", FAST)
def test_job_matches_oracle(spark, sf_small, con, name):
    got = queries()[name](spark, sf_small).toPandas()
    exp = con.execute(oracle_sql()[name]).df()
    gc, gr = _canon(got)
    ec, er = _canon(exp)
    assert gc == ec
    assert len(gr) == len(er)
    assert gr == er


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "queue_position" in df.columns


def test_every_oracle_has_a_job():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["adapter_transactions", "r03_velocity_bursts", "l4_stream_sessions"])
def test_results_do_not_depend_on_session_zone(spark, sf_small, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = queries()[name](spark, sf_small).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert _canon(got) == _canon(con.execute(oracle_sql()[name]).df())
