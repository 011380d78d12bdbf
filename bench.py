"""Benchmark: run the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each job runs its whole plan into Spark's no-op sink (nothing is collected) and
is timed end to end.  The shared derived transaction table is built once and
timed as ``build_transactions``; JVM warm-up is reported apart.  The oracle SQL
of the same jobs is timed in DuckDB on the same files for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.session import build_session  # noqa: E402

HEADLINE = ["r01_fraud_overview", "r02_rolling_fraud_rate", "r03_velocity_bursts", "r04_account_tiers",
            "r05_merchant_exposure", "r06_time_of_day", "r07_alert_queue", "r08_cohorts",
            "d13_rate_by_quantile_bin", "j01_summary", "i10_woe_bins", "i06_forest_scores",
            "m_rule_flags", "c10_vector_topk", "l00_chunks", "l2_stream_velocity"]


def run(df) -> int:
    """Execute the whole plan: write every row to the no-op sink (nothing reaches the driver)."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    from riskloom.plans.catalog import CATALOG
    from riskloom.sources import adapter
    times = {}
    t0 = time.time()
    spark.range(1_000_000).selectExpr("sum(id)").collect()      # JVM / codegen warm-up, reported apart
    warmup = round(time.time() - t0, 3)
    t0 = time.time()
    adapter.transactions_table(spark, sf_dir)          # shared derived table, built once
    times["build_transactions"] = round(time.time() - t0, 3)
    if any(n.startswith("l2_") or n.startswith("l3_") or n.startswith("l4_") or n.startswith("l5_") for n in names):
        from riskloom.streaming.jobs import replay_source
        t0 = time.time()
        replay_source(spark, sf_dir)                   # stream source: events written as day files, once
        times["build_stream_replay"] = round(time.time() - t0, 3)
    errors = {}
    for name in names:
        t0 = time.time()
        try:
            run(CATALOG[name](spark, sf_dir))
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep timing the other jobs
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
                      "session_warmup_sec": warmup, "errors": errors,
                      "duckdb_same_sql": duckdb_times(sf_dir, names),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


def duckdb_times(sf_dir: str, names: list[str]) -> dict:
    """Single-node reference point: the oracle SQL of the same jobs in DuckDB on the same files."""
    try:
        import duckdb
        from riskloom.oracle import SQL
    except Exception:  # noqa: BLE001
        return {}
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = {}
    for name in names:
        if name in SQL:
            t0 = time.time()
            try:
                con.execute(SQL[name]).fetchall()
                out[name] = round(time.time() - t0, 3)
            except Exception:  # noqa: BLE001
                out[name] = None
    return out


if __name__ == "__main__":
    main()
