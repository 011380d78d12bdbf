"""Count the physical operators that matter at scale in each job's plan.

usage: python tools/plan_shapes.py [sf_dir] [job ...]   -> markdown table on stdout
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import build_session  # noqa: E402

KINDS = {"shuffles": "Exchange hashpartitioning", "range/global": "Exchange rangepartitioning",
         "single-partition": "Exchange SinglePartition", "broadcasts": "BroadcastExchange",
         "windows": "Window [", "top-k": "TakeOrderedAndProject", "python": "PythonUDF|MapInPandas|FlatMapGroupsInPandas"}
DEFAULT = ["r01_fraud_overview", "r02_rolling_fraud_rate", "r03_velocity_bursts", "r04_account_tiers",
           "r05_merchant_exposure", "r06_time_of_day", "r07_alert_queue", "r08_cohorts", "d13_rate_by_quantile_bin",
           "j01_summary", "m_rule_flags", "c10_vector_topk"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = build_session()
    from riskloom.plans.catalog import CATALOG
    print("| job | " + " | ".join(KINDS) + " |")
    print("|---|" + "---|" * len(KINDS))
    for n in names:
        plan = CATALOG[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = []
        for pat in KINDS.values():
            counts.append(str(sum(plan.count(p) for p in pat.split("|"))))
        print(f"| {n} | " + " | ".join(counts) + " |")


if __name__ == "__main__":
    main()
