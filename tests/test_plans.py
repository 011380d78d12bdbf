"""Plan checks: pushdown/pruning reach the scan; no single-partition exchange over raw rows."""
from riskloom.operators import reports
from riskloom.sources import adapter


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_children(plan: str):
    """For every single-partition exchange, the operators below it down to the next exchange."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            seg = []
            for nxt in lines[i + 1:]:
                if "Exchange" in nxt:
                    break
                seg.append(nxt)
            out.append(" | ".join(seg))
    return out


def test_transaction_model_has_no_single_partition_exchange_over_rows(spark, sf_small):
    """Only 1-row partial aggregates (supplier count, quantile sketch) may meet in one task."""
    p = _plan(adapter.transactions(spark, sf_small))
    for child in _single_partition_children(p):
        assert "Aggregate" in child and ("partial_" in child or "keys=[]" in child), child


def test_reports_have_no_single_partition_exchange_over_rows(spark, sf_small):
    t = adapter.transactions_table(spark, sf_small)
    for df in (reports.alert_queue(t, adapter.merchants(spark, sf_small)), reports.cohorts(t),
               reports.account_tiers(t, adapter.accounts(spark, sf_small)), reports.velocity_bursts(t)):
        for child in _single_partition_children(_plan(df)):
            assert "Aggregate" in child or "TakeOrderedAndProject" in child or "Limit" in child, child


def test_report_scan_prunes_columns(spark, sf_small):
    t = adapter.transactions_table(spark, sf_small)
    p = _plan(reports.time_of_day(t))
    scan = [line for line in p.split("\n") if "ReadSchema" in line]
    assert scan and all("transaction_id" not in s for s in scan)


def test_filter_pushed_to_scan(spark, sf_small):
    from pyspark.sql import functions as F
    t = adapter.transactions_table(spark, sf_small).where(F.col("amount") >= 1000)
    assert "PushedFilters: [IsNotNull(amount), GreaterThanOrEqual(amount,1000.0)]" in _plan(t)


def test_alert_queue_uses_topk_not_global_window(spark, sf_small):
    t = adapter.transactions_table(spark, sf_small)
    p = _plan(reports.alert_queue(t, adapter.merchants(spark, sf_small)))
    assert "TakeOrderedAndProject" in p


def _window_partitions(plan: str):
    import re
    return re.findall(r"windowspecdefinition\(([^)]*?)(?:,\s*\w+#\d+L? (?:ASC|DESC)|,\s*specifiedwindowframe|\))", plan)


def test_no_per_account_window_without_time_bucket(spark, sf_small):
    """A hot account must never land in one window partition: every window keyed by the
    account also carries a time (or value) bucket.  There is one plan at every size."""
    t = adapter.transactions_table(spark, sf_small)
    for df in (adapter.transactions(spark, sf_small), reports.velocity_bursts(t)):
        p = _plan(df)
        for line in p.split("\n"):
            if "Window [" not in line or "windowspecdefinition(" not in line:
                continue
            spec = line.split("windowspecdefinition(", 1)[1]
            if "account_id" in spec.split(",")[0] or "_kk" in spec.split(",")[0]:
                head = spec.split("specifiedwindowframe")[0]
                assert "_b#" in head or "_rk_b" in head or "_sq_b" in head or "_tw_b" in head, line[:300]


def test_scores_are_walked_once_for_all_jobs(spark, sf_small):
    """Jobs on the forest read its stored scores: no plan scores rows itself, and the breakdown shuffles no rows."""
    from riskloom.plans import models
    for job in (models.forest_scores, models.forest_tiers, models.forest_importance, models.performance_drift, models.rank_shift,
                models.volume_fp, models.analyse_quarantine):
        assert "MapInPandas" not in _plan(job(spark, sf_small)), job
    assert "Exchange hashpartitioning(transaction_id" not in _plan(models.score_breakdown(spark, sf_small))


def test_velocity_bursts_rank_only_their_result(spark, sf_small):
    """The amount rank is counted for the 100 rows that stay; the table itself is not ranked or shuffled for it."""
    t = adapter.transactions_table(spark, sf_small)
    p = _plan(reports.velocity_bursts(t))
    assert p.count("Exchange hashpartitioning") <= 4 and "Window" not in p
