"""Named jobs (A10): name -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the shared tables (or what Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import eda, evaluate, features, reports
from riskloom.plans import checks, models
from riskloom.sources import adapter
from riskloom.streaming import jobs as streams

Job = Callable[[SparkSession, str], DataFrame]


def _t(spark, d):
    return adapter.transactions_table(spark, d)


def _scored(spark, d, col="amount_vs_avg_ratio"):
    """(label, score) table: the transaction table scored by one of its columns."""
    return _t(spark, d).withColumn("score", F.col(col))


CATALOG: dict[str, Job] = {
    "adapter_transactions": lambda s, d: adapter.transactions(s, d),
    "r01_fraud_overview": lambda s, d: reports.fraud_overview(_t(s, d)),
    "r02_rolling_fraud_rate": lambda s, d: reports.rolling_fraud_rate(_t(s, d)),
    "r03_velocity_bursts": lambda s, d: reports.velocity_bursts(_t(s, d)),
    "r04_account_tiers": lambda s, d: reports.account_tiers(_t(s, d), adapter.accounts(s, d)),
    "r05_merchant_exposure": lambda s, d: reports.merchant_exposure(_t(s, d), adapter.merchants(s, d)),
    "r06_time_of_day": lambda s, d: reports.time_of_day(_t(s, d)),
    "r07_alert_queue": lambda s, d: reports.alert_queue(_t(s, d), adapter.merchants(s, d)),
    "r08_cohorts": lambda s, d: reports.cohorts(_t(s, d)),
    "d11_class_summary": lambda s, d: eda.class_summary(_t(s, d)),
    "d12_rate_by_value": lambda s, d: eda.rate_by_value(_t(s, d)),
    "d13_rate_by_quantile_bin": lambda s, d: eda.rate_by_quantile_bin(_t(s, d)),
    "d14_hourly_rates": lambda s, d: eda.hourly_rates(_t(s, d)),
    "d15_amount_percentiles": lambda s, d: eda.amount_percentiles(_t(s, d)),
    "d16_correlations": lambda s, d: eda.correlations(_t(s, d)),
    "d17_rate_by_flag_count": lambda s, d: eda.rate_by_flag_count(_t(s, d)),
    "d18_key_findings": lambda s, d: eda.key_findings(_t(s, d)),
    "d22_category_rollup": lambda s, d: eda.category_rollup(_t(s, d), adapter.merchants(s, d)),
    "d23_burst_vs_fraud": lambda s, d: eda.burst_vs_fraud(reports.velocity_bursts(_t(s, d), limit=None)),
    "d27_daily_peaks": lambda s, d: eda.daily_peaks(reports.rolling_fraud_rate(_t(s, d))),
    "j01_summary": lambda s, d: evaluate.summary(_scored(s, d)),
    "j03_ks_curve": lambda s, d: evaluate.ks_curve(_scored(s, d)),
    "j04_at_threshold": lambda s, d: evaluate.at_threshold(_scored(s, d), threshold=1.5),
    "j05_curve": lambda s, d: evaluate.curve(_scored(s, d)).select(
        "threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1")]),
    "j06_best_f1": lambda s, d: evaluate.best_f1(_scored(s, d)),
    "j07_separation": lambda s, d: evaluate.separation(_scored(s, d)),
    "j08_calibration": lambda s, d: evaluate.calibration(_scored(s, d)),
    "j09_lift": lambda s, d: evaluate.lift(_scored(s, d)),
    "j10_deciles": lambda s, d: evaluate.deciles(_scored(s, d)),
    "j11_compare": lambda s, d: evaluate.compare({"ratio": _scored(s, d), "amount": _scored(s, d, "amount")}),
    "i10_woe_bins": models.woe_bins,
    "i13_woe_transform": models.woe_transform,
    "d16_woe_correlations": models.woe_correlations,
    "i14_iv_summary": models.iv_table,
    "i16_points_table": models.points,
    "i17_scorecard_scores": models.scorecard_scores,
    "i18_score_breakdown": models.score_breakdown,
    "i_scorecard_metrics": models.scorecard_metrics,
    "i03_forest_nodes": models.forest_nodes,
    "i06_forest_scores": models.forest_scores,
    "i20_forest_drivers": models.forest_drivers,
    "i21_forest_importance": models.forest_importance,
    "d19_tier_distribution": models.forest_tiers,
    "d20_scan_summary": models.forest_scan_summary,
    "d21_score_histogram": models.forest_score_histogram,
    "d21_card_score_histogram": models.card_score_histogram,
    "d25_score_bands": models.forest_score_bands,
    "i08_boosted_scores": models.boosted_scores,
    "i09_boosted_search": models.boosted_search,
    "j11_model_comparison": models.model_comparison,
    "l00_chunks": models.chunks,
    "c10_vector_topk": models.vector_topk,
    "l1f_analyse_results": models.analyse_results,
    "l1f_analyse_summary": models.analyse_summary,
    "b07_quarantine": models.analyse_quarantine,
    "l1d_prompts": models.prompts,
    "l2_stream_velocity": streams.velocity,
    "l2b_stream_velocity_microbatch": streams.velocity_microbatch,
    "l3_stream_fraud_windows": streams.fraud_windows,
    "l4_stream_sessions": streams.sessions,
    "l5_stream_alerts": streams.alerts,
    "m_rule_flags": models.rule_flags,
    "m_rule_summary": models.rule_summary,
    "m08_psi": models.psi_inputs,
    "m08_score_psi": models.score_psi,
    "m09_performance_drift": models.performance_drift,
    "m10_volume_fp": models.volume_fp,
    "m12_rank_shift": models.rank_shift,
    "a08_row_counts": lambda s, d: features.row_counts(adapter.tables(s, d)),
    "a09_constraints": lambda s, d: features.constraint_report(_t(s, d), adapter.accounts(s, d),
                                                               adapter.merchants(s, d)),
    "d24_queue_by_sla": models.queue_sla,
    "d26_points_range": models.points_range,
    "f04_class_sample": models.class_sample,
    "i21_importance_agreement": models.importance_agreement,
    "b14_profile": models.profile_missing,
    "b15_winsorised_amounts": models.winsorised_amounts,
    "i01_scaler": models.scaler_stats,
    "i02_split_counts": models.split_counts,
    "d21_log_amount_histogram": models.log_amount_histogram,
    "m05_escalated_tiers": models.escalated_tiers,
    **checks.JOBS,
}


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """Run a named job; unknown names raise ``KeyError`` listing the known ones."""
    if name not in CATALOG:
        raise KeyError(f"unknown job {name!r}; known: {sorted(CATALOG)}")
    return CATALOG[name](spark, sf_dir)


def run_sql(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    """Run SQL text over the views transactions, accounts and merchants."""
    return checks.run_sql(spark, text, sf_dir)
