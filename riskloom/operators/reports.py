"""The eight SQL reports (R01-R08) as DataFrame jobs.

Every report takes the ``transactions`` frame (and dimensions where needed)
and returns a DataFrame; nothing is collected.  Money is summed exactly as
``decimal(18,2)``; rounding is SQL half-up; divisions never raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators.ranking import numbered, percent_rank, top_k_with_position
from riskloom.operators.timewindow import MICROS, rank_of, rank_within_key, sequence
from riskloom.sources.store import spill

r = F.round


def fraud_overview(t: DataFrame) -> DataFrame:
    """14 global metrics in one aggregate."""
    fraud = F.col("is_fraud") == 1
    legit = F.col("is_fraud") == 0
    a = t.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("is_fraud").cast("long").alias("fraud_count"),
        F.avg("is_fraud").alias("_rate"),
        F.sum(X.money("amount")).alias("_vol"),
        F.sum(F.when(fraud, X.money("amount")).otherwise(F.lit(0).cast(X.MONEY))).alias("_fvol"),
        X.money_avg(F.when(legit, F.col("amount"))).alias("_avg_l"),
        X.money_avg(F.when(fraud, F.col("amount"))).alias("_avg_f"),
        F.avg(F.when(legit, F.col("velocity_1h"))).alias("_v_l"),
        F.avg(F.when(fraud, F.col("velocity_1h"))).alias("_v_f"),
        F.avg(F.when(fraud, F.col("high_risk_country"))).alias("_c_f"),
        F.avg(F.when(legit, F.col("high_risk_country"))).alias("_c_l"),
    )
    return a.select(
        "total_transactions", "fraud_count",
        (F.col("total_transactions") - F.col("fraud_count")).alias("legitimate_count"),
        r(F.col("_rate") * 100.0, 3).alias("fraud_rate_pct"),
        F.col("_vol").cast("double").alias("total_volume_aud"),
        F.col("_fvol").cast("double").alias("fraud_volume_aud"),
        r(X.pct(F.col("_fvol"), F.col("_vol")), 2).alias("fraud_volume_pct"),
        r(F.col("_avg_l"), 2).alias("avg_legit_amount"),
        r(F.col("_avg_f"), 2).alias("avg_fraud_amount"),
        r(X.ratio(F.col("_avg_f"), F.col("_avg_l")), 2).alias("fraud_to_legit_amount_ratio"),
        r(F.col("_v_l"), 2).alias("avg_legit_velocity_1h"),
        r(F.col("_v_f"), 2).alias("avg_fraud_velocity_1h"),
        r(F.col("_c_f") * 100.0, 1).alias("fraud_high_risk_country_pct"),
        r(F.col("_c_l") * 100.0, 1).alias("legit_high_risk_country_pct"),
    )


def daily_stats(t: DataFrame) -> DataFrame:
    """Per-day count, fraud and exact volume (one row per calendar day)."""
    return t.groupBy("txn_date").agg(
        F.count(F.lit(1)).alias("daily_txns"),
        F.sum("is_fraud").cast("long").alias("daily_fraud"),
        F.sum(X.money("amount")).alias("_daily_vol"))


def rolling_fraud_rate(t: DataFrame, days: int = 7) -> DataFrame:
    """Daily rate with a rolling window of ``days`` *rows* and a running fraud total.

    The windows run over the daily aggregate (one row per day), so the single
    ordered partition holds calendar days, never transactions."""
    d = daily_stats(t)
    w = Window.orderBy("txn_date").rowsBetween(-(days - 1), 0)
    run = Window.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, 0)
    return (d.select(
        "txn_date", "daily_txns", "daily_fraud",
        r(X.pct(F.col("daily_fraud"), F.col("daily_txns")), 2).alias("daily_fraud_rate_pct"),
        F.col("_daily_vol").cast("double").alias("daily_volume_aud"),
        F.sum("daily_txns").over(w).alias("rolling_7d_txns"),
        F.sum("daily_fraud").over(w).alias("rolling_7d_fraud"),
        r(X.pct(F.sum("daily_fraud").over(w), F.sum("daily_txns").over(w)), 3).alias("rolling_7d_fraud_rate_pct"),
        F.sum("_daily_vol").over(w).cast("double").alias("rolling_7d_volume_aud"),
        F.sum("daily_fraud").over(run).alias("cumulative_fraud_count"))
        .orderBy("txn_date"))


def velocity_sequence(t: DataFrame, grain_seconds: int = 300, ranked: bool = True) -> DataFrame:
    """Per-account previous transaction, sequence number and, if ``ranked``, amount rank
    (rank first, so its bucket sizing counts the plain table scan)."""
    r = rank_within_key(t, "account_id", "amount", "amount_rank_in_account", descending=True) if ranked else t
    return sequence(r, "account_id", "txn_timestamp", "transaction_id",
                    lag_cols=["txn_timestamp", "amount", "merchant_id"], row_number="txn_seq_num",
                    grain_seconds=grain_seconds)


def velocity_bursts(t: DataFrame, max_minutes: float = 60.0, burst_minutes: float = 10.0,
                    limit: int | None = 100) -> DataFrame:
    """Transactions within ``max_minutes`` of the account's previous one.

    Minutes use exact microseconds; order: minutes asc, amount desc, id.  With a ``limit`` the amount rank is counted
    for the rows that stay only."""
    s = velocity_sequence(t, ranked=limit is None)
    s = s.where(F.col("prev_txn_timestamp").isNotNull())
    us = F.expr("timestampdiff(MICROSECOND, prev_txn_timestamp, txn_timestamp)")
    minutes = us.cast("double") / float(60 * MICROS)
    e = s.select(
        "transaction_id", "account_id", "txn_timestamp",
        r(F.col("amount"), 2).alias("amount"),
        r(F.col("prev_amount"), 2).alias("prev_amount"),
        r(minutes, 1).alias("minutes_since_prev_txn"),
        r(X.ratio(F.col("amount"), F.col("prev_amount")), 2).alias("amount_ratio_vs_prev"),
        X.flag((us < F.lit(int(burst_minutes * 60 * MICROS)))
               & (F.col("merchant_id") != F.col("prev_merchant_id"))).alias("multi_merchant_burst_flag"),
        F.col("txn_seq_num").cast("long").alias("txn_seq_num"),
        *([F.col("amount_rank_in_account").cast("long").alias("amount_rank_in_account")] if limit is None else []),
        "high_risk_country", "is_fraud",
        F.col("amount").alias("_raw_amount"))
    e = e.where(F.col("minutes_since_prev_txn") < max_minutes)
    order = [F.col("minutes_since_prev_txn").asc(), F.col("_raw_amount").desc(), F.col("transaction_id").asc()]
    if limit is None:
        return e.orderBy(*order).drop("_raw_amount")
    few = spill(e.orderBy(*order).limit(limit), "velocity-bursts")
    e = rank_of(few, t, "account_id", "_raw_amount", "amount_rank_in_account", "transaction_id", df_value="amount")
    columns = [c for c in few.columns if c != "_raw_amount"]
    columns.insert(columns.index("txn_seq_num") + 1, "amount_rank_in_account")
    return (e.withColumn("amount_rank_in_account", F.col("amount_rank_in_account").cast("long"))
            .orderBy(*order).select(*columns))


def account_metrics(t: DataFrame, a: DataFrame) -> DataFrame:
    """D3: per-account metrics.  Transactions are aggregated per account first
    (partial aggregation), then joined to the account dimension 1:1."""
    m = t.groupBy("account_id").agg(
        F.count("transaction_id").alias("total_txns"),
        F.sum("is_fraud").cast("long").alias("confirmed_fraud_count"),
        F.sum(X.money("amount")).cast("double").alias("total_spend_aud"),
        r(X.money_avg("amount"), 2).alias("avg_txn_amount"),
        r(F.max("amount"), 2).alias("max_txn_amount"),
        F.max("velocity_1h").alias("peak_velocity_1h"),
        F.max("velocity_24h").alias("peak_velocity_24h"),
        F.sum("high_risk_country").cast("long").alias("high_risk_country_txns"),
        F.max("amount_vs_avg_ratio").alias("max_amount_ratio"),
        F.sum(X.flag(F.col("merchant_risk_tier") == 2)).cast("long").alias("high_risk_merchant_txns"),
        F.count_distinct("merchant_id").alias("distinct_merchants"),
        F.min("txn_date").alias("first_txn_date"),
        F.max("txn_date").alias("last_txn_date"))
    return m.join(a.select("account_id", "account_type", "credit_limit"), "account_id")


def account_risk_score() -> F.Column:
    """Additive account score, 0..120."""
    def band(c, steps):
        e = None
        for thr, pts in steps:
            e = F.when(c >= thr, pts) if e is None else e.when(c >= thr, pts)
        return e.otherwise(0)
    return (band(F.col("confirmed_fraud_count"), [(2, 50), (1, 30)])
            + band(F.col("high_risk_country_txns"), [(3, 25), (1, 15)])
            + band(F.col("peak_velocity_1h"), [(6, 20), (4, 12), (2, 5)])
            + band(F.col("max_amount_ratio"), [(10, 15), (5, 10), (3, 5)])
            + band(F.col("high_risk_merchant_txns"), [(3, 10), (1, 5)])).cast("int")


def account_tiers(t: DataFrame, a: DataFrame) -> DataFrame:
    """Account risk tiers with a global percentile (histogram of <= 121 scores)."""
    m = account_metrics(t, a).withColumn("risk_score", account_risk_score())
    s = F.col("risk_score")
    m = m.withColumn("account_risk_tier", F.when(s >= 60, "CRITICAL").when(s >= 35, "HIGH")
                     .when(s >= 15, "MEDIUM").otherwise("LOW"))
    m = percent_rank(m, "risk_score", "_pr", n_edges=None)
    return (m.select(
        "account_id", "account_type", "account_risk_tier", "risk_score",
        r(F.col("_pr") * 100.0, 1).alias("risk_percentile"),
        "total_txns", "confirmed_fraud_count", "total_spend_aud", "peak_velocity_1h",
        "high_risk_country_txns", "high_risk_merchant_txns",
        r(F.col("max_amount_ratio"), 1).alias("max_amount_ratio"),
        "credit_limit", "first_txn_date", "last_txn_date")
        .orderBy(F.col("risk_score").desc(), F.col("confirmed_fraud_count").desc(), F.col("account_id")))


def merchant_stats(t: DataFrame, mch: DataFrame, min_txns: int = 5) -> DataFrame:
    """Per-merchant metrics: aggregate by merchant first, then attach the dimension."""
    fraud = F.col("is_fraud") == 1
    agg = t.groupBy("merchant_id").agg(
        F.count("transaction_id").alias("total_txns"),
        F.sum("is_fraud").cast("long").alias("fraud_txns"),
        F.avg("is_fraud").alias("_rate"),
        F.sum(X.money("amount")).alias("_vol"),
        F.sum(F.when(fraud, X.money("amount")).otherwise(F.lit(0).cast(X.MONEY))).alias("_fvol"),
        F.sum(F.when(~fraud, X.money("amount")).otherwise(F.lit(0).cast(X.MONEY))).alias("_lvol"),
        X.money_avg("amount").alias("_avg"),
        F.max("amount").alias("_max"),
        F.count_distinct("account_id").alias("distinct_accounts"))
    j = mch.join(agg, "merchant_id", "left")
    j = j.withColumn("total_txns", F.coalesce(F.col("total_txns"), F.lit(0)))
    j = j.where(F.col("total_txns") >= min_txns)
    return j.select(
        "merchant_id", "merchant_name", "merchant_category", "risk_tier", "total_txns", "fraud_txns",
        (F.col("total_txns") - F.col("fraud_txns")).alias("legit_txns"),
        r(F.col("_rate") * 100.0, 2).alias("fraud_rate_pct"),
        F.col("_vol").cast("double").alias("total_volume_aud"),
        F.col("_fvol").cast("double").alias("fraud_volume_aud"),
        F.col("_lvol").cast("double").alias("legit_volume_aud"),
        r(X.pct(F.col("_fvol"), F.col("_vol")), 2).alias("fraud_volume_pct"),
        r(F.col("_avg"), 2).alias("avg_txn_amount"),
        r(F.col("_max"), 2).alias("max_txn_amount"),
        "distinct_accounts")


def merchant_exposure(t: DataFrame, mch: DataFrame, min_txns: int = 5, limit: int = 25) -> DataFrame:
    """Top merchants by fraud volume.  The merchant aggregate is written once; both RANKs are computed for the
    top-``limit`` rows only: the global one depends only on the rows above, the per-tier one counts the merchants of
    the tier with a higher rate."""
    s = spill(merchant_stats(t, mch, min_txns), "merchant-stats")
    order = [F.col("fraud_volume_aud").desc(), F.col("merchant_id").asc()]
    top = top_k_with_position(s, order, limit, "_pos")
    top = top.withColumn("fraud_volume_rank",
                         F.rank().over(Window.orderBy(F.col("fraud_volume_aud").desc())).cast("long"))
    top = rank_of(top, s, "risk_tier", "fraud_rate_pct", "fraud_rate_rank_in_tier", "merchant_id")
    return top.orderBy("_pos").select(
        "fraud_volume_rank", "merchant_name", "merchant_category",
        X.merchant_tier_label("risk_tier").alias("merchant_risk_tier"),
        "total_txns", "fraud_txns", "fraud_rate_pct", "fraud_volume_aud", "fraud_volume_pct",
        "total_volume_aud", "avg_txn_amount", "distinct_accounts",
        F.col("fraud_rate_rank_in_tier").cast("long").alias("fraud_rate_rank_in_tier"))


def time_of_day(t: DataFrame) -> DataFrame:
    """By hour, with uplift over the overall rate and share of all transactions."""
    fraud = F.col("is_fraud") == 1
    h = t.groupBy("hour").agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.sum("is_fraud").cast("long").alias("fraud_txns"),
        F.avg("is_fraud").alias("_rate"),
        X.money_avg("amount").alias("_avg"),
        F.sum(X.money("amount")).cast("double").alias("total_volume_aud"),
        F.sum(F.when(fraud, X.money("amount")).otherwise(F.lit(0).cast(X.MONEY))).cast("double")
        .alias("fraud_volume_aud"))
    # overall rate from the 24-row aggregate (same exact integer sums as a second scan)
    all_w = Window.partitionBy(F.lit(1))
    overall = (F.sum("fraud_txns").over(all_w).cast("double") / F.sum("total_txns").over(all_w).cast("double")) * 100.0
    rate = r(F.col("_rate") * 100.0, 3)
    return (h.select(
        "hour", X.time_window("hour").alias("time_window"), "total_txns", "fraud_txns",
        rate.alias("fraud_rate_pct"),
        r(X.ratio(rate, overall), 2).alias("fraud_rate_uplift"),
        r(F.col("_avg"), 2).alias("avg_amount"),
        "total_volume_aud", "fraud_volume_aud",
        r(X.pct(F.col("total_txns"), F.sum("total_txns").over(all_w)), 1).alias("txn_share_pct"))
        .orderBy("hour"))


def account_baselines(t: DataFrame) -> DataFrame:
    """D8."""
    return t.groupBy("account_id").agg(
        r(X.money_avg("amount"), 2).alias("account_avg_amount"),
        F.count(F.lit(1)).alias("account_total_txns"),
        F.sum("is_fraud").cast("long").alias("account_prior_fraud_count"))


def alert_score(amount="amount", country="high_risk_country", v1h="velocity_1h", ratio_c="amount_vs_avg_ratio",
                tier="merchant_risk_tier", age="days_since_account_open", prior="account_prior_fraud_count",
                v24h="velocity_24h") -> F.Column:
    """Composite alert priority, 0..145."""
    c = F.col
    return ((F.when(c(amount) >= 10000, 30).when(c(amount) >= 5000, 20).when(c(amount) >= 2000, 10).otherwise(0))
            + F.when(c(country) == 1, 25).otherwise(0)
            + F.when(c(v1h) >= 5, 20).when(c(v1h) >= 3, 10).otherwise(0)
            + F.when(c(ratio_c) >= 10, 20).when(c(ratio_c) >= 5, 12).when(c(ratio_c) >= 3, 6).otherwise(0)
            + F.when(c(tier) == 2, 15).when(c(tier) == 1, 5).otherwise(0)
            + F.when(c(age) <= 30, 10).otherwise(0)
            + F.when(c(prior) > 0, 15).otherwise(0)
            + F.when(c(v24h) >= 15, 10).otherwise(0)).cast("int")


def alert_candidate(tier_col: str = "merchant_risk_tier") -> F.Column:
    """B12."""
    c = F.col
    return (c("amount") >= 1000) & ((c("high_risk_country") == 1) | (c("velocity_1h") >= 3)
                                    | (c("amount_vs_avg_ratio") >= 3) | (c(tier_col) == 2)
                                    | (c("days_since_account_open") <= 30))


def alert_candidates(t: DataFrame, mch: DataFrame) -> DataFrame:
    """Scored alert candidates (R07 before ordering)."""
    b = account_baselines(t)
    m = mch.select("merchant_id", "merchant_name", "merchant_category",
                   F.col("risk_tier").alias("m_risk_tier"))
    j = t.join(m, "merchant_id").join(b, "account_id")
    j = j.where(alert_candidate("m_risk_tier"))
    return j.select(
        "transaction_id", "account_id", "txn_timestamp", "txn_date",
        r(F.col("amount"), 2).alias("amount"), "merchant_name", "merchant_category",
        F.col("m_risk_tier").alias("merchant_risk_tier"), "velocity_1h", "velocity_24h", "high_risk_country",
        r(F.col("amount_vs_avg_ratio"), 2).alias("amount_vs_avg_ratio"), "days_since_account_open",
        "is_weekend", "is_fraud", "account_avg_amount", "account_prior_fraud_count",
        alert_score(amount="amount", tier="m_risk_tier").alias("alert_priority_score"))


def alert_queue(t: DataFrame, mch: DataFrame, bands: int = 4, limit: int | None = 50) -> DataFrame:
    """The first ``limit`` queue positions (``None``: the whole queue, by a distributed sort).  NTILE needs only the position and
    the candidate count, so the full ordering is never materialised: a global
    count plus a top-k (per-partition top-k, merged) give exact results."""
    c = alert_candidates(t, mch)
    n = c.agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col("alert_priority_score").desc(), F.col("transaction_id").asc()]
    placed = numbered(c, order, "queue_position") if limit is None else top_k_with_position(c, order, limit, "queue_position")
    top = placed.crossJoin(F.broadcast(n))
    band = X.ntile_of_position(F.col("queue_position"), F.col("_n"), bands)
    return top.orderBy("queue_position").select(
        "queue_position", X.review_sla(band).alias("review_sla"), "alert_priority_score",
        "transaction_id", "account_id", "txn_timestamp", "amount", "merchant_name", "merchant_category",
        X.merchant_tier_label("merchant_risk_tier").alias("merchant_risk"), "velocity_1h",
        "high_risk_country", "amount_vs_avg_ratio", "days_since_account_open",
        "account_prior_fraud_count", F.col("is_fraud").alias("confirmed_fraud"))


def cohorts(t: DataFrame) -> DataFrame:
    """Account-age cohorts.  All cohort metrics are additive, so transactions
    are aggregated once per account and accounts once per cohort: no join of the
    transaction table.  ``approx_accounts`` is the exact account count (Q1)."""
    fraud = F.col("is_fraud") == 1
    per_acc = t.groupBy("account_id").agg(
        F.avg("days_since_account_open").alias("_days"),
        F.count("transaction_id").alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("is_fraud").cast("long").alias("_fraud"),
        F.count("is_fraud").alias("_nf"),
        F.sum(X.money("amount")).alias("_vol"),
        F.count("amount").alias("_na"),
        F.sum(F.when(fraud, X.money("amount")).otherwise(F.lit(0).cast(X.MONEY))).alias("_fvol"),
        F.sum("high_risk_country").cast("long").alias("_hrc"),
        F.count("high_risk_country").alias("_nhrc"),
        F.sum(X.flag(F.col("merchant_risk_tier") == 2)).cast("long").alias("_t2"),
        F.sum("velocity_1h").cast("long").alias("_v"),
        F.count("velocity_1h").alias("_nv"))
    per_acc = per_acc.withColumn("cohort_id", X.cohort_id(F.col("_days")))
    g = per_acc.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("approx_accounts"),
        *[F.sum(c).alias(c) for c in ["_n", "_rows", "_fraud", "_nf", "_vol", "_na", "_fvol", "_hrc", "_nhrc",
                                      "_t2", "_v", "_nv"]])
    all_w = Window.partitionBy(F.lit(1))
    overall = F.sum("_fraud").over(all_w).cast("double") / F.sum("_nf").over(all_w).cast("double") * 100.0
    rate = F.col("_fraud").cast("double") / F.col("_nf").cast("double")
    return (g.select(
        "cohort_id", X.cohort_label(F.col("cohort_id")).alias("cohort_label"), "approx_accounts",
        F.col("_n").alias("total_txns"), F.col("_fraud").alias("fraud_txns"),
        r(rate * 100.0, 2).alias("fraud_rate_pct"),
        r(X.ratio(F.col("_vol"), F.col("_na")), 2).alias("avg_txn_amount"),
        F.col("_vol").cast("double").alias("total_volume_aud"),
        F.col("_fvol").cast("double").alias("fraud_volume_aud"),
        r(F.col("_hrc").cast("double") / F.col("_nhrc").cast("double") * 100.0, 1).alias("high_risk_country_pct"),
        r(F.col("_t2").cast("double") / F.col("_rows").cast("double") * 100.0, 1).alias("high_risk_merchant_pct"),
        r(F.col("_v").cast("double") / F.col("_nv").cast("double"), 2).alias("avg_velocity_1h"),
        r(X.ratio(rate * 100.0, overall), 2).alias("fraud_rate_uplift"))
        .orderBy("cohort_id").drop("cohort_id"))
