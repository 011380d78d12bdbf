"""Model monitoring specified in the model card.

Periods are defined by a date split of the scored table (baseline = earlier,
current = later).  PSI uses baseline quantile edges (K2) and two histograms;
KS / AUC-PR drops reuse the evaluation metrics per period; volume and
false-positive checks are windows over the daily aggregate (one row per day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators import evaluate
from riskloom.operators.eda import _long, quantile_edges_exact

# Alert thresholds from the model card.
PSI_INPUT_ALERT, PSI_SCORE_ALERT = 0.25, 0.20
KS_DROP, AUC_PR_DROP = 0.10, 0.05
VOLUME_BAND, VOLUME_WINDOW_DAYS = 0.30, 30
FP_SHARE_ALERT, FP_WINDOW_DAYS = 0.80, 14
RANK_SHIFT = 3
PSI_EPS = 1e-6


def psi(df: DataFrame, cols: list[str], period: str = "period", n_bins: int = 10) -> DataFrame:
    """M8: population stability index per column between ``baseline`` and ``current``, all
    columns in one pass: melt, exact baseline quantile edges per feature (one row per feature,
    broadcast), bin (values below the first edge go to bin 0, above the last to the last bin),
    count per (feature, bin, period), sum the PSI terms."""
    lg = _long(df.select(period, *cols), cols)
    lg = lg.where(F.col("value").isNotNull())
    edges = quantile_edges_exact(lg.where(F.col(period) == "baseline"), "value", n_bins, by=["feature"])
    x = F.col("value")
    inner = F.size(F.filter(F.slice(F.col("edges"), F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))), lambda v: v < x))
    b = F.when(x < F.element_at("edges", 1), 0).otherwise(F.least(inner, F.size("edges") - 2))
    h = (lg.join(F.broadcast(edges), "feature")
           .groupBy("feature", b.alias("bin"))
           .agg(F.sum(X.flag(F.col(period) == "baseline")).alias("nb"),
                F.sum(X.flag(F.col(period) == "current")).alias("nc")))
    w = Window.partitionBy("feature")          # <= n_bins rows per feature
    p = F.col("nb") / F.sum("nb").over(w) + PSI_EPS
    q = F.col("nc") / F.sum("nc").over(w) + PSI_EPS
    return (h.select("feature", ((q - p) * F.log(q / p)).alias("term"))
             .groupBy("feature").agg(F.round(F.sum("term"), 6).alias("psi")))


def psi_alerts(psi_table: DataFrame, score_col: str) -> DataFrame:
    thr = F.when(F.col("feature") == score_col, PSI_SCORE_ALERT).otherwise(PSI_INPUT_ALERT)
    return psi_table.withColumn("threshold", thr).withColumn("alert", F.col("psi") > thr)


def performance_drift(df: DataFrame, label: str, score: str, period: str = "period") -> DataFrame:
    """M9: KS and AUC-PR per period and the relative drops against the thresholds."""
    b = evaluate.summary(df.where(F.col(period) == "baseline"), label, score)
    c = evaluate.summary(df.where(F.col(period) == "current"), label, score)
    j = b.select(F.col("ks").alias("ks_base"), F.col("auc_pr").alias("ap_base")).crossJoin(
        c.select(F.col("ks").alias("ks_cur"), F.col("auc_pr").alias("ap_cur")))
    ks_drop = X.ratio(F.col("ks_base") - F.col("ks_cur"), F.col("ks_base"))
    ap_drop = X.ratio(F.col("ap_base") - F.col("ap_cur"), F.col("ap_base"))
    return j.select("ks_base", "ks_cur", F.round(ks_drop, 6).alias("ks_drop"), (ks_drop > KS_DROP).alias("ks_alert"),
                    "ap_base", "ap_cur", F.round(ap_drop, 6).alias("auc_pr_drop"),
                    (ap_drop > AUC_PR_DROP).alias("auc_pr_alert"))


def volume_and_fp(scored: DataFrame, tier: str = "risk_tier", label: str = "is_fraud",
                  date: str = "txn_date") -> DataFrame:
    """Daily HIGH+CRITICAL volume vs its trailing 30-day average (+-30 %),
    14-day false-positive share of flagged rows (> 80 %), and two consecutive breaches."""
    flagged = F.col(tier).isin(*X.FLAGGED_TIERS)
    d = scored.groupBy(date).agg(F.sum(X.flag(flagged)).alias("flagged"),
                                 F.sum(X.flag(flagged & (F.col(label) == 0))).alias("false_pos"))
    w30 = Window.orderBy(date).rowsBetween(-VOLUME_WINDOW_DAYS, -1)          # daily rows
    w14 = Window.orderBy(date).rowsBetween(-(FP_WINDOW_DAYS - 1), 0)
    avg30 = F.avg("flagged").over(w30)
    dev = X.ratio(F.col("flagged") - avg30, avg30)
    fp = X.ratio(F.sum("false_pos").over(w14), F.sum("flagged").over(w14))
    out = d.select(date, "flagged", F.round(avg30, 6).alias("flagged_avg_30d"), F.round(dev, 6).alias("deviation"),
                   F.coalesce(F.abs(dev) > VOLUME_BAND, F.lit(False)).alias("volume_alert"),
                   F.round(fp, 6).alias("fp_share_14d"), F.coalesce(fp > FP_SHARE_ALERT, F.lit(False)).alias("fp_alert"))
    breach = F.col("volume_alert") | F.col("fp_alert")
    prev = F.lag(breach).over(Window.orderBy(date))
    return out.withColumn("retrain", breach & F.coalesce(prev, F.lit(False)))


def attribution_rank_shift(imp_base: DataFrame, imp_cur: DataFrame) -> DataFrame:
    """Per feature rank in each period; alert when the rank moves by >= 3."""
    j = imp_base.select("feature", F.col("rank").alias("rank_base")).join(
        imp_cur.select("feature", F.col("rank").alias("rank_cur")), "feature", "full")
    shift = F.abs(F.col("rank_base") - F.col("rank_cur"))
    return j.select("feature", "rank_base", "rank_cur", shift.alias("shift"), (shift >= RANK_SHIFT).alias("alert"))


def split_periods(df: DataFrame, date: str = "txn_date", cut: str | None = None) -> DataFrame:
    """``period`` = baseline before ``cut`` (default: the middle date), current from it."""
    if cut is None:
        mid = df.agg(F.date_add(F.min(date), F.floor(F.datediff(F.max(date), F.min(date)) / 2).cast("int"))
                     .alias("_cut"))
        j = df.crossJoin(F.broadcast(mid))
        return j.withColumn("period", F.when(F.col(date) < F.col("_cut"), "baseline").otherwise("current")).drop("_cut")
    return df.withColumn("period", F.when(F.col(date) < F.lit(cut).cast("date"), "baseline").otherwise("current"))
