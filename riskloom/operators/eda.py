"""Exploratory and monitoring aggregates over a transaction table.

All are grouped aggregates: partial aggregation before the shuffle, at most a
few hundred output rows.  Quantiles are exact through the distributed
cumulative-count operator (no group is gathered into one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators.features import risk_flag_count
from riskloom.operators.ranking import exact_quantiles

# The column lists the reference's analysis uses.
SUMMARY_COLUMNS = ["amount", "hour", "velocity_1h", "velocity_24h", "amount_vs_avg_ratio", "days_since_account_open"]
CATEGORICAL_COLUMNS = ["merchant_risk_tier", "high_risk_country", "is_weekend"]
BINNED_COLUMNS = {"amount": 10, "amount_vs_avg_ratio": 8, "velocity_1h": 8, "days_since_account_open": 8}
CORR_COLUMNS = ["amount", "hour", "merchant_risk_tier", "velocity_1h", "velocity_24h", "high_risk_country",
                "amount_vs_avg_ratio", "days_since_account_open", "is_weekend", "is_fraud"]
AMOUNT_PERCENTILES = [25, 50, 75, 90, 95, 99]

ROUND = 6   # order-dependent double aggregates are reported at 6 dp


def _long(df: DataFrame, cols: list[str], key: str = "feature", val: str = "value") -> DataFrame:
    """Melt ``cols`` to ``(key, val)`` rows with ``stack``; other columns are kept."""
    keep = [c for c in df.columns if c not in cols]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*[f"`{c}`" for c in keep], f"stack({len(cols)}, {pairs}) AS ({key}, {val})")


def class_summary(t: DataFrame, cols: list[str] = SUMMARY_COLUMNS, label: str = "is_fraud") -> DataFrame:
    """Mean, median (exact) and sample std per feature and class, with fraud/legit ratio."""
    lg = _long(t.select(label, *cols), cols)
    stats = lg.groupBy("feature", label).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    med = exact_quantiles(lg, "value", {"median": 0.5}, by=["feature", label])
    s = stats.join(med, ["feature", label])
    s = _long(s, ["mean", "median", "std"], key="statistic", val="v")
    p = s.groupBy("feature", "statistic").agg(
        F.max(F.when(F.col(label) == 0, F.col("v"))).alias("legitimate"),
        F.max(F.when(F.col(label) == 1, F.col("v"))).alias("fraud"))
    return p.select("feature", "statistic", F.round("legitimate", ROUND).alias("legitimate"),
                    F.round("fraud", ROUND).alias("fraud"),
                    F.round(X.ratio(F.col("fraud"), F.col("legitimate")), 2).alias("fraud_to_legit_ratio"))


def rate_by_value(t: DataFrame, cols: list[str] = CATEGORICAL_COLUMNS, label: str = "is_fraud") -> DataFrame:
    """Fraud rate (%) and count per value, all columns in one pass."""
    lg = _long(t.select(label, *cols), cols)
    return lg.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(label) * 100.0, 4).alias("fraud_rate_pct"))


def quantile_edges_exact(df: DataFrame, value: str, n_bins: int, by: list[str] | None = None) -> DataFrame:
    """K2: per group, ``edges`` = exact linear quantiles at i/n_bins, duplicates dropped, sorted."""
    probs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    q = exact_quantiles(df, value, probs, by=by)
    return q.select(*(by or []), F.array_sort(F.array_distinct(F.array(*[F.col(k) for k in probs]))).alias("edges"))


def bin_index(x, edges_col: str = "edges", most: int | None = None):
    """K2: right-closed bin (0-based) with the lowest edge included; NULL outside the range.  With at most ``most`` edges
    the edges below ``x`` are counted by that many plain comparisons, which Spark compiles."""
    e = F.col(edges_col)
    if most is not None:
        idx = F.lit(0)
        for i in range(1, most):
            idx = idx + F.when(F.get(e, F.lit(i)) < x, 1).otherwise(0)
    else:
        idx = F.size(F.filter(F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), lambda v: v < x))
    inside = (x >= F.element_at(e, 1)) & (x <= F.element_at(e, -1))
    return F.when(inside, idx)


def rate_by_quantile_bin(t: DataFrame, bins: dict[str, int] = BINNED_COLUMNS, label: str = "is_fraud") -> DataFrame:
    """Fraud rate per quantile bin (pandas ``qcut`` semantics), all features in one pass:
    melt, exact quantiles per feature, broadcast the per-feature edges (one row each), bin, count."""
    lg = _long(t.select(label, *bins), list(bins))
    n_of = F.create_map(*[x for c, n in bins.items() for x in (F.lit(c), F.lit(n))])
    # the number of bins differs per feature: compute the union of needed probabilities once
    probs = sorted({i / n for n in bins.values() for i in range(n + 1)})
    q = exact_quantiles(lg, "value", {f"p{i}": p for i, p in enumerate(probs)}, by=["feature"])
    want = F.transform(F.sequence(F.lit(0), n_of[F.col("feature")]),
                       lambda i: i.cast("double") / n_of[F.col("feature")].cast("double"))
    pmap = F.map_from_arrays(F.array(*[F.lit(p) for p in probs]), F.array(*[F.col(f"p{i}") for i in range(len(probs))]))
    edges = q.select("feature", F.array_sort(F.array_distinct(F.transform(want, lambda w: pmap[w]))).alias("edges"))
    x = F.col("value")
    b = lg.join(F.broadcast(edges), "feature").select(
        "feature", bin_index(x).cast("long").alias("bin"), F.element_at("edges", bin_index(x) + 1).alias("lo"),
        F.element_at("edges", bin_index(x) + 2).alias("hi"), label)
    return b.groupBy("feature", "bin", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(label) * 100.0, 4).alias("fraud_rate_pct"))


def hourly_rates(t: DataFrame) -> DataFrame:
    """Rate and volume by hour, plus night/day rates and the night uplift on every row."""
    night = F.col("hour").isin(*X.NIGHT_HOURS)
    h = t.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("long").alias("fraud"))
    w = Window.partitionBy(F.lit(1))
    nr = F.sum(F.when(night, F.col("fraud"))).over(w) / F.sum(F.when(night, F.col("n"))).over(w) * 100.0
    dr = F.sum(F.when(~night, F.col("fraud"))).over(w) / F.sum(F.when(~night, F.col("n"))).over(w) * 100.0
    return h.select("hour", "n", F.round(F.col("fraud") / F.col("n") * 100.0, 4).alias("fraud_rate_pct"),
                    F.round(nr, 4).alias("night_rate_pct"), F.round(dr, 4).alias("day_rate_pct"),
                    F.round(X.ratio(nr, dr), 4).alias("night_uplift"))


def amount_percentiles(t: DataFrame, pcts: list[int] = AMOUNT_PERCENTILES) -> DataFrame:
    """Exact linear percentiles of amount by class."""
    q = exact_quantiles(t, "amount", {f"p{p}": p / 100 for p in pcts}, by=["is_fraud"])
    return q.select("is_fraud", *[F.round(f"p{p}", ROUND).alias(f"p{p}") for p in pcts])


def correlations(t: DataFrame, cols: list[str] = CORR_COLUMNS, label: str = "is_fraud") -> DataFrame:
    """Pearson matrix in long form from one aggregate, plus |corr| rank against the label."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = t.select(*[F.col(c).cast("double").alias(c) for c in cols]).agg(
        *[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                        F.col(f"{a}__{b}").alias("corr")) for a, b in pairs]
                             + [F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"),
                                         F.col(f"{a}__{b}").alias("corr")) for a, b in pairs if a != b]))
    long = agg.select(rows.alias("s")).select("s.*").withColumn("corr", F.round("corr", ROUND))
    lab = long.where((F.col("feature_b") == label) & (F.col("feature_a") != label))
    lab = lab.withColumn("rank_vs_label", F.row_number().over(
        Window.orderBy(F.abs("corr").desc(), F.col("feature_a"))).cast("long"))   # <= 9 rows
    return long.join(lab.select("feature_a", "feature_b", "rank_vs_label"), ["feature_a", "feature_b"], "left")


def rate_by_flag_count(t: DataFrame) -> DataFrame:
    """D17."""
    return risk_flag_count(t).groupBy("n_flags").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("is_fraud") * 100.0, 4).alias("fraud_rate_pct"))


def key_findings(t: DataFrame) -> DataFrame:
    """Conditional uplifts and the imbalance ratio in one aggregate."""
    f = risk_flag_count(t)
    c = F.col

    def rate(cond):
        return F.avg(F.when(cond, c("is_fraud")))
    a = f.agg(F.avg("is_fraud").alias("overall"), rate(c("hour").isin(*X.NIGHT_HOURS)).alias("night"),
              rate(c("high_risk_country") == 1).alias("country"), rate(c("velocity_1h") >= 4).alias("vel"),
              rate(c("amount_vs_avg_ratio") >= 5).alias("ratio5"), rate(c("days_since_account_open") <= 30)
              .alias("new_acct"), rate(c("n_flags") >= 4).alias("flags4"),
              F.sum(1 - c("is_fraud")).alias("n_legit"), F.sum("is_fraud").alias("n_fraud"))
    return a.select(
        F.round(X.ratio(c("night"), c("overall")), 4).alias("night_uplift"),
        F.round(X.ratio(c("country"), c("overall")), 4).alias("high_risk_country_uplift"),
        F.round(X.ratio(c("vel"), c("overall")), 4).alias("high_velocity_uplift"),
        F.round(c("ratio5") * 100.0, 4).alias("high_ratio_rate_pct"),
        F.round(X.ratio(c("new_acct"), c("overall")), 4).alias("new_account_uplift"),
        F.round(c("flags4") * 100.0, 4).alias("four_flag_rate_pct"),
        F.round(X.ratio(c("n_legit"), c("n_fraud")), 4).alias("imbalance_ratio"))


def tier_distribution(scored: DataFrame, tier: str = "risk_tier", label: str = "is_fraud") -> DataFrame:
    """Count and fraud per tier, tiers without rows filled with 0 (4-row literal)."""
    tiers = scored.sparkSession.createDataFrame([(t,) for t in ("LOW", "MEDIUM", "HIGH", "CRITICAL")], [tier])
    g = scored.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("fraud"))
    return tiers.join(g, tier, "left").select(tier, F.coalesce("n", F.lit(0)).alias("n"),
                                              F.coalesce("fraud", F.lit(0)).cast("long").alias("fraud"))


def scan_summary(scored: DataFrame, tier: str = "risk_tier", score: str = "risk_score") -> DataFrame:
    """Total, HIGH+CRITICAL, MEDIUM and mean score."""
    return scored.agg(F.count(F.lit(1)).alias("total"),
                      F.sum(X.flag(F.col(tier).isin(*X.FLAGGED_TIERS))).cast("long").alias("flagged"),
                      F.sum(X.flag(F.col(tier) == "MEDIUM")).cast("long").alias("medium"),
                      F.round(F.avg(score), ROUND).alias("mean_score"))


def histogram(df: DataFrame, col: str | F.Column, n_bins: int, by: list[str] | None = None,
              range_per_group: bool = False) -> DataFrame:
    """Fixed-width histogram over [min, max] (numpy semantics: last bin closed).  With
    ``range_per_group`` each group of ``by`` uses its own min/max (one row per group, joined)."""
    by = by or []
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    base = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    if range_per_group and by:
        rng = base.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        j = base.join(rng, by)
    else:
        rng = base.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        j = base.crossJoin(F.broadcast(rng))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(n_bins - 1))).cast("int")
    return j.groupBy(*by, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / n_bins).alias("bin_start"), "n")


def class_histogram(df: DataFrame, score: str, label: str, n_bins: int = 39) -> DataFrame:
    """Score histogram of each class over the bins that both share, with densities (a class integrates to 1;
    null where all scores are equal).  Rows: classes times bins; empty bins give none, null labels are left out."""
    rows = df.where(F.col(label).isNotNull())
    ends = rows.agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    h = histogram(rows, score, n_bins, by=[label])
    total = F.sum("n").over(Window.partitionBy(label))                                # at most n_bins rows a class
    return (h.crossJoin(F.broadcast(ends)).select(
        label, F.col("bin").cast("long").alias("bin"), F.round("bin_start", 6).alias("bin_start"), "n",
        F.round(X.ratio(F.col("n"), total * (F.col("_hi") - F.col("_lo")) / n_bins), 6).alias("density")))


def category_rollup(t: DataFrame, m: DataFrame, top: int = 12) -> DataFrame:
    """Merchant category roll-up, top ``top`` by fraud rate."""
    g = (t.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("f"))
          .join(m.select("merchant_id", "merchant_category"), "merchant_id")
          .groupBy("merchant_category").agg(F.sum("n").alias("total_txns"), F.sum("f").cast("long").alias("fraud_txns")))
    g = g.withColumn("fraud_rate_pct", F.round(X.pct(F.col("fraud_txns"), F.col("total_txns")), 4))
    return g.orderBy(F.col("fraud_rate_pct").desc(), F.col("merchant_category")).limit(top)


def burst_vs_fraud(bursts: DataFrame) -> DataFrame:
    """Fraud rate by burst flag over all gaps under the threshold."""
    return bursts.groupBy("multi_merchant_burst_flag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("is_fraud") * 100.0, 4).alias("fraud_rate_pct"))


def score_bands(scored: DataFrame, tier: str, score: str, label: str = "is_fraud") -> DataFrame:
    """Per tier count, % of population, fraud, rate, % of fraud captured, min/max/avg score."""
    g = scored.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("fraud"),
                                 F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                                 F.round(F.avg(score), 4).alias("avg_score"))
    w = Window.partitionBy(F.lit(1))     # <= 4 rows
    return g.select(tier, "n", F.round(X.pct(F.col("n"), F.sum("n").over(w)), 4).alias("pct_population"),
                    "fraud", F.round(X.pct(F.col("fraud"), F.col("n")), 4).alias("fraud_rate_pct"),
                    F.round(X.pct(F.col("fraud"), F.sum("fraud").over(w)), 4).alias("pct_fraud_captured"),
                    "min_score", "max_score", "avg_score")


def daily_peaks(rolling: DataFrame) -> DataFrame:
    """Peak day and its rate, last cumulative count, mean of daily rates (on R02 output)."""
    return rolling.agg(F.max_by("txn_date", F.struct("daily_fraud_rate_pct", "txn_date")).alias("peak_date"),
                       F.max("daily_fraud_rate_pct").alias("peak_rate_pct"),
                       F.max("cumulative_fraud_count").alias("total_fraud"),
                       F.round(F.avg("daily_fraud_rate_pct"), 4).alias("mean_daily_rate_pct"))


def queue_by_sla(queue: DataFrame) -> DataFrame:
    """Alerts, confirmed fraud and fraud rate per review band of the alert queue,
    all four bands present (zero-filled)."""
    spark = queue.sparkSession
    bands = spark.createDataFrame([(v,) for v in X.REVIEW_SLA_LABELS.values()], ["review_sla"])
    g = queue.groupBy("review_sla").agg(F.count(F.lit(1)).alias("alerts"),
                                        F.sum("confirmed_fraud").cast("long").alias("fraud_confirmed"))
    j = bands.join(g, "review_sla", "left")
    return j.select("review_sla", F.coalesce("alerts", F.lit(0)).cast("long").alias("alerts"),
                    F.coalesce("fraud_confirmed", F.lit(0)).cast("long").alias("fraud_confirmed"),
                    F.round(F.coalesce(X.ratio(F.col("fraud_confirmed"), F.col("alerts")), F.lit(0.0)), 6)
                    .alias("fraud_rate"))


def points_range(points: DataFrame) -> DataFrame:
    """Min / max / range of points per scorecard feature (offset row excluded)."""
    d = points.where(F.col("feature") != "__OFFSET__")
    return d.groupBy("feature").agg(F.min("points").alias("min_pts"), F.max("points").alias("max_pts")) \
            .withColumn("range", F.col("max_pts") - F.col("min_pts"))


def class_sample(df: DataFrame, key: str, label: str = "is_fraud", n_negative: int = 500, seed: int = 42) -> DataFrame:
    """every positive row plus ``n_negative`` negatives chosen by a seeded hash order
    (a per-partition top-n merged by Spark; portable: md5 prefix, tie-broken by key)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    neg = df.where(F.col(label) == 0).withColumn("_h", h).orderBy("_h", key).limit(n_negative).drop("_h")
    return df.where(F.col(label) == 1).unionByName(neg)


def spearman(a: DataFrame, b: DataFrame, key: str = "feature", va: str = "a", vb: str = "b") -> DataFrame:
    """Spearman correlation of two importance vectors (average ranks for ties)."""
    j = a.select(key, F.col(va).alias("_a")).join(b.select(key, F.col(vb).alias("_b")), key)

    def avg_rank(c):
        w = Window.orderBy(F.col(c).desc())           # one row per feature: a handful of rows
        n_eq = F.count(F.lit(1)).over(Window.partitionBy(c))
        return F.rank().over(w) + (n_eq - 1) / 2.0
    r = j.select(key, avg_rank("_a").alias("ra"), avg_rank("_b").alias("rb"))
    return r.agg(F.round(F.corr("ra", "rb"), 6).alias("spearman_rho"), F.count(F.lit(1)).alias("n_features"))
