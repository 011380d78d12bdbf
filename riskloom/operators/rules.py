"""Monitoring rules specified in the reference's policy documents.

One row per transaction with every rule flag.  All account windows come from
two passes of the skew-safe ``trailing_stats`` (one for the raw windows, one
for the repeat-flagging count that depends on the flags); the merchant rule is
a merchant aggregate joined back (one row per merchant).
Rules needing data the tables do not carry (cash/wire type, balances, country
history, devices) are left out (SURVEY M7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators.timewindow import sequence, trailing_stats

HOUR = 3600
DAY = 86400

# Thresholds as written in the policy documents.
STRUCTURING_LO, STRUCTURING_HI, STRUCTURING_COUNT, STRUCTURING_WINDOW = 8000.0, 9999.0, 3, 48 * HOUR   # TM-003
UNUSUAL_MULT, UNUSUAL_WINDOW = 5.0, 90 * DAY                                                          # TM-004
FREQ_HOUR_COUNT, FREQ_DAY_COUNT = 4, 15                                                               # TM-010/011
AFTER_HOURS_AMOUNT, OVERNIGHT_WEIGHT = 2000.0, 0.1                                                    # TM-020/021
MULTI_FACTOR_RULES = 3                                                                                # TM-050
REPEAT_FLAGS, REPEAT_WINDOW = 2, 30 * DAY                                                             # TM-051
POLICY_LARGE = 10000.0                                                                                # bank policy
POLICY_NEAR_LO, POLICY_NEAR_HI, POLICY_NEAR_COUNT, POLICY_NEAR_WINDOW = 9000.0, 10000.0, 2, DAY
POLICY_RATIO, POLICY_PER_HOUR = 5.0, 5
TYPOLOGY_HOUR, TYPOLOGY_DAY = 3, 15                                                                   # fraud typologies
NEW_ACCOUNT_DAYS, NEW_ACCOUNT_DAILY_TXNS = 30, 5
SANCTIONS_AMOUNT = 1000.0                                                                             # sanctions

TM_RULES = ["tm003_structuring", "tm004_unusual_amount", "tm010_high_freq_hour", "tm011_high_freq_day",
            "tm020_overnight", "tm021_after_hours_high_value", "tm030_high_risk_country"]


def overnight(hour: str = "hour") -> F.Column:
    """TM-020 window 23:00-05:00 (to 04:59), narrower than the model's night flag (to 05:59)."""
    h = F.col(hour)
    return (h >= 23) | (h < 5)


def rule_flags(t: DataFrame, m: DataFrame, grain_seconds: int = HOUR) -> DataFrame:
    c = F.col
    x = (t.withColumn("_band8", X.flag(c("amount").between(STRUCTURING_LO, STRUCTURING_HI)))
          .withColumn("_band9", X.flag((c("amount") >= POLICY_NEAR_LO) & (c("amount") < POLICY_NEAR_HI)))
          .withColumn("_amt", X.money("amount")))
    x = trailing_stats(x, "account_id", "txn_timestamp", ["_band8", "_band9", "_amt"],
                       {"_w48": STRUCTURING_WINDOW, "_w24": POLICY_NEAR_WINDOW, "_w90": UNUSUAL_WINDOW},
                       grain_seconds=grain_seconds,
                       only={"_w48": ["_band8"], "_w24": ["_band9"], "_w90": ["_amt"]})
    avg90 = F.try_divide(c("_w90_s___amt").cast("double"), c("_w90_c___amt").cast("double"))
    x = (x.withColumn("tm003_structuring", X.flag((c("_band8") == 1) & (c("_w48_s___band8") >= STRUCTURING_COUNT)))
          .withColumn("tm004_unusual_amount", X.flag(c("amount") > F.lit(UNUSUAL_MULT) * avg90))
          .withColumn("tm010_high_freq_hour", X.flag(c("velocity_1h") >= FREQ_HOUR_COUNT))
          .withColumn("tm011_high_freq_day", X.flag(c("velocity_24h") >= FREQ_DAY_COUNT))
          .withColumn("tm020_overnight", X.flag(overnight()))
          .withColumn("tm021_after_hours_high_value", X.flag(overnight() & (c("amount") > AFTER_HOURS_AMOUNT)))
          .withColumn("tm030_high_risk_country", X.flag(c("high_risk_country") == 1))
          .withColumn("p_large_single", X.flag(c("amount") > POLICY_LARGE))
          .withColumn("p_near_threshold_24h", X.flag((c("_band9") == 1) & (c("_w24_s___band9") >= POLICY_NEAR_COUNT)))
          .withColumn("p_ratio_30d", X.flag(c("amount_vs_avg_ratio") > POLICY_RATIO))
          .withColumn("p_per_hour", X.flag(c("velocity_1h") > POLICY_PER_HOUR))
          .withColumn("f_velocity_hour", X.flag(c("velocity_1h") > TYPOLOGY_HOUR))
          .withColumn("f_velocity_day", X.flag(c("velocity_24h") > TYPOLOGY_DAY))
          .withColumn("f_unusual_hour", X.flag(overnight()))
          .withColumn("f_new_account_volume", X.flag((c("days_since_account_open") <= NEW_ACCOUNT_DAYS)
                                                     & (c("velocity_24h") >= NEW_ACCOUNT_DAILY_TXNS)))
          .withColumn("s_sanctions_review", X.flag((c("amount") > SANCTIONS_AMOUNT) & (c("high_risk_country") == 1))))
    n = sum(c(r) for r in TM_RULES)
    velocity = (c("tm010_high_freq_hour") == 1) | (c("tm011_high_freq_day") == 1)
    x = x.withColumn("rules_triggered", n.cast("int"))
    x = x.withColumn("rule_tier", F.when(c("rules_triggered") >= MULTI_FACTOR_RULES, "CRITICAL")
                     .when(((c("tm030_high_risk_country") == 1) | (c("tm004_unusual_amount") == 1)) & velocity, "HIGH")
                     .when(c("rules_triggered") >= 1, "MEDIUM").otherwise("LOW"))
    x = x.withColumn("risk_weight", F.when(c("tm020_overnight") == 1, F.lit(OVERNIGHT_WEIGHT)).otherwise(0.0))
    # TM-051: flagged (any rule) more than twice in the trailing 30 days
    x = x.withColumn("_flagged", X.flag(c("rules_triggered") >= 1))
    x = trailing_stats(x, "account_id", "txn_timestamp", "_flagged", {"_w30": REPEAT_WINDOW},
                       grain_seconds=grain_seconds)
    x = x.withColumn("tm051_repeat_flagging", X.flag(c("_w30_s") > REPEAT_FLAGS))
    # merchant hop: different merchant within 10 minutes of the previous transaction
    x = sequence(x, "account_id", "txn_timestamp", "transaction_id", ["txn_timestamp", "merchant_id"],
                 row_number=None)
    gap = F.expr("timestampdiff(MICROSECOND, prev_txn_timestamp, txn_timestamp)")
    x = x.withColumn("f_merchant_hop", X.flag((gap < 600_000_000) & (c("merchant_id") != c("prev_merchant_id"))))
    # merchant average above its category average (merchant aggregate, one row per merchant)
    ma = t.groupBy("merchant_id").agg(F.sum(X.money("amount")).alias("_ms"), F.count("amount").alias("_mc"))
    ma = ma.join(m.select("merchant_id", "merchant_category"), "merchant_id")
    cw = Window.partitionBy("merchant_category")      # categories x merchants: a dimension-sized table
    ma = ma.select("merchant_id", X.flag(
        F.try_divide(c("_ms").cast("double"), c("_mc").cast("double"))
        > F.try_divide(F.sum("_ms").over(cw).cast("double"), F.sum("_mc").over(cw).cast("double")))
        .alias("f_merchant_above_category"))
    x = x.join(ma, "merchant_id", "left")
    keep = ["transaction_id", "account_id", "txn_timestamp", "amount"] + TM_RULES + [
        "tm051_repeat_flagging", "rules_triggered", "rule_tier", "risk_weight", "p_large_single",
        "p_near_threshold_24h", "p_ratio_30d", "p_per_hour", "f_velocity_hour", "f_velocity_day",
        "f_merchant_hop", "f_unusual_hour", "f_new_account_volume", "f_merchant_above_category",
        "s_sanctions_review"]
    return x.select(*keep).withColumn("f_merchant_above_category",
                                      F.coalesce("f_merchant_above_category", F.lit(0)))


def escalate_tier(tier: F.Column, country: F.Column, velocity: F.Column) -> F.Column:
    """TM-030 on a model tier: at least MEDIUM with a high-risk country, HIGH if also velocity."""
    order = F.create_map(*[x for i, t in enumerate(["LOW", "MEDIUM", "HIGH", "CRITICAL"])
                           for x in (F.lit(t), F.lit(i))])
    names = F.array(*[F.lit(t) for t in ["LOW", "MEDIUM", "HIGH", "CRITICAL"]])
    floor = F.when(country & velocity, 2).when(country, 1).otherwise(0)
    return F.element_at(names, F.greatest(order[tier], floor) + 1)


def rule_summary(flags: DataFrame) -> DataFrame:
    """How often each rule fires, one row per rule (stack over one aggregate)."""
    rules = [c for c in flags.columns if c[:2] in ("tm", "p_", "f_", "s_")]
    agg = flags.agg(*[F.sum(c).cast("long").alias(c) for c in rules])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hits"))
                                          for r in rules])).alias("s")).select("s.*")
