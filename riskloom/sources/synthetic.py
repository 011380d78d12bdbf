"""Seeded synthetic transactions and dimensions (A3-A6), generated on the executors.

Every random draw is a function of ``(row id, seed, stream)`` through xxhash64,
so the result does not depend on partitioning or on the number of executors.
The class sizes are exact (``int(n * fraud_rate)`` frauds), and the sequential
``TXN-%07d`` ids are a fixed permutation of the row ids (an affine map modulo
``n``), so no global sort is needed to "shuffle".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class-conditional parameters of the generator.
LEGIT = {"amount": (3.5, 1.2), "tier_p": (0.7, 0.25, 0.05), "v1h": 1.5, "v24h": 8.0, "country_p": 0.03,
         "ratio": (0.0, 0.4), "age": (30, 2000), "weekend_p": 0.29}
FRAUD = {"amount": (5.5, 1.5), "tier_p": (0.2, 0.4, 0.4), "v1h": 5.0, "v24h": 18.0, "country_p": 0.4,
         "ratio": (1.5, 0.8), "age": (1, 180), "weekend_p": 0.5}
LEGIT_HOUR_WEIGHTS = [0.5, 0.3, 0.2, 0.2, 0.2, 0.4, 0.8, 1.5, 2.5, 4.0, 5.5, 6.0,
                      6.5, 6.0, 5.5, 5.0, 5.5, 6.0, 6.5, 6.0, 5.0, 4.0, 3.0, 1.5]
FRAUD_HOUR_WEIGHTS = [4.0, 5.0, 5.5, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0, 1.0, 1.0, 1.0,
                      1.0, 1.0, 1.0, 1.0, 1.0, 1.5, 2.0, 2.0, 2.0, 2.5, 3.0, 4.0]
ACCOUNT_TYPES = ["personal", "personal", "personal", "business", "joint"]
CREDIT_LIMITS = [2000.0, 5000.0, 10000.0, 20000.0, 50000.0]
ACCOUNT_BASE_DATE = "2020-01-01"
TXN_BASE_DATE = "2025-10-01"


def uniform(key: Column, seed: int, stream: int) -> Column:
    """U(0,1) from a hash of (key, seed, stream); 53 random bits."""
    h = F.xxhash64(key, F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2 ** 53))


def normal(key: Column, seed: int, stream: int) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u1, u2 = uniform(key, seed, stream), uniform(key, seed, stream + 1000)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def categorical(u: Column, probs) -> Column:
    """Index drawn with probabilities ``probs`` by inverse CDF."""
    total = float(sum(probs))
    acc, expr = 0.0, None
    for i, p in enumerate(probs[:-1]):
        acc += p / total
        expr = F.when(u < acc, i) if expr is None else expr.when(u < acc, i)
    last = len(probs) - 1
    return (expr.otherwise(last) if expr is not None else F.lit(last)).cast("int")


def poisson(u: Column, lam: float) -> Column:
    """Poisson(lam) by inverse CDF over a bounded support (tail mass below 1e-12)."""
    kmax = int(lam + 12 * math.sqrt(lam) + 12)
    pm = [math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(kmax + 1)]
    return categorical(u, pm)


def generate_transactions(spark: SparkSession, n: int = 10_000, fraud_rate: float = 0.02, seed: int = 42) -> DataFrame:
    """A3: ``n`` transactions, ``int(n * fraud_rate)`` of them fraud, reference feature distributions."""
    n_fraud = int(n * fraud_rate)
    mult = 1_000_003
    while math.gcd(mult, n) != 1:
        mult += 2
    base = spark.range(n).withColumn("is_fraud", (F.col("id") < n_fraud).cast("int"))
    k = F.col("id")
    fraud = F.col("is_fraud") == 1

    def pick(f, lg):
        return F.when(fraud, f).otherwise(lg)

    def lognormal(stream, params_f, params_l):
        z = normal(k, seed, stream)
        return F.exp(pick(F.lit(params_f[0]) + F.lit(params_f[1]) * z, F.lit(params_l[0]) + F.lit(params_l[1]) * z))

    def ints(stream, lo_hi_f, lo_hi_l):
        u = uniform(k, seed, stream)
        lo = pick(F.lit(lo_hi_f[0]), F.lit(lo_hi_l[0]))
        hi = pick(F.lit(lo_hi_f[1]), F.lit(lo_hi_l[1]))
        return (lo + F.floor(u * (hi - lo))).cast("int")

    out = base.select(
        F.format_string("TXN-%07d", F.pmod(k * F.lit(mult) + F.lit(seed), F.lit(n))).alias("transaction_id"),
        lognormal(1, FRAUD["amount"], LEGIT["amount"]).alias("amount"),
        pick(categorical(uniform(k, seed, 2), FRAUD_HOUR_WEIGHTS),
             categorical(uniform(k, seed, 2), LEGIT_HOUR_WEIGHTS)).alias("hour"),
        pick(categorical(uniform(k, seed, 3), FRAUD["tier_p"]),
             categorical(uniform(k, seed, 3), LEGIT["tier_p"])).alias("merchant_risk_tier"),
        pick(poisson(uniform(k, seed, 4), FRAUD["v1h"]), poisson(uniform(k, seed, 4), LEGIT["v1h"])).cast("long")
        .alias("velocity_1h"),
        pick(poisson(uniform(k, seed, 5), FRAUD["v24h"]), poisson(uniform(k, seed, 5), LEGIT["v24h"])).cast("long")
        .alias("velocity_24h"),
        (uniform(k, seed, 6) < pick(F.lit(FRAUD["country_p"]), F.lit(LEGIT["country_p"]))).cast("int")
        .alias("high_risk_country"),
        lognormal(7, FRAUD["ratio"], LEGIT["ratio"]).alias("amount_vs_avg_ratio"),
        ints(8, FRAUD["age"], LEGIT["age"]).alias("days_since_account_open"),
        (uniform(k, seed, 9) < pick(F.lit(FRAUD["weekend_p"]), F.lit(LEGIT["weekend_p"]))).cast("int")
        .alias("is_weekend"),
        "is_fraud")
    return out


def accounts_for(spark: SparkSession, n_accounts: int, seed: int = 42) -> DataFrame:
    """A5: one row per account ``ACC-%06d``; open date, type (3:1:1) and limit drawn per account."""
    k = F.col("id")
    types = F.array(*[F.lit(t) for t in ACCOUNT_TYPES])
    limits = F.array(*[F.lit(v) for v in CREDIT_LIMITS])
    return spark.range(n_accounts).select(
        F.format_string("ACC-%06d", k + 1).alias("account_id"),
        F.date_add(F.lit(ACCOUNT_BASE_DATE).cast("date"), F.floor(uniform(k, seed, 20) * 4 * 365).cast("int"))
        .alias("account_open_date"),
        F.element_at(types, (F.floor(uniform(k, seed, 21) * len(ACCOUNT_TYPES)) + 1).cast("int")).alias("account_type"),
        F.element_at(limits, (F.floor(uniform(k, seed, 22) * len(CREDIT_LIMITS)) + 1).cast("int")).alias("credit_limit"))


def merchants_from_catalogue(catalogue: DataFrame) -> DataFrame:
    """A4: ``(merchant_name, merchant_category, risk_tier, position)`` -> ids ``MER-%04d`` by position.
    The catalogue is a small dimension supplied by the caller."""
    return catalogue.select(F.format_string("MER-%04d", F.col("position") + 1).alias("merchant_id"),
                            "merchant_name", "merchant_category", F.col("risk_tier").cast("int").alias("risk_tier"))


def enrich(txns: DataFrame, merchants: DataFrame, seed: int = 42, days: int = 90) -> DataFrame:
    """Account (~10 transactions each), a merchant of the *same* risk tier, and a timestamp
    ``base + U[0, days) days + hour + random minute/second``.  The merchant lookup joins on
    ``(tier, index)`` against the per-tier numbering of the (small) merchant dimension."""
    from pyspark.sql import Window
    n = txns.count()
    n_acc = max(1, n // 10)
    k = F.xxhash64(F.col("transaction_id"))
    per_tier = merchants.withColumn("_i", (F.row_number().over(Window.partitionBy("risk_tier")
                                                                .orderBy("merchant_id")) - 1).cast("long"))
    counts = per_tier.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("_cnt"))
    t = (txns.withColumn("account_id", F.format_string("ACC-%06d", (F.floor(uniform(k, seed, 30) * n_acc) + 1)
                                                       .cast("long")))
             .join(F.broadcast(counts), txns.merchant_risk_tier == counts.risk_tier, "left")   # one row per tier
             .drop("risk_tier")
             .withColumn("_i", F.floor(uniform(k, seed, 31) * F.col("_cnt")).cast("long")))
    from riskloom.functions.expressions import bounded_broadcast
    t = t.join(bounded_broadcast(per_tier.select(F.col("risk_tier").alias("merchant_risk_tier"), "_i", "merchant_id")),
               ["merchant_risk_tier", "_i"], "left").drop("_i", "_cnt")
    secs = (F.floor(uniform(k, seed, 32) * days) * 86400 + F.col("hour") * 3600
            + F.floor(uniform(k, seed, 33) * 60) * 60 + F.floor(uniform(k, seed, 34) * 60)).cast("long")
    ts = F.expr(f"TIMESTAMP_NTZ'{TXN_BASE_DATE} 00:00:00'") + F.make_dt_interval(secs=secs)
    return t.withColumn("txn_timestamp", ts).withColumn("txn_date", F.to_date("txn_timestamp"))
