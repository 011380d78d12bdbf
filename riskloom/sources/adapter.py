"""Relational model of the risk jobs built from the shared test tables.

``transactions`` comes from ``events`` (one row per event), ``accounts`` from
``customer`` and ``merchants`` from ``supplier``/``nation``.  The derived
columns (velocities, 30-day amount ratio, account age, weekend flag) are
computed here with exact, skew-safe trailing windows
(:func:`riskloom.operators.timewindow.trailing_stats`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.timewindow import trailing_stats
from riskloom.session import table_path

HOUR = 3600
DAY = 86400
# Bucket grain of the per-account windows: divides 1 h / 24 h / 30 d; a hot account is split
# into 5-minute partitions and the per-key bucket window spans at most 30 d / 5 min = 8,640 rows.
WINDOW_GRAIN = 300

# Fixed values of the stand-in mapping (FIXTURES.md 2.1).
HIGH_RISK_REGION = 4
TIER_2_BELOW = 1000.0      # s_acctbal < 1000  -> merchant tier 2
TIER_1_BELOW = 4000.0      # s_acctbal < 4000  -> merchant tier 1
ACCOUNT_AGE_MULT = 37
ACCOUNT_AGE_MOD = 900
EPOCH_DATE = "2024-01-01"
AMOUNT_SCALE = 40.0

TRANSACTION_COLUMNS = [
    "transaction_id", "account_id", "merchant_id", "txn_timestamp", "txn_date", "amount", "hour",
    "merchant_risk_tier", "velocity_1h", "velocity_24h", "high_risk_country", "amount_vs_avg_ratio",
    "days_since_account_open", "is_weekend", "is_fraud",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def tier_of_balance(balance: F.Column) -> F.Column:
    return (F.when(balance < TIER_2_BELOW, 2).when(balance < TIER_1_BELOW, 1).otherwise(0)).cast("int")


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")      # nation: 25 rows by definition
             .select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name"),
                     F.col("n_name").alias("merchant_category"),
                     tier_of_balance(F.col("s_acctbal")).alias("risk_tier")))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    age = (F.col("c_custkey") * ACCOUNT_AGE_MULT) % ACCOUNT_AGE_MOD
    return c.select(F.col("c_custkey").alias("account_id"),
                    F.date_sub(F.lit(EPOCH_DATE).cast("date"), age.cast("int")).alias("account_open_date"),
                    F.col("c_mktsegment").alias("account_type"),
                    F.col("c_acctbal").alias("credit_limit"))


#: The part of a transaction that its event alone gives.
EVENT_COLUMNS = ["transaction_id", "account_id", "merchant_id", "txn_timestamp", "txn_date", "amount", "hour", "is_fraud"]


def from_events(e: DataFrame, suppliers: DataFrame) -> DataFrame:
    """EVENT_COLUMNS of every event; merchant = k mod (number of suppliers, a 1-row aggregate)."""
    n_sup = suppliers.agg(F.count(F.lit(1)).alias("_n_sup"))
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    return (e.crossJoin(F.broadcast(n_sup))
             .select(
                 F.format_string("TXN-%07d", F.col("event_id")).alias("transaction_id"),
                 F.col("user_id").alias("account_id"),
                 F.pmod(k, F.col("_n_sup")).alias("merchant_id"),
                 F.col("ts").alias("txn_timestamp"),
                 F.to_date(F.col("ts")).alias("txn_date"),
                 F.round(F.col("value") * F.lit(AMOUNT_SCALE), 2).alias("amount"),
                 F.hour(F.col("ts")).alias("hour"),
                 (F.col("event_type") == "error").cast("int").alias("is_fraud")))


def with_features(t: DataFrame, sf_dir: str, grain_seconds: int = WINDOW_GRAIN, keep: tuple[str, ...] = (),
                  rows: int | None = None, between: DataFrame | None = None, until: int | None = None) -> DataFrame:
    """The 15 transaction columns (and ``keep``) of rows with EVENT_COLUMNS; the trailing windows see these rows only.
    ``rows``: their number, where it is known.  ``between``: one row an account with the number ``_c`` and sum ``_s`` of
    amounts that lie in every 30 days asked for (and in no 24 h), beside the rows.  ``until``: the latest time in the
    rows in microseconds, where it is known."""
    spark = t.sparkSession
    sup = read(spark, sf_dir, "supplier")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    tiers = sup.select(F.col("s_suppkey").alias("_mid"), tier_of_balance(F.col("s_acctbal")).alias("merchant_risk_tier"))
    country = (cust.join(F.broadcast(nat), cust.c_nationkey == nat.n_nationkey, "left")   # 25-row nation
                   .select(F.col("c_custkey").alias("_aid"),
                           (F.col("n_regionkey") == HIGH_RISK_REGION).cast("int").alias("high_risk_country")))
    t = t.withColumn("_amt_dec", F.col("amount").cast(T.DecimalType(18, 2)))
    t = trailing_stats(t, "account_id", "txn_timestamp", "_amt_dec",
                       {"_v1h": HOUR, "_v24h": DAY, "_a30d": 30 * DAY}, grain_seconds=grain_seconds, rows=rows, until=until)
    if between is not None:
        t = (t.join(between.withColumnRenamed("account_id", "_bid"), t.account_id.eqNullSafe(F.col("_bid")), "left")
              .withColumns({"_a30d_s": F.col("_a30d_s") + F.coalesce("_s", F.lit(0)),
                            "_a30d_c": F.col("_a30d_c") + F.coalesce("_c", F.lit(0))}))
    avg30 = F.try_divide(F.col("_a30d_s").cast("double"), F.col("_a30d_c").cast("double"))
    t = (t.withColumn("velocity_1h", F.col("_v1h_n"))
          .withColumn("velocity_24h", F.col("_v24h_n"))
          .withColumn("amount_vs_avg_ratio", F.try_divide(F.col("amount"), F.nullif(avg30, F.lit(0.0))))
          .withColumn("days_since_account_open",
                      ((F.col("account_id") * ACCOUNT_AGE_MULT) % ACCOUNT_AGE_MOD
                       + F.datediff(F.col("txn_date"), F.lit(EPOCH_DATE).cast("date"))).cast("int"))
          .withColumn("is_weekend", (F.weekday(F.col("txn_timestamp")) >= 5).cast("int")))
    t = t.join(tiers, t.merchant_id == tiers._mid, "left").join(country, t.account_id == country._aid, "left")
    return t.select(*TRANSACTION_COLUMNS, *keep)


def transactions(spark: SparkSession, sf_dir: str, grain_seconds: int = WINDOW_GRAIN) -> DataFrame:
    """The 15-column transaction table (FIXTURES.md 2.1)."""
    events = read(spark, sf_dir, "events")
    return with_features(from_events(events, read(spark, sf_dir, "supplier")), sf_dir, grain_seconds, rows=events.count())


def transactions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction table, built once per application and read back from the
    shared checkpoint folder (see :mod:`riskloom.sources.store`)."""
    from riskloom.sources.store import materialized
    return materialized(spark, "transactions", sf_dir, lambda: transactions(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"transactions": transactions_table(spark, sf_dir), "accounts": accounts(spark, sf_dir),
            "merchants": merchants(spark, sf_dir)}
