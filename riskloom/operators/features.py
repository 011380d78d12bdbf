"""Feature columns, scaling, splitting, validation and data-quality jobs
(B1-B3, B7, B11, B14, B15, E13, I1, I2, A9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators.ranking import exact_quantiles

# The two feature sets and the record defaults / bounds.
SYNTHETIC_FEATURES = ["amount", "hour", "merchant_risk_tier", "velocity_1h", "velocity_24h",
                      "high_risk_country", "amount_vs_avg_ratio", "days_since_account_open", "is_weekend"]
WIDE_FEATURES = [f"V{i}" for i in range(1, 29)] + ["amount"]
RECORD_DEFAULTS = {"hour": 12, "merchant_risk_tier": 0, "velocity_1h": 1, "velocity_24h": 5,
                   "high_risk_country": 0, "amount_vs_avg_ratio": 1.0, "days_since_account_open": 365,
                   "is_weekend": 0}
# column -> (lower bound inclusive, upper bound inclusive or None)
RECORD_BOUNDS = {"hour": (0, 23), "merchant_risk_tier": (0, 2), "velocity_1h": (0, None),
                 "velocity_24h": (0, None), "high_risk_country": (0, 1), "amount_vs_avg_ratio": (0, None),
                 "days_since_account_open": (0, None), "is_weekend": (0, 1)}


def feature_names(df: DataFrame) -> list[str]:
    """B1: wide schema when ``V1`` exists, else the 9 synthetic features; only present columns."""
    wanted = WIDE_FEATURES if "V1" in df.columns else SYNTHETIC_FEATURES
    return [c for c in wanted if c in df.columns]


def normalise_wide(df: DataFrame) -> DataFrame:
    """A2: ``Time, Amount, Class`` -> ``time, amount, is_fraud``; V1..V28 kept."""
    ren = {k: v for k, v in {"Time": "time", "Amount": "amount", "Class": "is_fraud"}.items() if k in df.columns}
    return df.withColumnsRenamed(ren)


def add_derived(df: DataFrame) -> DataFrame:
    """``log_amount`` and ``is_night`` when their inputs exist."""
    out = df
    if "amount" in df.columns:
        out = out.withColumn("log_amount", X.log_amount("amount"))
    if "hour" in df.columns:
        out = out.withColumn("is_night", X.is_night("hour"))
    return out


def risk_flag_count(df: DataFrame) -> DataFrame:
    """Number of co-occurring risk flags."""
    c = F.col
    n = (X.flag(c("high_risk_country") == 1) + X.flag(c("merchant_risk_tier") == 2)
         + X.flag((c("hour") >= 23) | (c("hour") <= 5)) + X.flag(c("velocity_1h") >= 4)
         + X.flag(c("amount_vs_avg_ratio") >= 3))
    return df.withColumn("n_flags", n.cast("int"))


# ---------------------------------------------------------------- I1 scaler
def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table of mean and *population* std per column (one aggregate pass).
    Zero std becomes 1, as a standard scaler does."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std")]
    return df.agg(*aggs)


def scaler_long(scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Scaler as rows ``(feature, mean, std)``."""
    return scaler.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
        for c in cols])).alias("s")).select("s.*")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str], prefix: str = "z_") -> DataFrame:
    """Append standardised columns; the 1-row scaler is broadcast."""
    j = df.crossJoin(F.broadcast(scaler))
    for c in cols:
        std = F.col(f"{c}__std")
        std = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
        j = j.withColumn(f"{prefix}{c}", (F.col(c).cast("double") - F.col(f"{c}__mean")) / std)
    return j.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


# ---------------------------------------------------------------- I2 split
#: Bits of the hash that orders rows, bits that one pass over the rows decides, and the most classes a label may have.
HASH_BITS, PASS_BITS, MAX_CLASSES = 60, 12, 64


def hash_order(key: Column, seed: int = 42) -> Column:
    """A 60-bit number drawn from ``key``: the first 15 digits of the md5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def smallest_up_to(df: DataFrame, group: str, value: str, shares: list[float]) -> dict[str, list[int]]:
    """Per group and share, the value of the k-th smallest row, k = share * rows of the group, rounded half up; -1 for k = 0.

    Each pass counts rows per (group, next 12 bits of the value) among the rows whose higher bits are still open, so
    the driver sees at most groups * shares * 4096 counts, no row is shuffled beyond these counts, and the number of
    passes is at most five whatever the table holds."""
    spark = df.sparkSession
    cuts: dict[str, list[int]] = {}
    open_at: dict[tuple[str, int], list[tuple[int, int]]] = {}                      # (group, bits so far) -> [(share, rank inside)]
    for shift in range(HASH_BITS - PASS_BITS, -1, -PASS_BITS):
        digit = F.shiftright(F.col(value), shift)
        if shift == HASH_BITS - PASS_BITS:
            counted = df.groupBy(group, digit.alias("bits"))
        else:
            some = spark.createDataFrame([(g, p) for g, p in open_at], "g string, p long")
            counted = (df.join(F.broadcast(some), (F.col(group) == F.col("g")) & (F.shiftright(F.col(value), shift + PASS_BITS) == F.col("p")),
                               "left_semi").groupBy(group, digit.alias("bits")))
        rows = counted.agg(F.count(F.lit(1)).alias("n")).collect()
        found: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in rows:
            found.setdefault((r[group], r["bits"] >> PASS_BITS), []).append((r["bits"], r["n"]))
        if shift == HASH_BITS - PASS_BITS:
            if len(found) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} groups")
            totals = {g: sum(n for _, n in bits) for (g, _), bits in found.items()}
            cuts = {g: [-1] * len(shares) for g in totals}
            open_at = {(g, 0): [(i, k) for i, f in enumerate(shares) if (k := min(n, int(n * f + 0.5))) > 0] for g, n in totals.items()}
        further: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for at, wanted in open_at.items():
            for i, k in wanted:
                below = 0
                for bits, n in sorted(found[at]):
                    if below + n >= k:
                        break
                    below += n
                if below + n == k or shift == 0:                                  # the whole bucket belongs to the smallest
                    cuts[at[0]][i] = ((bits + 1) << shift) - 1
                else:
                    further.setdefault((at[0], bits), []).append((i, k - below))
        open_at = further
        if not open_at:
            break
    return cuts


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42,
                     valid_fraction: float = 0.0) -> DataFrame:
    """Adds ``split`` in {'train','valid','test'}.  Of each class exactly its share of rows (rounded half up) goes to
    the test rows, those with the smallest hashes of label and key; the next ones are validation rows.  The result
    does not depend on partitioning.  Rows of one class and key stay together, so a key that repeats at a cut may carry
    its split beyond the share; a null label is a class of its own, a null key a key like any other."""
    group = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    order = hash_order(F.concat_ws("|", F.col(label).cast("string"), F.col(key).cast("string")), seed)
    cuts = smallest_up_to(df.select(group.alias("group"), order.alias("order")), "group", "order", [test_fraction, test_fraction + valid_fraction])
    test = valid = F.lit(-1).cast("long")
    for g, (t, v) in cuts.items():
        test, valid = F.when(group == g, F.lit(t)).otherwise(test), F.when(group == g, F.lit(v)).otherwise(valid)
    return df.withColumn("split", F.when(order <= test, "test").when(order <= valid, "valid").otherwise("train"))


# ---------------------------------------------------------------- B7 validation
def _with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
                           for c, v in RECORD_DEFAULTS.items()})


def record_rules() -> dict[str, Column]:
    """Rule text -> condition that breaks it (over rows with defaults filled in)."""
    rules = {"amount missing": F.col("amount").isNull(),
             "amount must be > 0": (F.col("amount") <= 0) | F.isnan(F.col("amount").cast("double"))}
    for c, (lo, hi) in RECORD_BOUNDS.items():
        rules[f"{c} must be >= {lo}"] = F.col(c) < lo
        if hi is not None:
            rules[f"{c} must be <= {hi}"] = F.col(c) > hi
    return rules


def validate_records(df: DataFrame) -> DataFrame:
    """Fill defaults for missing fields, then list violated rules in ``reasons``
    (empty string when valid).  ``valid`` is a boolean column."""
    checks = [F.when(broken, F.lit(rule)) for rule, broken in record_rules().items()]
    reasons = F.concat_ws("; ", F.array_compact(F.array(*checks)))
    return _with_defaults(df).withColumn("reasons", reasons).withColumn("valid", F.col("reasons") == "")


def rule_violations(df: DataFrame) -> DataFrame:
    """Rows checked and rows that break each rule, rules without a breach included (one aggregate)."""
    rules = record_rules()
    counts = _with_defaults(df).agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum(F.when(broken, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"v{i}") for i, broken in enumerate(rules.values())])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
                                                  for i, rule in enumerate(rules)])).alias("s")).select(
        "s.rule", F.col("n").alias("checked"), "s.violations")


# ---------------------------------------------------------------- A9 data quality
def constraint_report(t: DataFrame, a: DataFrame, m: DataFrame) -> DataFrame:
    """Primary-key duplicates, NOT NULL violations and foreign-key orphans, one row per check."""
    def dup(df, k, table):
        return (df.groupBy(k).count().where(F.col("count") > 1)
                  .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations"))
                  .select(F.lit(table).alias("table_name"), F.lit(f"primary key {k}").alias("check_name"),
                          "violations"))

    def nulls(df, table):
        return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]).select(
            F.explode(F.array(*[F.struct(F.lit(table).alias("table_name"),
                                         F.lit(f"not null {c}").alias("check_name"),
                                         F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations"))
                                for c in df.columns])).alias("s")).select("s.*")

    def orphans(child, fk, parent, pk, name):
        o = child.select(fk).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
        return o.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(
            F.lit("transactions").alias("table_name"), F.lit(name).alias("check_name"), "violations")

    parts = [dup(t, "transaction_id", "transactions"), dup(a, "account_id", "accounts"),
             dup(m, "merchant_id", "merchants"), nulls(t, "transactions"), nulls(a, "accounts"),
             nulls(m, "merchants"),
             orphans(t, "account_id", a, "account_id", "foreign key account_id"),
             orphans(t, "merchant_id", m, "merchant_id", "foreign key merchant_id")]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table in one union."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- B14 / B15
def profile(df: DataFrame) -> DataFrame:
    """One row per column: type and missing count (one aggregate pass)."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                 F.coalesce(F.col(c), F.lit(0)).cast("long").alias("missing"))
        for c, t in df.dtypes])).alias("s")).select("s.*")


def winsorise(df: DataFrame, col: str, p: float = 0.99, out: str | None = None) -> DataFrame:
    """Clip ``col`` at its exact ``p`` quantile (a 1-row broadcast table)."""
    q = exact_quantiles(df, col, {"_cap": p})
    return (df.crossJoin(F.broadcast(q)).withColumn(out or col, F.least(F.col(col).cast("double"), F.col("_cap")))
              .drop("_cap"))
