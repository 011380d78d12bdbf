"""Jobs whose results SQL can state exactly.

The operators on scored tables run here on a score that is a column expression, so their whole result has an
oracle; the fitted models are audited: every rule that their output must keep is counted over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators import eda, evaluate, features, levels
from riskloom.operators import forest as FO
from riskloom.operators import monitor as MO
from riskloom.operators import rules as RU
from riskloom.operators import scorecard as S
from riskloom.operators import text as TX
from riskloom.operators.timewindow import sequence
from riskloom.plans import models
from riskloom.sources import adapter


def ratio_scored(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with risk score r / (1 + r) of their amount ratio r, its tier and action."""
    r = F.coalesce("amount_vs_avg_ratio", F.lit(0.0))
    s = adapter.transactions_table(spark, d).withColumn("risk_score", X.ratio(r, r + 1.0))
    return s.withColumn("risk_tier", X.risk_tier("risk_score")).withColumn("recommended_action", X.tier_action("risk_tier"))


def ratio_texts(spark: SparkSession, d: str) -> DataFrame:
    """L1c to L1e: retrieval text, prompt and template brief of every transaction, over the ratio score."""
    s = ratio_scored(spark, d).withColumn("is_night", X.is_night("hour")).withColumn(
        "top_drivers", F.concat(F.lit("amount_vs_avg_ratio at "), F.coalesce("merchant_id", F.lit(0)).cast("string")))
    s = TX.fallback_brief(TX.risk_prompt(TX.retrieval_query(s), context="no_context"))
    return s.select("transaction_id", "retrieval_query", "prompt", "risk_summary")


def ratio_tiers(spark: SparkSession, d: str) -> DataFrame:
    return eda.tier_distribution(ratio_scored(spark, d))


def ratio_scan(spark: SparkSession, d: str) -> DataFrame:
    return eda.scan_summary(ratio_scored(spark, d))


def ratio_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(ratio_scored(spark, d), "risk_score", 50).select(
        F.col("bin").cast("long").alias("bin"), F.round("bin_start", 6).alias("bin_start"), "n")


def ratio_class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.class_histogram(ratio_scored(spark, d), "risk_score", "is_fraud")


def ratio_bands(spark: SparkSession, d: str) -> DataFrame:
    return eda.score_bands(ratio_scored(spark, d), "risk_tier", "risk_score")


def ratio_escalated(spark: SparkSession, d: str) -> DataFrame:
    return models.escalation(ratio_scored(spark, d))


def ratio_drift(spark: SparkSession, d: str) -> DataFrame:
    return MO.performance_drift(MO.split_periods(ratio_scored(spark, d)), "is_fraud", "risk_score")


def ratio_volume(spark: SparkSession, d: str) -> DataFrame:
    return MO.volume_and_fp(ratio_scored(spark, d))


def lift_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.lift_grid(adapter.transactions_table(spark, d).withColumn("score", F.col("amount_vs_avg_ratio")))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return features.rule_violations(adapter.transactions_table(spark, d))


def profile_types(spark: SparkSession, d: str) -> DataFrame:
    """Type, missing values and number of rows of every column."""
    t = adapter.transactions_table(spark, d)
    shape = t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(t.columns)))
    return features.profile(t).crossJoin(F.broadcast(shape))                    # both a row per column at most


def next_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Position of every transaction within its account, and the transaction that follows it."""
    s = sequence(adapter.transactions_table(spark, d), "account_id", "txn_timestamp", "transaction_id", [],
                 ["transaction_id", "txn_timestamp"])
    return s.select("transaction_id", F.col("seq_num").cast("long").alias("seq_num"), "next_transaction_id", "next_txn_timestamp")


def split_labels(spark: SparkSession, d: str) -> DataFrame:
    """H7: review labels split at their dash, and found by a word they contain."""
    part = F.split("review_sla", " — ")
    return models.queue_sla(spark, d).select(part[0].alias("band"), part[1].alias("wording"),
                                             F.col("review_sla").contains("Day").alias("within_days"), "alerts")


#: An ad-hoc statement of the kind ``catalog.run_sql`` takes.
AD_HOC = """SELECT m.merchant_category, COUNT(*) AS txns, CAST(SUM(t.is_fraud) AS BIGINT) AS fraud
FROM transactions t JOIN merchants m ON t.merchant_id = m.merchant_id GROUP BY m.merchant_category"""


def run_sql(spark: SparkSession, text: str, d: str) -> DataFrame:
    """A10: Spark SQL text over the views transactions, accounts and merchants."""
    adapter.transactions_table(spark, d).createOrReplaceTempView("transactions")
    adapter.accounts(spark, d).createOrReplaceTempView("accounts")
    adapter.merchants(spark, d).createOrReplaceTempView("merchants")
    return spark.sql(text)


# ----------------------------------------------------------------------------- audits of fitted models
def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, checked, violations: rows of ``df`` on which each rule does not hold (null counts as a breach)."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(ok, 0).otherwise(1)), F.lit(0)).cast("long").alias(f"v{i}")
                                               for i, ok in enumerate(rules.values())])
    return a.select("n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v{i}").alias("violations"))
                                             for i, r in enumerate(rules)])).alias("s")).select(
        "s.rule", F.col("n").alias("checked"), "s.violations")


def _follows(tier: str, score: str) -> Column:
    low, mid, high = X.TIER_THRESHOLDS
    s, t = F.col(score), F.col(tier)
    return ((s < low) & (t == "LOW")) | ((s >= low) & (s < mid) & (t == "MEDIUM")) | \
           ((s >= mid) & (s < high) & (t == "HIGH")) | ((s >= high) & (t == "CRITICAL"))


def _once(df: DataFrame, name: str) -> DataFrame:
    """Rule ``name``: every transaction has one row."""
    per = df.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return audit(per, {name: F.col("n") == 1})


def forest_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit_forest(models.forest_scored(spark, d, attributions=True), models.trained_forest(spark, d))


def audit_forest(s: DataFrame, forest: dict) -> DataFrame:
    """Scores in range, tiers that follow them, and attributions that add up: the expected path length
    of a row and its attributions make the mean of the trees' roots."""
    roots = forest["nodes"].where("node = 0").agg(F.avg("value").alias("_root"))
    depth = -F.log2("anomaly_score") * float(FO.c_factor([forest["psi"]])[0])
    total = F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x)
    return audit(s.crossJoin(F.broadcast(roots)), {
        "forest: anomaly score in (0, 1]": (F.col("anomaly_score") > 0) & (F.col("anomaly_score") <= 1),
        "forest: risk score in [0, 1]": F.col("risk_score").between(0, 1),
        "forest: tier follows score": _follows("risk_tier", "risk_score"),
        "forest: an attribution per feature": F.size("attributions") == len(forest["cols"]),
        "forest: attributions add up": F.abs(depth + total - F.col("_root")) < 1e-6,
    }).unionByName(_once(s, "forest: one row per transaction"))


def forest_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per tree, the rows its root saw and the rows its leaves hold."""
    n = models.trained_forest(spark, d)["nodes"]
    return n.groupBy("tree").agg(F.sum(F.when(F.col("depth") == 0, F.col("size"))).alias("rows"),
                                 F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows"),
                                 (F.max("depth") <= levels.MAX_DEPTH).alias("within_depth"))


#: Trees that the symmetry audit doubles.
AUDIT_TREES = 24


def shapley_audit(spark: SparkSession, d: str) -> DataFrame:
    """Axioms of the attributions on every transaction.  A feature no tree splits on gets exactly 0; in a forest
    made symmetric in two features, exchanging their values exchanges their attributions and leaves all others."""
    forest = models.trained_forest(spark, d)
    cols, one, two = forest["cols"], 0, forest["cols"].index("amount_vs_avg_ratio")
    some = forest["nodes"].where(F.col("tree") < AUDIT_TREES)
    mirrored = some.withColumn("tree", F.col("tree") + AUDIT_TREES).withColumn("feature", F.when(F.col("feature") == one, two)
                                                                              .when(F.col("feature") == two, one).otherwise(F.col("feature")))
    model = {**forest, "nodes": some.unionByName(mirrored), "scaler": None, "cols": [*cols, "dummy"], "n_trees": 2 * AUDIT_TREES}
    z = features.apply_scaler(adapter.transactions_table(spark, d), forest["scaler"], cols).select(
        "transaction_id", *[F.col(f"z_{c}").alias(c) for c in cols], F.lit(1.5).alias("dummy"))
    source = {cols[one]: cols[two], cols[two]: cols[one]}
    exchanged = z.select(*[F.col(source.get(c, c)).alias(c) for c in z.columns])
    a = FO.score_forest(z, model, attributions=True).select("transaction_id", F.col("attributions").alias("a"))
    b = FO.score_forest(exchanged, model, attributions=True).select("transaction_id", F.col("attributions").alias("b"))
    return audit_shapley(a.join(b, "transaction_id"), one, two)


def audit_shapley(j: DataFrame, one: int, two: int) -> DataFrame:
    def near(x, y):
        return F.abs(x - y) < 1e-9

    swapped = F.transform("b", lambda v, i: F.when(i == one, F.col("b")[two]).when(i == two, F.col("b")[one]).otherwise(v))
    return audit(j, {"shapley: a feature without splits gets nothing": F.element_at("a", -1) == 0,
                     "shapley: exchanged features exchange attributions": near(F.col("a")[one], F.col("b")[two]) & near(F.col("a")[two], F.col("b")[one]),
                     "shapley: other features keep theirs": F.forall(F.arrays_zip("a", swapped.alias("s")), lambda p: near(p["a"], p["s"]))})


def search_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per model, trials in the log, trials that reached each later rung, winners, parameters outside the ranges,
    and the training rows every trial saw."""
    log = models.boosted_search(spark, d)
    spaces = {"isolation_forest": models.SE.FOREST_SPACE, "boosted_trees": models.SE.BOOSTED_SPACE}
    outside = F.lit(0)
    for model, space in spaces.items():
        for name, (_, lo, hi) in space.items():
            if name != "scale_pos_weight":                     # in units of the class ratio, which the log has multiplied in
                v = F.col("params")[name]
                outside = outside + F.when((F.col("model") == model) & ~F.coalesce(v.between(lo, hi), F.lit(False)), 1).otherwise(0)
    return log.groupBy("model").agg(
        F.count(F.lit(1)).alias("trials"), F.sum(X.flag(F.col("rung") >= 1)).cast("long").alias("second_rung"),
        F.sum(X.flag(F.col("rung") >= 2)).cast("long").alias("third_rung"), F.sum(X.flag(F.col("best"))).cast("long").alias("winners"),
        F.sum(outside).cast("long").alias("outside_ranges"), F.max("rows_used").alias("training_rows"))


def boosted_audit(spark: SparkSession, d: str) -> DataFrame:
    s = models.boosted_scores(spark, d)
    return audit(s, {"boosted: risk score in [0, 1]": F.col("risk_score").between(0, 1),
                     "boosted: tier follows score": _follows("risk_tier", "risk_score")}) \
        .unionByName(_once(s, "boosted: one row per transaction"))


def fit_audit(spark: SparkSession, d: str) -> DataFrame:
    """Gradient of the objective at the fitted coefficients, per training row, recomputed over the plain rows by
    column expressions; 0 after rounding to 6 digits where the fit has converged."""
    r = models.trained_scorecard(spark, d)
    cols, lr = r["features"], r["lr"]
    t = adapter.transactions_table(spark, d).withColumn("is_night", X.is_night("hour"))
    train = features.stratified_split(t, "transaction_id", "is_fraud").where(F.col("split") == "train")
    w = S.apply_woe(train, r["model"], cols)
    margin = F.lit(lr["intercept"])
    for c in cols:
        margin = margin + F.lit(lr["coef"][c]) * F.col(f"woe_{c}")
    pull = 1.0 / (1.0 + F.exp(-margin)) - F.col("is_fraud")
    names, values = ["__INTERCEPT__", *cols], [F.lit(1.0), *[F.col(f"woe_{c}") for c in cols]]
    per_class = w.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), *[F.sum(pull * v).alias(f"g{i}") for i, v in enumerate(values)])
    total = per_class.agg(F.sum("n").alias("rows"), *[F.sum(F.col(f"g{i}") / (2 * F.col("n"))).alias(f"g{i}") for i in range(len(names))])
    parts = [F.struct(F.lit(c).alias("feature"), (F.col(f"g{i}") + F.lit(lr["coef"].get(c, 0.0)) / F.col("rows")).alias("g"))
             for i, c in enumerate(names)]
    return total.select(F.explode(F.array(*parts)).alias("p")).select(
        "p.feature", F.abs(F.round("p.g", 6)).alias("gradient"), (F.abs("p.g") < 1e-7).alias("converged"))


def scorecard_audit(spark: SparkSession, d: str) -> DataFrame:
    """Score and probability state the same odds (within rounding), and the breakdown adds up to the score
    (every part is rounded to whole points)."""
    s = models.scorecard_scores(spark, d)
    b, a = S.scaling()
    parts = len(models.trained_scorecard(spark, d)["features"]) + 1
    odds = 1.0 / (1.0 + F.exp(-(F.col("scorecard_score") - a) / b))
    sums = models.score_breakdown(spark, d).groupBy("transaction_id").agg(F.sum("points").alias("points"), F.max_by(
        "running_total", F.struct(F.col("feature") != "__OFFSET__", "feature")).alias("last"), F.count(F.lit(1)).alias("parts"))
    j = s.join(sums, "transaction_id", "left")
    return audit(j, {"scorecard: probability in [0, 1]": F.col("fraud_probability").between(0, 1),
                     "scorecard: score states the probability": F.abs(odds - F.col("fraud_probability")) < 0.25 * 0.5 / b + 1e-4,
                     "scorecard: breakdown adds up": F.abs(F.col("points") - F.col("scorecard_score")) <= 0.5 * (parts + 1),
                     "scorecard: running total ends at the sum": F.col("last") == F.col("points"),
                     "scorecard: a part per feature and the offset": F.col("parts") == parts}) \
        .unionByName(_once(s, "scorecard: one row per transaction"))


JOBS = {
    "l1_ratio_texts": ratio_texts,
    "d19_ratio_tiers": ratio_tiers, "d20_ratio_scan": ratio_scan, "d21_ratio_histogram": ratio_histogram,
    "d21_ratio_class_histogram": ratio_class_histogram,
    "d25_ratio_bands": ratio_bands, "m05_ratio_escalated": ratio_escalated, "m09_ratio_drift": ratio_drift,
    "m10_ratio_volume": ratio_volume, "j09_lift_grid": lift_grid, "b07_rule_violations": rule_violations,
    "b14_profile_types": profile_types, "e04_next_transactions": next_transactions, "h07_split_labels": split_labels,
    "a10_sql_text": lambda s, d: run_sql(s, AD_HOC, d),
    "i03_forest_sizes": forest_sizes, "i19_shapley_audit": shapley_audit, "i09_search_audit": search_audit,
    "i06_forest_audit": forest_audit, "i08_boosted_audit": boosted_audit, "i18_scorecard_audit": scorecard_audit,
    "i15_fit_audit": fit_audit,
}
