"""Model evaluation on a ``(label, score)`` table.

Every ranking metric is computed from the distinct-score histogram with
cumulative positive/negative counts (``cumulative_by_value``): rows are never
sorted globally and no group lands in one task.  Ties are handled as the
usual threshold-based definitions do (all rows at a score share a threshold).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators.eda import bin_index, quantile_edges_exact
from riskloom.operators.ranking import cumulative_by_value, exact_quantiles

ROUND = 6
LIFT_RATES = (0.05, 0.10, 0.20)


def _counts(df: DataFrame, label: str, score: str, descending: bool) -> DataFrame:
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return cumulative_by_value(d, score, {"pos": F.sum(F.col(label).cast("long")),
                                          "neg": F.sum((1 - F.col(label)).cast("long"))},
                               descending=descending)


def _curve_from(c: DataFrame, score: str) -> DataFrame:
    """Threshold table from *ascending* cumulative counts: rows at or above a threshold are
    everything except the rows strictly below it."""
    P, N = F.col("total_pos"), F.col("total_neg")
    tp = P - F.col("before_pos")
    fp = N - F.col("before_neg")
    prec = X.ratio(tp, tp + fp)
    rec = X.ratio(tp, P)
    return c.select(F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.coalesce(prec, F.lit(0.0)).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"),
                    F.coalesce(X.ratio(fp, N), F.lit(0.0)).alias("fpr"),
                    F.coalesce(X.ratio(2 * tp, 2 * tp + fp + (P - tp)), F.lit(0.0)).alias("f1"),
                    "pos", "neg", "before_neg", P.alias("n_pos"), N.alias("n_neg"))


def curve(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """One row per distinct score threshold (rows with score >= threshold predicted positive):
    tp, fp, precision, recall (= TPR), FPR, F1."""
    return _curve_from(_counts(df, label, score, descending=False), score).drop("before_neg")


def summary(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Average precision (step-wise), ROC AUC (ties count one half), Gini, KS, prevalence --
    all from one pass of cumulative counts over the distinct scores."""
    cv = _curve_from(_counts(df, label, score, descending=False), score)
    a = cv.agg(F.sum(F.when(F.col("n_pos") > 0, F.col("pos") / F.col("n_pos") * F.col("precision"))).alias("ap"),
               F.max(F.abs(F.col("recall") - F.col("fpr"))).alias("ks"),
               F.sum(F.col("pos").cast("double") * (F.col("before_neg").cast("double") + 0.5 * F.col("neg")))
               .alias("_u"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n"))
    roc = X.ratio(F.col("_u"), F.col("_p").cast("double") * F.col("_n").cast("double"))
    return a.select(F.round("ap", ROUND).alias("auc_pr"), F.round(roc, ROUND).alias("auc_roc"),
                    F.round(roc * 2 - 1, ROUND).alias("gini"), F.round("ks", ROUND).alias("ks"),
                    F.round(X.ratio(F.col("_p"), F.col("_p") + F.col("_n")), ROUND).alias("prevalence"),
                    F.col("_p").alias("n_pos"), F.col("_n").alias("n_neg"))


def at_threshold(df: DataFrame, label: str = "is_fraud", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Precision / recall / F1 with ``score >= threshold``; zero division gives 0."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    a = df.agg(F.sum(X.flag(pred & y)).alias("tp"), F.sum(X.flag(pred & ~y)).alias("fp"),
               F.sum(X.flag(~pred & y)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(F.lit(float(threshold)).alias("threshold"), tp.cast("long").alias("tp"),
                    fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
                    F.round(F.coalesce(X.ratio(tp, tp + fp), F.lit(0.0)), ROUND).alias("precision"),
                    F.round(F.coalesce(X.ratio(tp, tp + fn), F.lit(0.0)), ROUND).alias("recall"),
                    F.round(F.coalesce(X.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), ROUND).alias("f1"))


def best_f1(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Threshold with the highest F1 (lowest threshold among equals)."""
    cv = curve(df, label, score)
    return cv.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                           F.struct(F.col("f1"), -F.col("threshold"))).alias("b")).select(
        F.col("b.threshold").alias("threshold"), F.round("b.precision", ROUND).alias("precision"),
        F.round("b.recall", ROUND).alias("recall"), F.round("b.f1", ROUND).alias("f1"))


def separation(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Mean and exact median score per class."""
    m = df.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(df, score, {"median_score": 0.5}, by=[label])
    return m.join(q, label).select(label, "n", F.round("mean_score", ROUND).alias("mean_score"),
                                   F.round("median_score", ROUND).alias("median_score"))


def calibration(df: DataFrame, label: str = "is_fraud", score: str = "score", n_bins: int = 10) -> DataFrame:
    """Reliability per score quantile bin (empty bins absent)."""
    edges = quantile_edges_exact(df, score, n_bins)
    x = F.col(score).cast("double")
    b = df.crossJoin(F.broadcast(edges)).select(bin_index(x).cast("long").alias("bin"), x.alias("s"), label)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), ROUND).alias("mean_score"),
                                F.round(F.avg(label), ROUND).alias("fraud_rate"))


def lift(df: DataFrame, label: str = "is_fraud", score: str = "score", rates=LIFT_RATES) -> DataFrame:
    """% of positives among the top ``int(rate * n)`` rows by score.  Rows tied
    with the cut score are credited proportionally (order among ties is undefined)."""
    c = _counts(df, label, score, descending=True)
    parts = []
    for rt in rates:
        k = F.floor(F.lit(float(rt)) * (F.col("total_pos") + F.col("total_neg")).cast("double"))
        cnt_before = F.col("before_pos") + F.col("before_neg")
        cnt_here = F.col("pos") + F.col("neg")
        take = F.greatest(F.lit(0), F.least(cnt_here, k - cnt_before))
        caught = F.when(cnt_here > 0, F.col("pos") * take / cnt_here).otherwise(0.0)
        parts.append(c.agg(F.sum(caught).alias("caught"), F.max("total_pos").alias("P"), F.max(k).alias("k"))
                     .select(F.lit(float(rt)).alias("review_rate"), F.col("k").cast("long").alias("reviewed"),
                             F.round(X.pct(F.col("caught"), F.col("P")), 4).alias("fraud_caught_pct")))
    return reduce(DataFrame.unionByName, parts)


def lift_grid(df: DataFrame, label: str = "is_fraud", score: str = "score", points: int = 100) -> DataFrame:
    """J9 (curve): ``lift`` at review rates 1/points .. 1 in one pass.  Every grid point falls to the one distinct
    score at which its number of reviewed rows is reached."""
    c = _counts(df, label, score, descending=True)
    before, here, n = F.col("before_pos") + F.col("before_neg"), F.col("pos") + F.col("neg"), F.col("total_pos") + F.col("total_neg")
    grid = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.struct(
        (i / F.lit(float(points))).alias("rate"), F.floor(i * n / F.lit(points)).cast("long").alias("k")))
    own = F.filter(grid, lambda g: ((g["k"] > before) | (g["k"] == 0) & (before == 0)) & (g["k"] <= before + here))
    g = c.select("before_pos", "pos", before.alias("before"), here.alias("here"), "total_pos", F.explode(own).alias("g"))
    caught = F.col("before_pos") + F.col("pos") * (F.col("g.k") - F.col("before")) / F.col("here")
    return g.select(F.col("g.rate").alias("review_rate"), F.col("g.k").alias("reviewed"),
                    F.round(X.pct(caught, F.col("total_pos")), 4).alias("fraud_caught_pct"))


def deciles(df: DataFrame, label: str = "is_fraud", score: str = "score", n_bins: int = 10) -> DataFrame:
    """Decile table (1 = lowest scores) and the gains curve from the top decile down."""
    edges = quantile_edges_exact(df, score, n_bins)
    x = F.col(score).cast("double")
    b = df.crossJoin(F.broadcast(edges)).select((bin_index(x) + 1).cast("long").alias("decile"), x.alias("s"), label)
    g = b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_fraud"),
                                F.round(F.avg("s"), ROUND).alias("avg_score"))
    w = Window.orderBy(F.col("decile").desc()).rowsBetween(Window.unboundedPreceding, 0)   # <= n_bins rows
    wall = Window.partitionBy(F.lit(1))
    return g.select("decile", "n", "n_fraud", "avg_score",
                    F.round(X.ratio(F.col("n_fraud"), F.col("n")), ROUND).alias("fraud_rate"),
                    F.round(X.pct(F.sum("n_fraud").over(w), F.sum("n_fraud").over(wall)), 4).alias("cum_fraud_pct"),
                    F.round(X.pct(F.sum("n").over(w), F.sum("n").over(wall)), 4).alias("cum_population_pct"))


def ks_curve(df: DataFrame, label: str = "is_fraud", score: str = "score", points: int = 200) -> DataFrame:
    """J3 (plot form): class CDFs at ``points`` thresholds ``i / (points - 1)``.  Each distinct
    score goes to the first threshold at or above it; CDFs are prefix sums over <= points rows."""
    spark = df.sparkSession
    d = float(points - 1)
    th = spark.range(points).select(F.col("id").alias("idx"), (F.col("id") / d).alias("threshold"))
    c = _counts(df, label, score, descending=False).select(F.col(score).cast("double").alias("v"), "pos", "neg")
    i0 = F.ceil(F.col("v") * d)
    i1 = F.when(i0 / d < F.col("v"), i0 + 1).otherwise(i0)
    idx = F.greatest(F.lit(0), F.when((i1 - 1) / d >= F.col("v"), i1 - 1).otherwise(i1))
    g = c.groupBy(idx.alias("idx")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tot = c.agg(F.sum("pos").alias("_all_pos"), F.sum("neg").alias("_all_neg"))
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)        # <= points rows
    j = th.join(g, "idx", "left").crossJoin(F.broadcast(tot))
    cp = F.coalesce(F.sum("p").over(w), F.lit(0))
    cn = F.coalesce(F.sum("n").over(w), F.lit(0))
    return j.select("threshold",
                    F.round(F.coalesce(X.ratio(cp, F.col("_all_pos")), F.lit(0.0)), ROUND).alias("cdf_fraud"),
                    F.round(F.coalesce(X.ratio(cn, F.col("_all_neg")), F.lit(0.0)), ROUND).alias("cdf_legit"))


def compare(models: dict[str, DataFrame], label: str = "is_fraud", score: str = "score") -> DataFrame:
    """One row per model plus the prevalence baseline; winner flag and AUC-PR margin."""
    rows = [summary(df, label, score).select(F.lit(name).alias("model"), "auc_pr", "auc_roc")
            for name, df in models.items()]
    first = next(iter(models.values()))
    base = first.agg(F.round(F.avg(label), ROUND).alias("auc_pr")).select(
        F.lit("baseline").alias("model"), "auc_pr", F.lit(0.5).alias("auc_roc"))
    u = reduce(DataFrame.unionByName, rows + [base])
    w = Window.partitionBy(F.lit(1))        # a handful of rows
    return u.select("model", "auc_pr", "auc_roc",
                    (F.col("auc_pr") == F.max("auc_pr").over(w)).alias("winner"),
                    F.round(F.max("auc_pr").over(w) - F.min("auc_pr").over(w), ROUND).alias("margin"))
