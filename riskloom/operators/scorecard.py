"""Weight-of-evidence binning, information value and a points scorecard.

Fitting is a handful of aggregates: exact quantile edges per continuous
feature, one ``groupBy(feature, bin)`` over the melted table for all features
at once, a fold over at most ``n_bins`` bins per feature (a column
expression), and Newton steps over distinct WoE vectors (``operators/logistic``).  The fitted state is
three small tables (edges, bins, coefficients); transforming and scoring are
plain column expressions over broadcast 1-row maps -- no Python per row.

Deviations from the reference, on purpose (SURVEY Q4-Q7): fine bins merge in
numeric order; WoE keys are typed; out-of-range and NULL values get WoE 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.operators import logistic
from riskloom.operators.eda import _long, bin_index
from riskloom.operators.features import SYNTHETIC_FEATURES, stratified_split
from riskloom.operators.ranking import exact_quantiles

# Scaling, binning defaults, categorical features, IV bands.
BASE_SCORE = 600
BASE_ODDS = 50.0
PDO = 20
N_BINS = 8
MIN_BADS = 3
WOE_EPS = 1e-6
WOE_CLIP = 4.0
MAX_CATEGORIES = 6
CATEGORICAL = {"merchant_risk_tier", "high_risk_country", "is_weekend", "is_night"}
IV_BANDS = [(0.5, "Suspicious (check for leakage)"), (0.3, "Strong"), (0.1, "Medium"), (0.02, "Weak"),
            (0.0, "Useless")]
SCORECARD_FEATURES = SYNTHETIC_FEATURES + ["is_night"]

MAX_STATE_ROWS = 100_000


def freeze(df: DataFrame, limit: int = MAX_STATE_ROWS) -> DataFrame:
    """Collect a *bounded* fitted-state table (bins, edges, trees) and rebuild it as a
    local DataFrame, so later jobs do not re-run the fit.  Refuses unbounded input."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"fitted state has more than {limit} rows; refusing to collect it")
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def _woe(n_bad, n_good, total_bad, total_good):
    db = n_bad / F.greatest(total_bad, F.lit(1))
    dg = n_good / F.greatest(total_good, F.lit(1))
    woe = F.greatest(F.lit(-WOE_CLIP), F.least(F.lit(WOE_CLIP), F.log((db + WOE_EPS) / (dg + WOE_EPS))))
    return db, dg, woe


def iv_strength(iv) -> F.Column:
    e = None
    for thr, lbl in IV_BANDS:
        e = F.when(iv >= thr, lbl) if e is None else e.when(iv >= thr, lbl)
    return e.otherwise("Useless")


_GROUPS = "array<struct<first_bin:int,last_bin:int,n_bad:bigint,n_good:bigint>>"


def _joined(a, b) -> F.Column:
    return F.struct(a["first_bin"].alias("first_bin"), b["last_bin"].alias("last_bin"),
                    (a["n_bad"] + b["n_bad"]).alias("n_bad"), (a["n_good"] + b["n_good"]).alias("n_good"))


def coarse_groups(fine: F.Column, min_bads: int) -> F.Column:
    """Fine bins (ordered structs first_bin, last_bin, n_bad, n_good) -> groups of neighbours with at least
    ``min_bads`` bads.  Only the last group can be short while bins arrive; one that stays short at the end
    belongs to the group before it."""
    def add(groups, b):
        last = F.get(groups, F.size(groups) - 1)
        return F.when(last["n_bad"] < min_bads, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(_joined(last, b)))) \
                .otherwise(F.concat(groups, F.array(b)))

    def close(groups):
        n = F.size(groups)
        last, before = F.get(groups, n - 1), F.get(groups, n - 2)
        return F.when((n > 1) & (last["n_bad"] < min_bads),
                      F.concat(F.slice(groups, F.lit(1), n - 2), F.array(_joined(before, last)))).otherwise(groups)

    return F.aggregate(fine, F.array().cast(_GROUPS), add, close)


def fit_woe(df: DataFrame, cols: list[str], label: str = "is_fraud", n_bins: int = N_BINS,
            min_bads: int = MIN_BADS, categorical: list[str] | None = None) -> dict[str, DataFrame]:
    """Fit WoE bins for all ``cols`` at once.

    Returns ``{"edges": (feature, edges), "bins": one row per (feature, bin) with counts,
    WoE, IV contribution and the fine-bin range it covers}``."""
    d = df.select(label, *cols).where(F.col(label).isNotNull())
    # one pass: class totals and the distinct counts that decide categorical features (1 row)
    others = [c for c in cols if c not in CATEGORICAL] if categorical is None else []
    row = d.agg(F.sum(F.col(label).cast("long")).alias("total_bad"),
                F.sum((1 - F.col(label)).cast("long")).alias("total_good"),
                *[F.approx_count_distinct(c).alias(f"_nd_{c}") for c in others]).first()
    if categorical is not None:
        cat = categorical
    else:
        cat = [c for c in cols if c in CATEGORICAL or row[f"_nd_{c}"] <= MAX_CATEGORIES]
    cont = [c for c in cols if c not in cat]
    if not row["total_bad"] or not row["total_good"]:
        raise ValueError("labels must contain both fraud (1) and legitimate (0) rows")
    tot = df.sparkSession.createDataFrame([(int(row["total_bad"]), int(row["total_good"]))],
                                          "total_bad long, total_good long")
    parts = []
    edges = None
    if cat:
        lc = _long(d.select(label, *cat), cat)
        g = lc.groupBy("feature", "value").agg(F.sum(F.col(label).cast("long")).alias("n_bad"),
                                               F.sum((1 - F.col(label)).cast("long")).alias("n_good"))
        parts.append(g.select("feature", F.lit("categorical").alias("kind"), F.col("value").alias("category"),
                              F.lit(None).cast("int").alias("first_bin"), F.lit(None).cast("int").alias("last_bin"),
                              "n_bad", "n_good"))
    if cont:
        lc = _long(d.select(label, *cont), cont)
        probs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
        q = exact_quantiles(lc, "value", probs, by=["feature"])
        edges = freeze(q.select("feature", F.array_sort(F.array_distinct(F.array(*[F.col(k) for k in probs])))
                                .alias("edges")))
        fine = (lc.join(F.broadcast(edges), "feature")
                  .select("feature", bin_index(F.col("value"), most=n_bins + 1).alias("bin"), label)
                  .where(F.col("bin").isNotNull())
                  .groupBy("feature", "bin").agg(F.sum(F.col(label).cast("long")).alias("n_bad"),
                                                 F.sum((1 - F.col(label)).cast("long")).alias("n_good")))
        listed = F.array_sort(F.collect_list(F.struct(F.col("bin").cast("int").alias("first_bin"), F.col("bin").cast("int").alias("last_bin"),
                                                      "n_bad", "n_good")))               # at most n_bins per feature
        merged = fine.groupBy("feature").agg(listed.alias("fine")).select("feature", F.inline(coarse_groups(F.col("fine"), min_bads)))
        parts.append(merged.select("feature", F.lit("continuous").alias("kind"),
                                   F.lit(None).cast("double").alias("category"), "first_bin", "last_bin",
                                   "n_bad", "n_good"))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    u = u.crossJoin(F.broadcast(tot))
    db, dg, woe = _woe(F.col("n_bad"), F.col("n_good"), F.col("total_bad"), F.col("total_good"))
    bins = u.select("feature", "kind", "category", "first_bin", "last_bin", "n_bad", "n_good",
                    (F.col("n_bad") + F.col("n_good")).alias("n_total"),
                    F.round(X.ratio(F.col("n_bad"), F.greatest(F.col("n_bad") + F.col("n_good"), F.lit(1))), 4)
                    .alias("event_rate"),
                    db.alias("dist_bad"), dg.alias("dist_good"), woe.alias("woe"), ((db - dg) * woe).alias("iv_contrib"))
    if edges is not None:
        bins = bins.join(F.broadcast(edges), "feature", "left").withColumn(
            "lo", F.when(F.col("kind") == "continuous", F.element_at("edges", F.col("first_bin") + 1))).withColumn(
            "hi", F.when(F.col("kind") == "continuous", F.element_at("edges", F.col("last_bin") + 2))).drop("edges")
    else:
        bins = bins.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
        edges = df.sparkSession.createDataFrame([], "feature string, edges array<double>")
    return {"edges": freeze(edges), "bins": freeze(bins)}


def iv_summary(bins: DataFrame) -> DataFrame:
    """IV per feature with its strength label, highest first."""
    g = bins.groupBy("feature").agg(F.sum("iv_contrib").alias("iv"))
    return g.select("feature", F.round("iv", 4).alias("iv"), iv_strength(F.col("iv")).alias("strength")) \
            .orderBy(F.col("iv").desc(), "feature")


def woe_maps(model: dict[str, DataFrame]) -> DataFrame:
    """One-row table: per feature a ``map<double,double>`` (category or fine bin -> WoE) and its edges.
    Its size is bounded by features x bins, whatever the data size."""
    bins = model["bins"]
    cat = bins.where(F.col("kind") == "categorical").select(
        "feature", F.coalesce(F.col("category"), F.lit(float("nan"))).alias("k"), "woe")
    cont = bins.where(F.col("kind") == "continuous").select(
        "feature", F.explode(F.transform(F.sequence("first_bin", "last_bin"), lambda i: i.cast("double"))).alias("k"),
        "woe")
    kv = cat.unionByName(cont).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("k", "woe")))
                                                        .alias("m"))
    kinds = bins.select("feature", "kind").distinct()
    kv = kv.join(kinds, "feature").join(model["edges"], "feature", "left")
    return kv.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("kind", "m", "edges"))))
                  .alias("_woe_maps"))


def apply_woe(df: DataFrame, model: dict[str, DataFrame], cols: list[str], prefix: str = "woe_") -> DataFrame:
    """Replace values by WoE; unseen categories, out-of-range values and missing columns give 0."""
    j = df.crossJoin(F.broadcast(woe_maps(model)))
    for c in cols:
        spec = F.col("_woe_maps")[F.lit(c)]
        if c not in df.columns:
            j = j.withColumn(f"{prefix}{c}", F.lit(0.0))
            continue
        x = F.col(c).cast("double")
        key = F.when(spec["kind"] == "categorical", F.coalesce(x, F.lit(float("nan")))).otherwise(
            bin_index(x, "_e").cast("double"))
        j = j.withColumn("_e", spec["edges"])
        j = j.withColumn(f"{prefix}{c}", F.coalesce(F.element_at(spec["m"], key), F.lit(0.0)))
    return j.drop("_woe_maps", "_e")


def fit_logistic(woe_df: DataFrame, cols: list[str], label: str = "is_fraud", C: float = 1.0,
                 max_iter: int = 100, prefix: str = "woe_"):
    """L2 logistic regression on WoE columns with balanced class weights; raises when it does not converge."""
    found = logistic.fit(woe_df, [f"{prefix}{c}" for c in cols], label, C, max_iter)
    return {**found, "coef": dict(zip(cols, found["coef"]))}


def scaling(base_score=BASE_SCORE, base_odds=BASE_ODDS, pdo=PDO):
    b = pdo / math.log(2)
    return b, base_score + b * math.log(base_odds)


def points_table(model: dict[str, DataFrame], lr: dict, base_score=BASE_SCORE, base_odds=BASE_ODDS,
                 pdo=PDO) -> DataFrame:
    """I16: offset row first, then one row per (feature, bin) with integer points (half-even)."""
    b, a = scaling(base_score, base_odds, pdo)
    spark = model["bins"].sparkSession
    coefs = spark.createDataFrame([(k, v) for k, v in lr["coef"].items()], "feature string, coef double")
    bins = model["bins"].join(F.broadcast(coefs), "feature")
    label = F.when(F.col("kind") == "categorical", F.col("category").cast("string")).otherwise(
        F.concat(F.lit("("), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]")))
    rows = bins.select(F.lit(1).alias("row_kind"), "feature", label.alias("bin"), "first_bin", "category",
                       "n_total", "n_bad", "event_rate", F.round("woe", 4).alias("woe"),
                       F.round("iv_contrib", 4).alias("iv_contrib"), F.round("coef", 4).alias("coef"),
                       F.bround(F.lit(b) * F.col("coef") * F.col("woe"), 0).cast("long").alias("points"))
    offset = spark.range(1).select(
        F.lit(0).alias("row_kind"), F.lit("__OFFSET__").alias("feature"),
        F.lit("(base intercept contribution)").alias("bin"), F.lit(None).cast("int").alias("first_bin"),
        F.lit(None).cast("double").alias("category"), F.lit(None).cast("long").alias("n_total"),
        F.lit(None).cast("long").alias("n_bad"), F.lit(None).cast("double").alias("event_rate"),
        F.lit(None).cast("double").alias("woe"), F.lit(None).cast("double").alias("iv_contrib"),
        F.lit(None).cast("double").alias("coef"),
        F.bround(F.lit(a + b * lr["intercept"]), 0).cast("long").alias("points"))
    return offset.unionByName(rows)


def score_scorecard(df: DataFrame, model: dict[str, DataFrame], lr: dict, cols: list[str],
                    base_score=BASE_SCORE, base_odds=BASE_ODDS, pdo=PDO) -> DataFrame:
    """Integer score, probability (4 dp, half-even), tier and action -- column expressions only."""
    b, a = scaling(base_score, base_odds, pdo)
    w = apply_woe(df, model, cols)
    logit = F.lit(lr["intercept"])
    for c in cols:
        logit = logit + F.lit(lr["coef"].get(c, 0.0)) * F.col(f"woe_{c}")
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    tier = (F.when(prob >= 0.85, "CRITICAL").when(prob >= 0.60, "HIGH").when(prob >= 0.30, "MEDIUM")
             .otherwise("LOW"))
    out = (w.withColumn("scorecard_score", F.bround(F.lit(a) + F.lit(b) * logit, 0).cast("long"))
            .withColumn("fraud_probability", F.bround(prob, 4))
            .withColumn("risk_tier", tier)
            .withColumn("recommended_action", X.tier_action("risk_tier", X.SCORECARD_ACTIONS)))
    return out.drop(*[f"woe_{c}" for c in cols])


def explain_score(df: DataFrame, model: dict[str, DataFrame], lr: dict, cols: list[str], key: str,
                  base_score=BASE_SCORE, base_odds=BASE_ODDS, pdo=PDO) -> DataFrame:
    """Additive breakdown per row: feature, raw value, WoE, points and running total, starting from the
    offset, features in name order.  The parts and their running totals are columns of the row, exploded at the
    end: no shuffle."""
    b, a = scaling(base_score, base_odds, pdo)
    w = apply_woe(df.select(key, *[c for c in cols if c in df.columns]), model, cols)
    number = lambda x, t, name: x.cast(t).alias(name)
    total = F.bround(F.lit(a + b * lr["intercept"]), 0).cast("long")
    parts = [F.struct(F.lit("__OFFSET__").alias("feature"), number(F.lit(None), "double", "raw_value"),
                      number(F.lit(None), "double", "woe"), number(total, "long", "points"), number(total, "long", "running_total"))]
    for c in sorted(cols):
        raw = F.col(c) if c in df.columns else F.lit(None)
        points = F.bround(F.lit(b) * F.lit(lr["coef"].get(c, 0.0)) * F.col(f"woe_{c}"), 0).cast("long")
        total = total + points
        parts.append(F.struct(F.lit(c).alias("feature"), number(raw, "double", "raw_value"), number(F.col(f"woe_{c}"), "double", "woe"),
                              number(points, "long", "points"), number(total, "long", "running_total")))
    return w.select(key, F.inline(F.array(*parts)))


def train_scorecard(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id", n_bins: int = N_BINS,
                    min_bads: int = MIN_BADS, C: float = 1.0, min_iv: float = 0.02, test_size: float = 0.2,
                    seed: int = 42) -> dict:
    """End to end: is_night -> split -> WoE on train -> IV >= min_iv -> logistic -> points -> test metrics."""
    from riskloom.operators import evaluate
    d = df.withColumn("is_night", X.is_night("hour")) if "hour" in df.columns else df
    cols = [c for c in SCORECARD_FEATURES if c in d.columns]
    d = stratified_split(d, key, label, test_size, seed)
    train = d.where(F.col("split") == "train")
    test = d.where(F.col("split") == "test")
    full = fit_woe(train, cols, label, n_bins, min_bads)
    ivs = iv_summary(full["bins"])
    usable = [r["feature"] for r in ivs.where(F.col("iv") >= min_iv).collect()]       # <= len(cols) rows
    if not usable:
        raise ValueError(f"No features have IV >= {min_iv}.")
    model = {"edges": full["edges"].where(F.col("feature").isin(usable)),
             "bins": full["bins"].where(F.col("feature").isin(usable))}
    lr = fit_logistic(apply_woe(train, model, usable), usable, label, C)
    scored = score_scorecard(test, model, lr, usable)
    metrics = evaluate.summary(scored.withColumn("score", F.col("fraud_probability")), label, "score")
    return {"model": model, "lr": lr, "features": usable, "iv_summary": ivs, "all_features": cols,
            "points": points_table(model, lr), "metrics": metrics}
