"""Isolation forest: fit, score, normalise, tier, attributions.

* Fit, ``psi`` a number of rows: each row joins tree ``t`` when ``xxhash64(key, seed, t)``, over its whole 64-bit
  range, falls under ``psi / n`` -- seeded, independent per tree, and independent of partitioning.
  Only the chosen (row, tree) pairs are exploded, so each tree group holds about
  ``psi`` rows; ``groupBy(tree).applyInPandas`` builds one tree per group with numpy.
* Fit, ``psi`` a share of all rows (0.5 to 1 in the model cards): all trees grow together, level by level, from
  aggregates over the rows (``operators/levels.py``); no rows are shuffled.
* The node table is the bounded fitted state (trees x < 2 psi rows, or trees x < 2^(depth + 1)).
* Score: ``mapInPandas`` walks all trees for a whole Arrow batch at once
  (vectorised over rows, one loop per depth level).  Anomaly score
  ``s = 2^(-E[h(x)] / c(psi))``; risk is ``s`` min-max scaled over the batch
  (``mode="batch"``, the reference's behaviour) or over the training scores
  (``mode="frozen"``, stable for streams and single rows).
* Attributions: exact path-dependent Shapley values of the expected path length (``operators/shapley.py``); they sum
  to the row's expected path length minus the forest average.  Sign: positive raises risk.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import expressions as X
from riskloom.operators import levels, shapley
from riskloom.operators.features import apply_scaler, fit_scaler
from riskloom.operators.scorecard import freeze
from riskloom.sources.store import spill

EULER = 0.5772156649015329
#: Rows whose attributions are computed together (the tables of a tree are built once for them).
GATHER_ROWS = 100_000
#: Rows whose attributions one task computes.
TASK_ROWS = 200_000

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("value", T.DoubleType())])


def c_factor(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(x: np.ndarray, rng: np.random.Generator, feats: np.ndarray, max_depth: int):
    nodes = []   # [node, feature, threshold, left, right, size, depth]

    def grow(idx, depth):
        nid = len(nodes)
        nodes.append([nid, -1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return nid
        sub = x[idx][:, feats]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        ok = np.flatnonzero(hi > lo)
        if ok.size == 0:
            return nid
        j = ok[rng.integers(ok.size)]
        thr = rng.uniform(lo[j], hi[j])
        f = int(feats[j])
        go_left = x[idx, f] < thr
        nodes[nid][1], nodes[nid][2] = f, float(thr)
        nodes[nid][3] = grow(idx[go_left], depth + 1)
        nodes[nid][4] = grow(idx[~go_left], depth + 1)
        return nid

    grow(np.arange(x.shape[0]), 0)
    arr = np.array(nodes, dtype=object)
    # expected path length below each node (leaf: depth + c(size)), children first
    value = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        nid, f, thr, left, right, size, depth = nodes[i]
        if left < 0:
            value[i] = depth + float(c_factor([size])[0])
        else:
            sl, sr = nodes[left][5], nodes[right][5]
            value[i] = (sl * value[left] + sr * value[right]) / max(sl + sr, 1)
    return arr, value


def _tree_builder(cols: list[str], psi: int, max_features: float, seed: int):
    n_feat = len(cols)
    k = max(1, int(round(max_features * n_feat)))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        pdf = pdf.sort_values("_key")                      # input order never matters
        rng = np.random.default_rng([seed, tree])
        x = pdf[cols].to_numpy(dtype=float)
        feats = np.sort(rng.choice(n_feat, size=k, replace=False))
        arr, value = _build_tree(x, rng, feats, max_depth)
        return pd.DataFrame({"tree": tree, "node": arr[:, 0].astype(int), "feature": arr[:, 1].astype(int),
                             "threshold": arr[:, 2].astype(float), "left": arr[:, 3].astype(int),
                             "right": arr[:, 4].astype(int), "size": arr[:, 5].astype(np.int64),
                             "depth": arr[:, 6].astype(int), "value": value})
    return build


def draw_limit(share: float) -> int:
    """Largest signed 64-bit hash that a draw of ``share`` accepts (never below one hash in 2^64)."""
    return max(-(1 << 63), min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63) - 1))


def fit_forest(df: DataFrame, cols: list[str], key: str, n_trees: int = 100, psi: int | float = 256,
               max_features: float = 1.0, seed: int = 42, scale: bool = True, max_depth: int = levels.MAX_DEPTH) -> dict:
    """Fit the forest.  ``psi``: rows per tree (int), or the share of all rows each tree sees (float up to 1).
    Returns ``{"nodes", "scaler", "cols", "psi", "n_trees", "key"}``."""
    scaler = freeze(fit_scaler(df, cols)) if scale else None
    z = apply_scaler(df, scaler, cols, prefix="z_") if scale else df.select(
        key, *[F.col(c).alias(f"z_{c}") for c in cols])
    zc = [f"z_{c}" for c in cols]
    n = df.count()
    if isinstance(psi, float):
        first, second = levels.key_halves(F.col(key))
        rows = spill(z.select(*zc, first.alias("_first"), second.alias("_second")), "forest-rows")
        nodes = levels.grow(rows, zc, n_trees, psi, max_features, seed, levels.depth_of(psi * n, max_depth))
        return {"nodes": df.sparkSession.createDataFrame(nodes, NODE_SCHEMA), "scaler": scaler, "cols": cols,
                "psi": int(round(psi * n)), "n_trees": n_trees, "key": key}
    frac = min(1.0, psi / max(n, 1))
    psi_eff = int(min(psi, n))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.xxhash64(F.col(key), F.lit(seed), t) <= F.lit(draw_limit(frac)))
    sample = (z.select(F.col(key).cast("string").alias("_key"), *zc, F.explode(trees).alias("_tree")))
    nodes = sample.groupBy("_tree").applyInPandas(
        _tree_builder(zc, psi_eff, max_features, seed), NODE_SCHEMA)
    # bounded state: a tree on psi rows has < 2 psi nodes
    nodes = freeze(nodes, limit=n_trees * 2 * max(psi_eff, 1))
    return {"nodes": nodes, "scaler": scaler, "cols": cols, "psi": psi_eff, "n_trees": n_trees, "key": key}


def _pack(nodes: pd.DataFrame, n_trees: int) -> list:
    """Node table -> per tree (feature, threshold, left, right, size, value), trees without nodes left out."""
    names = ["feature", "threshold", "left", "right", "size", "value"]
    return [tuple(g[c].to_numpy() for c in names) for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")]


def _path_length(x: np.ndarray, trees: list) -> np.ndarray:
    """Mean over the trees of the expected path length where each row ends."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, _, value in trees:
        total += value[levels.descend(x, feature, threshold, left, right)]
    return total / max(len(trees), 1)


def shapley_values(x: np.ndarray, trees: list, n_features: int) -> np.ndarray:
    """[rows, features]: exact Shapley values of the mean path length, turned so that positive raises risk."""
    out = np.zeros((n_features, len(x)))
    for tree in trees:
        shapley.add_tree(x, *tree, out)
    return -out.T / max(len(trees), 1)


def gathered(batches, rows: int):
    """Batches joined to at least ``rows`` rows where there are so many."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``rows`` rows, at least one task a core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows)))


def score_forest(df: DataFrame, model: dict, out: str = "anomaly_score", attributions: bool = False) -> DataFrame:
    """I4: append ``anomaly_score`` = 2^(-E[h]/c(psi)) (higher = more anomalous) and, optionally,
    ``attributions: array<double>`` aligned with ``model["cols"]``."""
    cols = model["cols"]
    z = apply_scaler(df, model["scaler"], cols, prefix="_z_") if model["scaler"] is not None else \
        df.select("*", *[F.col(c).alias(f"_z_{c}") for c in cols])
    nodes_pdf = model["nodes"].toPandas()                       # bounded: trees x nodes
    packed = _pack(nodes_pdf, model["n_trees"])
    cpsi = float(c_factor([model["psi"]])[0]) or 1.0
    zc = [f"_z_{c}" for c in cols]
    fields = list(z.schema.fields) + [T.StructField(out, T.DoubleType())]
    if attributions:
        fields.append(T.StructField("attributions", T.ArrayType(T.DoubleType())))
    schema = T.StructType([f for f in fields if f.name not in zc])
    bc = df.sparkSession.sparkContext.broadcast(packed)
    keep = [f.name for f in schema.fields if f.name not in (out, "attributions")]

    def run(batches):
        p = bc.value
        for pdf in gathered(batches, GATHER_ROWS) if attributions else batches:
            x = pdf[zc].to_numpy(dtype=float)
            res = pdf[keep].copy()
            res[out] = np.power(2.0, -_path_length(x, p) / cpsi)
            if attributions:
                res["attributions"] = list(shapley_values(x, p, len(cols)))
            yield res

    return (spread(z, TASK_ROWS) if attributions else z).mapInPandas(run, schema)


def normalise(df: DataFrame, col: str = "anomaly_score", out: str = "risk_score",
              bounds: tuple[float, float] | None = None) -> DataFrame:
    """Min-max to [0, 1]; all-equal -> 0.  ``bounds=None`` uses the batch's own min/max
    (one 1-row aggregate, broadcast); pass training bounds for frozen scaling (clipped)."""
    if bounds is None:
        mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
        j = df.crossJoin(F.broadcast(mm))
        v = F.when(F.col("_mx") == F.col("_mn"), F.lit(0.0)).otherwise(
            (F.col(col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn")))
        return j.withColumn(out, v).drop("_mn", "_mx")
    lo, hi = bounds
    if hi == lo:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(col) - lo) / (hi - lo))))


def score_batch(df: DataFrame, model: dict, thresholds=X.TIER_THRESHOLDS, attributions: bool = False,
                bounds: tuple[float, float] | None = None) -> DataFrame:
    """Inputs kept, plus ``risk_score``, ``risk_tier``, ``recommended_action``."""
    s = score_forest(df, model, attributions=attributions)
    if bounds is None:                   # the batch's range is needed first: trees are walked once, not twice
        s = spill(s, "forest-scores")
    s = normalise(s, "anomaly_score", "risk_score", bounds)
    return (s.withColumn("risk_tier", X.risk_tier("risk_score", thresholds))
             .withColumn("recommended_action", X.tier_action("risk_tier")))


# Driver descriptions (exact wording).
DRIVER_DESCRIPTIONS = {
    "amount": "transaction amount is unusually large",
    "log_amount": "transaction amount is unusually large (log-scaled)",
    "velocity_1h": "unusually high transaction frequency in the last hour",
    "velocity_24h": "unusually high transaction volume in the last 24 hours",
    "high_risk_country": "transaction linked to a high-risk jurisdiction",
    "amount_vs_avg_ratio": "amount significantly exceeds the account's recent average",
    "hour": "transaction occurred at an unusual time of day",
    "is_night": "transaction occurred during the high-risk overnight window (11pm–5am)",
    "merchant_risk_tier": "merchant is in a high-risk category",
    "days_since_account_open": "account is relatively new",
    "is_weekend": "transaction occurred on a weekend",
}


def top_drivers(df: DataFrame, names: list[str], values: str = "attributions", n: int = 3,
                out: str = "top_drivers") -> DataFrame:
    """Numbered lines for the ``n`` largest |attribution| (ties keep feature order):
    ``"1. feat (+0.123): description"``.  Pure column expressions."""
    desc = F.create_map(*[x for k, v in DRIVER_DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    items = F.transform(F.col(values), lambda v, i: F.struct(
        F.lit(None).cast("string").alias("_"), F.element_at(F.array(*[F.lit(c) for c in names]), i + 1).alias("f"),
        v.alias("v"), i.alias("i")))
    srt = F.array_sort(items, lambda a, b: F.when(F.abs(a["v"]) > F.abs(b["v"]), -1)
                       .when(F.abs(a["v"]) < F.abs(b["v"]), 1)
                       .otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    top = F.slice(srt, 1, n)
    lines = F.transform(top, lambda e, k: F.format_string(
        "%d. %s (%s%.3f): %s", k + 1, e["f"], F.when(e["v"] > 0, "+").otherwise("-"), F.abs(e["v"]),
        F.coalesce(desc[e["f"]], F.concat(e["f"], F.lit(" contributed to the anomaly score")))))
    return df.withColumn(out, F.array_join(lines, "\n"))


def global_importance(attributed: DataFrame, names: list[str], values: str = "attributions") -> DataFrame:
    """Mean |attribution| per feature (posexplode + one aggregate), ranked."""
    from pyspark.sql import Window
    e = attributed.select(F.posexplode(values).alias("i", "v"))
    g = e.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs"))
    m = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(i), F.lit(c))])
    return g.select(m[F.col("i")].alias("feature"), F.round("mean_abs", 6).alias("mean_abs_attribution")).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("mean_abs_attribution").desc(), "feature")).cast("long"))
