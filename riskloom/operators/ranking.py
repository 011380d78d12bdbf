"""Global ordered statistics without a single-task window.

``cumulative_by_value`` collapses rows to distinct ``(group, value)`` first
(partial aggregation, so a value held by a third of all rows is one row), then
forms prefix sums over the distinct values.  When the number of distinct
values is itself unbounded, values are pre-bucketed by approximate quantile
edges (a bounded 1-row table): prefix sums run per (group, bucket) and bucket
offsets come from a table with at most ``groups x (n_edges + 2)`` rows.
Results are exact either way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.timewindow import auto_edges, bucket_of, quantile_edges


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False,
                        n_edges: int | str | None = "auto", by: list[str] | None = None) -> DataFrame:
    """One row per distinct ``(by..., value)`` with per-value sums and prefix sums.

    Output columns: ``by...``, ``value``, and for each name in ``sums``: ``name``
    (at this value), ``before_<name>`` (over values strictly earlier in the order,
    within the group) and ``total_<name>`` (whole group).  Nulls sort first
    ascending, last descending.  ``n_edges=None`` runs one window per group over
    its distinct values (only for value domains known to be small); ``"auto"`` takes four
    buckets per shuffle partition.  Edges come from the distinct values that the windows run over.
    """
    by = list(by or [])
    if n_edges == "auto":
        n_edges = auto_edges(df)
    hist = df.groupBy(*by, value).agg(*[expr.alias(name) for name, expr in sums.items()])
    names = list(sums)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    gw = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    if n_edges is None:
        w = (Window.partitionBy(*by) if by else Window).orderBy(order) \
            .rowsBetween(Window.unboundedPreceding, -1)
        cols = []
        for n in names:
            cols += [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"before_{n}"), F.sum(n).over(gw).alias(f"total_{n}")]
        return hist.select("*", *cols)

    edges = quantile_edges(hist.where(F.col(value).isNotNull()), value, n_edges)
    x = F.col(value).cast("double")
    b = bucket_of(x, F.col("edges"), n_edges)
    if descending:
        b = F.lit(n_edges) - b
    null_b = F.lit(n_edges + 1) if descending else F.lit(-1)
    hb = (hist.crossJoin(F.broadcast(edges))
              .withColumn("_cv_b", F.when(F.col(value).isNull(), null_b).otherwise(b)).drop("edges"))
    wl = Window.partitionBy(*by, "_cv_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hb = hb.select("*", *[F.coalesce(F.sum(n).over(wl), F.lit(0)).alias(f"_cv_l_{n}") for n in names])
    bt = hb.groupBy(*by, "_cv_b").agg(*[F.sum(n).alias(f"_cv_t_{n}") for n in names])
    wb = (Window.partitionBy(*by) if by else Window).orderBy("_cv_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    bcols = []
    for n in names:
        bcols += [F.coalesce(F.sum(f"_cv_t_{n}").over(wb), F.lit(0)).alias(f"_cv_o_{n}"),
                  F.sum(f"_cv_t_{n}").over(gw).alias(f"total_{n}")]
    bt = bt.select("*", *bcols)
    if by:                                                # a null group is a group
        bt = bt.withColumnsRenamed({c: f"_cv_g_{c}" for c in by} | {"_cv_b": "_cv_gb"})
        same = reduce(lambda a, c: a & hb[c].eqNullSafe(bt[f"_cv_g_{c}"]), by, hb["_cv_b"] == bt["_cv_gb"])
        j = hb.join(bt, same)
    else:
        j = hb.join(F.broadcast(bt), "_cv_b")
    cols = [F.col(c) for c in by] + [F.col(value)] + [F.col(n) for n in names]
    for n in names:
        cols += [(F.col(f"_cv_o_{n}") + F.col(f"_cv_l_{n}")).alias(f"before_{n}"), F.col(f"total_{n}")]
    return j.select(*cols)


def percent_rank(df: DataFrame, value: str, out: str = "percent_rank", n_edges: int | str | None = "auto") -> DataFrame:
    """SQL ``PERCENT_RANK() OVER (ORDER BY value)`` appended to every row."""
    cum = cumulative_by_value(df, value, {"_pr_n": F.count(F.lit(1))}, n_edges=n_edges)
    pr = F.when(F.col("total__pr_n") <= 1, F.lit(0.0)).otherwise(
        F.col("before__pr_n").cast("double") / (F.col("total__pr_n") - 1).cast("double"))
    lookup = cum.select(F.col(value).alias("_pr_v"), pr.alias(out))
    j = df.join(lookup, df[value].eqNullSafe(lookup["_pr_v"]), "left")
    return j.drop("_pr_v")


#: Accuracy of the sketches that bracket a quantile; groups and distinct values that may come to the driver.
ACCURACY, MAX_GROUPS, MAX_BRACKETED = 10_000, 10_000, 500_000
#: Steps of the grid that cuts a bracket which still holds too many distinct values.
GRID = 256


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
                    n_edges: int | str | None = "narrow") -> DataFrame:
    """Exact linear-interpolated quantiles (``percentile_cont``, pandas ``quantile``) per group; nulls and NaN are left out.
    Returns one row per group with one column per entry of ``probs``.

    All quantiles are narrowed together, no row is sorted or shuffled: one pass brackets them with mergeable sketches,
    the next counts the rows between the brackets and the distinct values inside.  Brackets that hold too many values
    are cut by another pass (each by a factor of about GRID); brackets that a sketch placed wrongly are widened, so the
    result never depends on the sketch.  The driver holds at most MAX_BRACKETED values; more groups than that allows go
    through ``quantiles_of_many_groups``, as does a given ``n_edges``."""
    by = list(by or [])
    if n_edges != "narrow":
        return quantiles_of_many_groups(df, value, probs, by, n_edges)
    v = F.col("_q_v")
    d = df.select(*by, F.col(value).cast("double").alias("_q_v")).where(v.isNotNull() & ~F.isnan(v))
    inner = sorted({p for p in probs.values() if 0 < p < 1})
    margin, spans = 2.0 / ACCURACY, None
    at = [q for p in inner for q in (max(0.0, p - margin), min(1.0, p + margin))] or [0.5]
    first = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                               F.percentile_approx(v, at, ACCURACY).alias("q")).limit(MAX_GROUPS + 1).collect()
    if len(first) > MAX_GROUPS or 6 * len(first) * len(probs) > MAX_BRACKETED:
        return quantiles_of_many_groups(d, "_q_v", probs, by)
    first = [g for g in first if g["n"]]
    keys = [tuple(g[c] for c in by) for g in first]
    ends = {k: (g["n"], g["least"], g["most"]) for k, g in zip(keys, first)}
    spans = {k: _disjoint([(g["q"][2 * i], g["q"][2 * i + 1]) for i in range(len(inner))]) for k, g in zip(keys, first)}
    wanted = {k: sorted({int(f((n - 1) * p)) for p in probs.values() for f in (math.floor, math.ceil)} - {0, n - 1})
              for k, (n, _, _) in ends.items()}
    found = {k: {0: lo, n - 1: hi} for k, (n, lo, hi) in ends.items()}
    while any(k not in found[g] for g in wanted for k in wanted[g]):
        placed = _placed(d, by, spans, df)
        inside = F.when(F.col("_q_in"), v)
        rows = placed.groupBy(*by, "_q_i", inside.alias("_q_v")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_BRACKETED + 1).collect()
        if len(rows) > MAX_BRACKETED:
            before, spans = spans, _cut(placed, by, spans, wanted)
            if spans == before:
                return quantiles_of_many_groups(d, "_q_v", probs, by)
            continue
        groups: dict = {}
        for r in rows:
            groups.setdefault(tuple(r[c] for c in by), []).append((r["_q_i"], r["_q_v"] is not None, r["_q_v"], r["n"]))
        for g, cells in groups.items():
            before = 0
            for _, is_value, x, n in sorted(cells, key=lambda c: (c[0], c[1], c[2] if c[1] else 0.0)):
                if is_value:                                     # rows ahead of bracket i sort before its values
                    found[g].update({k: x for k in wanted[g] if before <= k < before + n})
                before += n
            if any(k not in found[g] for k in wanted[g]):        # the sketch missed: take the whole range
                spans[g] = [(ends[g][1], ends[g][2])]
    rows = []
    for g, (n, _, _) in ends.items():
        out = []
        for p in probs.values():
            pos = (n - 1) * p
            lo, hi = found[g][int(math.floor(pos))], found[g][int(math.ceil(pos))]
            out.append(lo + (hi - lo) * (pos - math.floor(pos)))
        rows.append((*g, *out))
    schema = T.StructType([df.select(c).schema[0] for c in by] + [T.StructField(name, T.DoubleType()) for name in probs])
    return df.sparkSession.createDataFrame(rows, schema)


def _disjoint(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _placed(d: DataFrame, by: list[str], spans: dict, df: DataFrame) -> DataFrame:
    """Rows with the number of the first bracket that does not end below them, and whether they lie in it."""
    schema = T.StructType([T.StructField(f"_q_{c}", df.select(c).schema[0].dataType) for c in by]
                          + [T.StructField("_q_b", T.ArrayType(T.ArrayType(T.DoubleType())))])
    table = d.sparkSession.createDataFrame([(*g, [list(s) for s in b]) for g, b in spans.items()], schema)
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_q_{c}")), by, F.lit(True))
    j = d.join(F.broadcast(table), same)                         # at most MAX_GROUPS rows
    i = F.size(F.filter("_q_b", lambda s: s[1] < F.col("_q_v")))
    return j.withColumn("_q_i", i).withColumn("_q_in", F.coalesce(F.get("_q_b", F.col("_q_i"))[0] <= F.col("_q_v"), F.lit(False)))


def _cut(placed: DataFrame, by: list[str], spans: dict, wanted: dict) -> dict:
    """Narrower brackets: each is cut on a grid of its own values, the pieces around the wanted places stay."""
    grid, step = [i / GRID for i in range(GRID + 1)], 1 + math.ceil(2 * GRID / ACCURACY)
    rows = placed.groupBy(*by, "_q_i", "_q_in").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_q_v", grid, ACCURACY).alias("q")).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    out = {}
    for g, cells in groups.items():
        before, pieces = 0, []
        for r in sorted(cells, key=lambda r: (r["_q_i"], r["_q_in"])):
            if r["_q_in"]:
                for k in wanted[g]:
                    if before <= k < before + r["n"]:
                        at = (k - before) / max(1, r["n"] - 1) * GRID
                        pieces.append((r["q"][max(0, math.floor(at) - step)], r["q"][min(GRID, math.ceil(at) + step)]))
            before += r["n"]
        out[g] = _disjoint(pieces) or spans[g]
    return out


def quantiles_of_many_groups(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
                             n_edges: int | str | None = "auto") -> DataFrame:
    """``exact_quantiles`` for any number of groups.

    Rows are reduced to distinct values with counts; cumulative counts locate the
    two order statistics around ``(n - 1) * p`` for every requested ``p`` in one
    pass; no group is ever gathered into one task.  Returns one row per group
    with one column per entry of ``probs``."""
    by = list(by or [])
    d = df.where(F.col(value).isNotNull())
    cum = cumulative_by_value(d, value, {"_q_n": F.count(F.lit(1))}, n_edges=n_edges, by=by)
    want = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    start, end = F.col("before__q_n"), F.col("before__q_n") + F.col("_q_n")     # positions [start, end)

    def hits(q):                     # order statistics of this probability that fall on this value
        at = (F.col("total__q_n") - 1).cast("double") * q["p"]
        return ((F.floor(at) >= start) & (F.floor(at) < end)) | ((F.ceil(at) >= start) & (F.ceil(at) < end))
    x = cum.withColumn("_q_want", F.filter(want, hits)).where(F.size("_q_want") > 0)      # at most 2 x probs rows per group
    x = x.select(*by, F.col(value).cast("double").alias("_q_v"), "before__q_n", "_q_n", "total__q_n",
                 F.explode("_q_want").alias("_q"))
    pos = (F.col("total__q_n") - 1).cast("double") * F.col("_q.p")
    lo, hi = F.floor(pos), F.ceil(pos)
    x = x.select(*by, F.col("_q.name").alias("_q_name"), "_q_v", ((lo >= start) & (lo < end)).alias("_q_lo"),
                 ((hi >= start) & (hi < end)).alias("_q_hi"), (pos - lo).alias("_q_frac"))
    x = x.where(F.col("_q_lo") | F.col("_q_hi"))
    g = x.groupBy(*by, "_q_name").agg(
        F.max(F.when(F.col("_q_lo"), F.col("_q_v"))).alias("_vlo"),
        F.max(F.when(F.col("_q_hi"), F.col("_q_v"))).alias("_vhi"),
        F.max("_q_frac").alias("_frac"))
    g = g.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    return g.groupBy(*by).pivot("_q_name", list(probs)).agg(F.first("_q"))


def numbered(df: DataFrame, order: list[Column], position: str) -> DataFrame:
    """Every row with its place (1 ..) in a total order: a distributed sort, written once, whose partitions
    are numbered locally and shifted by the sizes of the partitions before them (one row per partition)."""
    from riskloom.sources.store import spill
    s = spill(df.orderBy(*order).withColumn("_nb_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_nb_id", 33), F.col("_nb_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("count").over(Window.orderBy("_nb_p").rowsBetween(Window.unboundedPreceding, -1))
    shift = s.groupBy(part.alias("_nb_p")).count().select("_nb_p", F.coalesce(before, F.lit(0)).alias("_nb_s"))
    return (s.withColumn("_nb_p", part).join(F.broadcast(shift), "_nb_p")
            .withColumn(position, F.col("_nb_s") + place + 1).drop("_nb_id", "_nb_p", "_nb_s"))


def top_k_with_position(df: DataFrame, order: list[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows by ``order`` (top-k per partition, then merge) numbered 1..k.
    ``order`` must end in a unique key so the result is deterministic."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("long"))
