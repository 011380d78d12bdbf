"""Per-key event-time operators that stay exact when one key is very hot.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task; with
one account holding a third of all rows that task would hold a third of the
data.  The operators here partition by ``(key, time bucket)`` instead and
stitch buckets together through a small per-bucket aggregate:

* ``trailing_stats``  -- count / sum / non-null count over ``[t - W, t]``.
  Each row is copied once per distinct window width into bucket ``b + m``
  ("halo", narrow: key, bucket, position, value), so a bucket partition
  sees its own rows and the rows exactly ``m`` buckets earlier.  With
  ``W = m * grain``::

      stat(t) = sum_{j=b-m}^{b-1} total(j) + own_prefix(<= t) - halo_prefix(< t - W)

  where the bucket totals come from a per-(key, bucket) aggregate that has at
  most one row per active bucket and width.  Their sum is a difference of two
  prefix sums, formed as one running sum of own rows minus halo rows.
* ``sequence``        -- LAG / LEAD / ROW_NUMBER by time within key: local
  window per bucket, then the last (first) row and the row count of the
  neighbouring bucket from the per-bucket aggregate.
* ``rank_within_key`` -- RANK by a value within key, from counts of distinct
  (key, value) pairs bucketed by value quantile edges (a bounded 1-row table,
  broadcast).

All results equal the single-partition window functions exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
#: Rows (halo copies included) of one task of ``trailing_stats``, where the number of rows is known.
ROWS_PER_TASK = 1_000_000


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970-01-01 for timestamp or timestamp_ntz, zone-free for ntz."""
    dtype = df.schema[ts].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def _null_safe_key(df: DataFrame, key: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """Add ``{prefix}kk = coalesce(key, default)`` and ``{prefix}kn = key IS NULL``: partitioning,
    windows and joins use these two plain columns, so the final equi-join needs no re-shuffle of
    the big side (a ``<=>`` join would be re-keyed on coalesce/isnull expressions)."""
    dtype = df.schema[key].dataType
    if isinstance(dtype, (T.IntegralType, T.FractionalType)):
        default = F.lit(0).cast(dtype)
        kk = F.coalesce(F.col(key), default)
    elif isinstance(dtype, T.StringType):
        kk = F.coalesce(F.col(key), F.lit(""))
    else:
        kk = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = df.withColumn(f"{prefix}kk", kk).withColumn(f"{prefix}kn", F.col(key).isNull())
    return out, [f"{prefix}kk", f"{prefix}kn"]


def trailing_stats(df: DataFrame, key: str, ts: str, value: str | list[str] | None,
                   widths: dict[str, int], grain_seconds: int = 3600,
                   only: dict[str, list[str]] | None = None, rows: int | None = None,
                   until: int | None = None) -> DataFrame:
    """Add ``{name}_n`` (rows), ``{name}_s`` (sum of value), ``{name}_c`` (non-null values)
    for rows of the same key with event time in ``[t - width, t]`` (ties included).

    ``value`` may be a list of columns; then the sums are ``{name}_s__{col}`` and the
    counts ``{name}_c__{col}``, all from the same single shuffle.  ``widths`` maps an
    output prefix to a width in seconds; each must be a multiple of ``grain_seconds``.
    ``only`` restricts the value columns summed for a width (default: all of them).  ``rows``, the number of rows, keeps
    a task's share at about ROWS_PER_TASK: where accounts are sparse nearly every row has a bucket of its own, and
    partitions joined by their compressed size hold many times that in memory.  ``until``, the latest time in the rows in
    microseconds, spares the halo copies of rows that leave their window only after it.

    Sums are differences of prefix sums: exact for whole numbers and decimals; a NaN or an infinity in a floating
    column stays in the later sums of its key.
    """
    g = grain_seconds * MICROS
    mults = {}
    for name, w in widths.items():
        if w % grain_seconds:
            raise ValueError(f"window {name}={w}s is not a multiple of the grain {grain_seconds}s")
        mults[name] = w // grain_seconds
    values = [] if value is None else ([value] if isinstance(value, str) else list(value))
    single = isinstance(value, str)
    vcols = [f"_tw_v{i}" for i in range(len(values))]
    vmap = dict(zip(values, vcols))
    per_w = {name: [vmap[v] for v in (only or {}).get(name, values)] for name in mults}
    per_m: dict[int, set] = {}
    for name, m in mults.items():
        per_m.setdefault(m, set()).update(per_w[name])
    base = (df.withColumn("_tw_us", epoch_micros(df, ts))
              .withColumn("_tw_b", F.floor(F.col("_tw_us") / F.lit(g)).cast("long"))
              .withColumn("_tw_p", F.col("_tw_us") - F.col("_tw_b") * F.lit(g)))
    for vc, v in zip(vcols, values):
        base = base.withColumn(vc, F.col(v))
    base, kcols = _null_safe_key(base, key, "_tw_")

    real = base.withColumn("_tw_k", F.lit(0))
    parts = [real]
    for m in sorted(set(mults.values())):
        leaving = base if until is None else base.where(F.col("_tw_b") + F.lit(m) <= F.lit(until // g))
        parts.append(leaving.select(*kcols, (F.col("_tw_b") + F.lit(m)).alias("_tw_b"), "_tw_p", *sorted(per_m[m]),
                                    F.lit(m).alias("_tw_k")))       # halo rows: only the values this width sums
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    # one shuffle by (key, bucket) feeds both the per-bucket totals and the bucket windows,
    # so the input is computed once
    dealt = [] if rows is None else [max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                                         -(-rows * len(parts) // ROWS_PER_TASK))]
    u = u.repartition(*dealt, *kcols, "_tw_b")

    # One row per (key, bucket): bounded by active buckets, tiny next to the rows.  A row counts +1 in its own bucket and
    # its halo copy -1 in bucket b + m, so the running sum before a bucket is the sum of the m buckets before it: one
    # growing frame, whose cost does not depend on the width.
    ms = sorted(set(mults.values()))

    def net(m, one):
        return F.sum(F.when(F.col("_tw_k") == 0, one).when(F.col("_tw_k") == m, -one))

    aggs = [F.max(F.col("_tw_k") == 0).alias("_tw_active")]
    for m in ms:
        aggs.append(net(m, F.lit(1)).alias(f"_tw_dn_{m}"))
        for vc in sorted(per_m[m]):
            aggs += [net(m, F.col(vc)).alias(f"_tw_ds_{m}{vc}"), net(m, F.col(vc).isNotNull().cast("int")).alias(f"_tw_dc_{m}{vc}")]
    totals = u.groupBy(*kcols, "_tw_b").agg(*aggs)
    if dealt:
        totals = totals.repartition(*dealt, *kcols)
    earlier = Window.partitionBy(*kcols).orderBy("_tw_b").rangeBetween(Window.unboundedPreceding, -1)
    tcols = [F.sum(c).over(earlier).alias(c.replace("_tw_d", "_tw_S", 1)) for c in totals.columns if c.startswith("_tw_d")]
    totals = totals.select(*kcols, "_tw_b", "_tw_active", *tcols).where("_tw_active").drop("_tw_active")

    w = Window.partitionBy(*kcols, "_tw_b").orderBy("_tw_p")
    own = w.rangeBetween(Window.unboundedPreceding, 0)
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    is_own = F.col("_tw_k") == 0

    def cnt(cond, frame):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(frame), F.lit(0))
    wcols = [cnt(is_own, own).alias("_tw_on")]      # one select -> one Window operator
    for vc in vcols:
        wcols += [F.sum(F.when(is_own, F.col(vc))).over(own).alias(f"_tw_os{vc}"),
                  cnt(is_own & F.col(vc).isNotNull(), own).alias(f"_tw_oc{vc}")]
    for m in ms:
        is_h = F.col("_tw_k") == m
        wcols.append(cnt(is_h, before).alias(f"_tw_hn_{m}"))
        for vc in sorted(per_m[m]):
            wcols += [F.sum(F.when(is_h, F.col(vc))).over(before).alias(f"_tw_hs_{m}{vc}"),
                      cnt(is_h & F.col(vc).isNotNull(), before).alias(f"_tw_hc_{m}{vc}")]
    u = u.select("*", *wcols)
    u = u.filter(is_own)

    j = u.join(totals, [*kcols, "_tw_b"], "left")
    out_cols = [F.col(c) for c in u.columns]
    extra = []
    for name, m in mults.items():
        extra.append((F.coalesce(F.col(f"_tw_Sn_{m}"), F.lit(0)) + F.col("_tw_on")
                      - F.col(f"_tw_hn_{m}")).cast("long").alias(f"{name}_n"))
        for vc, v in zip(vcols, values):
            if vc not in per_w[name]:
                continue
            zero = F.lit(0).cast(base.schema[vc].dataType)
            suffix = "" if single else f"__{v}"
            extra += [
                (F.coalesce(F.col(f"_tw_Ss_{m}{vc}"), zero) + F.coalesce(F.col(f"_tw_os{vc}"), zero)
                 - F.coalesce(F.col(f"_tw_hs_{m}{vc}"), zero)).alias(f"{name}_s{suffix}"),
                (F.coalesce(F.col(f"_tw_Sc_{m}{vc}"), F.lit(0)) + F.col(f"_tw_oc{vc}")
                 - F.col(f"_tw_hc_{m}{vc}")).cast("long").alias(f"{name}_c{suffix}")]
    res = j.select(*out_cols, *extra)
    drop = [c for c in res.columns if c.startswith("_tw_")]
    return res.drop(*drop)


def sequence(df: DataFrame, key: str, ts: str, tiebreak: str, lag_cols: list[str],
             lead_cols: list[str] | None = None, row_number: str | None = "seq_num",
             grain_seconds: int = 300) -> DataFrame:
    """LAG (``prev_<c>``), LEAD (``next_<c>``) and ROW_NUMBER within ``key`` ordered by
    ``(ts, tiebreak)``, computed per (key, time bucket) and stitched across buckets."""
    lead_cols = lead_cols or []
    g = grain_seconds * MICROS
    base, kcols = _null_safe_key(df.withColumn("_sq_b", F.floor(epoch_micros(df, ts) / F.lit(g)).cast("long")),
                                 key, "_sq_")
    base = base.repartition(*kcols, "_sq_b")          # one shuffle feeds both branches below
    order = [F.col(ts), F.col(tiebreak)]
    w = Window.partitionBy(*kcols, "_sq_b").orderBy(*order)
    sel = [F.row_number().over(w).alias("_sq_rn"),
           F.count(F.lit(1)).over(Window.partitionBy(*kcols, "_sq_b")).alias("_sq_cnt")]
    sel += [F.lag(c).over(w).alias(f"_sq_lag_{c}") for c in lag_cols]
    sel += [F.lead(c).over(w).alias(f"_sq_lead_{c}") for c in lead_cols]
    out = base.select("*", *sel)

    ordkey = F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("i"))
    agg = [F.count(F.lit(1)).alias("_sq_n")]
    if lag_cols:
        agg.append(F.max_by(F.struct(*[F.col(c) for c in lag_cols]), ordkey).alias("_sq_last"))
    if lead_cols:
        agg.append(F.min_by(F.struct(*[F.col(c) for c in lead_cols]), ordkey).alias("_sq_first"))
    per_b = base.groupBy(*kcols, "_sq_b").agg(*agg)
    wk = Window.partitionBy(*kcols).orderBy("_sq_b")
    pcols = [F.coalesce(F.sum("_sq_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
             .alias("_sq_off")]
    if lag_cols:
        pcols.append(F.lag("_sq_last").over(wk).alias("_sq_prev"))
    if lead_cols:
        pcols.append(F.lead("_sq_first").over(wk).alias("_sq_next"))
    per_b = per_b.select("*", *pcols).drop("_sq_n", "_sq_last", "_sq_first")

    j = out.join(per_b, [*kcols, "_sq_b"], "left")
    cols = [F.col(c) for c in df.columns]
    for c in lag_cols:
        cols.append(F.when(F.col("_sq_rn") == 1, F.col("_sq_prev")[c]).otherwise(F.col(f"_sq_lag_{c}"))
                    .alias(f"prev_{c}"))
    for c in lead_cols:
        cols.append(F.when(F.col("_sq_rn") == F.col("_sq_cnt"), F.col("_sq_next")[c])
                    .otherwise(F.col(f"_sq_lead_{c}")).alias(f"next_{c}"))
    if row_number:
        cols.append((F.col("_sq_off") + F.col("_sq_rn")).cast("int").alias(row_number))
    return j.select(*cols)


def auto_edges(df: DataFrame) -> int:
    """Number of quantile edges of the bucketed windows: four per shuffle partition, the setting that is
    sized with the data.  The plan is the same at every size and needs no count beforehand."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_edges(df: DataFrame, col: str, n_edges: int = 64, accuracy: int | None = None) -> DataFrame:
    """1-row DataFrame ``edges: array<double>`` of approximate quantiles (sorted, distinct).
    The size is bounded by ``n_edges`` whatever the data size."""
    probs = [i / (n_edges + 1) for i in range(1, n_edges + 1)]
    acc = accuracy or max(10_000, 4 * n_edges)
    return df.agg(F.array_sort(F.array_distinct(
        F.percentile_approx(F.col(col).cast("double"), probs, acc))).alias("edges"))


def bucket_of(x: Column, edges: Column, max_edges: int) -> Column:
    """Number of ``edges`` (sorted ascending) strictly below ``x``: a binary search of
    ``ceil(log2(max_edges + 1))`` steps inside one ``aggregate`` expression (stays in codegen-able
    JVM expressions; O(log n) per row instead of scanning all edges)."""
    steps = max(1, math.ceil(math.log2(max_edges + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def step(acc, _):
        active = acc["lo"] < acc["hi"]
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        less = F.coalesce(F.element_at(edges, mid + 1) < x, F.lit(False))
        return F.struct(F.when(active & less, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(active & ~less, mid).otherwise(acc["hi"]).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def rank_within_key(df: DataFrame, key: str, value: str, out: str, descending: bool = True,
                    n_edges: int | None = None) -> DataFrame:
    """SQL ``RANK() OVER (PARTITION BY key ORDER BY value DESC|ASC)`` (nulls last for DESC,
    first for ASC, as Spark and SQLite do) without one task per key.

    Ranks are formed over the distinct (key, value) pairs with their counts, so a value that a
    third of the rows share is one row; the pairs are cut into buckets by quantile edges of those
    distinct values, and ranks are joined back to the rows."""
    n_edges = n_edges if n_edges else auto_edges(df)
    base, kcols = _null_safe_key(df, key, "_rk_")
    base = base.withColumn("_rk_v", F.col(value)).withColumn("_rk_vn", F.col(value).isNull())
    zero = F.lit(0).cast(df.schema[value].dataType)
    base = base.withColumn("_rk_v", F.coalesce("_rk_v", zero))
    counts = base.groupBy(*kcols, "_rk_vn", "_rk_v").agg(F.count(F.lit(1)).alias("_rk_n"))
    edges = quantile_edges(counts.where(~F.col("_rk_vn")), "_rk_v", n_edges)
    b = bucket_of(F.col("_rk_v").cast("double"), F.col("edges"), n_edges)
    ordc = F.col("_rk_v").desc() if descending else F.col("_rk_v").asc()
    # buckets ascend in rank order; nulls come last (descending) or first (ascending)
    place = F.when(F.col("_rk_vn"), F.lit(n_edges + 1 if descending else -1)).otherwise(F.lit(n_edges) - b if descending else b)
    hist = counts.crossJoin(F.broadcast(edges)).withColumn("_rk_b", place).drop("edges")
    earlier = Window.unboundedPreceding, -1
    local = Window.partitionBy(*kcols, "_rk_b").orderBy(ordc).rowsBetween(*earlier)
    hist = hist.withColumn("_rk_local", F.coalesce(F.sum("_rk_n").over(local), F.lit(0)))
    above = (hist.groupBy(*kcols, "_rk_b").agg(F.sum("_rk_n").alias("_rk_t"))
             .withColumn("_rk_above", F.coalesce(F.sum("_rk_t").over(
                 Window.partitionBy(*kcols).orderBy("_rk_b").rowsBetween(*earlier)), F.lit(0))).drop("_rk_t"))
    ranks = hist.join(above, [*kcols, "_rk_b"]).select(
        *kcols, "_rk_vn", "_rk_v", (F.col("_rk_above") + F.col("_rk_local") + 1).cast("int").alias(out))
    return base.join(ranks, [*kcols, "_rk_vn", "_rk_v"]).select(*[F.col(c) for c in df.columns], out)


def rank_of(few: DataFrame, df: DataFrame, key: str, value: str, out: str, few_id: str, df_value: str | None = None) -> DataFrame:
    """``RANK() OVER (PARTITION BY key ORDER BY value DESC)`` (nulls last) among the rows of ``df``, for the rows of
    ``few`` alone: a bounded result (a report's top rows, ``few_id`` unique) that is broadcast and meets ``df`` once;
    the rows above each are counted, no rank over the table is formed.  ``few`` is read twice: pass a written table.
    ``df_value``: the value's name in ``df`` where it differs."""
    mine = few.select(F.col(few_id).alias("_ro_id"), F.col(key).alias("_ro_k"), F.col(value).alias("_ro_v"))
    above = df.select(F.col(key).alias("_ro_key"), F.col(df_value or value).alias("_ro_value")).join(F.broadcast(mine), (
        F.col("_ro_key").eqNullSafe(F.col("_ro_k")) & F.col("_ro_value").isNotNull()
        & (F.col("_ro_v").isNull() | (F.col("_ro_value") > F.col("_ro_v")))))
    counts = above.groupBy("_ro_id").agg(F.count(F.lit(1)).alias("_ro_n"))
    return (few.join(F.broadcast(counts), few[few_id] == counts["_ro_id"], "left")           # a row per row of ``few``
            .withColumn(out, (F.coalesce("_ro_n", F.lit(0)) + 1).cast("int")).drop("_ro_id", "_ro_n"))
