"""Column expressions shared by the jobs (tiers, labels, flags, exact money sums)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# ---------------------------------------------------------------------------
# Texts and thresholds that must read exactly as the reference's.
# ---------------------------------------------------------------------------
TIER_THRESHOLDS = (0.30, 0.60, 0.85)          # MEDIUM, HIGH, CRITICAL lower bounds (inclusive)
TIER_ACTIONS = {
    "CRITICAL": "Immediately escalate to the Financial Crime team. Freeze transaction pending review.",
    "HIGH": "Flag for same-day review by a risk analyst. Do not release funds until cleared.",
    "MEDIUM": "Add to the daily review queue. Monitor account for additional suspicious activity.",
    "LOW": "Log for audit trail. No immediate action required.",
}
SCORECARD_ACTIONS = {
    "CRITICAL": "Immediately escalate to Financial Crime. Freeze transaction.",
    "HIGH": "Flag for same-day analyst review. Hold funds pending clearance.",
    "MEDIUM": "Queue for daily review. Monitor account activity.",
    "LOW": "Log for audit trail. No immediate action required.",
}
MERCHANT_TIER_LABELS = {0: "Low", 1: "Medium", 2: "High"}
REVIEW_SLA_LABELS = {1: "P1 — Immediate", 2: "P2 — Same Day", 3: "P3 — Next Day", 4: "P4 — Weekly"}
TIME_WINDOW_LABELS = ("1_Morning (6am–12pm)", "2_Afternoon (12pm–6pm)", "3_Evening (6pm–11pm)",
                      "4_Night (11pm–6am)")
COHORT_LABELS = ("1 — New (≤30 days)", "2 — Early (31–90 days)", "3 — Established (91d–1yr)",
                 "4 — Mature (1–2 years)", "5 — Veteran (2+ years)")
COHORT_UPPER_DAYS = (30, 90, 365, 730)
NIGHT_HOURS = (23, 0, 1, 2, 3, 4, 5)          # hour >= 23 or hour <= 5
FLAGGED_TIERS = ("HIGH", "CRITICAL")
# ---------------------------------------------------------------------------


def money(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def money_sum(col: Column | str) -> Column:
    """Exact sum of 2-dp amounts: decimal sum, then double (order-independent)."""
    return F.sum(money(col)).cast("double")


def money_avg(col: Column | str) -> Column:
    """Exact average of 2-dp amounts: exact decimal sum over the non-null count, in double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(money(c)).cast("double"), F.count(c).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """SQL ``num / NULLIF(den, 0)`` in double, NULL instead of an error on zero."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def pct(num: Column, den: Column) -> Column:
    return ratio(num * F.lit(100.0), den)


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def is_night(hour: Column | str = "hour") -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return ((h >= 23) | (h <= 5)).cast("int")


def log_amount(amount: Column | str = "amount") -> Column:
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.log1p(a)


def risk_tier(score: Column | str, thresholds=TIER_THRESHOLDS) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    low, med, high = thresholds
    return (F.when(s >= high, "CRITICAL").when(s >= med, "HIGH").when(s >= low, "MEDIUM")
             .otherwise("LOW"))


def _lookup(mapping: dict, key: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr


def tier_action(tier: Column | str, actions: dict = TIER_ACTIONS) -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    return _lookup(actions, t)


def merchant_tier_label(tier: Column | str) -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    return _lookup(MERCHANT_TIER_LABELS, t)


def review_sla(band: Column | str) -> Column:
    b = F.col(band) if isinstance(band, str) else band
    return _lookup(REVIEW_SLA_LABELS, b)


def time_window(hour: Column | str = "hour") -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    m, a, e, n = TIME_WINDOW_LABELS
    return (F.when(h.between(6, 11), m).when(h.between(12, 17), a).when(h.between(18, 22), e)
             .otherwise(n))


def cohort_id(avg_days: Column) -> Column:
    c30, c90, c365, c730 = COHORT_UPPER_DAYS
    return (F.when(avg_days <= c30, 1).when(avg_days <= c90, 2).when(avg_days <= c365, 3)
             .when(avg_days <= c730, 4).otherwise(5))


def cohort_label(cid: Column) -> Column:
    return _lookup({i + 1: lbl for i, lbl in enumerate(COHORT_LABELS)}, cid)


def ntile_of_position(position: Column, n: Column, buckets: int) -> Column:
    """SQL ``NTILE(buckets)`` for a 1-based row position among ``n`` rows."""
    q = F.floor(n / buckets)
    r = n - q * buckets
    big = r * (q + 1)
    return F.when(position <= big, F.floor((position - 1) / (q + 1)) + 1) \
            .otherwise(r + F.floor((position - big - 1) / q) + 1).cast("int")


BROADCAST_MAX_ROWS = 1_000_000


def bounded_broadcast(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast hint only when the table is proven to have at most ``max_rows`` rows (counted
    with a limit, so the check itself is bounded); otherwise a plain join that the planner/AQE
    may still broadcast from runtime statistics."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
