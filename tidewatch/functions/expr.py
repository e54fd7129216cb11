"""Column expressions of the risk model. Everything stays inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidewatch import config as C


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps null: least/greatest alone would skip it."""
    c = as_col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def money_units(c) -> Column:
    """Amount as whole 1/10 000 units: integer sums are exact in any order."""
    return F.round(as_col(c) * C.MONEY_SCALE).cast("long")


# -- calendar and channel ---------------------------------------------------

def amount_log1p(amount) -> Column:
    return F.log1p(clip(amount, low=0.0))


def hour_angle(ts) -> Column:
    return F.hour(as_col(ts)) * F.lit(math.pi / 12)


def hour_sin(ts) -> Column:
    return F.sin(hour_angle(ts))


def hour_cos(ts) -> Column:
    return F.cos(hour_angle(ts))


def is_weekend(ts) -> Column:
    return (F.weekday(as_col(ts)) >= 5).cast("int")


def is_night(ts, before_hour: int = 6) -> Column:
    """Night is 23:00 to 06:00; the graph edges use `before_hour=5`."""
    h = F.hour(as_col(ts))
    return ((h < before_hour) | (h >= 23)).cast("int")


def channel_flag(channel, word: str, equality: bool = False) -> Column:
    low = F.lower(as_col(channel))
    return (low == word if equality else low.contains(word)).cast("int")


def had_payment_error(err) -> Column:
    return (F.trim(F.coalesce(as_col(err), F.lit(""))) != "").cast("int")


def calendar_columns() -> list[Column]:
    return [
        amount_log1p("amount").alias("amount_log1p"),
        hour_sin("event_time").alias("hour_sin"),
        hour_cos("event_time").alias("hour_cos"),
        is_weekend("event_time").alias("is_weekend"),
        is_night("event_time").alias("is_night"),
        *[channel_flag("payment_channel", w).alias(f"channel_{w}")
          for w in ("swipe", "chip", "online")],
        had_payment_error("payment_error").alias("had_payment_error"),
    ]


def month_label(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def month_idx(ts) -> Column:
    ts = as_col(ts)
    return (F.year(ts) - 1970) * 12 + (F.month(ts) - 1)


# -- scores -----------------------------------------------------------------

def logit(p, floor: float = 1e-6) -> Column:
    c = clip(p, floor, 1.0 - floor)
    return F.log(c / (1.0 - c))


def sigmoid(m) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(m)))


def calibrate(p, scale) -> Column:
    """Undo positive-class weighting; a scale of at most 1 changes nothing."""
    p = as_col(p)
    s = as_col(scale) if isinstance(scale, (str, Column)) else F.lit(float(scale))
    return F.when(s <= 1.0, p).otherwise(clip(p / (s * (1.0 - p) + p), 0.0, 1.0))


def band(p, hold, review) -> Column:
    p = as_col(p)
    hold = hold if isinstance(hold, Column) else F.lit(float(hold))
    review = review if isinstance(review, Column) else F.lit(float(review))
    return F.when(p >= hold, "hold").when(p >= review, "review").otherwise("allow")


def lookup(c, table: dict[str, str], default: str) -> Column:
    out = None
    c = as_col(c)
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def security_action(action) -> Column:
    return lookup(action, C.SECURITY_ACTIONS, "REVIEW")


def verdict(action) -> Column:
    return lookup(action, C.VERDICTS, "REVIEW")


def webhook_event_name(action) -> Column:
    return F.when(as_col(action) == "allow", "payment.captured").otherwise("payment.risk_flagged")


def outcome_class(action, outcome) -> Column:
    a, o = as_col(action), as_col(outcome)
    out = None
    for (ka, ko), name in C.OUTCOME_CLASSES.items():
        cond = (a == ka) & (o == ko)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def fail_type(action, outcome) -> Column:
    a, o = as_col(action), as_col(outcome)
    return (F.when((o == "fraud") & (a == "allow"), "missed_fraud")
            .when((o == "legit") & (a == "hold"), "false_hold"))


def ln(col) -> Column:
    """Natural logarithm as in IEEE arithmetic: minus infinity at 0, where Spark's is null; null below."""
    c = as_col(col)
    return F.when(c == 0, F.lit(-math.inf)).otherwise(F.log(c))


def finite_or_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# -- ids and hashes ---------------------------------------------------------

def plain_id(c) -> Column:
    """Ids exported as floats ('123.0') and as integers ('123') are one id."""
    return F.regexp_replace(as_col(c), r"^([0-9]+)\.0$", "$1")


def error_signature(text) -> Column:
    """16 hex digits that do not depend on the numbers in the message."""
    return F.substring(F.md5(F.regexp_replace(F.lower(as_col(text)), r"[0-9]+", "N")), 1, 16)


# Failure classes and their markers; decision failures come first.
ERROR_MARKERS = (
    ("MISSED_FRAUD", ("missed_fraud", "missed fraud")),
    ("FALSE_HOLD", ("false_hold", "false hold")),
    ("COLD_START_UNCERTAIN", ("cold_start", "cold start", "unknown entity")),
    ("RATE_LIMIT", ("rate limit", "too many requests", "429", "quota")),
    ("TIMEOUT", ("timeout", "timed out", "504", "asyncio.timeout")),
    ("AUTH_EXPIRED", ("auth", "unauthorized", "token expired", "401")),
    ("SERVER_ERROR", ("500", "internal server", "502", "503")),
    ("NETWORK_ERROR", ("connection", "network", "econnrefused", "connectionrefused")),
)


def error_class(text) -> Column:
    low = F.lower(as_col(text))
    out = None
    for name, words in ERROR_MARKERS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNKNOWN")


def canonical_json(**fields) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    cols = [as_col(fields[k]).alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def half_even(c, digits: int) -> Column:
    return F.bround(as_col(c), digits)


def format_hour(h) -> Column:
    return F.format_string("%02d", as_col(h))
