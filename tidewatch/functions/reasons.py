"""Reasons and cold-start rules as array expressions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch import config as C
from tidewatch.functions.expr import as_col

# Probes in order (feature, lowest firing value, text).
PROBES = (
    ("cust_prev_amount_ratio", 3.0, "This transaction amount is %.1fx the customer's previous transaction amount, which is unusual."),
    ("cust_v_1h_count", 5.0, "This customer has made %.0f transaction(s) in the past 1 hour, an unusually high frequency."),
    ("cust_v_24h_count", 15.0, "This customer has made %.0f transaction(s) in the past 24 hours."),
    ("card_v_1h_count", 3.0, "This card has 1 or more rapid transactions in the past hour, a marker of card testing."),
    ("merch_fraud_rate_prior", 0.01, "This merchant's historical fraud rate is elevated and needs close attention."),
    ("merch_v_7d_count", 20.0, "This merchant's recent activity deviates sharply from its historical 7-day volume (a structural anomaly)."),
    ("merch_v_24h_count", 40.0, "This merchant has unusually high 24h transaction volume."),
    ("channel_swipe", 0.5, "This is a swipe (card-present) transaction, a channel with structural fraud risk."),
    ("channel_online", 0.5, "This is a card-not-present online transaction, structurally riskier."),
    ("is_night", 0.5, "This transaction occurred outside common daytime spending hours."),
    ("had_payment_error", 0.5, "This transaction carried a payment error, which can indicate card testing."),
    ("amount_log1p", 6.0, "This transaction amount(log-scale) is elevated relative to typical traffic."),
)
# Probes for entities without history.
COLD_PROBES = (
    ("amount_log1p", 6.0, "A high-value transaction from an entity with no or little history."),
    ("is_night", 0.5, "Out-of-hours transaction from an unknown entity."),
    ("channel_online", 0.5, "Card-not-present transaction from an unknown entity."),
    ("channel_swipe", 0.5, "Card-present transaction from an unknown entity."),
    ("had_payment_error", 0.5, "Transaction with an error from an unknown entity."),
)
ROUTINE = "No dominant risk factor exceeded thresholds; scored as routine."

# Cold-start rules (feature, lowest firing value, score, reason or None).
COLD_RULES = (
    ("amount_log1p", 6.0, 0.7, "high-value transaction from an entity with little history"),
    ("is_night", 0.5, 0.45, "out-of-hours transaction"),
    ("channel_online", 0.5, 0.5, None),
    ("channel_swipe", 0.5, 0.5, None),
    ("had_payment_error", 0.5, 0.6, "transaction carried a payment error"),
    ("merch_fraud_rate_prior", 0.01, 0.65, "merchant has an elevated historical fraud rate"),
)
COLD_FALLBACK = "low-history entity scored conservatively by rules"


def human_reasons(available: list[str], cold: bool = False, top_n: int = 4) -> Column:
    """The first `top_n` texts whose feature reaches its level; a neutral text otherwise."""
    hits = []
    for feature, level, text in (COLD_PROBES if cold else PROBES):
        if feature not in available:
            continue
        v = F.col(feature).cast("double")
        said = F.format_string(text, v) if "%." in text else F.lit(text)
        hits.append(F.when(v >= level, said))
    found = F.slice(F.array_compact(F.array(*hits)), 1, top_n)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ROUTINE)))


def cold_flag(*counts, min_history: int = C.COLD_MIN_HISTORY) -> Column:
    """True when any entity's history is unknown or shorter than `min_history`."""
    out = F.lit(False)
    for c in counts:
        out = out | (F.coalesce(as_col(c), F.lit(0)) < min_history)
    return out


def cold_risk(available: list[str]) -> tuple[Column, Column, Column]:
    """(risk score, action, reasons) from history-free signals."""
    fired = [(F.col(f).cast("double") >= level, score, why)
             for f, level, score, why in COLD_RULES if f in available]
    score = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(c, s).otherwise(0.0) for c, s, _ in fired])
    action = F.when(score >= 0.6, "hold").when(score >= 0.4, "review").otherwise("allow")
    told = F.array_compact(F.array(*[F.when(c, why) for c, _, why in fired if why]))
    reasons = F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(COLD_FALLBACK)))
    return F.round(score, 4), action, reasons


def rule_reasons(rate, default_rate, ts, channel) -> Column:
    """Context reasons before any model contribution, as structs.

    `rate` is the merchant's prior or null when it was not seen in training.
    """
    rate, default_rate = as_col(rate) * 100, as_col(default_rate) * 100
    hour = F.hour(as_col(ts))

    def reason(cond, feature, detail):
        return F.when(cond, F.struct(F.lit(feature).alias("feature"), F.lit("increases_risk").alias("direction"),
                                     detail.alias("detail")))

    return F.array_compact(F.array(
        reason(rate.isNull(), "merchant_id",
               F.lit("Merchant unseen in training history; scored with population default.")),
        reason(rate > F.greatest(3 * default_rate, F.lit(1.0)), "merch_fraud_rate_prior",
               F.format_string("Merchant historical fraud rate %.2f%% vs %.2f%% typical.", rate, default_rate)),
        reason((hour <= 5) | (hour >= 23), "is_night",
               F.format_string("Transaction at %02d:00, outside common spending hours.", hour)),
        reason(F.lower(as_col(channel)).contains("online"), "channel_online",
               F.lit("Card-not-present online channel carries elevated structural risk."))))


def top_attributions(names: list[str], k: int) -> Column:
    """The k attributions of largest magnitude in a row, with direction and text."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    # Larger magnitude first; equal magnitudes keep column order by name.
    ordered = F.array_sort(items, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                           .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                           .when(a["feature"] < b["feature"], -1)
                           .when(a["feature"] > b["feature"], 1).otherwise(0))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(
        x["feature"].alias("feature"), x["value"].alias("magnitude"),
        F.when(x["value"] > 0, "increases_risk").otherwise("reduces_risk").alias("direction"),
        F.concat(x["feature"], F.lit(" pushed "), F.format_string("%.4f", F.abs(x["value"])),
                 F.when(x["value"] > 0, " toward fraud").otherwise(" away from fraud")).alias("detail")))
