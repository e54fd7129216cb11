"""Fixed values of the risk model: windows, feature catalogue, thresholds, wording."""

from __future__ import annotations

from dataclasses import dataclass

# Sliding windows in seconds.
WINDOW_SECONDS = {"1h": 3600, "24h": 86400, "7d": 604800}


@dataclass(frozen=True)
class WindowFeature:
    """One sliding window of an entity: a count, maybe a sum, maybe distinct merchants."""

    label: str
    amount: bool = True
    distinct: bool = False


@dataclass(frozen=True)
class Entity:
    """An entity whose past is summarised, and what is asked of that past."""

    name: str
    id_col: str
    windows: tuple[WindowFeature, ...] = ()
    priors: tuple[str, ...] = ()


# The velocity catalogue.
CATALOGUE: tuple[Entity, ...] = (
    Entity("cust", "customer_id",
           (WindowFeature("1h"), WindowFeature("24h", distinct=True),
            WindowFeature("7d", distinct=True)),
           ("txn_count_prior", "amount_mean_prior", "time_since_prev_log", "prev_amount_ratio")),
    Entity("card", "card_id",
           (WindowFeature("1h"), WindowFeature("24h"), WindowFeature("7d")),
           ("txn_count_prior", "amount_mean_prior", "time_since_prev_log")),
    Entity("merch", "merchant_id",
           (WindowFeature("24h", amount=False), WindowFeature("7d", amount=False)),
           ("txn_count_prior",)),
    Entity("device", "device_id", (WindowFeature("24h"), WindowFeature("7d")), ()),
)


def velocity_feature_names(entities: tuple[Entity, ...] = CATALOGUE) -> list[str]:
    names = []
    for e in entities:
        for w in e.windows:
            names.append(f"{e.name}_v_{w.label}_count")
            if w.amount:
                names.append(f"{e.name}_v_{w.label}_amount")
            if w.distinct:
                names.append(f"{e.name}_v_{w.label}_distinct_merchants")
    return names


def prior_feature_names(entities: tuple[Entity, ...] = CATALOGUE) -> list[str]:
    return [f"{e.name}_{p}" for e in entities for p in e.priors]


def priors_alone(names: list[str], entities: tuple[Entity, ...] = CATALOGUE) -> tuple[Entity, ...]:
    """The entities that the priors `names` are of, with these priors and no windows."""
    kept = [Entity(e.name, e.id_col, (), tuple(p for p in e.priors if f"{e.name}_{p}" in names)) for e in entities]
    return tuple(e for e in kept if e.priors)


CALENDAR_COLUMNS = [
    "amount_log1p", "hour_sin", "hour_cos", "is_weekend", "is_night",
    "channel_swipe", "channel_chip", "channel_online", "had_payment_error",
]
ENCODING_COLUMNS = ["merch_freq_share", "merch_fraud_rate_prior", "mcc_freq_share"]
HISTORY_COLUMNS = prior_feature_names()
FULL_COLUMNS = CALENDAR_COLUMNS + HISTORY_COLUMNS + ENCODING_COLUMNS
ONLINE_COLUMNS = CALENDAR_COLUMNS + ENCODING_COLUMNS
ONLINE_VELOCITY_COLUMNS = ONLINE_COLUMNS + velocity_feature_names() + prior_feature_names()
MONITORED_COLUMNS = ONLINE_COLUMNS

# Money and rates.
INR_PER_USD = 83.5
MONEY_SCALE = 10_000  # amounts are summed as whole 1/10 000 units, so sums are exact

# Cold start.
COLD_MIN_HISTORY = 5

# Drift.
PSI_WARN = 0.25
PSI_BINS = 10
PSI_FLOOR = 1e-6
Z_WARN = 3.0
SWITCH_PENALTY = 0.02

# Healing.
MISS_RATE_WARN = 0.05
FALSE_HOLD_WARN = 0.10
RETRAIN_MIN_FAILURES = 2
TIGHTEN_HOLD_FACTOR = 1.25
RELAX_HOLD_FACTOR = 0.8
HOLD_FLOOR, HOLD_CEILING = 1e-8, 0.999999
MIN_REPAIR_ROWS = 8
MEMORY_MAX_EPISODES = 200_000
MEMORY_KEEP_EPISODES = 100_000

# Outcome classes by (action, outcome).
OUTCOME_CLASSES = {
    ("hold", "fraud"): "fraud_prevented",
    ("allow", "fraud"): "missed_fraud",
    ("review", "fraud"): "review_caught",
    ("hold", "legit"): "false_positive",
    ("review", "legit"): "review_friction",
    ("allow", "legit"): "normal",
}
SECURITY_ACTIONS = {"allow": "APPROVE", "review": "REQUEST_STEP_UP", "hold": "DECLINE"}
VERDICTS = {"allow": "APPROVED", "review": "MANUAL_REVIEW", "hold": "BLOCKED"}

# Audit ledger.
GENESIS = "GENESIS"

# Skew handling: an entity with more rows than this is cut into time slices.
HOT_ROWS = 2_000_000
