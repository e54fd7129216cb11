"""Strictly-past velocity features and priors for every entity, in one sweep.

Each event leaves marks on its entity's timeline: one when it happens and one
when it leaves each sliding window. Running sums of the marks before an event,
in (time, sequence) order, are exactly the counts, amounts and distinct
merchants of the events that happened earlier and lie in `[t - w, t]`.
A running sum costs one step per mark, where a sliding frame would revisit the
whole window for every row. All entities share one shuffle for the sweep and
one to bring an event's features together.

Ties: equal times follow `seq`, then `transaction_id`; the later row sees the
earlier one. A window is closed on both ends, so leaving marks sort behind the
events of the same instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.operators import skew

EVENT = 0
#: Events of all entities that a sweep task gets on average; each leaves up to four marks.
EVENTS_PER_TASK = 250_000
KEYS = ["eid", "ent"]  # the id leads: it is what tells rows apart in the sort


def _labels(entities) -> list[str]:
    return list(dict.fromkeys(w.label for e in entities for w in e.windows))


def _distinct_labels(entities) -> list[str]:
    return list(dict.fromkeys(w.label for e in entities for w in e.windows if w.distinct))


def _base(txn: DataFrame, entities) -> DataFrame:
    ids = dict.fromkeys(e.id_col for e in entities)
    extra = {"merchant_id"} - set(ids) if _distinct_labels(entities) else set()
    return txn.select(
        "transaction_id", "seq", X.micros("event_time").alias("at"),
        X.money_units(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))).alias("amt"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in (*ids, *extra)])


def _with_first_seen(base: DataFrame, entity, code: int, hot: DataFrame | None, rows: int | None) -> DataFrame:
    """Neighbour times of the same (entity, merchant), for distinct counts."""
    plan = None
    if hot is not None:
        own = hot.filter(F.col("ent") == code).select(F.col("eid").alias(entity.id_col), "_hot")
        plan = skew.slice_plan(base, [entity.id_col], own, rows, F.col("at"), seq=F.col("seq"))
    out = skew.neighbours(base, [entity.id_col, "merchant_id"], "at", ["seq", "transaction_id"], plan, [entity.id_col])
    keep = [c for c in out.columns if c not in ("prev_at", "next_at", "_hot")]
    known = F.col("merchant_id").isNotNull()
    flags = []
    for w in entity.windows:
        if w.distinct:
            span = C.WINDOW_SECONDS[w.label] * 1_000_000
            enters = known & (F.col("prev_at").isNull() | (F.col("prev_at") < F.col("at") - span))
            leaves = known & (F.col("next_at").isNull() | (F.col("next_at") > F.col("at") + span))
            flags += [enters.cast("int").alias(f"{entity.name}_in_{w.label}"),
                      leaves.cast("int").alias(f"{entity.name}_out_{w.label}")]
    return out.select(*keep, *flags)


def _events(base: DataFrame, entities, distinct: list[str]) -> DataFrame:
    """One row per event and entity it names, with the distinct flags of that entity's windows."""

    def event(i, e):
        own = {w.label for w in e.windows if w.distinct}
        flags = [(F.col(f"{e.name}_{way}_{lab}") if lab in own else F.lit(0)).cast("byte").alias(f"{way}_{lab}")
                 for lab in distinct for way in ("in", "out")]
        return F.struct(F.col(e.id_col).alias("eid"), F.lit(i).cast("byte").alias("ent"), *flags)

    named = F.explode(F.array(*[event(i, e) for i, e in enumerate(entities)])).alias("e")
    return base.select("transaction_id", "seq", "at", "amt", named).select("e.*", "at", "seq", "transaction_id", "amt").filter(F.col("eid").isNotNull())


def _marks(events: DataFrame, entities, labels: list[str], distinct: list[str], cut: bool) -> DataFrame:
    """The marks of `_events`; with `cut` each keeps its event's seq, for an instant of leaving marks may have to be cut too.

    Marks are made row by row, so the placing of the events holds for them as well.
    """
    zero = F.lit(0).cast("byte")

    def mark(kind, at, flags):
        return F.struct(F.lit(kind).cast("byte").alias("kind"), at.alias("at"),
                        *[flags.get(lab, zero).alias(f"f_{lab}") for lab in distinct])

    entering = mark(EVENT, F.col("at"), {lab: F.col(f"in_{lab}") for lab in distinct})
    of_entity = None
    for i, e in enumerate(entities):
        own = F.array(entering, *[
            mark(1 + labels.index(w.label), F.col("at") + C.WINDOW_SECONDS[w.label] * 1_000_000,
                 {w.label: F.col(f"out_{w.label}")} if w.distinct else {}) for w in e.windows])
        of_entity = F.when(F.col("ent") == i, own) if of_entity is None else of_entity.when(F.col("ent") == i, own)
    made = events.withColumn("m", F.explode(of_entity))
    is_event = F.col("m.kind") == EVENT
    return made.select(
        *KEYS, "m.*", "amt", (F.col("seq") if cut else F.when(is_event, F.col("seq"))).alias("seq"),
        F.when(is_event, F.col("transaction_id")).alias("transaction_id"), (F.col("m.kind") != EVENT).cast("byte").alias("leaves"))


def entity_rows(base: DataFrame, entities) -> DataFrame:
    """(eid, ent) once per event and entity."""
    ids = base.select(F.explode(F.array(*[
        F.struct(F.col(e.id_col).alias("eid"), F.lit(i).cast("byte").alias("ent"))
        for i, e in enumerate(entities)])).alias("k"))
    return ids.select("k.*").filter(F.col("eid").isNotNull())


def find_hot(base: DataFrame, entities, hot_rows: int | None) -> tuple[DataFrame | None, int]:
    """The hot entities, or None when the counting pass finds none; and the number of sweep tasks.

    The counting pass reads the id columns only and is partial before its
    shuffle; when no entity is hot the sweep needs no slices at all. It also counts
    the events. The number of tasks is asked for by number, because Spark would merge
    partitions by the bytes of the shuffled events, which grow several times behind it.
    """
    spark = base.sparkSession
    if hot_rows is None:
        return None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    hot = skew.find_hot(entity_rows(base, entities).observe(seen, F.count(F.lit(1)).alias("n")), KEYS, hot_rows)
    return hot, max(spark.sparkContext.defaultParallelism, -(-seen.get["n"] // EVENTS_PER_TASK))


def velocity_features(txn: DataFrame, entities: tuple[C.Entity, ...] = C.CATALOGUE,
                      hot_rows: int | None = C.HOT_ROWS) -> DataFrame:
    """One row per transaction: velocity and prior features, strictly past.

    Needs `transaction_id, seq, event_time, amount` and the id columns. An
    event without an id for an entity gets null for that entity's features.
    First event of an entity: count 0, mean 0, gap 0, ratio 1.
    An entity with more than `hot_rows` events is cut into slices of at most as
    many marks; `hot_rows=None` skips the search for hot entities.
    """
    labels, distinct = _labels(entities), _distinct_labels(entities)
    base = _base(txn, entities)
    hot, tasks = find_hot(base, entities, hot_rows)
    for i, e in enumerate(entities):
        if any(w.distinct for w in e.windows):
            base = _with_first_seen(base, e, i, hot, hot_rows)

    events = _events(base, entities, distinct)
    order = F.col("at"), F.col("leaves"), F.col("seq")
    if hot is None:
        # Only events are shuffled; the marks they leave stay where the event is.
        shuffled = _marks(events.repartition(tasks, *KEYS), entities, labels, distinct, False).withColumn(skew.SLICE, F.lit(0).cast("long"))
    else:
        marks = _marks(events, entities, labels, distinct, True)
        plan = skew.slice_plan(marks, KEYS, hot, hot_rows, *order)
        shuffled = skew.with_slices(marks, KEYS, plan, *order).repartition(tasks, *KEYS, skew.SLICE)
    is_event = F.col("kind") == EVENT
    delta = {"n_all": is_event.cast("long"), "a_all": F.when(is_event, F.col("amt")).otherwise(F.lit(0))}
    for i, lab in enumerate(labels):
        has = F.col("ent").isin(*[k for k, e in enumerate(entities) if lab in [w.label for w in e.windows]])
        sign = F.when(is_event & has, 1).when(F.col("kind") == 1 + i, -1).otherwise(0)
        delta[f"n_{lab}"] = sign.cast("long")
        delta[f"a_{lab}"] = sign * F.col("amt")
    for lab in distinct:
        i = labels.index(lab)
        delta[f"d_{lab}"] = (F.when(is_event, F.col(f"f_{lab}"))
                             .when(F.col("kind") == 1 + i, -F.col(f"f_{lab}")).otherwise(0)).cast("long")
    # The narrow marks are sorted first; the deltas are made behind that. The slice totals
    # below read the same shuffle, so both carry the same columns. Without hot keys the slice
    # is a constant, which the optimiser takes out of the window: the keys alone place all.
    place = [*KEYS, skew.SLICE] if hot is not None else list(KEYS)
    placed = shuffled.sortWithinPartitions(*place, "at", "leaves", "seq", "transaction_id")
    flag = ["_hot"] if hot is not None else []
    before = (Window.partitionBy(*place)
              .orderBy("at", "leaves", "seq", "transaction_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    swept = placed.select(
        *KEYS, skew.SLICE, *flag, "at", "kind", "transaction_id", "amt",
        *[F.coalesce(F.sum(d).over(before), F.lit(0)).alias(n) for n, d in delta.items()],
        F.last(F.when(is_event, F.col("at")), ignorenulls=True).over(before).alias("prev_at"),
        F.last(F.when(is_event, F.col("amt")), ignorenulls=True).over(before).alias("prev_amt"),
    ).filter(is_event)

    if hot is not None:
        newest = F.when(is_event, F.struct("at", "leaves", "seq", "transaction_id", "amt"))
        base_rows = skew.carried(
            shuffled, KEYS,
            {**{n: F.sum(d) for n, d in delta.items()}, "newest": F.max(newest)},
            {**{f"b_{n}": F.sum(n) for n in delta},
             "b_prev": F.last("newest", ignorenulls=True)})
        swept = swept.join(base_rows, [*KEYS, skew.SLICE], "left")
        for n in delta:
            swept = swept.withColumn(n, F.col(n) + F.when(F.col("_hot"), F.coalesce(F.col(f"b_{n}"), F.lit(0))).otherwise(0))
        swept = (swept.withColumn("prev_at", F.coalesce("prev_at", "b_prev.at"))
                 .withColumn("prev_amt", F.coalesce("prev_amt", "b_prev.amt")))

    amt, prev_amt = F.col("amt"), F.col("prev_amt")
    gap = F.greatest(F.col("at") - F.col("prev_at"), F.lit(0)) / F.lit(1e6)
    prior = {
        "txn_count_prior": F.col("n_all").cast("double"),
        "amount_mean_prior": F.when(F.col("n_all") > 0, F.col("a_all") / C.MONEY_SCALE / F.col("n_all"))
        .otherwise(0.0),
        "time_since_prev_log": F.when(F.col("prev_at").isNotNull(), F.log1p(gap)).otherwise(0.0),
        "prev_amount_ratio": F.when(prev_amt > 0, F.least(F.greatest(amt / prev_amt, F.lit(0.0)), F.lit(50.0)))
        .otherwise(1.0),
    }
    values = {}
    for i, e in enumerate(entities):
        own = F.col("ent") == i
        for w in e.windows:
            values[f"{e.name}_v_{w.label}_count"] = F.max(F.when(own, F.col(f"n_{w.label}").cast("double")))
            if w.amount:
                values[f"{e.name}_v_{w.label}_amount"] = F.max(
                    F.when(own, F.col(f"a_{w.label}") / F.lit(float(C.MONEY_SCALE))))
            if w.distinct:
                values[f"{e.name}_v_{w.label}_distinct_merchants"] = F.max(
                    F.when(own, F.col(f"d_{w.label}").cast("double")))
        for p in e.priors:
            values[f"{e.name}_{p}"] = F.max(F.when(own, prior[p]))
    names = C.velocity_feature_names(entities) + C.prior_feature_names(entities)
    return swept.groupBy("transaction_id").agg(*[values[n].alias(n) for n in names])


def history_features(txn: DataFrame, hot_rows: int | None = C.HOT_ROWS, entities: tuple[C.Entity, ...] = C.CATALOGUE) -> DataFrame:
    """Batch form of the priors of `entities`: unknown is null, gaps are log1p(gap + 1).

    Per entity: null gap and mean on the first row, mean clipped to [0, 1e7],
    ratio to the previous amount clipped to [0, 50] (50 when a positive amount
    follows zero).
    """
    entities = tuple(C.Entity(e.name, e.id_col, (), e.priors) for e in entities if e.priors)
    raw = raw_priors(txn, entities, hot_rows)
    out = ["transaction_id"]
    for e in entities:
        n, a, pa, pt = (F.col(f"{e.name}_{c}") for c in ("n", "a", "prev_amt", "prev_at"))
        gap = F.greatest(F.floor((F.col("at") - pt) / 1_000_000), F.lit(0))
        forms = {
            "txn_count_prior": n.cast("double"),
            "amount_mean_prior": F.when(n > 0, F.least(F.greatest(
                a / F.lit(float(C.MONEY_SCALE)) / n, F.lit(0.0)), F.lit(1e7))),
            "time_since_prev_log": F.when(pt.isNotNull(), F.log1p(gap + 1)),
            "prev_amount_ratio": F.when(pa.isNull(), None).when(
                pa == 0, F.when(F.col("amt") > 0, 50.0).when(F.col("amt") < 0, 0.0)).otherwise(
                F.least(F.greatest(F.col("amt") / F.when(pa != 0, pa), F.lit(0.0)), F.lit(50.0))),
        }
        out += [forms[p].alias(f"{e.name}_{p}") for p in e.priors]
    return raw.select(*out)


def raw_priors(txn: DataFrame, entities, hot_rows: int | None) -> DataFrame:
    """Per transaction and entity: earlier count, earlier sum, previous amount and time."""
    base = _base(txn, entities)
    hot, tasks = find_hot(base, entities, hot_rows)
    long = base.select("transaction_id", "seq", "at", "amt", F.explode(F.array(*[
        F.struct(F.col(e.id_col).alias("eid"), F.lit(i).cast("byte").alias("ent"))
        for i, e in enumerate(entities)])).alias("k"))
    long = long.select("k.*", "transaction_id", "seq", "at", "amt").filter(F.col("eid").isNotNull())
    plan = skew.slice_plan(long, KEYS, hot, hot_rows, F.col("at"), seq=F.col("seq"))
    s = skew.with_slices(long, KEYS, plan, F.col("at"), seq=F.col("seq")).repartition(
        tasks, *KEYS, *([skew.SLICE] if hot is not None else []))
    before = (Window.partitionBy(*KEYS, skew.SLICE).orderBy("at", "seq", "transaction_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    r = s.select(*KEYS, skew.SLICE, "transaction_id", "at", "amt",
                 F.count("amt").over(before).alias("n"),
                 F.coalesce(F.sum("amt").over(before), F.lit(0)).alias("a"),
                 F.last("at").over(before).alias("prev_at"),
                 F.last("amt").over(before).alias("prev_amt"))
    if hot is not None:
        base_rows = skew.carried(
            s, KEYS,
            {"n": F.count("amt"), "a": F.sum("amt"),
             "newest": F.max(F.struct("at", "seq", "transaction_id", "amt"))},
            {"b_n": F.sum("n"), "b_a": F.sum("a"), "b_prev": F.last("newest")})
        r = (r.join(base_rows, [*KEYS, skew.SLICE], "left")
             .withColumn("n", F.col("n") + F.coalesce("b_n", F.lit(0)))
             .withColumn("a", F.col("a") + F.coalesce("b_a", F.lit(0)))
             .withColumn("prev_at", F.coalesce("prev_at", "b_prev.at"))
             .withColumn("prev_amt", F.coalesce("prev_amt", "b_prev.amt")))
    aggs = [F.max("at").alias("at"), F.max("amt").alias("amt")]
    for i, e in enumerate(entities):
        own = F.col("ent") == i
        aggs += [F.max(F.when(own, F.col(c))).alias(f"{e.name}_{c}")
                 for c in ("n", "a", "prev_amt", "prev_at")]
    return r.groupBy("transaction_id").agg(*aggs)
