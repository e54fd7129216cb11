"""Drift: monthly windows, PSI, mean shift, EWMA, CUSUM, Page-Hinkley, ADWIN.

Rows are reduced to one line per month or bin first. The recursive detectors
then fold over a series that is as long as the calendar, not as the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import ranking as R
from tidewatch.session import stored


def window_stats(scores: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Per month: rows, mean and population std of the score, fraud rate, frauds."""
    return scores.groupBy(X.month_label("event_time").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"), F.avg(label).alias("fraud_rate"), F.sum(label).alias("frauds"))


def reference_stats(scores: DataFrame, months: int = 3, score: str = "score") -> DataFrame:
    """The last `months` train months: pooled mean and std of the monthly means."""
    per = (scores.filter(F.col("split") == "train").groupBy(X.month_label("event_time").alias("month"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s")))
    tail = per.orderBy(F.desc("month")).limit(months)
    return tail.agg(F.min("month").alias("first_month"), F.count(F.lit(1)).alias("months"),
                    F.sum("n").alias("ref_rows"), (F.sum("s") / F.sum("n")).alias("ref_mean"),
                    F.greatest(F.stddev_pop(F.col("s") / F.col("n")), F.lit(1e-9)).alias("ref_std"))


# -- population stability ---------------------------------------------------

def bin_edges(reference: DataFrame, value: str, keys: list[str] | None = None, bins: int = C.PSI_BINS,
              rows: Column | None = None) -> DataFrame:
    """Inner quantile edges of the reference per key, array column `edges`."""
    q = R.quantiles(reference, value, [i / bins for i in range(1, bins)], keys, rows=rows)
    return q.withColumnRenamed("q", "edges").drop("n")


def quantile_sketches(df: DataFrame, value: str, by: list[str], k: int = 400) -> DataFrame:
    """One KLL sketch of `value` per group of `by` (months, parts): a few KB a row, to be stored and merged.

    The rank of an estimated quantile is off by about 1.33 % at k = 200 and half as
    much at twice the k, whatever the rows; `quantiles` of the ranking module stays exact.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: list[float], by: list[str] | None = None, k: int = 400) -> DataFrame:
    """Estimated quantiles `q` and rows `n` over many sketches, without a second read of their rows."""
    one = sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_all"))
    q = F.array(*[F.kll_sketch_get_quantile_double("_all", F.lit(float(p))) for p in probs])
    return one.select(*(by or []), F.kll_sketch_get_n_double("_all").alias("n"), q.alias("q"))


def sketched_edges(sketches: DataFrame, by: list[str] | None = None, bins: int = C.PSI_BINS) -> DataFrame:
    """`bin_edges` from stored sketches: inner quantile edges per key."""
    return merged_quantiles(sketches, [i / bins for i in range(1, bins)], by).withColumnRenamed("q", "edges").drop("n")


def bin_of(value: str, edges: str = "edges") -> Column:
    """Bins are closed below; equal edges leave the bins between them empty."""
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def bin_number(value: str, edges: list[float]) -> Column:
    """The same bin from known edges, as plain comparisons inside generated code."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.col(value) >= F.lit(float(e))).cast("int")
    return out


def psi_of_counts(ref: str, obs: str) -> Column:
    """PSI of two arrays of bin counts; null when a side is empty."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda c, t: F.greatest(c / t, F.lit(C.PSI_FLOOR))
    rt, ot = total(ref), total(obs)
    terms = F.zip_with(ref, obs, lambda r, o: (share(o, ot) - share(r, rt)) * F.log(share(o, ot) / share(r, rt)))
    return F.when((rt > 0) & (ot > 0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def histogram(df: DataFrame, value: str, edges: DataFrame, groups: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows per (keys, groups, bin). Edges: one short array per key."""
    keys = keys or []
    j = df.join(F.broadcast(edges), keys) if keys else attach_row(df, edges)
    return (j.withColumn("bin", bin_of(value)).groupBy(*keys, *groups, "bin")
            .agg(F.count(F.lit(1)).alias("n")))


def psi(ref_hist: DataFrame, obs_hist: DataFrame, groups: list[str], keys: list[str] | None = None,
        bins: int = C.PSI_BINS) -> DataFrame:
    """Population stability index per (keys, groups) against the keys' reference."""
    keys = keys or []

    def shares(h, cols, name):
        total = F.sum("n").over(Window.partitionBy(*cols))
        return h.select(*cols, "bin", (F.col("n") / total).alias(name))

    ref = shares(ref_hist, keys, "r")
    obs = shares(obs_hist, [*keys, *groups], "o")
    grid = obs.select(*keys, *groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(obs, [*keys, *groups, "bin"], "left").join(ref, [*keys, "bin"], "left")
    o = F.greatest(F.coalesce("o", F.lit(0.0)), F.lit(C.PSI_FLOOR))
    r = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(C.PSI_FLOOR))
    return full.groupBy(*keys, *groups).agg(F.sum((o - r) * F.log(o / r)).alias("psi"))


def mean_shift_z(ref_mean, ref_std, obs_mean, obs_n) -> Column:
    """Standard errors between the observed and the reference mean."""
    se = X.as_col(ref_std) / F.greatest(F.sqrt(F.greatest(X.as_col(obs_n), F.lit(1))), F.lit(1e-9))
    return (X.as_col(obs_mean) - X.as_col(ref_mean)) / F.greatest(se, F.lit(1e-9))


def unpivot_features(df: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """(ids, feature, value) with finite values only."""
    long = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ids, features, "feature", "value")
    return long.withColumn("value", X.finite_or_null("value")).filter(F.col("value").isNotNull())


def feature_drift(reference: DataFrame, observed: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: means, PSI and z of observed against reference."""
    both = reference.select(*features, F.lit(True).alias("is_ref")).unionByName(
        observed.select(*features, F.lit(False).alias("is_ref")))
    # The only pass over the rows: equal values are merged, and all that follows reads them.
    long = stored(unpivot_features(both, features, ["is_ref"]).groupBy("feature", "is_ref", "value")
                  .agg(F.count(F.lit(1)).alias("n")), "feature-values")
    edges = {r["feature"]: r["edges"] for r in bin_edges(
        long.filter("is_ref"), "value", ["feature"], rows=F.sum("n")).collect()}  # nine numbers per feature
    number = F.coalesce(*[F.when(F.col("feature") == f, bin_number("value", edges.get(f, []))) for f in features])
    means = long.groupBy("feature", "is_ref").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    off = F.col("value") - F.col("mean")
    per = long.join(F.broadcast(means), ["feature", "is_ref"]).groupBy("feature", "is_ref", number.alias("bin")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * off * off).alias("squares"), F.first("mean").alias("mean"))
    sides = per.groupBy("feature", "is_ref").agg(
        F.sum("rows").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.sum("squares") / F.sum("rows")).alias("std"),
        F.array(*[F.coalesce(F.max(F.when(F.col("bin") == i, F.col("rows"))), F.lit(0)) for i in range(C.PSI_BINS)]).alias("h"))
    row = sides.groupBy("feature").agg(*[
        F.max(F.when(F.col("is_ref") == flag, F.col(c))).alias(f"{p}_{c}")
        for flag, p in ((True, "r"), (False, "o")) for c in ("n", "mean", "std", "h")])
    return row.select("feature", F.col("r_mean").alias("ref_mean"), F.col("o_mean").alias("obs_mean"),
                      psi_of_counts("r_h", "o_h").alias("psi"), mean_shift_z("r_mean", "r_std", "o_mean", "o_n").alias("z"))


def feature_shift(rows: DataFrame, is_reference: Column, features: list[str], weight: str | None = None) -> DataFrame:
    """z of observed against reference means, one row per feature, as in `feature_drift` but without PSI and its edges.

    `is_reference` is null for rows of neither side. With `weight` a row stands for so many; such
    a table is read twice, so pass a short one.
    """
    finite = {f: X.finite_or_null(F.col(f).cast("double")) for f in features}
    sides = {"r": is_reference, "o": ~is_reference}
    n = F.lit(1) if weight is None else F.col(weight)
    figures = []
    for f, x in finite.items():
        for side, flag in sides.items():
            mine = F.when(flag, x)
            total = F.sum(F.when(mine.isNotNull(), n))
            figures += [total.alias(f"{side}_n_{f}"), (F.avg(mine) if weight is None else F.sum(n * mine) / total).alias(f"{side}_mean_{f}")]
        if weight is None:
            figures.append(F.stddev_pop(F.when(is_reference, x)).alias(f"r_std_{f}"))
    moments = rows.agg(*figures)
    if weight is not None:
        off = {f: F.when(is_reference, x) - F.col(f"r_mean_{f}") for f, x in finite.items()}
        spread = attach_row(rows, moments.select(*[f"r_mean_{f}" for f in features])).agg(*[
            F.sqrt(F.sum(n * d * d) / F.sum(F.when(d.isNotNull(), n))).alias(f"r_std_{f}") for f, d in off.items()])
        moments = attach_row(moments, spread)
    names = ("r_n", "o_n", "r_mean", "o_mean", "r_std")
    each = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{c}_{f}").alias(c) for c in names]) for f in features])
    row = moments.select(F.explode(each).alias("f")).select("f.*").filter((F.col("r_n") > 0) | (F.col("o_n") > 0))
    return row.select("feature", mean_shift_z("r_mean", "r_std", "o_mean", "o_n").alias("z"))


def retrain_trigger(drift_table: DataFrame, groups: list[str] | None = None, psi_warn: float = C.PSI_WARN,
                    z_warn: float = C.Z_WARN) -> DataFrame:
    """YES with culprits when any feature moved; one row per group.

    The table holds one row per monitored feature, so the lists are short.
    """
    culprit = (F.col("psi") > psi_warn) | (F.abs("z") > z_warn)
    out = drift_table.groupBy(*(groups or [])).agg(
        F.least(F.greatest(F.avg(F.coalesce("psi", F.lit(0.0))), F.lit(0.0)), F.lit(2.0)).alias("score"),
        F.count(F.lit(1)).alias("n_features"),
        F.sort_array(F.collect_list(F.when(culprit, F.col("feature")))).alias("culprits"))
    n = F.size("culprits")
    return out.withColumn("score", F.round("score", 4)).withColumn("n_culprits", n).withColumn(
        "trigger", F.when(n > 0, "YES").otherwise("NO")).withColumn(
        "reasons", F.when(n > 0, F.array(
            F.concat(n.cast("string"), F.lit(" feature(s) drifted: "), F.array_join("culprits", ", ")),
            F.lit("feature-level drift detected; retrain to recover ranking power"))).otherwise(F.array().cast("array<string>")))


def merge_triggers(triggers: DataFrame) -> DataFrame:
    """Several windows' triggers as one: any YES, highest score, each culprit once."""
    return triggers.agg(
        F.when(F.max(F.col("trigger") == "YES"), "YES").otherwise("NO").alias("trigger"),
        F.max("score").alias("score"), F.sum("n_culprits").alias("n_culprits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("culprits")))).alias("culprits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def retrain_belief(memory: DataFrame, drift_table: DataFrame) -> DataFrame:
    """YES when a feature moved far (peak |z| > 3) or retraining has mostly helped."""
    belief = memory.agg(F.coalesce(F.avg("outcome"), F.lit(0.5)).alias("belief"))
    peak = drift_table.agg(F.max(F.abs("z")).alias("peak_z"))
    return attach_row(belief, peak).withColumn(
        "recommend", F.when((F.col("peak_z") > C.Z_WARN) | (F.col("belief") > 0.5), "YES").otherwise("NO"))


# -- folds over short ordered series ----------------------------------------

def ordered_series(points: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """One row per key with the series as an array; the points are calendar windows."""
    return points.groupBy(*(keys or [])).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x")))).alias("s"))


def ewma(s: Column, span: float) -> Column:
    """Array of exponentially weighted means, seeded by the first value."""
    alpha = 2.0 / (span + 1.0)
    return F.aggregate(
        s, F.array().cast("array<double>"),
        lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) == 0, p["x"]).otherwise(
            F.lit(alpha) * p["x"] + F.lit(1.0 - alpha) * F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))))))


def cusum(s: Column, mean: Column, std: Column, k: float = 0.5, h: float = 5.0) -> Column:
    """Array of (chart, fired): two-sided sums of standardised deviations, reset when fired."""
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"),
                     F.array().cast("array<struct<chart:double,fired:boolean>>").alias("out"))

    def step(acc, p):
        z = (p["x"] - mean) / F.greatest(std, F.lit(1e-9))
        pos, neg = F.greatest(F.lit(0.0), acc["pos"] + z - k), F.greatest(F.lit(0.0), acc["neg"] - z - k)
        fired = (pos > h) | (neg > h)
        pos, neg = F.when(fired, 0.0).otherwise(pos), F.when(fired, 0.0).otherwise(neg)
        return F.struct(pos.alias("pos"), neg.alias("neg"), F.concat(
            acc["out"], F.array(F.struct(F.greatest(pos, neg).alias("chart"), fired.alias("fired")))).alias("out"))

    return F.aggregate(s, start, step, lambda acc: acc["out"])


def page_hinkley(s: Column, reference: Column, delta: Column, lamb: Column) -> Column:
    """Array of booleans: where the rise above the reference was declared (then reset)."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"), F.array().cast("array<boolean>").alias("out"))

    def step(acc, p):
        total = acc["sum"] + (p["x"] - reference - delta)
        low = F.least(acc["low"], total)
        fired = (total - low) > lamb
        return F.struct(F.when(fired, 0.0).otherwise(total).alias("sum"), F.when(fired, 0.0).otherwise(low).alias("low"),
                        F.concat(acc["out"], F.array(fired)).alias("out"))

    return F.aggregate(s, start, step, lambda acc: acc["out"])


def adwin_fired(s: Column, delta: float = 0.01, max_bucket: int = 64, min_cut: int = 3) -> Column:
    """Array of booleans: where an adaptive window over the series `s` of (at, x) drops its older part.

    The window keeps at most 2 * max_bucket values; the earliest cut whose halves
    differ by more than the Hoeffding bound removes what lies before it. Running
    totals make every mean one difference, and the fold carries the window's start.
    """
    totals = F.aggregate(s, F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["x"])))
    both = F.struct(totals.alias("t"), F.sequence(F.lit(1), F.size(s)).alias("ends"))
    scale = 2.0 * math.log(2.0 / delta)

    def fold(b):
        start = F.struct(F.lit(0).alias("from"), F.array().cast("array<boolean>").alias("out"))

        def step(acc, end):
            low = F.greatest(acc["from"], end - 2 * max_bucket)
            n = end - low
            left = lambda c: (F.get(b["t"], low + c) - F.get(b["t"], low)) / c
            right = lambda c: (F.get(b["t"], end) - F.get(b["t"], low + c)) / (n - c)
            cuts = F.when(n > min_cut, F.sequence(F.lit(min_cut), F.greatest(n - 1, F.lit(min_cut)))).otherwise(F.array().cast("array<int>"))
            cut = F.array_min(F.filter(cuts, lambda c: F.abs(left(c) - right(c)) > F.sqrt(scale * (1.0 / c + 1.0 / (n - c)))))
            return F.struct((low + F.coalesce(cut, F.lit(0))).alias("from"), F.concat(acc["out"], F.array(cut.isNotNull())).alias("out"))

        return F.aggregate(b["ends"], start, step, lambda acc: acc["out"])

    # the totals are bound once, as the element of an array of one
    return F.when(F.size(s) > 0, F.element_at(F.transform(F.array(both), fold), 1)).otherwise(F.array().cast("array<boolean>"))


def adwin(series: DataFrame, keys: list[str], delta: float = 0.01, max_bucket: int = 64, min_cut: int = 3) -> DataFrame:
    """(keys, i, x, fired) from one row per key with array column `s` of (at, x).

    `max_bucket` and `min_cut` are those of `adwin_fired`: the window's length is
    part of the method.
    """
    fired = adwin_fired(F.col("s"), delta, max_bucket, min_cut)
    each = series.select(*keys, F.posexplode(F.arrays_zip(F.transform("s", lambda p: p["x"]).alias("x"), fired.alias("fired"))).alias("i", "e"))
    return each.select(*keys, "i", "e.x", "e.fired")


def calibrate_detector(s: Column) -> dict[str, Column]:
    """Reference mean, delta and lambda from the first max(2, n // 16) points."""
    warm = F.greatest(F.lit(2), F.least(F.size(s), F.floor(F.size(s) / 16).cast("int")))
    ref = F.transform(F.slice(s, 1, warm), lambda p: p["x"])
    n = F.size(ref)
    mean = F.aggregate(ref, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(ref, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    std = F.greatest(F.sqrt(var), F.lit(1e-6))
    return {"baseline": mean, "delta": F.greatest(2.0 * std, mean * 0.25), "lamb": 6.0 * std, "warm": warm}


def monitor_report(scores: DataFrame, reference_months: int = 3, span: float = 3.0, k: float = 0.5,
                   h: float = 5.0, score: str = "score") -> DataFrame:
    """Every month after train against the last train months: z, PSI, EWMA, CUSUM."""
    ref = reference_stats(scores, reference_months, score).first()
    if ref["months"] < reference_months:
        raise ValueError("not enough train windows for a reference tail")
    month = X.month_label("event_time")
    used = (scores.filter((F.col("split") != "train") | (month >= ref["first_month"]))
            .select(F.when(F.col("split") != "train", month).alias("month"), F.col(score).alias("score"),
                    "is_fraud", X.logit(score).alias("lg")))
    edges = bin_edges(used.filter(F.col("month").isNull()), "lg").first()["edges"]
    b = bin_number("lg", edges)
    # One pass: the reference tail is the group without a month.
    per = used.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        F.avg("is_fraud").alias("fraud_rate"), F.sum("is_fraud").alias("frauds"),
        F.array(*[F.count_if(b == i) for i in range(C.PSI_BINS)]).alias("h"))
    series = per.agg(F.max_by("h", F.when(F.col("month").isNull(), 1)).alias("ref_h"), F.array_sort(F.collect_list(F.when(
        F.col("month").isNotNull(), F.struct(F.col("month").alias("at"), F.col("mean_score").alias("x"), "rows", "std_score",
                                             "fraud_rate", "frauds", "h")))).alias("s"))  # one row per month
    mean, std = F.lit(float(ref["ref_mean"])), F.lit(float(ref["ref_std"]))
    rows = series.select("ref_h", F.explode(F.arrays_zip(
        F.col("s"), ewma(F.col("s"), span).alias("e"), cusum(F.col("s"), mean, std, k, h).alias("c"))).alias("f"))
    rows = rows.select("ref_h", "f.s.*", F.col("f.e").alias("ewma_mean_score"), F.col("f.c.chart").alias("cusum_stat"),
                       F.col("f.c.fired").alias("cusum_fired"))
    return rows.select(
        F.col("at").alias("month"), "rows", F.col("x").alias("mean_score"), "std_score", "fraud_rate", "frauds",
        ((F.col("x") - mean) / std).alias("z_mean_score"), psi_of_counts("ref_h", "h").alias("psi"),
        "ewma_mean_score", "cusum_stat", "cusum_fired")


def first_alerts(report: DataFrame) -> DataFrame:
    return report.agg(F.min(F.when(F.col("cusum_fired"), F.col("month"))).alias("cusum_first_alert_month"),
                      F.min(F.when(F.col("psi") > C.PSI_WARN, F.col("month"))).alias("psi_first_alert_month"))


def auto_switch(points: DataFrame, order: str, value: str, candidates: DataFrame, serving: str) -> DataFrame:
    """One decision row: first firing index of each detector, and whether to switch.

    `candidates` is the ranked registry (rank 1 is best) against the degraded bar.
    """
    s = ordered_series(points, order, value)
    cal = calibrate_detector(F.col("s"))
    s = s.select("s", *[c.alias(n) for n, c in cal.items()])
    ph = s.select("baseline", "delta", "lamb", (F.array_position(
        page_hinkley(F.col("s"), F.col("baseline"), F.col("delta"), F.col("lamb")), True) - 1).alias("p"))
    ph = ph.select("baseline", "delta", "lamb", F.when(F.col("p") >= 0, F.col("p")).alias("page_hinkley_at"))
    aw = adwin(s.withColumn("series", F.lit(0)), ["series"]).agg(
        F.min(F.when(F.col("fired"), F.col("i"))).alias("adwin_at"))
    best = candidates.agg(F.min_by("name", "rank").alias("to_model"))
    d = attach_row(attach_row(ph, aw), best)
    drift = F.col("page_hinkley_at").isNotNull() | F.col("adwin_at").isNotNull()
    go = drift & F.col("to_model").isNotNull() & (F.col("to_model") != serving)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return d.select(
        go.alias("triggered"), "page_hinkley_at", F.col("adwin_at").cast("long").alias("adwin_at"),
        "baseline", "delta", "lamb", F.when(go, F.lit(serving)).alias("from_model"),
        F.when(go, F.col("to_model")).alias("to_model"),
        F.when(~drift, "no drift detected; serving model remains in place")
        .when(go, F.concat(F.lit("drift detected (page-hinkley="), said("page_hinkley_at"), F.lit(", adwin="),
                           said("adwin_at"), F.lit("); promoting "), F.col("to_model"), F.lit(f" over {serving}")))
        .otherwise("drift detected but no candidate beats the serving model; no switch warranted").alias("reason"))
