"""Learned scoring: models fitted on the train part, results for all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.operators import learned as L, metrics as M, priors, ranking as R, velocity as V
from tidewatch.plans.registry import query
from tidewatch.plans.sources import BOUNDS_SQL
from tidewatch.plans.sqltext import sql
from tidewatch.session import stored
from tidewatch.sources import cards

ID = "transaction_id"
ONLINE = C.ONLINE_COLUMNS
FULL = C.FULL_COLUMNS


def featured(t, history: bool = False):
    """Online (or full) features of every event, with split and label."""
    d = cards.with_split(t.txn(), cards.split_bounds(t.txn()))
    p = priors.fit(d.filter(F.col("split") == "train"))
    base = d.select(ID, "split", "is_fraud", "merchant_id", "merchant_category_code", *X.calendar_columns())
    out = priors.attach(base, p)
    return stored(priors.join_velocity(out, V.history_features(t.txn())) if history else out, "features")


def fitted(t, columns, frame):
    part = lambda s: frame.filter(F.col("split") == s)
    return L.train_gbt(part("train"), columns, validation=part("validation"))


@query("ml_train_gbt")
def _(t):
    """Trees on the full feature set: importance per feature (value and null part)."""
    f = featured(t, history=True)
    model, weight = fitted(t, FULL, f)
    imp = model.featureImportances.toArray().tolist()
    n = len(FULL)
    rows = [(c, float(imp[i] + imp[i + n]), weight) for i, c in enumerate(FULL)]
    return t.spark.createDataFrame(rows, "feature string, importance double, scale_pos_weight double")


@query("ml_score")
def _(t):
    f = featured(t)
    model, weight = fitted(t, ONLINE, f)
    return L.score(model, weight, f, ONLINE, 0.05, 0.02).select(ID, "split", "fraud_probability", "action")


@query("ml_checks", sql(
    "SELECT split, count(*) AS rows, count(*) AS banded, count(*) AS probable, "
    "(SELECT count(*) FILTER (is_fraud = 0) / greatest(count(*) FILTER (is_fraud = 1), 1) FROM sp WHERE split = 'train')::DOUBLE AS weight FROM sp GROUP BY 1", "txn", extra=BOUNDS_SQL))
def _(t):
    """What must hold of the scores whatever the trees: each row once, bands by the thresholds, probabilities, the weight."""
    f = featured(t)
    model, weight = fitted(t, ONLINE, f)
    s = L.score(model, weight, f, ONLINE, 0.05, 0.02)
    p = F.col("fraud_probability")
    band = F.when(p >= 0.05, "hold").when(p >= 0.02, "review").otherwise("allow")
    return s.groupBy("split").agg(F.count_distinct(ID).alias("rows"), F.count_if(F.col("action") == band).alias("banded"),
                                  F.count_if(p.between(0, 1)).alias("probable")).withColumn("weight", F.lit(weight))


@query("ml_stack")
def _(t):
    """Stacked signals: validation and test metrics of the stacker."""
    lines = stored(t.scores().select("seq", "split", "score", "amount", "is_fraud"), "scores")  # joined once, read twice
    s = lines.withColumn("noise", (F.col("seq") % 101) / F.lit(101.0)).withColumn(
        "anomaly", F.log1p("amount")).withColumn("is_fraud", F.col("is_fraud").cast("double"))
    cols = ["score", "noise", "anomaly"]
    train = s.filter(F.col("split") == "train").select(*cols, "is_fraud").persist()
    try:
        model = L.stack(train, cols, raw_signals=("anomaly",))
    finally:
        train.unpersist()
    from pyspark.ml.functions import vector_to_array
    out = model.transform(s.filter(F.col("split") != "train").select("split", *cols, "is_fraud")).withColumn("stacked", vector_to_array("probability")[1])
    return M.metrics_report(out, score="stacked").withColumn("frauds", F.col("frauds").cast("long"))


@query("ml_anomaly")
def _(t):
    f = featured(t)
    return L.anomaly(f.filter(F.col("split") == "train"), f, ONLINE, [ID, "split"])


@query("ml_what_if")
def _(t):
    """The smallest changes that make rows safe.

    Labels of the supplied tables follow no feature, so nothing that a model learns of them can be
    changed; the search runs on a model of a rule: large amounts (a tenth of the train part) online.
    """
    f = featured(t)
    large = R.nearest_rank(f.filter(F.col("split") == "train").select("amount_log1p"), "amount_log1p", [0.9]).first()["q0"]
    f = f.withColumn("is_fraud", ((F.col("amount_log1p") > F.lit(large)) & (F.col("channel_online") == 1)).cast("int"))
    model, weight = fitted(t, ONLINE, f)
    scored = L.score(model, weight, f, ONLINE, 0.05, 0.02)
    return L.what_if(model, weight, scored.filter(F.col("action") != "allow"), ONLINE, [ID]).select(
        ID, "rank", "feature", "from_value", "to_value", "proba", "proba_after", "distance", "statement")
