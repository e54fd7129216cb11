"""Learned scoring on Spark ML, and the what-if search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def statement(label: Column, before: Column, after: Column, p: Column, p_after: Column) -> Column:
    return F.format_string(
        "If this transaction's %s changed from %.2f to %.2f, the model's risk probability would drop from %.1f%% to %.1f%%.",
        label, before, after, p * 100, p_after * 100)


# Features a what-if may change, and their labels.
ACTIONABLE = {"amount_log1p": "transaction amount", "hour_sin": "time of day (sine)", "hour_cos": "time of day (cosine)"}
STEPS, STEP = 19, 0.05
SAFE_PROBABILITY = 0.001


def perturbation_grid(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Every row with each actionable feature lowered by 5 %..95 % of the row's scale.

    The grid is an array literal that is exploded, so no join is involved.
    """
    names = list(ACTIONABLE)
    scale = F.greatest(*[F.abs(n) for n in names], F.lit(1e-6))
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("step"))
                                for n in names for i in range(1, STEPS + 1)]))
    g = rows.withColumn("scale", scale).withColumn("g", steps)
    value = None
    for n in names:
        hit = F.col("g.feature") == n
        value = F.when(hit, F.col(n)) if value is None else value.when(hit, F.col(n))
    g = g.select("*", "g.feature", "g.step", value.alias("from_value")).drop("g")
    return g.withColumn("to_value", F.col("from_value") - F.col("step") * STEP * F.col("scale"))


def scorer(load):
    """An Arrow scorer over feature columns, given one after the other.

    `load()` returns a function (rows, features) -> probabilities; it is called
    once per worker task, so a model is read once and not per batch.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], axis=1)
            yield pd.Series(model(x) if len(x) else np.empty(0))

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


# -- boosted trees ----------------------------------------------------------

def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature vector with null indicators: unknown stays distinguishable from zero."""
    from pyspark.ml.feature import VectorAssembler

    from tidewatch.functions.expr import finite_or_null

    filled = df
    for c in columns:
        v = finite_or_null(F.col(c).cast("double"))
        filled = filled.withColumn(f"_x_{c}", F.coalesce(v, F.lit(0.0))).withColumn(f"_n_{c}", v.isNull().cast("double"))
    names = [f"_x_{c}" for c in columns] + [f"_n_{c}" for c in columns]
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled).drop(*names)


def best_prefix(losses: list[float], patience: int) -> int:
    """How many trees to keep: those up to the least loss that is met before `patience` trees in a row bring none."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_gbt(train: DataFrame, columns: list[str], label: str = "is_fraud", trees: int = 50, depth: int = 5,
              step: float = 0.1, seed: int = 42, validation: DataFrame | None = None, patience: int = 20):
    """Class-weighted boosted trees; returns (model, weight of a positive row).

    With rows in `validation` the first trees with the least weighted loss on them
    are kept: all `trees` are fitted, the loss after each is measured, and the model is
    fitted again with as many as `best_prefix` says (the same trees, as the seed is the
    same). The weight, negatives per positive, is that of the training rows.
    """
    from pyspark.ml.classification import GBTClassifier

    counts = F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")
    r = train.agg(*counts).first()
    w = float(r["n"]) / max(r["p"], 1)

    def vectors(df):
        return assemble(df, columns).select("features", F.col(label).cast("double").alias("label"),
                                            F.when(F.col(label) == 1, w).otherwise(1.0).alias("weight"))

    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
                        stepSize=step, seed=seed, subsamplingRate=0.9, checkpointInterval=10)
    data = vectors(train)
    model = gbt.fit(data)
    if validation is None or validation.isEmpty():
        return model, w
    keep = best_prefix(model.evaluateEachIteration(vectors(validation)), patience)
    return (model if keep == trees else gbt.copy({gbt.maxIter: keep}).fit(data)), w


def raw_probability(model, df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assemble(df, columns))
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score(model, weight: float, df: DataFrame, columns: list[str], hold: float, review: float) -> DataFrame:
    """Calibrated probability and band per row."""
    from tidewatch.functions import expr as X

    s = raw_probability(model, df, columns)
    return s.withColumn("fraud_probability", X.calibrate("raw", weight)).withColumn(
        "action", X.band("fraud_probability", hold, review)).drop("raw")


def stack(train: DataFrame, signals: list[str], raw_signals: tuple[str, ...] = (), label: str = "is_fraud"):
    """Logistic regression on logits of base scores; unbounded signals stay as they are."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    def term(c):
        p = f"least(greatest({c}, 1e-6), 1.0 - 1e-6)"
        return f"{c} AS _s_{c}" if c in raw_signals else f"ln({p} / (1.0 - {p})) AS _s_{c}"

    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(term(c) for c in signals) + " FROM __THIS__"),
              VectorAssembler(inputCols=[f"_s_{c}" for c in signals], outputCol="features"),
              LogisticRegression(featuresCol="features", labelCol=label, maxIter=200)]
    return Pipeline(stages=stages).fit(train)


def anomaly(train: DataFrame, df: DataFrame, columns: list[str], ids: list[str], k: int = 4) -> DataFrame:
    """Mean squared reconstruction error on train-standardised features.

    The train rows give means, deviations and principal components; those are
    a handful of numbers, and the error is a column expression.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    zero = lambda d: d.select(*[c for c in d.columns if c not in columns],
                              *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    train, df = zero(train), zero(df)
    s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = {c: (F.col(c) - float(s[f"m_{c}"])) / (float(s[f"s_{c}"]) if s[f"s_{c}"] >= 1e-6 else 1.0) for c in columns}
    scaled = train.select(*[z[c].alias(c) for c in columns])
    pca = PCA(k=k, inputCol="v", outputCol="p").fit(
        VectorAssembler(inputCols=columns, outputCol="v").transform(scaled))
    pc = pca.pc.toArray()  # columns x k
    proj = [sum((z[c] * float(pc[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"_p{j}") for j in range(k)]
    d = df.select(*ids, *[z[c].alias(f"_z_{c}") for c in columns], *proj)
    err = None
    for i, c in enumerate(columns):
        back = sum((F.col(f"_p{j}") * float(pc[i, j]) for j in range(k)), F.lit(0.0))
        sq = (F.col(f"_z_{c}") - back) * (F.col(f"_z_{c}") - back)
        err = sq if err is None else err + sq
    return d.select(*ids, (err / len(columns)).alias("anomaly_score"))


def what_if(model, weight: float, flagged: DataFrame, columns: list[str], ids: list[str], top: int = 3) -> DataFrame:
    """Per flagged row the smallest single-feature decreases that make it safe, nearest first.

    `flagged` holds `columns` and `fraud_probability`. Rows already safe are left out.
    """
    from pyspark.sql import Window

    from tidewatch.functions import expr as X

    rows = flagged.filter(F.col("fraud_probability") > SAFE_PROBABILITY).withColumnRenamed("fraud_probability", "proba")
    g = perturbation_grid(rows, ids)
    for n in ACTIONABLE:
        g = g.withColumn(n, F.when(F.col("feature") == n, F.col("to_value")).otherwise(F.col(n)))
    tried = raw_probability(model, g, columns).withColumn("proba_after", X.calibrate("raw", weight))
    safe = tried.filter(F.col("proba_after") <= SAFE_PROBABILITY)
    best = safe.groupBy(*ids, "feature").agg(F.min_by(
        F.struct("from_value", "to_value", "proba", "proba_after", (F.col("step") * STEP).alias("distance")), "step").alias("b"))
    out = best.select(*ids, "feature", "b.*")
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy("distance", "feature"))
    label = X.lookup("feature", ACTIONABLE, "feature")
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn(
        "statement", statement(label, F.col("from_value"), F.col("to_value"), F.col("proba"), F.col("proba_after")))
