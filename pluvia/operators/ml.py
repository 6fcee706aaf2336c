"""Models of rain amount and extreme-rain risk on Spark ML, calibration and scoring."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.config import StudyConfig
from pluvia.operators import metrics, splits
from pluvia.operators.storage import dealt, materialise

CFG = StudyConfig()
#: Trees of a boosted model unless the caller says otherwise.
TREES = 200


# ------------------------------------------------------------------- feature vectors
def with_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_ausente": F.col(c).isNull().cast("double") for c in columns})


def vector_stages(columns: Sequence[str], flags: bool = True) -> list:
    """Mean imputation, missing flags and assembly; Spark ML takes no NULL features."""
    filled = [f"{c}_cheio" for c in columns]
    extra = [f"{c}_ausente" for c in columns] if flags else []
    return [
        Imputer(inputCols=list(columns), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled + extra, outputCol="features"),
    ]


def as_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature columns as doubles with their missing flags, plus the kept columns.

    A feature without any value becomes 0 with its flag set, so that the imputer can fit.
    """
    typed = df.select(
        *keep,
        *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c)
          for c in columns if c not in keep],
    )
    return with_missing_flags(typed, columns)


def drop_empty(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Features with at least one value; one aggregation, one row to the driver."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]


def at_once(spark: SparkSession, calls: Sequence[Callable], concurrent: int | None = None) -> list:
    """What independent calls return, in their order; a failed call fails all.

    Their jobs are jobs of one session. A boosted model is a thousand short jobs one after the other; another
    model's tasks run while the driver prepares the next of them.
    """
    # A thread of its own JVM thread each, with the caller's local properties.
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, concurrent or len(calls))) as pool:
        return [f.result() for f in [pool.submit(inherit(call)) for call in calls]]


# ------------------------------------------------------------------------- estimators
def rain_regressor(kind: str = "tweedie", target: str = "chuva_futura_24h", **params):
    """Regressor of the 24 h amount for a target with many zeros.

    ``tweedie`` is a log-link GLM with variance power 1.5, ``gbt`` boosted trees.
    """
    if kind == "tweedie":
        return GeneralizedLinearRegression(
            family="tweedie", variancePower=CFG.tweedie_power, linkPower=0.0, labelCol=target,
            featuresCol="features", predictionCol="previsto", maxIter=25, regParam=1e-3, **params,
        )
    return GBTRegressor(
        labelCol=target, featuresCol="features", predictionCol="previsto", seed=42, **{"maxIter": TREES, **params}
    )


def _named_outputs(classifier: GBTClassifier) -> GBTClassifier:
    return (
        classifier.setProbabilityCol("probabilidade")
        .setRawPredictionCol("bruto")
        .setPredictionCol("classe")
    )


def event_classifier(label: str = "evento_extremo", **params) -> GBTClassifier:
    """Weighted boosted trees; give positives the weight neg/pos in column ``peso``."""
    return _named_outputs(
        GBTClassifier(labelCol=label, featuresCol="features", weightCol="peso", seed=42, **{"maxIter": TREES, **params})
    )


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    weight = splits.positive_weight(df, label).scalar()
    return df.withColumn("peso", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def combiner(columns: Sequence[str], rows: int, label: str = "rotulo", c: float = 1.0) -> Pipeline:
    """Standardise, then unweighted logistic regression.

    An L2 penalty on the summed loss with strength 1/(2C) equals a penalty of 1/(C n) on
    the mean loss.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="cru"),
            StandardScaler(inputCol="cru", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol=label, featuresCol="features", probabilityCol="probabilidade",
                rawPredictionCol="bruto", predictionCol="classe", maxIter=200, tol=1e-9,
                regParam=1.0 / (c * rows), elasticNetParam=0.0, standardization=False,
            ),
        ]
    )


def interaction_tree(columns: Sequence[str], label: str = "rotulo", trees: int = TREES) -> Pipeline:
    """Small boosted trees that can use interactions of the same columns."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="features"),
            _named_outputs(
                GBTClassifier(
                    labelCol=label, featuresCol="features", maxIter=trees, maxDepth=3, stepSize=0.1,
                    minInstancesPerNode=20, seed=42,
                )
            ),
        ]
    )


def positive_probability(column: str = "probabilidade") -> Column:
    return vector_to_array(F.col(column))[1]


def scored_by(model: Transformer, df: DataFrame, keep: Sequence[str], name: str = "score"):
    for stage in getattr(model, "stages", [model]):
        # A summary of the training holds the session, which cannot go to tasks once it has observed a metric.
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model.transform(df).select(*keep, positive_probability().alias(name))


# ------------------------------------------------------------------------ calibration
def fit_isotonic(df: DataFrame, score: str, label: str):
    """Isotonic regression of the label on the score, clipped outside the fitted range.

    Rows collapse to (score, mean label, count) first, which gives the same fit.
    """
    points = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("_x"))
        .agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    )
    return IsotonicRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_iso", isotonic=True
    ).fit(points)


def apply_isotonic(model, df: DataFrame, score: str, name: str = "calibrado") -> DataFrame:
    return (
        model.transform(df.withColumn("_x", F.col(score).cast("double")))
        .withColumnRenamed("_iso", name)
        .drop("_x")
    )


def recalibration(valid: DataFrame, test: DataFrame, label: str, score: str, *, old,
                  old_threshold: float, key="station", hour="h") -> DataFrame:
    """Station-day scores on the test rows: as is, new threshold only, both renewed."""
    new = fit_isotonic(valid, score, label)
    plans = [
        ("antes", old, None),
        ("so o corte", old, old),
        ("isotonica e corte", new, new),
    ]
    parts = []
    for name, calibrator, chooser in plans:
        threshold = F.lit(old_threshold)
        if chooser is not None:
            days = metrics.station_day(
                apply_isotonic(chooser, valid, score), label, ["calibrado"], key=key, hour=hour
            )
            threshold = metrics.best_threshold(days, label, "calibrado").select("threshold").scalar()
        days = metrics.station_day(
            apply_isotonic(calibrator, test, score), label, ["calibrado"], key=key, hour=hour
        )
        scores = metrics.classification_scores(days, label, "calibrado", threshold)
        ap = metrics.average_precision(days, label, "calibrado").select("pr_auc")
        parts.append(
            scores.select(
                F.lit(name).alias("variante"), threshold.alias("threshold"), "f1", "precision",
                "recall", ap.scalar().alias("pr_auc"), "n",
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----------------------------------------------------------------------------- search
def search(rows: DataFrame, limits: DataFrame, candidates: Sequence[dict], build, score, *, maximise: bool,
           prepare: Sequence | None = None, concurrent: int = 4, hour: str = "h") -> DataFrame:
    """Mean score of each candidate over expanding folds, best first; ``ordem`` is the place.

    ``limits`` are hour limits (see ``expanding_folds``), so a fold is a filter of the rows. ``build(params)``
    gives an estimator, ``score(predictions)`` a one-row DataFrame with ``valor``. The stages of ``prepare``
    depend on the rows of a fold alone: they are fitted once a fold, and its vectors written for all candidates,
    dealt over so many tasks that all fits of a time have two for each core.
    ``concurrent`` fits run at a time, as jobs of one session (set ``spark.scheduler.mode`` to FAIR to share the
    executors evenly); each fit is distributed and only its score comes back. Scores do not depend on the order in
    which fits end; a failed fit fails the search.
    """
    h = F.col(hour)
    session = rows.sparkSession
    tasks = max(2, math.ceil(2 * session.sparkContext.defaultParallelism / max(1, concurrent)))

    def fold_tables(k) -> tuple[DataFrame, DataFrame]:
        train, test = rows.where(h <= k.train_to), rows.where(h.between(k.test_from, k.test_to))
        if not prepare:
            return train, test
        shared = Pipeline(stages=list(prepare)).fit(train)
        return tuple(materialise(dealt(shared.transform(part), tasks), "fold") for part in (train, test))

    def one(job) -> tuple:
        (number, params), (fold, (train, test)) = job
        value = score(build(params).fit(train).transform(test)).first()["valor"]
        return number, json.dumps(params, sort_keys=True), int(fold), float(value)

    found = limits.orderBy("fold").collect()  # a number the caller chose
    tables = at_once(session, [partial(fold_tables, k) for k in found], concurrent)
    jobs = itertools.product(enumerate(candidates), [(k.fold, t) for k, t in zip(found, tables)])
    results = at_once(session, [partial(one, job) for job in jobs], concurrent)
    table = session.createDataFrame(
        results, "candidato int, parametros string, fold int, valor double"
    )
    means = table.groupBy("candidato", "parametros").agg(
        F.avg("valor").alias("media"), F.stddev_pop("valor").alias("desvio")
    )
    order = [F.desc("media") if maximise else F.asc("media"), F.col("candidato")]
    place = F.row_number().over(Window.orderBy(*order))  # over the candidates, not over rows
    return means.withColumn("ordem", place).orderBy("ordem")


def random_candidates(space: dict[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    """Distinct random picks from a parameter space."""
    import random

    rng, picks = random.Random(seed), []
    size = 1
    for options in space.values():
        size *= len(options)
    while len(picks) < min(trials, size):
        pick = {name: rng.choice(list(options)) for name, options in space.items()}
        if pick not in picks:
            picks.append(pick)
    return picks


# ---------------------------------------------------------------------- save and score
def save_models(path: str, spark: SparkSession, *, regressor: PipelineModel,
                classifier: PipelineModel, calibrator: Model, metadata: dict) -> None:
    """Models next to a one-row JSON table with threshold and feature order."""
    regressor.write().overwrite().save(f"{path}/regressor")
    classifier.write().overwrite().save(f"{path}/classifier")
    calibrator.write().overwrite().save(f"{path}/calibrator")
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")


def load_metadata(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def score_batch(df: DataFrame, path: str, keep: Sequence[str]) -> DataFrame:
    """Amount (at least 0), calibrated risk and alert for every row of a table.

    Feature order and threshold are those saved with the models; a feature the table does
    not have counts as missing.
    """
    from pyspark.ml.regression import IsotonicRegressionModel

    meta = load_metadata(path, df.sparkSession)
    columns = meta["feature_columns"]
    rows = as_features(df, columns, keep)
    amount = PipelineModel.load(f"{path}/regressor").transform(rows).drop(
        "features", *[f"{c}_cheio" for c in columns]
    )
    risk = PipelineModel.load(f"{path}/classifier").transform(amount).withColumn(
        "_p", positive_probability()
    )
    calibrated = apply_isotonic(
        IsotonicRegressionModel.load(f"{path}/calibrator"), risk, "_p", "risco_evento_extremo"
    )
    return calibrated.select(
        *keep,
        F.round(F.greatest(F.col("previsto"), F.lit(0.0)), 2).alias("chuva_24h_prevista"),
        F.round("risco_evento_extremo", 4).alias("risco_evento_extremo"),
        (F.col("risco_evento_extremo") > meta["threshold"]).alias("alerta"),
        F.lit(float(meta["threshold"])).alias("threshold"),
    )


def feature_importance(model: PipelineModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance of each feature, its missing flag included, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    labels = list(names) + [f"{c}_ausente" for c in names]
    rows = [(labels[i], float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, importancia double").orderBy(
        F.desc("importancia"), "feature"
    )


def train(rows: DataFrame, features: Sequence[str], path: str, *, target="chuva_futura_24h",
          label="evento_extremo", key="station", hour="h", trees: int = TREES) -> DataFrame:
    """Fit on treino, calibrate and choose the threshold on validacao, measure on teste.

    Saves the models and returns tidy test metrics.
    """
    spark = rows.sparkSession
    splits.require_splits(rows, ("treino", "validacao", "teste"))
    names = drop_empty(rows.where("janela = 'treino'"), features)
    data = as_features(rows, names, [key, hour, "janela", target, label]).withColumn(
        target, F.col(target).cast("double")
    )
    part = {name: data.where(F.col("janela") == name) for name in ("treino", "validacao", "teste")}
    regressor = Pipeline(stages=[*vector_stages(names), rain_regressor("gbt", target, maxIter=trees)])
    classifier = Pipeline(stages=[*vector_stages(names), event_classifier(label, maxIter=trees)])
    weighted = with_class_weight(part["treino"], label)
    amount, risk = at_once(spark, [partial(regressor.fit, part["treino"]), partial(classifier.fit, weighted)])
    keys = [key, hour, label]
    valid = materialise(scored_by(risk, part["validacao"], keys), "scored")
    calibrator = fit_isotonic(valid, "score", label)
    days = metrics.station_day(apply_isotonic(calibrator, valid, "score"), label, ["calibrado"], key=key, hour=hour)
    threshold = metrics.best_threshold(days, label, "calibrado").first()["threshold"]
    save_models(
        path, spark, regressor=amount, classifier=risk, calibrator=calibrator,
        metadata={"threshold": threshold, "feature_columns": names},
    )
    test = apply_isotonic(calibrator, scored_by(risk, part["teste"], keys), "score")
    per_row = metrics.classification_scores(test, label, "calibrado", threshold)
    test_days = metrics.station_day(test, label, ["calibrado"], key=key, hour=hour)
    per_day = metrics.classification_scores(test_days, label, "calibrado", threshold)
    error = metrics.error_scores(amount.transform(part["teste"]), target, "previsto")
    ap = metrics.average_precision(test, label, "calibrado").select("pr_auc")
    ap_day = metrics.average_precision(test_days, label, "calibrado").select("pr_auc")

    def tidy(table: DataFrame, unit: str) -> DataFrame:
        return table.select(*[F.col(c).cast("double").alias(c) for c in table.columns]).unpivot(
            [], table.columns, "metrica", "valor"
        ).select(F.lit(unit).alias("unidade"), "metrica", "valor")

    return (
        tidy(per_row, "linha")
        .unionByName(tidy(per_day, "estacao-dia"))
        .unionByName(tidy(error, "regressao"))
        .unionByName(tidy(ap, "linha"))
        .unionByName(tidy(ap_day, "estacao-dia"))
    )


