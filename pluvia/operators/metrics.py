"""Verification of scores against labels: curves, average precision, errors, bias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions.clock import day_of_hour
from pluvia.functions.rates import f1, ratio
from pluvia.operators.joins import add_station_bias
from pluvia.operators.prefix import running_totals
from pluvia.operators.storage import materialise


def station_day(df: DataFrame, label: str, scores: Sequence[str], *, group: Sequence[str] = (),
                key="station", hour="h") -> DataFrame:
    """Collapse hours to (station, UTC day): highest label and highest score."""
    return df.groupBy(*group, key, day_of_hour(F.col(hour)).alias("dia")).agg(
        F.max(label).alias(label), *[F.max(s).alias(s) for s in scores]
    )


def observed_days(df: DataFrame, *, rain="mm", gust="gust", key="station", hour="h",
                  anchor: int = 12, min_hours: int = 18) -> DataFrame:
    """Rain total and highest gust per emission-anchored day with enough measured hours."""
    days = df.groupBy(key, day_of_hour(F.col(hour), -anchor).alias("dia")).agg(
        F.sum(rain).alias("chuva_24h_obs"),
        F.max(gust).alias("rajada_max_obs"),
        F.count(rain).alias("horas"),
    )
    return days.where(F.col("horas") >= min_hours).drop("horas")


def gauge_days(df: DataFrame, min_hours: int = 1, *, rain="mm", key="station", hour="h",
               shift: int = 11, name="chuva_nossa") -> DataFrame:
    """Rain per gauge day, the day that ends at 12 UTC; NULL with too few measured hours."""
    return df.groupBy(key, day_of_hour(F.col(hour), shift).alias("dia")).agg(
        F.when(F.count(rain) >= min_hours, F.sum(rain)).alias(name)
    )


def score_histogram(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Rows and positives per distinct score; rows without a score are left out."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*group, F.col(score).alias("_s"))
        .agg(
            F.sum(w).cast("long").alias("_n"),
            F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("_tp"),
        )
    )


def average_precision(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
                      weight: str | None = None, name: str = "pr_auc") -> DataFrame:
    """Average precision per group: sum over thresholds of recall step times precision.

    Equal scores are one threshold. A group without positives has 0.
    """
    ranked = running_totals(
        score_histogram(df, label, score, group, weight), list(group), "_s", ["_n", "_tp"],
        descending=True,
    )
    gain = F.sum(F.col("_tp") * ratio(F.col("cum__tp"), F.col("cum__n")))
    return ranked.groupBy(*group).agg(
        F.coalesce(ratio(gain, F.sum("_tp")), F.lit(0.0)).alias(name),
        F.sum("_n").alias("n"),
        F.sum("_tp").alias("eventos"),
    )


def average_precisions(df: DataFrame, label: str, score: str, group: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Average precision per group under each of several weights: ``_k`` (number of the weight), ``_ap``, ``eventos``.

    The weights of a row are columns and share one ordering of the scores. As `average_precision` otherwise.
    """
    n, tp = [f"_n{k}" for k in range(len(weights))], [f"_tp{k}" for k in range(len(weights))]
    hit = F.col(label) == 1
    hist = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*group, F.col(score).alias("_s"))
        .agg(
            *[F.sum(w).cast("long").alias(a) for w, a in zip(weights, n)],
            *[F.sum(F.when(hit, F.col(w)).otherwise(0)).cast("long").alias(a) for w, a in zip(weights, tp)],
        )
    )
    ranked = running_totals(materialise(hist, "drawn"), list(group), "_s", [*n, *tp], descending=True)
    totals = ranked.groupBy(*group).agg(
        *[F.sum(F.col(b) * ratio(F.col(f"cum_{b}"), F.col(f"cum_{a}"))).alias(f"_g{k}") for k, (a, b) in enumerate(zip(n, tp))],
        *[F.sum(b).alias(b) for b in tp],
    )
    each = F.array(*[
        F.struct(
            F.lit(k).alias("_k"),
            F.coalesce(ratio(F.col(f"_g{k}"), F.col(b)), F.lit(0.0)).alias("_ap"),
            F.col(b).alias("eventos"),
        )
        for k, b in enumerate(tp)
    ])
    return totals.select(*group, F.inline(each))


def operating_curve(df: DataFrame, label: str, score: str, cuts: Sequence[float],
                    group: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Alerts, hits, precision, recall, F1 and missed events at each cut.

    An alert is ``score >= cut`` (``>`` when strict). All cuts come from one aggregation.
    """
    hist = score_histogram(df, label, score, group)

    def alert(cut: float) -> Column:
        return F.col("_s") > cut if strict else F.col("_s") >= cut

    points = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("corte"),
                F.coalesce(F.sum(F.when(alert(c), F.col("_n"))), F.lit(0)).alias("alertas"),
                F.coalesce(F.sum(F.when(alert(c), F.col("_tp"))), F.lit(0)).alias("acertos"),
            )
            for c in cuts
        ]
    )
    totals = hist.groupBy(*group).agg(
        F.coalesce(F.sum("_tp"), F.lit(0)).alias("_pos"), points.alias("_points")
    )
    return _rates(totals.select(*group, "_pos", F.inline("_points")))


def _rates(points: DataFrame) -> DataFrame:
    precision = ratio(F.col("acertos"), F.col("alertas"))
    recall = ratio(F.col("acertos"), F.col("_pos"))
    return points.withColumns(
        {
            "precisao": precision,
            "recall": recall,
            "f1": f1(precision, recall),
            "perdidos": F.col("_pos") - F.col("acertos"),
        }
    ).drop("_pos")


def cut_for_recall(df: DataFrame, label: str, score: str, targets: Sequence[float]) -> DataFrame:
    """Largest cut that still reaches each target recall.

    Candidate cuts are the positive scores rounded to two decimals. Candidates and scores
    share one ordering, so all of them are read off one running total.
    """
    hist = score_histogram(df, label, score).select(
        F.col("_s").cast("double").alias("_s"), "_n", "_tp", F.lit(0).alias("_c")
    )
    marks = hist.where(F.col("_tp") > 0).select(
        F.round("_s", 2).alias("_s"), F.lit(0).cast("long").alias("_n"),
        F.lit(0).cast("long").alias("_tp"), F.lit(1).alias("_c"),
    )
    axis = hist.unionByName(marks).groupBy("_s").agg(
        F.sum("_n").alias("_n"), F.sum("_tp").alias("_tp"), F.max("_c").alias("_c")
    )
    ranked = running_totals(axis, [], "_s", ["_n", "_tp"], descending=True, with_total=True)
    recall = ratio(F.col("cum__tp"), F.col("total__tp"))
    points = ranked.where((F.col("_c") == 1) & (F.col("cum__n") > 0)).select(
        F.struct(
            F.col("_s").alias("corte"),
            F.col("cum__n").alias("alertas"),
            ratio(F.col("cum__tp"), F.col("cum__n")).alias("precisao"),
            recall.alias("recall"),
        ).alias("_pick")
    )
    reached = points.withColumn(
        "alvo", F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    ).where(F.col("_pick.recall") >= F.col("alvo"))
    return reached.groupBy("alvo").agg(F.max("_pick").alias("_pick")).select("alvo", "_pick.*")


def alerts_per_station_year(curve: DataFrame, rows: DataFrame, *, key="station", hour="h"):
    """Alerts of each cut per station and year of the covered period (whole days)."""
    span = rows.agg(
        F.count_distinct(key).alias("_stations"),
        (F.floor((F.max(hour) - F.min(hour)) / 24) / 365.25).alias("_years"),
    )
    per = span.select(F.col("_stations") * F.col("_years")).scalar()
    return curve.withColumn("alertas_por_estacao_ano", ratio(F.col("alertas"), per))


def best_threshold(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
                   grid: Sequence[float] = config.THRESHOLD_GRID) -> DataFrame:
    """Lowest threshold of the grid with the best F1; 0.5 when F1 is 0 everywhere."""
    curve = operating_curve(df, label, score, grid, group, strict=True)
    ranked = F.struct(F.col("f1").alias("f1"), (-F.col("corte")).alias("menos_corte"))
    best = curve.groupBy(*group).agg(F.max(ranked).alias("_b"))
    return best.select(
        *group,
        F.when(F.col("_b.f1") > 0, -F.col("_b.menos_corte")).otherwise(F.lit(0.5)).alias("threshold"),
        F.col("_b.f1").alias("f1"),
    )


def classification_scores(df: DataFrame, label: str, score: str, threshold: float | Column,
                          group: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and Brier score, alert strict."""
    y = F.col(label) == 1
    alert = F.col(score) > threshold
    counted = df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if(y & alert).alias("vp"),
        F.count_if(~y & alert).alias("fp"),
        F.count_if(y & ~alert).alias("fn"),
        F.count_if(~y & ~alert).alias("vn"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
    )
    p = F.coalesce(ratio(F.col("vp"), F.col("vp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("vp"), F.col("vp") + F.col("fn")), F.lit(0.0))
    return counted.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": f1(p, r),
            "accuracy": ratio(F.col("vp") + F.col("vn"), F.col("n")),
        }
    )


def error_scores(df: DataFrame, target: str, predicted: str, group: Sequence[str] = (),
                 wet_above: float = 1.0) -> DataFrame:
    """Mean absolute error, overall and where the target exceeds ``wet_above``."""
    miss = F.abs(F.col(predicted) - F.col(target))
    return df.groupBy(*group).agg(
        F.avg(miss).alias("mae"),
        F.avg(F.when(F.col(target) > wet_above, miss)).alias("mae_com_chuva"),
        F.count(miss).alias("n"),
    )


def fold_summary(scores: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of a score over folds."""
    return scores.groupBy(*group).agg(
        F.avg(value).alias(f"{value}_cv_mean"), F.stddev_pop(value).alias(f"{value}_cv_std")
    )


def unpivot_scores(df: DataFrame, keep: Sequence[str], scores: Sequence[str],
                   name="candidato", value="score") -> DataFrame:
    """One row per (row, candidate score)."""
    return df.unpivot([F.col(c) for c in keep], [F.col(s).cast("double").alias(s) for s in scores],
                      name, value)


def with_intensity_bin(df: DataFrame, value: str, edges: Sequence[float] = config.INTENSITY_EDGES,
                       name="faixa") -> DataFrame:
    """Left-closed bin number, NULL outside all bins."""
    bins = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        inside = (F.col(value) >= edges[i - 1]) & (F.col(value) < edges[i])
        bins = F.when(inside, F.lit(i - 1)).otherwise(bins)
    return df.withColumn(name, bins)


def bias_table(df: DataFrame, observed: str, predicted: str, group: Sequence[str] = ()):
    """Rows, means, bias (observed minus predicted) and ratio of totals per group."""
    floor = F.greatest(F.sum(predicted), F.lit(1e-9))
    return df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(observed).alias("observado_medio"),
        F.avg(predicted).alias("previsto_medio"),
        F.avg(F.col(observed) - F.col(predicted)).alias("vies"),
        (F.sum(observed) / floor).alias("razao"),
    )


def bias_by_intensity(df: DataFrame, observed: str, predicted: str,
                      edges: Sequence[float] = config.INTENSITY_EDGES) -> DataFrame:
    return bias_table(
        with_intensity_bin(df, predicted, edges).where(F.col("faixa").isNotNull()),
        observed, predicted, ["faixa"],
    )


def variance_by_station(df: DataFrame, residual: Column, *, key="station") -> DataFrame:
    """Share of the residual variance that station identity explains."""
    parts = df.groupBy(key).agg(
        F.count(residual).alias("_n"), F.avg(residual).alias("_m"), F.var_pop(residual).alias("_v")
    )
    n, m = F.col("_n"), F.col("_m")
    within = F.sum(n * F.col("_v"))
    between = F.sum(n * m * m) - F.pow(F.sum(n * m), 2) / F.sum(n)
    return parts.agg(F.sum("_n").alias("n"), (1 - ratio(within, within + between)).alias("r2_estacao"))


def compare_corrections(fit: DataFrame, evaluation: DataFrame, observed: str, predicted: str, *,
                        key="station", spread_by="h", isotonic=None) -> DataFrame:
    """MAE on the evaluation rows of corrections fitted on the fit rows.

    Raw, additive bias, ratio of totals and additive bias per station; with
    ``isotonic(fit, rows, name)``, which adds a column, the isotonic correction as well.
    """
    overall = bias_table(fit, observed, predicted)
    bias = overall.select("vies").scalar()
    factor = overall.select("razao").scalar()
    rows = add_station_bias(
        evaluation, bias_table(fit, observed, predicted, [key]), predicted, "por_estacao",
        key=key, spread_by=spread_by,
    ).withColumns(
        {
            "cru": F.col(predicted).cast("double"),
            "aditivo": F.col(predicted) + bias,
            "fator": F.col(predicted) * factor,
        }
    )
    names = ["cru", "aditivo", "fator", "por_estacao"]
    if isotonic is not None:
        rows, names = isotonic(fit, rows, "isotonica"), [*names, "isotonica"]
    long = unpivot_scores(rows, [observed], names, "correcao")
    return error_scores(long, observed, "score", ["correcao"])


def coverage(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows, rows with every column present, and NULL count per column, as tidy rows."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    counted = df.groupBy(*group).agg(
        F.count("*").alias("linhas"),
        F.count_if(complete).alias("completas"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulos_{c}") for c in columns],
    )
    names = ["linhas", "completas", *[f"nulos_{c}" for c in columns]]
    return counted.unpivot([F.col(g) for g in group], names, "medida", "valor")


def reach_of_fit(fit: DataFrame, evaluation: DataFrame, yardstick: str, *, key="station") -> DataFrame:
    """Evaluation rows, share of them with a yardstick, stations, and share of stations the fit never saw."""
    seen = fit.select(key).distinct().withColumn("_seen", F.lit(True))
    # One row per station before the join, so a station with many rows costs no more than others.
    stations = evaluation.groupBy(key).agg(F.count("*").alias("_n"), F.count(yardstick).alias("_y"))
    return stations.join(seen, key, "left").agg(
        F.sum("_n").alias("linhas"),
        ratio(F.sum("_y"), F.sum("_n")).alias("com_regua"),
        F.count("*").alias("estacoes"),
        ratio(F.count_if(F.col("_seen").isNull()), F.count("*")).alias("ineditas"),
    )


def read_interval(intervals: DataFrame, low="ic_inf", high="ic_sup") -> DataFrame:
    """Add the reading of each interval, and its upper end where the interval reaches zero."""
    around = (F.col(low) <= 0) & (F.col(high) >= 0)
    return intervals.withColumns({"leitura": verdict(F.col(low), F.col(high)), "ganho_maximo": F.when(around, F.col(high))})


def verdict(low: Column, high: Column) -> Column:
    """Reading of a confidence interval of a gain."""
    return (
        F.when(low > 0, "melhor").when(high > 0, "nao distinguivel").otherwise("pior")
    )
