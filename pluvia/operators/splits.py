"""Time splits with an embargo, expanding folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.rates import ratio
from pluvia.operators.prefix import running_totals


def with_split(df: DataFrame, train_end: int, valid_end: int, embargo: int = 24, *, hour="h",
               name="janela") -> DataFrame:
    """treino / validacao / teste by hour; rows inside an embargo get NULL."""
    h = F.col(hour)
    return df.withColumn(
        name,
        F.when(h <= train_end - embargo, "treino")
        .when((h > train_end) & (h <= valid_end), "validacao")
        .when(h > valid_end + embargo, "teste"),
    )


def with_fit_split(df: DataFrame, fit_start: int, fit_end: int, embargo: int = 24, *, hour="h",
                   name="janela") -> DataFrame:
    """ajuste inside [start, end], avaliacao after the embargo, else NULL."""
    h = F.col(hour)
    return df.withColumn(
        name,
        F.when(h.between(fit_start, fit_end), "ajuste").when(h > fit_end + embargo, "avaliacao"),
    )


def split_summary(df: DataFrame, label: str, *, split="janela", hour="h") -> DataFrame:
    return (
        df.where(F.col(split).isNotNull())
        .groupBy(split)
        .agg(
            F.count("*").alias("linhas"),
            F.min(hour).alias("inicio"),
            F.max(hour).alias("fim"),
            F.avg(label).alias("taxa_evento"),
        )
    )


def require_splits(df: DataFrame, names: tuple[str, ...], split: str = "janela") -> DataFrame:
    """Fail when one of the named windows has no row."""
    found = df.agg(*[F.max(F.col(split) == n).alias(f"w{i}") for i, n in enumerate(names)]).first() if names else ()
    empty = [n for n, any_row in zip(names, found) if not any_row]
    if empty:
        raise ValueError(f"empty time windows: {empty}")
    return df


def expanding_folds(df: DataFrame, folds: int, embargo: int = 24, *, hour="h") -> DataFrame:
    """Hour limits of ``folds`` expanding folds of about equal numbers of rows.

    Fold ``i`` tests the hours in (test_from, test_to] and trains on hours up to
    ``train_to``. Limits fall on whole hours: the rows of one hour are never split.
    """
    per_hour = df.groupBy(F.col(hour).alias("_h")).agg(F.count("*").alias("_n"))
    ranked = running_totals(per_hour, [], "_h", ["_n"], with_total=True)
    chunk = F.floor(F.col("total__n") / (folds + 1))
    first_test = F.col("total__n") - folds * chunk
    # The hour that contains row position first_test + i * chunk opens fold i.
    opens = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(
        (F.col("cum__n") - F.col("_n") <= first_test + F.col("fold") * chunk)
        & (F.col("cum__n") > first_test + F.col("fold") * chunk)
    )
    starts = opens.groupBy("fold").agg(F.min("_h").alias("test_from"))
    after = starts.select((F.col("fold") - 1).alias("fold"), F.col("test_from").alias("_next"))
    last = ranked.agg(F.max("_h")).scalar()
    return starts.join(after, "fold", "left").select(
        "fold",
        (F.col("test_from") - embargo).alias("train_to"),
        "test_from",
        F.coalesce(F.col("_next") - 1, last).alias("test_to"),
    )


def with_fold_role(df: DataFrame, limits: DataFrame, *, hour="h") -> DataFrame:
    """Every row once per fold it plays a role in, as ``treino`` or ``teste``."""
    h = F.col(hour)
    role = F.when(h <= F.col("train_to"), "treino").when(
        h.between(F.col("test_from"), F.col("test_to")), "teste"
    )
    # limits has one row per fold, a number the caller chose
    return (
        df.join(F.broadcast(limits), (h <= F.col("train_to")) | h.between(F.col("test_from"), F.col("test_to")))
        .withColumn("papel", role)
        .drop("train_to", "test_from", "test_to")
    )


def positive_weight(df: DataFrame, label: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Negatives per positive; 1 when there is no positive."""
    pos = F.sum(F.col(label).cast("long"))
    return df.groupBy(*group).agg(
        F.coalesce(ratio(F.count("*") - pos, pos), F.lit(1.0)).alias("peso_positivos")
    )
