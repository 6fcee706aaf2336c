"""Parquet stores: yearly reanalysis, archived forecasts, daily snapshots, warnings, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.operators import deltas


def write_by_year(series: DataFrame, path: str, hour: str = "h") -> None:
    """Add a series to a store by year, replacing the station-years it contains. Rows without an hour have no year."""
    year = F.year(F.timestamp_seconds(F.col(hour) * 3600))
    deltas.put(series, path, ["station", "ano"], {"ano": year}, ["station", hour])


def read_days(spark: SparkSession, path: str, first: str, last: str, hour: str = "h") -> DataFrame:
    """Rows of the days ``first`` to ``last`` inclusive; other years are not opened."""
    lo = F.unix_date(F.lit(first).cast("date")) * 24
    hi = (F.unix_date(F.lit(last).cast("date")) + 1) * 24
    years = F.col("ano").between(int(first[:4]), int(last[:4]))
    return deltas.stored(spark, path).where(years & (F.col(hour) >= lo) & (F.col(hour) < hi))


def write_forecast_archive(series: DataFrame, path: str, model: str, window: str) -> None:
    """Store an archived forecast under its model and time window, with the names of its variables.

    The stations of the series replace what the archive has of them for the model and window; others stay.
    """
    names = [c for c in series.columns if c not in ("station", "h")]
    rows = series.withColumn("variaveis", F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    place = {"modelo": F.lit(model), "periodo": F.lit(window)}
    deltas.put(rows, path, ["modelo", "periodo", "station"], place, ["station", "h"])


def read_forecast_archive(spark: SparkSession, path: str, model: str, window: str,
                          variables: Sequence[str]) -> DataFrame:
    """One model and window; fails when a requested variable was not stored for all of their stations."""
    stored = deltas.stored(spark, path)
    chosen = stored.where((F.col("modelo") == model) & (F.col("periodo") == window))
    named = [F.min(F.array_contains("variaveis", v).cast("int")) for v in variables]
    found = chosen.agg(*named).first()
    missing = [v for v, has in zip(variables, found) if not has]
    if missing:
        raise ValueError(f"variables are not in the archive of {model}, {window}: {missing}")
    return chosen.select("station", "h", *variables)


def latest_snapshot_means(snapshots: DataFrame, columns: Sequence[str], hours: int = 24, *,
                          key="station", hour="h", issued="emitida_h") -> DataFrame:
    """Mean of the first ``hours`` rows of the newest snapshot of each station."""
    newest = snapshots.groupBy(key).agg(F.max(issued).alias(issued))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(hour))
    rows = (
        snapshots.join(newest, [key, issued], "left_semi")
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= hours)
    )
    return rows.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def append_snapshot(spark: SparkSession, snapshot: DataFrame, path: str, *, force: bool = False,
                    day: str = "dia_emissao") -> None:
    """Store the issue days of a snapshot; days already stored are kept unless forced.

    Fails when there is nothing to store.
    """
    if snapshot.isEmpty():
        raise ValueError("the snapshot has no station")
    try:
        stored = None if force else spark.read.parquet(path).select(day).distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    rows = snapshot if stored is None else snapshot.join(stored, day, "left_anti")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )


def warnings_in_window(archive: DataFrame, first: str, last: str, start: str = "data_inicio"):
    """Obtained warnings whose start date lies in the window."""
    day = F.substring(start, 1, 10).try_cast("date")
    return archive.where(F.col("obtido") & day.between(F.lit(first), F.lit(last)))


def tidy_metrics(table: DataFrame, run: str, study: str, group: Sequence[str]) -> DataFrame:
    """``run_id, study, grupo, metrica, valor`` rows of a metric table."""
    numeric = [c for c in table.columns if c not in group]
    label = F.concat_ws(" / ", *[F.col(g).cast("string") for g in group]) if group else F.lit("")
    return table.select(
        F.lit(run).alias("run_id"),
        F.lit(study).alias("study"),
        label.alias("grupo"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
    ).unpivot(["run_id", "study", "grupo"], numeric, "metrica", "valor")


def write_metrics(tidy: DataFrame, path: str) -> None:
    (
        tidy.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "study")
        .parquet(path)
    )
