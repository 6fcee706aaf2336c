"""Typing, range checks, duplicates, completeness and labels of observation rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pluvia import config
from pluvia.operators.joins import attach


def null_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = config.SENTINEL):
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def number(value: Column) -> Column:
    """Double, NULL for junk and for NaN."""
    cast = value.try_cast("double")
    return F.when(~F.isnan(cast), cast)


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in columns})


def merge_columns(df: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Merge columns that mean the same: the first one with a number wins."""
    used = {c for cols in sources.values() for c in cols}
    kept = [F.col(c) for c in df.columns if c not in used]
    merged = [
        F.coalesce(*[number(F.col(c)) for c in cols]).alias(name) for name, cols in sources.items()
    ]
    return df.select(*kept, *merged)


def observation_time(old_date: Column, old_hour: Column, new_date: Column, new_hour: Column):
    """UTC timestamp from the two date layouts; the old one wins when both are readable.

    Old: ``yyyy-MM-dd`` with ``HH:mm``. New: ``HHmm UTC``, padded to four digits. Dates may
    use slashes.
    """
    def date(d: Column) -> Column:
        return F.replace(F.trim(d), F.lit("/"), F.lit("-"))

    def stamp(d: Column, hhmm: Column) -> Column:
        return F.try_to_timestamp(F.concat(date(d), F.lit(" "), hhmm), F.lit("yyyy-MM-dd HH:mm"))

    digits = F.lpad(F.trim(F.replace(new_hour, F.lit(" UTC"), F.lit(""))), 4, "0")
    padded = F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    return F.coalesce(stamp(old_date, F.trim(old_hour)), stamp(new_date, padded))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def within_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = config.RANGES):
    """NULL outside the closed range; the row and its other columns stay."""
    checks = {
        c: F.when(F.col(c).between(lo, hi), F.col(c))
        for c, (lo, hi) in ranges.items()
        if c in df.columns
    }
    return df.withColumns(checks)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the given order.

    The rank filter is applied before the shuffle as well, so a group of many copies sends
    one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def complete_rows(df: DataFrame, required: Sequence[str] = config.REQUIRED_FEATURES,
                  observed: str | None = None) -> DataFrame:
    """Observed rows in which every required column has a value."""
    rows = df.where(F.col(observed)) if observed else df
    return rows.dropna(subset=list(required))


def fill_zero(df: DataFrame, columns: Sequence[str] = config.ZERO_FILLED_FEATURES) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def label_above(df: DataFrame, value: str, limit: float, name: str = "evento_extremo"):
    """1 when strictly above the limit, else 0; a missing value counts as 0."""
    return df.withColumn(name, F.coalesce(F.col(value) > limit, F.lit(False)).cast("int"))


def at_hours(df: DataFrame, hours: Sequence[int], hour: str = "h") -> DataFrame:
    return df.where(F.pmod(F.col(hour), F.lit(24)).isin(list(hours)))


def only_stations(df: DataFrame, stations: DataFrame | None, key: str = "station") -> DataFrame:
    """Rows of the listed stations; no list keeps all."""
    if stations is None:
        return df
    return df.join(stations.select(key).distinct(), key, "left_semi")


def only_types(df: DataFrame, types: Sequence, column: str = "descricao") -> DataFrame:
    return df.where(F.col(column).isin(list(types)))


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns, in order, as doubles; absent ones are NULL."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c)
            for c in columns
        ]
    )


def impute_monthly(df: DataFrame, columns: Sequence[str], *, key="station", month="mes",
                   spread_by="h") -> DataFrame:
    """NULL -> mean of the (station, month), else mean of everything, else 0."""
    monthly = df.groupBy(key, month).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
    )
    overall = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    joined = attach(df, monthly, [key, month], spread_by=spread_by)
    fallback = {c: overall.select(f"_a_{c}").scalar() for c in columns}
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_m_{c}"), fallback[c], F.lit(0.0)) for c in columns}
    ).drop(*[f"_m_{c}" for c in columns])


def counted_losses(df: DataFrame, drops: dict[str, Column], nulls: dict[str, Column], name: str = "perdas"):
    """The rows for which no condition of ``drops`` holds, with new values of the columns in ``nulls``, and what is lost.

    The second result is an observation, filled while the first is computed: ``linhas`` of the input, ``mantidas``,
    dropped rows by the first reason that holds, and ``<column>_anulados``, values of kept rows that became null.
    In a stream the same figures are in ``observedMetrics`` of each batch.
    """
    reason = F.coalesce(*[F.when(c, F.lit(r)) for r, c in drops.items()], F.lit(None).cast("string"))
    olds = {f"_old_{c}": F.col(c) for c in nulls}
    seen = df.withColumn("_reason", reason).withColumns(olds).withColumns(nulls)
    kept = F.col("_reason").isNull()
    counts = [F.count("*").alias("linhas"), F.count_if(kept).alias("mantidas")]
    counts += [F.count_if(F.col("_reason") == r).alias(r) for r in drops]
    counts += [F.count_if(kept & F.col(f"_old_{c}").isNotNull() & F.col(c).isNull()).alias(f"{c}_anulados") for c in nulls]
    losses = name if df.isStreaming else Observation(name)
    return seen.observe(losses, *counts).where(kept).drop("_reason", *olds), losses
