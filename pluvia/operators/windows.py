"""Time-window features of hourly series: lags, totals, spread, trends, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.tiling import (
    HOURS_PER_TILE,
    Frames,
    over_series,
    with_row_position,
)

LAGS = (1, 3, 6, 24)
TOTALS = (3, 6, 12, 24, 48, 72)


def lags(df: DataFrame, value: str, hours: Sequence[int] = LAGS, *, key="station", hour="h",
         prefix="lag_", width: int = HOURS_PER_TILE) -> DataFrame:
    """Value exactly ``k`` hours earlier; NULL when that hour was not observed."""
    return over_series(
        df, [key], hour,
        lambda f: {f"{prefix}{k}h": F.max(value).over(f.at(-k)) for k in hours},
        back=max(hours), width=width,
    )


def rolling_totals(df: DataFrame, value: str, hours: Sequence[int] = TOTALS, *, key="station",
                   hour="h", prefix="chuva_", width: int = HOURS_PER_TILE) -> DataFrame:
    """Totals over the last ``k`` hours including this one, from one value on."""
    return over_series(
        df, [key], hour,
        lambda f: {f"{prefix}{k}h": F.sum(value).over(f.last(k)) for k in hours},
        back=max(hours) - 1, width=width,
    )


def rolling_spread(df: DataFrame, value: str, hours: int = 24, *, key="station", hour="h",
                   width: int = HOURS_PER_TILE) -> DataFrame:
    """Sample standard deviation and maximum over the last ``hours`` hours."""
    return over_series(
        df, [key], hour,
        lambda f: {
            f"rolling_std_{hours}h": F.stddev_samp(value).over(f.last(hours)),
            f"rolling_max_{hours}h": F.max(value).over(f.last(hours)),
        },
        back=hours - 1, width=width,
    )


def trends(df: DataFrame, rain="precipitacao", pressure="pressao", dew="orvalho", *,
           key="station", hour="h", width: int = HOURS_PER_TILE) -> DataFrame:
    """Differences between lagged values of rain, pressure and dew point."""

    def build(f: Frames):
        def at(c, k):
            return F.max(c).over(f.at(-k))

        return {
            "tendencia_6h": at(rain, 1) - at(rain, 6),
            "queda_pressao_3h": at(pressure, 1) - at(pressure, 3),
            "queda_pressao_24h": at(pressure, 1) - at(pressure, 24),
            "tendencia_orvalho_3h": F.col(dew) - at(dew, 3),
        }

    return over_series(df, [key], hour, build, back=24, width=width)


def future_total(df: DataFrame, value: str, hours: int = 24, *, key="station", hour="h",
                 name="chuva_futura_24h", width: int = HOURS_PER_TILE) -> DataFrame:
    """Total of the next ``hours`` hours, this one excluded; NULL unless all are present."""
    return over_series(
        df, [key], hour,
        lambda f: {
            name: F.when(F.count(value).over(f.following(hours)) == hours,
                         F.sum(value).over(f.following(hours)))
        },
        ahead=hours, width=width,
    )


def future_max(df: DataFrame, value: str, hours: int = 24, *, key="station", hour="h",
               name="max_futuro_24h", width: int = HOURS_PER_TILE) -> DataFrame:
    """Maximum of the next ``hours`` hours; NULL unless all are present."""
    return over_series(
        df, [key], hour,
        lambda f: {
            name: F.when(F.count(value).over(f.following(hours)) == hours,
                         F.max(value).over(f.following(hours)))
        },
        ahead=hours, width=width,
    )


def future_mean(df: DataFrame, columns: Sequence[str], steps: int = 24, *, key="station",
                hour="h", by_row: bool = False, suffix="", width: int = HOURS_PER_TILE) -> DataFrame:
    """Mean of the next ``steps`` values of each column, from one value on.

    ``by_row=False`` looks at the next ``steps`` hours. ``by_row=True`` looks at the next
    ``steps`` surviving rows, which may lie across a gap.
    """
    def build(f: Frames):
        return {f"{c}{suffix}": F.avg(c).over(f.following(steps)) for c in columns}

    if not by_row:
        return over_series(df, [key], hour, build, ahead=steps, width=width)
    numbered = with_row_position(df, [key], hour, "_row", width)
    return over_series(numbered, [key], "_row", build, ahead=steps, width=width).drop("_row")


def hourly_grid(df: DataFrame, *, key="station", hour="h", flag="observado") -> DataFrame:
    """Every hour between the first and last of each series, real rows flagged.

    The hours are generated per (station, month-long block), so a long series spreads.
    """
    span = df.groupBy(key).agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))
    block = 720
    blocks = span.select(
        key, "_a", "_b",
        F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor(F.col("_b") / block))).alias("_k"),
    ).repartition(key, "_k")
    hours = blocks.select(
        key,
        F.explode(
            F.sequence(
                F.greatest(F.col("_a"), F.col("_k") * block),
                F.least(F.col("_b"), F.col("_k") * block + block - 1),
            )
        ).alias(hour),
    )
    return hours.join(df.withColumn(flag, F.lit(True)), [key, hour], "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )
