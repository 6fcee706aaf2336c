"""The feature table: every window, neighbour and climatology feature plus the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions import clock
from pluvia.operators import cleaning, climatology, neighbours
from pluvia.operators.storage import materialise
from pluvia.operators.tiling import HOURS_PER_TILE, Frames, over_series
from pluvia.operators.windows import LAGS, TOTALS


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def point_features(df: DataFrame) -> DataFrame:
    """Features that depend on the row only. Missing inputs give NULL features."""
    def c(name):
        return _column(df, name)

    north, east = clock.wind_components(c("vento"), c("vento_dir"))
    north100, east100 = clock.wind_components(c("wind_speed_100m"), c("wind_direction_100m"))
    hour, month = clock.hour_of_day(F.col("h")), F.month(clock.day_of_hour(F.col("h")))
    (hour_sin, hour_cos), (month_sin, month_cos) = clock.cyclic(hour, 24), clock.cyclic(month, 12)
    return df.withColumns(
        {
            "hora": hour,
            "mes": month,
            "hora_sin": hour_sin,
            "hora_cos": hour_cos,
            "mes_sin": month_sin,
            "mes_cos": month_cos,
            "orvalho": c("orvalho"),
            "deficit_orvalho": c("temperatura") - c("orvalho"),
            "vento_dir_sin": F.sin(F.radians(c("vento_dir"))),
            "vento_dir_cos": F.cos(F.radians(c("vento_dir"))),
            "vento_norte": north,
            "vento_leste": east,
            "vento100_norte": north100,
            "vento100_leste": east100,
            "rajada": c("rajada"),
            "rajada_excesso": c("rajada") - c("vento"),
            "amplitude_temp": c("temp_max") - c("temp_min"),
            "amplitude_pressao": c("pressao_max") - c("pressao_min"),
            "temp_umidade": c("temperatura") * c("umidade"),
        }
    )


def window_features(df: DataFrame, width: int = HOURS_PER_TILE) -> DataFrame:
    """All time-window features and the target, from one exchange and one sort."""

    def build(f: Frames):
        def at(name, k):
            return F.max(name).over(f.at(-k))

        rain = "precipitacao"
        day = f.following(24)
        return (
            {f"lag_{k}h": at(rain, k) for k in LAGS}
            | {f"chuva_{k}h": F.sum(rain).over(f.last(k)) for k in TOTALS}
            | {
                "rolling_std_24h": F.stddev_samp(rain).over(f.last(24)),
                "rolling_max_24h": F.max(rain).over(f.last(24)),
                "tendencia_6h": at(rain, 1) - at(rain, 6),
                "queda_pressao_3h": at("pressao", 1) - at("pressao", 3),
                "queda_pressao_24h": at("pressao", 1) - at("pressao", 24),
                "tendencia_orvalho_3h": F.col("orvalho") - at("orvalho", 3),
                "chuva_futura_24h": F.when(F.count(rain).over(day) == 24, F.sum(rain).over(day)),
            }
        )

    return over_series(df, ["station"], "h", build, back=max(TOTALS) - 1, ahead=24, width=width)


def feature_table(observations: DataFrame, stations: DataFrame, cutoff: int,
                  cfg: config.StudyConfig = config.StudyConfig()) -> DataFrame:
    """Clean observations -> complete feature rows with target and label.

    ``observations``: ``station, h`` and the measurements, one row per key.
    ``stations``: ``station, lat, lon`` and optionally ``altitude``.
    """
    rows = window_features(point_features(observations))
    # Both tables are small and read several times below.
    stations = materialise(stations, "stations")
    near = materialise(neighbours.neighbour_map(stations, cfg.neighbours, cfg.radius_km), "neighbours")
    rows = neighbours.neighbour_means(rows, near, observations)
    dated = observations.withColumn("mes", F.month(clock.day_of_hour(F.col("h"))))
    rows = climatology.with_climatology(rows, stations, cutoff, dated)
    rows = cleaning.fill_zero(climatology.relative_total(rows))
    rows = cleaning.complete_rows(rows)
    return cleaning.label_above(rows, "chuva_futura_24h", cfg.extreme_mm)
