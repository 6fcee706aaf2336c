"""Smallest complete study: hourly series, rolling totals, label, station-day rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import cleaning, metrics, windows
from pluvia.plans import views as V


def rainfall_days(spark, sf_dir: str) -> DataFrame:
    rows = windows.rolling_totals(V.obs(spark, sf_dir), "mm_c", [24, 48])
    labelled = cleaning.label_above(rows, "chuva_24h", V.HEAVY_C)
    return metrics.station_day(labelled, "evento_extremo", ["chuva_24h", "chuva_48h"]).select(
        "station", F.col("dia"), "evento_extremo", "chuva_24h", "chuva_48h"
    )
