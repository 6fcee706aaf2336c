"""Rain regime of each station before a cut-off, inherited where there is no history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.joins import attach
from pluvia.operators.neighbours import nearest
from pluvia.operators.prefix import exact_quantiles
from pluvia.operators.storage import materialise

MONTH = "mes"


def before_cutoff(df: DataFrame, cutoff: int, hour: str = "h") -> DataFrame:
    """Rows up to the cut-off hour, or all rows when none is that old."""
    earliest = df.agg(F.min(hour)).scalar()
    return df.where((F.col(hour) <= cutoff) | (earliest > cutoff))


def station_climatology(df: DataFrame, cutoff: int, *, rain="precipitacao", humidity="umidade",
                        pressure="pressao", key="station", hour="h") -> DataFrame:
    """Mean and 99th percentile of rain, mean humidity and pressure per station."""
    past = before_cutoff(df, cutoff, hour)
    means = past.groupBy(key).agg(
        F.avg(rain).alias("clima_chuva_media"),
        F.avg(humidity).alias("clima_umidade_media"),
        F.avg(pressure).alias("clima_pressao_media"),
    )
    return means.join(exact_quantiles(past, [key], rain, {"clima_chuva_p99": 0.99}), key, "left")


def monthly_climatology(df: DataFrame, cutoff: int, *, rain="precipitacao", key="station",
                        hour="h", month=MONTH) -> DataFrame:
    """Mean hourly rain per station and month of the year."""
    past = before_cutoff(df, cutoff, hour)
    return past.groupBy(key, month).agg(F.avg(rain).alias("clima_chuva_mes"))


def inherit(table: DataFrame, stations: DataFrame, columns: list[str], extra: list[str] | None = None,
            k: int = 5, key: str = "station") -> DataFrame:
    """Add stations that have no row: the mean of the ``k`` nearest stations that have one.

    ``extra`` are further key columns of the table, such as the month. The table is written out
    once, since it is read several times.
    """
    extra = extra or []
    table = materialise(table.select(key, *extra, *columns), "known")
    known = table.select(key).distinct()
    missing = stations.join(known, key, "left_anti").select(key, "lat", "lon")
    donors = stations.join(known, key, "left_semi").select(key, "lat", "lon")
    chosen = nearest(missing, donors, k).select(F.col("station").alias("_for"), F.col("viz").alias(key))
    inherited = (
        chosen.join(table, key)
        .groupBy(F.col("_for").alias(key), *extra)
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return table.select(key, *extra, *columns).unionByName(inherited)


def with_climatology(df: DataFrame, stations: DataFrame, cutoff: int,
                     observations: DataFrame | None = None, *, key="station", hour="h",
                     month=MONTH) -> DataFrame:
    """Attach both climatologies, inherited where needed.

    ``observations`` is where they come from, ``df`` itself when not given. The two tables
    hold a row per station and month at most; inheritance writes them out once.
    """
    source = df if observations is None else observations
    yearly = ["clima_chuva_media", "clima_chuva_p99", "clima_umidade_media", "clima_pressao_media"]
    base = inherit(station_climatology(source, cutoff, key=key, hour=hour), stations, yearly, key=key)
    monthly = monthly_climatology(source, cutoff, key=key, hour=hour, month=month)
    by_month = inherit(monthly, stations, ["clima_chuva_mes"], [month], key=key)
    joined = attach(df, base, [key], spread_by=hour)
    return attach(joined, by_month, [key, month], spread_by=hour)


def relative_total(df: DataFrame, total="chuva_24h", p99="clima_chuva_p99", name="chuva_24h_rel"):
    return df.withColumn(name, F.col(total) / (F.col(p99) + 0.1))
