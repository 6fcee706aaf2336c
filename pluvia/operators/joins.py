"""Joins of observation rows with dimensions, gridded series and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators import windows
from pluvia.operators.tiling import HOURS_PER_TILE

SALTS = 16


def attach(df: DataFrame, dim: DataFrame, keys: Sequence[str], *, spread_by: str,
           how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join rows to a dimension with one row per key.

    One key may own a third of the rows, so the key is salted by another column of the
    row and the dimension is repeated per salt. Spark still broadcasts the dimension when
    its measured size allows it.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def most_frequent(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key the most frequent non-null value of each column, the smallest winning a tie, and how many it had.

    All columns are counted in one pass. Counts are combined before the shuffle, so a key with many rows
    costs its distinct values only. A key without any value has NULLs.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    counts = df.select(key, F.inline(cells)).groupBy(key, "_i", "_v").agg(F.count("*").alias("_n"))
    own = [(F.col("_i") == i) & F.col("_v").isNotNull() for i in range(len(columns))]
    return counts.groupBy(key).agg(
        *[F.max_by(F.col("_v"), F.when(own[i], F.struct(F.col("_n"), -F.col("_v")))).alias(c) for i, c in enumerate(columns)],
        *[F.nullif(F.count_if(own[i]), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(columns)],
    )


def station_coordinates(df: DataFrame, key: str = "station",
                        columns: Sequence[str] = ("latitude", "longitude", "altitude")):
    """One coordinate set per station, the mode of each column, and how many values it had."""
    table = most_frequent(df, key, columns)
    return table.select(key, *[x for c in columns for x in (c, f"n_{c}")])


def canonical_coordinates(df: DataFrame, key: str = "station", *, spread_by: str,
                          columns: Sequence[str] = ("latitude", "longitude", "altitude")):
    """Replace the coordinates of every row by those of its station."""
    table = station_coordinates(df, key, columns).select(key, *columns)
    return attach(df.drop(*columns), table, [key], spread_by=spread_by)


def first_known(df: DataFrame, columns: Sequence[str], *, key="station", order="h") -> DataFrame:
    """First non-null value of each column per station, and the span of its series."""
    return df.groupBy(key).agg(
        *[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
            for c in columns
        ],
        F.min(order).alias("inicio"),
        F.max(order).alias("fim"),
    )


def enrich(df: DataFrame, series: DataFrame, columns: Sequence[str], *, key="station", hour="h",
           order: str) -> DataFrame:
    """Left join a gridded series on (station, hour), the first row per key counting."""
    rank = F.row_number().over(Window.partitionBy(key, hour).orderBy(order))
    unique = (
        series.withColumn("_rank", rank).where(F.col("_rank") == 1).select(key, hour, *columns)
    )
    return df.join(unique, [key, hour], "left")


def substitute_forecast(df: DataFrame, forecast: DataFrame, columns: Sequence[str], start_hour: int,
                        *, key="station", hour="h") -> DataFrame:
    """From ``start_hour`` on, take the forecast where a forecast row exists, NULLs included."""
    renamed = forecast.where(F.col(hour) >= start_hour).select(
        key, hour, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_f_{c}") for c in columns]
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col(hour) >= start_hour)
    return (
        df.join(renamed, [key, hour], "left")
        .withColumns({c: F.when(hit, F.col(f"_f_{c}")).otherwise(F.col(c)) for c in columns})
        .drop("_hit", *[f"_f_{c}" for c in columns])
    )


def attach_yardstick(df: DataFrame, forecast: DataFrame, *, rain="precipitation",
                     probability="precipitation_probability", key="station", hour="h",
                     width: int = HOURS_PER_TILE) -> DataFrame:
    """Forecast rain total and peak probability of the next 24 hours, by (station, hour)."""
    total = windows.future_total(forecast, rain, key=key, hour=hour, name="ifs_chuva_24h", width=width)
    both = windows.future_max(total, probability, key=key, hour=hour, name="ifs_prob_24h", width=width)
    return df.join(both.select(key, hour, "ifs_chuva_24h", "ifs_prob_24h"), [key, hour], "left")


def add_station_bias(df: DataFrame, bias: DataFrame, forecast: str, name: str, *, key="station",
                     spread_by="h") -> DataFrame:
    """Forecast plus the bias of its station; an unseen station has bias 0."""
    joined = attach(df, bias.select(key, F.col("vies").alias("_bias")), [key], spread_by=spread_by)
    return joined.withColumn(name, F.col(forecast) + F.coalesce("_bias", F.lit(0.0))).drop("_bias")


def common_stations(left: DataFrame, right: DataFrame, key: str = "station") -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def both_present(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]):
    """Inner join that keeps rows in which all the columns have values."""
    return left.join(right, list(keys)).dropna(subset=list(columns))
