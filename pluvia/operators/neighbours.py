"""Nearest stations on the sphere and what the neighbours observed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.config import EARTH_RADIUS_KM
from pluvia.functions.geo import haversine_km
from pluvia.operators.joins import attach
from pluvia.operators.storage import materialise

FINEST_LEVEL = 21
PLACES_PER_TASK = 1_024  # each meets some hundred candidates, which its task sorts


def _with_cube(df: DataFrame, level: Column) -> DataFrame:
    """Cube of side 2**-level around the point on the unit sphere."""
    lat, lon = F.radians("lat"), F.radians("lon")
    scale = F.pow(F.lit(2.0), level)
    axes = {"_cx": F.cos(lat) * F.cos(lon), "_cy": F.cos(lat) * F.sin(lon), "_cz": F.sin(lat)}
    return df.withColumns({c: F.floor(v * scale).cast("long") for c, v in axes.items()})


CUBE = ["_level", "_cx", "_cy", "_cz"]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5,
            radius_km: float | None = None) -> DataFrame:
    """The ``k`` nearest other candidates of each query station, nearest first.

    Inputs have ``station, lat, lon``. Ties go to the smaller station. Exact: each place
    searches the 27 cubes around it on the finest level at which its own cube one level
    below already holds ``k + 1`` candidates, so nothing nearer can be outside. Crowded
    areas therefore search small cubes, and places sharing one coordinate are searched
    once with at most ``k + 1`` candidates each. The places are written out and dealt to tasks
    by number, since their few bytes say nothing of the pairs that they form.
    """
    if radius_km is None:
        coarsest = -1
    else:
        coarsest = math.floor(-math.log2(2 * math.sin(radius_km / (2 * EARTH_RADIUS_KM))))
    levels = F.explode(F.sequence(F.lit(coarsest), F.lit(FINEST_LEVEL))).alias("_level")

    same_place = Window.partitionBy("lat", "lon").orderBy("station")
    kept = (
        candidates.select("station", "lat", "lon")
        .dropna()
        .withColumn("_rank", F.row_number().over(same_place))
        .where(F.col("_rank") <= k + 1)
        .select(F.col("station").alias("viz"), "lat", "lon")
    )
    placed = _with_cube(kept.select("viz", "lat", "lon", levels), F.col("_level"))
    crowded = placed.groupBy(*CUBE).agg(F.count("*").alias("_n")).where(F.col("_n") > k)

    places = materialise(queries.select("lat", "lon").dropna().distinct(), "places")
    tasks = places.count() // PLACES_PER_TASK + 1
    depth = (
        _with_cube(places.select("lat", "lon", levels), F.col("_level"))
        .join(crowded.select(*CUBE), CUBE, "left_semi")
        .groupBy("lat", "lon")
        .agg(F.max("_level").alias("_deep"))
    )
    searched = places.join(depth, ["lat", "lon"], "left").withColumn(
        "_level",
        F.greatest(F.coalesce(F.col("_deep") - 1, F.lit(coarsest)), F.lit(coarsest)).cast("int"),
    )
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = _with_cube(searched, F.col("_level")).select(
        F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"), *CUBE
    ).repartition(tasks, "_qlat", "_qlon")
    for axis in CUBE[1:]:
        around = around.withColumn("_step", F.explode(steps)).withColumn(
            axis, F.col(axis) + F.col("_step")
        )
    distance = haversine_km(F.col("_qlat"), F.col("_qlon"), F.col("vlat"), F.col("vlon"))
    pairs = around.join(
        placed.select("viz", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), *CUBE), CUBE
    ).withColumn("dist_km", distance)
    if radius_km is not None:
        pairs = pairs.where(F.col("dist_km") <= radius_km)
    by_place = Window.partitionBy("_qlat", "_qlon").orderBy("dist_km", "viz")
    short = (
        pairs.withColumn("_rank", F.row_number().over(by_place))
        .where(F.col("_rank") <= k + 1)
        .drop("_rank", *CUBE)
    )
    named = queries.select("station", F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"))
    by_station = Window.partitionBy("station").orderBy("dist_km", "viz")
    return (
        named.join(short, ["_qlat", "_qlon"])
        .where(F.col("station") != F.col("viz"))
        .withColumn("posicao", F.row_number().over(by_station))
        .where(F.col("posicao") <= k)
        .select(
            "station", "viz", "posicao", "dist_km",
            (F.col("vlon") < F.col("_qlon")).alias("oeste"),
        )
    )


def neighbour_map(stations: DataFrame, k: int = 5, radius_km: float = 150.0) -> DataFrame:
    """Up to ``k`` nearest stations within the radius, those to the west flagged."""
    return nearest(stations, stations, k, radius_km)


def hourly_state(df: DataFrame, *, rain="precipitacao", pressure="pressao", key="station", hour="h"):
    """Rain of the last 3 h and pressure change 3 h -> 1 h ago, for every hour that has them.

    Hours without a row of their own get a state too, up to the last hour of the station.
    Each observation is handed to the hours it matters for, so no grid is built.
    """
    nothing = F.lit(None).cast("double")
    mm, p = F.col(rain).cast("double"), F.col(pressure).cast("double")

    def part(shift: int, r: Column, a: Column, b: Column) -> Column:
        return F.struct((F.col(hour) + shift).alias(hour), r.alias("_r"), a.alias("_a"), b.alias("_b"))

    spread = F.array(
        part(0, mm, nothing, nothing),
        part(1, mm, p, nothing),
        part(2, mm, nothing, nothing),
        part(3, nothing, nothing, p),
    )
    ends = df.groupBy(key).agg(F.max(hour).alias("_end"))
    state = (
        df.select(key, F.inline(spread))
        .groupBy(key, hour)
        .agg(F.sum("_r").alias("chuva_3h"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .select(key, hour, "chuva_3h", (F.col("_a") - F.col("_b")).alias("queda_pressao_3h"))
    )
    return attach(state, ends, [key], spread_by=hour, how="inner").where(
        F.col(hour) <= F.col("_end")
    ).drop("_end")


def neighbour_means(df: DataFrame, neighbours: DataFrame, observations: DataFrame | None = None, *,
                    rain="precipitacao", pressure="pressao", key="station", hour="h") -> DataFrame:
    """Mean state of the neighbours at the same hour, all of them and those to the west.

    ``observations`` is where the state comes from, ``df`` itself when not given.
    """
    source = df if observations is None else observations
    state = hourly_state(source, rain=rain, pressure=pressure, key=key, hour=hour)
    reverse = neighbours.select(F.col("station").alias("_for"), F.col("viz").alias(key), "oeste")
    salted = state.withColumn("_salt", F.pmod(F.col(hour), F.lit(16)).cast("int"))
    copies = reverse.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    means = (
        salted.join(copies, [key, "_salt"])
        .groupBy(F.col("_for").alias(key), hour)
        .agg(
            F.avg("chuva_3h").alias("viz_chuva_3h"),
            F.avg(F.when(F.col("oeste"), F.col("chuva_3h"))).alias("viz_oeste_chuva_3h"),
            F.avg("queda_pressao_3h").alias("viz_queda_pressao_3h"),
        )
    )
    return df.join(means, [key, hour], "left")
