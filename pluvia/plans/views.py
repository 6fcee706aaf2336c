"""Station, forecast and warning views over the given tables.

Every view exists twice: as a Spark DataFrame and as the SQL text of a common table
expression for the oracle. Expressions both engines share are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.clock import day_of_hour, epoch_hour

# Keys come straight from the row: neighbouring users share a station, neighbouring customers one too, so
# that series are dense and their number grows with the tables.
USER_STATION = "user_id div 38"
ORDER_STATION = "o_custkey div 15"
REPORT_STATION = "user_id * 2 div 3"
REPORT_SHIFT_HOURS = 9497 * 24
CUTOFF_H = 473712  # 2024-01-16 00:00
TRAIN_END_H = 473759
VALID_END_H = 473879
HEAVY_C = 130000
STUDY_EVENT_MM = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hourly observations
WEATHER = {
    "station": "station",
    "h": "h",
    "precipitacao": "mm_c / 100e0",
    "temperatura": "case when a % 31 = 0 then null else (a % 620) / 10e0 - 14e0 end",
    "umidade": "case when a % 37 = 0 then null else (a % 101) * 1e0 end",
    "pressao": "case when a % 41 = 0 then null else 860e0 + (a * 7 % 1800) / 10e0 end",
    "vento": "case when a % 43 = 0 then null else (a * 3 % 700) / 10e0 end",
    "orvalho": "case when a % 47 = 0 then null else (a * 11 % 500) / 10e0 - 20e0 end",
    "rajada": "(a * 3 % 700) / 10e0 + (a % 17) / 10e0",
    "vento_dir": "(a * 13 % 361) * 1e0",
    "radiacao": "(a * 17 % 6001) * 1e0",
    "temp_max": "(a % 620) / 10e0 - 14e0 + (a % 7) / 10e0",
    "temp_min": "(a % 620) / 10e0 - 14e0 - (a % 5) / 10e0",
    "umid_max": "(a % 101) * 1e0",
    "umid_min": "(a % 89) * 1e0",
    "pressao_max": "860e0 + (a * 7 % 1800) / 10e0 + (a % 3) / 10e0",
    "pressao_min": "860e0 + (a * 7 % 1800) / 10e0 - (a % 2) / 10e0",
    "a": "a",
}

OBS_SQL = f"""obs as (
  select station, h, cast(floor(sum(c) / count(*)) as bigint) as mm_c, count(*) as n,
         cast(sum(event_id) as bigint) as a
  from (select user_id // 38 as station,
               cast(floor(epoch(date_trunc('hour', ts)) / 3600) as bigint) as h,
               cast(round(value * 100) as bigint) as c, event_id
        from events) e
  group by 1, 2)"""
WEATHER_SQL = (
    "weather as (select " + ", ".join(f"{e} as {c}" for c, e in WEATHER.items()) + " from obs)"
)


def obs(spark, d) -> DataFrame:
    return (
        table(spark, d, "events").select(
            F.expr(USER_STATION).alias("station"),
            epoch_hour(F.col("ts")).alias("h"),
            F.round(F.col("value") * 100).cast("long").alias("c"),
            "event_id",
        )
        .groupBy("station", "h")
        .agg(
            F.floor(F.sum("c") / F.count("*")).cast("long").alias("mm_c"),
            F.count("*").alias("n"),
            F.sum("event_id").alias("a"),
        )
    )


def weather(spark, d) -> DataFrame:
    return obs(spark, d).selectExpr(*[f"{e} as {c}" for c, e in WEATHER.items()])


# ------------------------------------------------------------------------- stations
LAT = "cast(-27e0 - 0.5e0*(s_suppkey % 10) - 0.0137e0*((s_suppkey*7) % 13) as double)"
LON = "cast(-57e0 + 0.5e0*floor(s_suppkey/10e0) + 0.0091e0*((s_suppkey*5) % 11) as double)"
STATIONS_SQL = f"stations as (select s_suppkey as station, {LAT} as lat, {LON} as lon from supplier)"


def stations(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey as station", f"{LAT} as lat", f"{LON} as lon"
    )


# ---------------------------------------------------------------------- daily rain
DAILY_SQL = """obs_daily as (
  select l_suppkey as station, cast(l_shipdate as date) as dia,
         cast(sum(l_quantity) as bigint) as mm, max(l_discount) * 200 as gust
  from lineitem group by 1, 2)"""


def daily(spark, d) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("dia"))
        .agg(
            F.sum("l_quantity").cast("long").alias("mm"),
            (F.max("l_discount") * 200).alias("gust"),
        )
    )


def daily_observed(spark, d) -> DataFrame:
    return daily(spark, d).select(
        "station", "dia", F.col("mm").alias("chuva_24h_obs"), F.col("gust").alias("rajada_max_obs")
    )


OBSERVED_SQL = (
    "observed as (select station, dia, mm as chuva_24h_obs, gust as rajada_max_obs from obs_daily)"
)

# ------------------------------------------------------------------------- warnings
RISKS = """case o_orderkey % 4
    when 0 then concat('Pancadas de 15 a 25 mm/h; acumulado de ', cast(20 + o_orderkey % 60 as {text}), ' mm/dia; rajadas de 40-60 km/h.')
    when 1 then concat('Volume entre ', cast(20 + o_orderkey % 40 as {text}), ' e 100 mm/dia, com 12 mm/h no pico')
    when 2 then 'Rajadas de 100 km/h ou mais' else 'Ar seco, com 12 a 20 por cento' end"""
SEVERITY = """case substr(o_orderpriority,1,1) when '1' then 8 when '2' then 7 when '3' then 6 else 0 end"""
SEVERITY_NAME = """case substr(o_orderpriority,1,1) when '1' then 'Grande Perigo' when '2' then 'Perigo'
  when '3' then 'Perigo Potencial' else 'Sem nivel' end"""
TYPE_NAME = """case o_orderkey % 4 when 0 then 'Chuvas Intensas' when 1 then 'Acumulado de Chuva'
  when 2 then 'Vendaval' else 'Baixa Umidade' end"""
HALF = "cast(0.4e0 + 0.1e0*(o_orderkey % 5) as double)"

WARNINGS_SQL = f"""warnings as (
  select o_orderkey as id, {SEVERITY} as id_severidade, {SEVERITY_NAME} as severidade,
         {TYPE_NAME} as descricao, st.lon as cx, st.lat as cy, {HALF} as hw,
         cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 24 as integer)) as inicio,
         cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 24 + 6 + o_orderkey % 40 as integer)) as fim,
         {RISKS.format(text="varchar")} as riscos, o_orderstatus, o_orderdate
  from orders join stations st on st.station = o_custkey // 15)"""
PAIRS_SQL = """criteria as (
  select *, cast(case id % 4 when 0 then 20 + id % 60 when 1 then 20 + id % 40 end as double) as criterio_mm,
    cast(case id % 4 when 0 then 40 when 2 then 100 end as double) / 3.6e0 as criterio_ms
  from warnings),
matches as (
  select c.*, s.station from criteria c join stations s
    on s.lon >= c.cx - c.hw and s.lon < c.cx + c.hw and s.lat >= c.cy - c.hw and s.lat < c.cy + c.hw),
pairs as (
  select station, cast(unnest(generate_series(
      cast(date_trunc('day', inicio - interval 12 hours) as timestamp),
      cast(date_trunc('day', greatest(inicio, fim) - interval 12 hours) as timestamp), interval 1 day)) as date) as dia,
    id, descricao, id_severidade, criterio_mm, criterio_ms, severidade
  from matches where descricao <> 'Baixa Umidade')"""


def square(cx: str, cy: str, hw: str) -> str:
    """SQL expression: GeoJSON of a square."""
    def corner(sx: str, sy: str) -> str:
        return f"'[', cast({cx} {sx} {hw} as string), ',', cast({cy} {sy} {hw} as string), ']'"

    ring = ", ',', ".join(
        corner(sx, sy) for sx, sy in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-"))
    )
    return f"""concat('{{"type":"Polygon","coordinates":[[', {ring}, ']]}}')"""


def shape_warnings(orders: DataFrame, places: DataFrame) -> DataFrame:
    """Warnings of orders that carry the ``station`` their square is centred on."""
    joined = orders.join(places, "station")
    at = "cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24{} as int))"
    return joined.withColumns(
        {"cx": F.col("lon"), "cy": F.col("lat"), "hw": F.expr(HALF)}
    ).select(
        F.col("o_orderkey").alias("id"),
        "station",
        F.expr(SEVERITY).alias("id_severidade"),
        F.expr(SEVERITY_NAME).alias("severidade"),
        F.expr(TYPE_NAME).alias("descricao"),
        F.expr(at.format("")).alias("inicio"),
        F.expr(at.format(" + 6 + o_orderkey % 40")).alias("fim"),
        F.expr(RISKS.format(text="string")).alias("riscos"),
        F.expr(square("cx", "cy", "hw")).alias("poligono"),
        "o_orderstatus",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    )


def warnings(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("station", F.expr(ORDER_STATION))
    return shape_warnings(orders, stations(spark, d)).drop("station")


def panel_pairs(spark, d) -> DataFrame:
    from pluvia.operators.warnings import expand_station_days

    return expand_station_days(
        warnings(spark, d), stations(spark, d),
        types=["Chuvas Intensas", "Tempestade", "Acumulado de Chuva", "Vendaval"],
    )


# ---------------------------------------------- scored rows (label, scores, split)
# The forecast mixes the observed future with the last day, the model score with noise
# that depends on the row only. All are integers or short decimals.
SCORED_SQL = f"""scored as (
  select station, h, mm_c, a, chuva_24h, chuva_futura_24h, cast(floor(h / 24) as bigint) as dia_n,
    case when chuva_futura_24h > {HEAVY_C} then 1 else 0 end as y,
    (chuva_futura_24h * 6 + chuva_24h * 4) // 10 + (a * 7919) % 20000 as previsto,
    ((chuva_futura_24h // 1000 + (a * 104729) % 60) % 200) / 200e0 as prob,
    case when h <= {TRAIN_END_H} - 24 then 'treino'
         when h > {TRAIN_END_H} and h <= {VALID_END_H} then 'validacao'
         when h > {VALID_END_H} + 24 then 'teste' end as janela
  from (select station, h, mm_c, a,
          cast(sum(mm_c) over (partition by station order by h range between 23 preceding and current row) as bigint) as chuva_24h,
          cast(case when count(mm_c) over (partition by station order by h range between 1 following and 24 following) = 24
               then sum(mm_c) over (partition by station order by h range between 1 following and 24 following) end as bigint) as chuva_futura_24h
        from obs) w
  where chuva_futura_24h is not null)"""


def scored(spark, d) -> DataFrame:
    from pluvia.operators.splits import with_split
    from pluvia.operators.windows import over_series

    frames = over_series(
        obs(spark, d), ["station"], "h",
        lambda f: {
            "chuva_24h": F.sum("mm_c").over(f.last(24)),
            "chuva_futura_24h": F.when(
                F.count("mm_c").over(f.following(24)) == 24, F.sum("mm_c").over(f.following(24))
            ),
        },
        back=23, ahead=24,
    ).where(F.col("chuva_futura_24h").isNotNull())
    rows = frames.selectExpr(
        "station", "h", "mm_c", "a", "chuva_24h", "chuva_futura_24h",
        "cast(floor(h / 24) as bigint) as dia_n",
        f"case when chuva_futura_24h > {HEAVY_C} then 1 else 0 end as y",
        "(chuva_futura_24h * 6 + chuva_24h * 4) div 10 + (a * 7919) % 20000 as previsto",
        "((chuva_futura_24h div 1000 + (a * 104729) % 60) % 200) / 200e0 as prob",
    )
    return with_split(rows, TRAIN_END_H, VALID_END_H)


def hour_day(hour: str = "h", shift: int = 0):
    return day_of_hour(F.col(hour), shift)


VIEW_SQL = {
    "obs": OBS_SQL,
    "weather": WEATHER_SQL,
    "stations": STATIONS_SQL,
    "obs_daily": DAILY_SQL,
    "observed": OBSERVED_SQL,
    "warnings": WARNINGS_SQL,
    "pairs": PAIRS_SQL,
    "scored": SCORED_SQL,
}
NEEDS = {
    "weather": ["obs"],
    "observed": ["obs_daily"],
    "warnings": ["stations"],
    "pairs": ["warnings"],
    "scored": ["obs"],
}


def with_views(names: list[str], body: str) -> str:
    """Prefix a query with the views it names and those they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    head = "with " + ",\n".join(VIEW_SQL[n] for n in ordered)
    if body.lower().startswith("with "):
        return head + ",\n" + body[5:]
    return head + "\n" + body
