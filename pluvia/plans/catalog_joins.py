"""Queries: joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions.rates import round6
from pluvia.operators import climatology, joins, metrics, neighbours, spatial, warnings
from pluvia.plans import views as V
from pluvia.plans.catalog_series import _next, r6
from pluvia.plans.registry import query

GEO_SQL = """geo as (
  select user_id as station, event_id, -30e0 - (event_id % 7 % 3) as latitude, -51e0 + (event_id % 5 % 2) as longitude,
    case when event_id % 4 = 0 then null else (user_id % 9) * 10e0 end as altitude from events)"""


def _geo_rows(spark, d):
    return V.table(spark, d, "events").selectExpr(
        "user_id as station", "event_id", "-30e0 - (event_id % 7 % 3) as latitude",
        "-51e0 + (event_id % 5 % 2) as longitude",
        "case when event_id % 4 = 0 then null else (user_id % 9) * 10e0 end as altitude")


def _mode_sql(c):
    return f"""m_{c} as (select station, {c} from (select station, {c}, row_number() over (partition by station order by count(*) desc, {c}) as r
      from geo where {c} is not null group by 1, 2) where r = 1)"""


@query("J1_canonical_coordinates", ["obs"], f"""
with {GEO_SQL}, {_mode_sql("latitude")}, {_mode_sql("longitude")}, {_mode_sql("altitude")}
select g.event_id, g.station, a.latitude, o.longitude, t.altitude from geo g
left join m_latitude a using (station) left join m_longitude o using (station) left join m_altitude t using (station)""")
def canonical(spark, d):
    return joins.canonical_coordinates(_geo_rows(spark, d), spread_by="event_id")


@query("J1_divergent_stations", ["obs"], f"""
with {GEO_SQL} select count(*) as divergentes from (select station from geo group by 1 having count(distinct latitude) > 1)""")
def divergent(spark, d):
    table = joins.station_coordinates(_geo_rows(spark, d))
    return table.agg(F.count_if(F.col("n_latitude") > 1).alias("divergentes"))


SERIES_SQL = """series as (
  select user_id % 7 as station, cast(floor(epoch(ts) / 3600) as bigint) as h, value as cloud_cover_low,
    case when event_id % 6 = 0 then null else value * 2 end as soil_moisture, event_id from events)"""


def _series(spark, d):
    from pluvia.functions.clock import epoch_hour

    return V.table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("station"), epoch_hour(F.col("ts")).alias("h"),
        F.col("value").alias("cloud_cover_low"),
        F.expr("case when event_id % 6 = 0 then null else value * 2 end").alias("soil_moisture"), "event_id")


@query("J2_reanalysis_enrichment", ["obs"], f"""
with {SERIES_SQL}, u as (select * from (select *, row_number() over (partition by station, h order by event_id) as r from series) where r = 1)
select o.station, o.h, o.mm_c, u.cloud_cover_low, u.soil_moisture from obs o left join u using (station, h)""")
def reanalysis(spark, d):
    base = V.obs(spark, d).select("station", "h", "mm_c")
    return joins.enrich(base, _series(spark, d), ["cloud_cover_low", "soil_moisture"], order="event_id")


NEAR_SQL = """dist as (
  select a.station, b.station as viz, b.lon < a.lon as oeste,
    2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) as km
  from stations a join stations b on a.station <> b.station),
near as (select *, row_number() over (partition by station order by km, viz) as posicao from dist where km <= 150 qualify posicao <= 5)"""


@query("J3_neighbour_map", ["stations"], f"""
with {NEAR_SQL} select station, viz, cast(posicao as integer) as posicao, oeste, round(km, 6) + 0e0 as dist_km from near""")
def neighbour_map(spark, d):
    out = neighbours.neighbour_map(V.stations(spark, d))
    return out.select("station", "viz", F.col("posicao").cast("int").alias("posicao"), "oeste",
                      round6(F.col("dist_km")).alias("dist_km"))


@query("J4_neighbour_means", ["weather", "stations"], f"""
with {NEAR_SQL},
span as (select station, min(h) as a, max(h) as b from weather group by 1),
grid as (select g.station, g.h, w.precipitacao, w.pressao from (select station, unnest(generate_series(a, b)) as h from span) g left join weather w using (station, h)),
st as (select station, h,
   sum(precipitacao) over (partition by station order by h rows between 2 preceding and current row) as c3,
   lag(pressao, 1) over (partition by station order by h) - lag(pressao, 3) over (partition by station order by h) as q3 from grid),
m as (select n.station, s.h, avg(c3) as v, avg(case when oeste then c3 end) as w, avg(q3) as q from near n join st s on s.station = n.viz group by 1, 2)
select o.station, o.h, round(v, 6) + 0e0 as viz_chuva_3h, round(w, 6) + 0e0 as viz_oeste_chuva_3h, round(q, 6) + 0e0 as viz_queda_pressao_3h
from weather o left join m using (station, h)""")
def neighbour_state(spark, d):
    rows = V.weather(spark, d).select("station", "h", "precipitacao", "pressao")
    out = neighbours.neighbour_means(rows, neighbours.neighbour_map(V.stations(spark, d)))
    cols = ["viz_chuva_3h", "viz_oeste_chuva_3h", "viz_queda_pressao_3h"]
    return r6(out, *cols).select("station", "h", *cols)


KNOWN_SQL = """known as (select station, cast(sum(mm) as double) / count(*) as clima from obs_daily where station % 3 <> 0 group by 1)"""


@query("J5_climatology_inheritance", ["stations", "obs_daily"], f"""
with {KNOWN_SQL},
miss as (select * from stations where station not in (select station from known)),
don as (select s.*, k.clima from stations s join known k using (station)),
r as (select m.station, d.clima, row_number() over (partition by m.station order by
    2 * 6371 * asin(sqrt(pow(sin(radians(d.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - m.lon) / 2), 2))), d.station) as p
  from miss m cross join don d)
select station, round(clima, 6) + 0e0 as clima from known
union all select station, round(avg(clima), 6) + 0e0 from r where p <= 5 group by 1""")
def inheritance(spark, d):
    known = V.daily(spark, d).where("station % 3 <> 0").groupBy("station").agg(
        (F.sum("mm").cast("double") / F.count("*")).alias("clima"))
    out = climatology.inherit(known, V.stations(spark, d), ["clima"])
    return r6(out, "clima")


@query("J6_climatology_lookup", ["weather", "stations"], f"""
with past as (select *, month(make_timestamp(h * 3600000000)) as mes from weather where h <= {V.CUTOFF_H}),
c as (select station, avg(precipitacao) as media, quantile_cont(precipitacao, 0.99) as p99 from past group by 1),
m as (select station, mes, avg(precipitacao) as mensal from past group by 1, 2)
select w.station, w.h, round(media, 6) + 0e0 as clima_chuva_media, round(p99, 6) + 0e0 as clima_chuva_p99, round(mensal, 6) + 0e0 as clima_chuva_mes
from weather w left join c using (station) left join m on m.station = w.station and m.mes = month(make_timestamp(w.h * 3600000000))""")
def lookup(spark, d):
    from pluvia.functions.clock import day_of_hour

    rows = V.weather(spark, d).withColumn("mes", F.month(day_of_hour(F.col("h"))))
    places = V.stations(spark, d).join(rows.select("station").distinct(), "station", "left_semi")
    out = climatology.with_climatology(rows, places, V.CUTOFF_H)
    cols = ["clima_chuva_media", "clima_chuva_p99", "clima_chuva_mes"]
    return r6(out, *cols).select("station", "h", *cols)


@query("J7_forecast_substitution", ["weather"], f"""
with f as (select station, h, precipitacao * 2 as vento, case when a % 4 = 0 then null else a * 1e0 end as umidade from weather where a % 3 <> 0)
select w.station, w.h, case when f.station is not null and w.h >= {V.CUTOFF_H} then f.vento else w.vento end as vento,
  case when f.station is not null and w.h >= {V.CUTOFF_H} then f.umidade else w.umidade end as umidade
from weather w left join f using (station, h)""")
def substitution(spark, d):
    base = V.weather(spark, d)
    forecast = base.where("a % 3 <> 0").selectExpr(
        "station", "h", "precipitacao * 2 as vento", "case when a % 4 = 0 then null else a * 1e0 end as umidade")
    rows = base.select("station", "h", "vento", "umidade")
    return joins.substitute_forecast(rows, forecast, ["vento", "umidade"], V.CUTOFF_H)


@query("J8_yardstick", ["obs"], f"""
with f as (select station, h, {_next(24, "count")} as n, {_next(24)} as s, {_next(24, "count", "n")} as k, {_next(24, "max", "n")} as m
  from (select * from obs where a % 50 <> 0))
select o.station, o.h, cast(case when f.n = 24 then s end as bigint) as ifs_chuva_24h, case when k = 24 then m end as ifs_prob_24h
from obs o left join f using (station, h)""")
def yardstick(spark, d):
    base = V.obs(spark, d)
    forecast = base.where("a % 50 <> 0").select(
        "station", "h", F.col("mm_c").alias("precipitation"), F.col("n").alias("precipitation_probability"))
    return joins.attach_yardstick(base.select("station", "h"), forecast)


@query("J9_station_in_polygon", ["warnings"], """
select w.id, s.station from warnings w join stations s
on s.lon >= w.cx - w.hw and s.lon < w.cx + w.hw and s.lat >= w.cy - w.hw and s.lat < w.cy + w.hw""")
def in_polygon(spark, d):
    polygons = V.warnings(spark, d).select("id", "poligono")
    return spatial.points_in_polygons(polygons, V.stations(spark, d)).select("id", "station")


@query("J9_holes_and_multipolygons", ["warnings"], """
with b as (select *, cx - hw as x0, cx + hw as x1, cy - hw as y0, cy + hw as y1 from warnings)
select w.id, s.station from b w join stations s on
  (w.id % 3 = 0 and s.lon >= x0 and s.lon < x1 and s.lat >= y0 and s.lat < y1
    and not (s.lon >= cx - hw / 2 and s.lon < cx + hw / 2 and s.lat >= cy - hw / 2 and s.lat < cy + hw / 2))
  or (w.id % 3 = 1 and ((s.lon >= x0 and s.lon < x1 and s.lat >= y0 and s.lat < y1)
    or (s.lon >= x0 + 1e0 and s.lon < x1 + 1e0 and s.lat >= y0 and s.lat < y1)))""")
def holes(spark, d):
    def ring(cx, cy, hw):
        pts = ", ',', ".join(
            f"'[', cast({cx} {a} {hw} as string), ',', cast({cy} {b} {hw} as string), ']'"
            for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-")))
        return f"'[', {pts}, ']'"

    outer, hole, shifted = ring("cx", "cy", "hw"), ring("cx", "cy", "hw / 2"), """
      '[[', cast(cx - hw + 1e0 as string), ',', cast(cy - hw as string), '],[', cast(cx + hw + 1e0 as string), ',', cast(cy - hw as string),
      '],[', cast(cx + hw + 1e0 as string), ',', cast(cy + hw as string), '],[', cast(cx - hw + 1e0 as string), ',', cast(cy + hw as string), ']]'"""
    orders = V.table(spark, d, "orders")
    rows = orders.withColumn("station", F.expr(V.ORDER_STATION)).join(V.stations(spark, d), "station")
    rows = rows.selectExpr("o_orderkey as id", "lon as cx", "lat as cy", f"{V.HALF} as hw")
    shaped = rows.selectExpr("id", f"""case id % 3
      when 0 then concat('{{"type":"Polygon","coordinates":[', {outer}, ',', {hole}, ']}}')
      when 1 then concat('{{"type":"MultiPolygon","coordinates":[[', {outer}, '],[', {shifted}, ']]}}')
      else 'not a polygon' end as poligono""")
    return spatial.points_in_polygons(shaped, V.stations(spark, d)).select("id", "station")


@query("J10_station_day_expansion", ["pairs"], """
select station, dia, id, descricao, id_severidade, criterio_mm, round(criterio_ms, 6) + 0e0 as criterio_ms from pairs""")
def expansion(spark, d):
    return r6(V.panel_pairs(spark, d), "criterio_ms")


PANEL_SQL = f"""panel as (
  select o.*, c.id_severidade, c.criterio_mm, c.criterio_ms, c.id_severidade is not null as tem_aviso, o.chuva_24h_obs > {V.STUDY_EVENT_MM} as evento
  from observed o left join (select station, dia, max(id_severidade) as id_severidade, min(criterio_mm) as criterio_mm, min(criterio_ms) as criterio_ms
    from pairs group by 1, 2) c using (station, dia))"""


def panel(spark, d):
    return warnings.station_day_panel(V.daily_observed(spark, d), V.panel_pairs(spark, d), V.STUDY_EVENT_MM)


@query("J11_station_day_panel", ["observed", "pairs"], f"""
with {PANEL_SQL}
select station, dia, chuva_24h_obs, round(rajada_max_obs, 6) + 0e0 as rajada_max_obs, id_severidade, criterio_mm, round(criterio_ms, 6) + 0e0 as criterio_ms, tem_aviso, evento from panel""")
def station_day_panel(spark, d):
    return r6(panel(spark, d), "criterio_ms", "rajada_max_obs")


@query("J12_pairs_with_observation", ["observed", "pairs"], """
select station, dia, id, chuva_24h_obs from pairs join observed using (station, dia)""")
def pairs_observed(spark, d):
    return V.panel_pairs(spark, d).join(V.daily_observed(spark, d), ["station", "dia"]).select(
        "station", "dia", "id", "chuva_24h_obs")


GAUGE_SQL = """gauge as (select station, dia, case when mm % 11 = 0 then null when mm % 10 = 0 then mm + 3 else mm end as chuva_bdmep from obs_daily where mm % 7 <> 0),
ours as (select station, dia, case when mm % 13 = 0 then null else mm end as chuva_nossa from obs_daily where mm % 5 <> 0)"""


def gauge(spark, d):
    return V.daily(spark, d).where("mm % 7 <> 0").selectExpr(
        "station", "dia", "case when mm % 11 = 0 then null when mm % 10 = 0 then mm + 3 else mm end as chuva_bdmep")


def ours(spark, d):
    return V.daily(spark, d).where("mm % 5 <> 0").selectExpr(
        "station", "dia", "case when mm % 13 = 0 then null else mm end as chuva_nossa")


@query("J13_own_sum_vs_gauge", ["obs_daily"], f"""
with {GAUGE_SQL} select station, dia, chuva_nossa, chuva_bdmep from ours join gauge using (station, dia)
where chuva_nossa is not null and chuva_bdmep is not null""")
def both(spark, d):
    return joins.both_present(ours(spark, d), gauge(spark, d), ["station", "dia"], ["chuva_nossa", "chuva_bdmep"])


@query("J14_station_bias", ["scored"], """
with b as (select station, avg(chuva_futura_24h - previsto) as vies from scored where janela = 'validacao' group by 1)
select s.station, s.h, round(s.previsto + coalesce(b.vies, 0), 4) + 0e0 as corrigido from scored s left join b using (station) where s.janela = 'teste'""")
def station_bias(spark, d):
    rows = V.scored(spark, d)
    fit = metrics.bias_table(rows.where("janela = 'validacao'"), "chuva_futura_24h", "previsto", ["station"])
    out = joins.add_station_bias(rows.where("janela = 'teste'"), fit, "previsto", "corrigido")
    return out.select("station", "h", (F.round("corrigido", 4) + F.lit(0.0)).alias("corrigido"))


@query("J15_common_stations", ["obs_daily"], """
select station from obs_daily where dia < date '1997-01-01' intersect select station from obs_daily where dia >= date '2001-06-01'""")
def common(spark, d):
    rows = V.daily(spark, d)
    return joins.common_stations(rows.where("dia < date '1997-01-01'"), rows.where("dia >= date '2001-06-01'"))


def flood_reports(spark, d):
    return V.table(spark, d, "events").select(
        F.col("event_id").alias("report_id"), F.expr(V.REPORT_STATION).alias("station"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) - V.REPORT_SHIFT_HOURS * 3600).alias("ts_s"),
        F.expr("case event_type when 'error' then 'sim' when 'view' then 'nao sei' else 'nao' end").alias("alagou"))


@query("J16_reports_in_force", ["warnings"], f"""
with r as (select event_id as report_id, user_id * 2 // 3 as station,
    cast(floor(epoch(ts)) as bigint) - {V.REPORT_SHIFT_HOURS * 3600} as ts_s,
    case event_type when 'error' then 'sim' when 'view' then 'nao sei' else 'nao' end as alagou from events),
m as (select r.report_id, w.id, w.id_severidade, row_number() over (partition by r.report_id order by w.id_severidade desc, w.inicio desc, w.id desc) as p
  from r join stations s using (station) join warnings w on s.lon >= w.cx - w.hw and s.lon < w.cx + w.hw and s.lat >= w.cy - w.hw and s.lat < w.cy + w.hw
    and r.ts_s >= cast(epoch(w.inicio) as bigint) and r.ts_s <= cast(epoch(w.fim) as bigint))
select r.report_id, r.station, r.ts_s, r.alagou, m.id, m.id_severidade from r left join m on m.report_id = r.report_id and m.p = 1""")
def reports(spark, d):
    in_force = V.warnings(spark, d).select(
        "id", "id_severidade", F.unix_seconds("inicio").alias("inicio_s"), F.unix_seconds("fim").alias("fim_s"), "poligono")
    return warnings.reports_in_force(flood_reports(spark, d), in_force, V.stations(spark, d))
