"""Queries: time windows (E), cleaning (P) and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions import clock, geo, text
from pluvia.functions.rates import round6
from pluvia.operators import cleaning, metrics, tiling, windows
from pluvia.operators.joins import attach
from pluvia.operators.storage import materialise
from pluvia.plans import views as V
from pluvia.plans.registry import query


def r6(df, *columns):
    return df.withColumns({c: round6(F.col(c)) for c in columns})


# ------------------------------------------------------------------------ E: windows
@query("E1_hourly_grid", ["obs"], """
with span as (select station, min(h) as a, max(h) as b from obs group by 1),
grid as (select station, unnest(generate_series(a, b)) as h from span)
select g.station, g.h, o.mm_c, o.mm_c is not null as observado
from grid g left join obs o using (station, h)""")
def hourly_grid(spark, d):
    return windows.hourly_grid(V.obs(spark, d).select("station", "h", "mm_c"))


GAPPED_SQL = """gapped as (
  select station, h, case when a % 3 = 0 or a % 100 < 20 then null else mm_c * 1e0 end as x from obs)"""


def gapped(spark, d):
    return V.obs(spark, d).selectExpr(
        "station", "h", "case when a % 3 = 0 or a % 100 < 20 then null else mm_c * 1e0 end as x"
    )


@query("E2_short_gap_interpolation", ["obs"], f"""
with {GAPPED_SQL},
n as (select *, row_number() over (partition by station order by h) as rn from gapped),
k as (select *,
   last_value(x ignore nulls) over w1 as pv, last_value(case when x is not null then rn end ignore nulls) over w1 as pr,
   first_value(x ignore nulls) over w2 as nv, first_value(case when x is not null then rn end ignore nulls) over w2 as nr
 from n window w1 as (partition by station order by h rows between unbounded preceding and current row),
               w2 as (partition by station order by h rows between current row and unbounded following))
select station, h, round(case when x is not null then x
  when pv is not null and nv is not null then
    case when rn - pr <= 3 or nr - rn <= 3 then pv + (nv - pv) * (rn - pr) / (nr - pr) end
  when rn - pr <= 3 then pv when nr - rn <= 3 then nv end, 6) + 0e0 as x
from k""")
def short_gaps(spark, d):
    return r6(tiling.fill_short_gaps(gapped(spark, d), ["station"], "h", ["x"]), "x")


def _at(k, c="mm_c"):
    return f"max({c}) over (partition by station order by h range between {k} preceding and {k} preceding)"


def _last(k, f="sum", c="mm_c"):
    return f"{f}({c}) over (partition by station order by h range between {k - 1} preceding and current row)"


def _next(k, f="sum", c="mm_c"):
    return f"{f}({c}) over (partition by station order by h range between 1 following and {k} following)"


@query("E3_lags", ["obs"],
       "select station, h, " + ", ".join(f"{_at(k)} as lag_{k}h" for k in windows.LAGS) + " from obs")
def lags(spark, d):
    return windows.lags(V.obs(spark, d), "mm_c").select("station", "h", *[f"lag_{k}h" for k in windows.LAGS])


@query("E4_rolling_totals", ["obs"],
       "select station, h, " + ", ".join(
           f"cast({_last(k)} as bigint) as chuva_{k}h" for k in windows.TOTALS) + " from obs")
def totals(spark, d):
    return windows.rolling_totals(V.obs(spark, d), "mm_c").select(
        "station", "h", *[f"chuva_{k}h" for k in windows.TOTALS])


@query("E5_rolling_spread", ["obs"], f"""
select station, h, round(coalesce({_last(24, "stddev_samp")}, 0), 4) + 0e0 as rolling_std_24h,
  {_last(24, "max")} as rolling_max_24h from obs""")
def spread(spark, d):
    out = cleaning.fill_zero(windows.rolling_spread(V.obs(spark, d), "mm_c"), ["rolling_std_24h"])
    return out.select("station", "h", (F.round("rolling_std_24h", 4) + F.lit(0.0)).alias("rolling_std_24h"),
                      "rolling_max_24h")


@query("E6_trends", ["weather"], f"""
select station, h,
  round({_at(1, "precipitacao")} - {_at(6, "precipitacao")}, 6) + 0e0 as tendencia_6h,
  round({_at(1, "pressao")} - {_at(3, "pressao")}, 6) + 0e0 as queda_pressao_3h,
  round({_at(1, "pressao")} - {_at(24, "pressao")}, 6) + 0e0 as queda_pressao_24h,
  round(orvalho - {_at(3, "orvalho")}, 6) + 0e0 as tendencia_orvalho_3h
from weather""")
def trends(spark, d):
    cols = ["tendencia_6h", "queda_pressao_3h", "queda_pressao_24h", "tendencia_orvalho_3h"]
    return r6(windows.trends(V.weather(spark, d)), *cols).select("station", "h", *cols)


@query("E7_future_target", ["obs"], f"""
select station, h, cast(case when {_next(24, "count")} = 24 then {_next(24)} end as bigint) as chuva_futura_24h
from obs""")
def target(spark, d):
    return windows.future_total(V.obs(spark, d), "mm_c").select("station", "h", "chuva_futura_24h")


@query("E8_forecast_future", ["obs"], f"""
select station, h, cast(case when {_next(24, "count")} = 24 then {_next(24)} end as bigint) as soma,
  case when {_next(24, "count", "n")} = 24 then {_next(24, "max", "n")} end as pico
from obs""")
def forecast_future(spark, d):
    total = windows.future_total(V.obs(spark, d), "mm_c", name="soma")
    return windows.future_max(total, "n", name="pico").select("station", "h", "soma", "pico")


@query("E9_future_mean_hours", ["obs"], f"""
select station, h, round({_next(24, "avg")}, 6) + 0e0 as media from obs where a % 5 <> 0""")
def future_mean_hours(spark, d):
    kept = V.obs(spark, d).where("a % 5 <> 0")
    out = windows.future_mean(kept, ["mm_c"], suffix="_media")
    return out.select("station", "h", round6(F.col("mm_c_media")).alias("media"))


@query("E9_future_mean_rows", ["obs"], """
select station, h, round(avg(mm_c) over (partition by station order by h rows between 1 following and 24 following), 6) + 0e0 as media
from obs where a % 5 <> 0""")
def future_mean_rows(spark, d):
    kept = V.obs(spark, d).where("a % 5 <> 0")
    out = windows.future_mean(kept, ["mm_c"], by_row=True, suffix="_media")
    return out.select("station", "h", round6(F.col("mm_c_media")).alias("media"))


@query("E10_run_ids", ["obs"], """
with f as (select station, h, case when mm_c > 5000 then 1 else 0 end as y from obs),
c as (select *, case when y is distinct from lag(y) over (partition by station order by h) then 1 else 0 end as s from f)
select station, h, y, cast(sum(s) over (partition by station order by h rows unbounded preceding) as bigint) as run from c""")
def run_ids(spark, d):
    flagged = V.obs(spark, d).selectExpr("station", "h", "case when mm_c > 5000 then 1 else 0 end as y")
    return tiling.with_run_id(flagged, ["station"], "h", "y", "run").select("station", "h", "y", "run")


@query("E11_cumulative_hits", ["scored"], """
with g as (select previsto as score, count(*) as n, sum(y) as tp from scored group by 1)
select score, cast(sum(tp) over (order by score desc) as bigint) as vp,
  cast(sum(n - tp) over (order by score desc) as bigint) as fp from g""")
def cumulative_hits(spark, d):
    from pluvia.operators.prefix import running_totals

    hist = metrics.score_histogram(V.scored(spark, d), "y", "previsto")
    out = running_totals(hist, [], "_s", ["_n", "_tp"], descending=True)
    return out.select(F.col("_s").alias("score"), F.col("cum__tp").alias("vp"),
                      (F.col("cum__n") - F.col("cum__tp")).alias("fp"))


@query("E12_top_hours_per_station", ["obs"], """
select station, h, mm_c, cast(r as bigint) as posicao from (
  select *, row_number() over (partition by station order by mm_c desc, h) as r from obs) where r <= 10""")
def top_hours(spark, d):
    rank = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("mm_c"), "h"))
    return V.obs(spark, d).withColumn("posicao", rank.cast("int")).where("posicao <= 10").select(
        "station", "h", "mm_c", F.col("posicao").cast("long").alias("posicao"))


# ----------------------------------------------------------------------- P: cleaning
@query("P1_header_canonical", (), """
select s_suppkey as k, case s_suppkey % 3 when 0 then 'PRECIPITACAO TOTAL, HORARIO (MM)'
  when 1 then 'RADIACAO GLOBAL (KJ/M)' else 'TEMPERATURA DO PONTO DE ORVALHO (C)' end as cabecalho from supplier""")
def header_canonical(spark, d):
    raw = F.expr("""case s_suppkey % 3 when 0 then ' PRECIPITAÇÃO TOTAL, HORÁRIO (mm)'
      when 1 then 'RADIAÇÃO GLOBAL (Kj/m²) ' else 'TEMPERATURA DO PONTO DE ORVALHO (°C)' end""")
    return V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), text.canonical_header(raw).alias("cabecalho"))


@query("P2_merge_columns", (), """
select event_id, case when event_id % 3 = 0 then value when event_id % 5 = 0 then null else value * 2 end as radiacao from events""")
def merge_columns(spark, d):
    raw = V.table(spark, d, "events").selectExpr(
        "event_id",
        "case when event_id % 3 = 0 then cast(value as string) else 'x' end as radiacao_a",
        "case when event_id % 5 = 0 and event_id % 3 <> 0 then null else cast(value * 2 as string) end as radiacao_b")
    return cleaning.merge_columns(raw, {"radiacao": ["radiacao_a", "radiacao_b"]})


DIRTY = "case when event_id % 7 = 0 then -9999e0 else value end"


@query("P3_sentinel_to_null", (), f"select event_id, nullif({DIRTY}, -9999e0) as v from events")
def sentinel(spark, d):
    raw = V.table(spark, d, "events").selectExpr("event_id", f"{DIRTY} as v")
    return cleaning.null_sentinel(raw, ["v"])


@query("P4_numeric_coercion", (), """
select event_id, case when event_id % 4 = 0 then null when event_id % 4 = 1 then null else value end as v from events""")
def coercion(spark, d):
    raw = V.table(spark, d, "events").selectExpr(
        "event_id", "case event_id % 4 when 0 then 'junk' when 1 then 'NaN' else cast(value as string) end as v")
    return cleaning.to_numbers(raw, ["v"])


RAW_TIME = [
    "event_id",
    "case when event_id % 50 = 0 then 'xx' when event_id % 2 = 0 then date_format(ts, 'yyyy-MM-dd') end as d1",
    "case when event_id % 2 = 0 then date_format(ts, 'HH:mm') end as h1",
    "case when event_id % 2 = 1 then date_format(ts, 'yyyy/MM/dd') end as d2",
    "case when event_id % 2 = 1 then concat(cast(cast(date_format(ts, 'HHmm') as int) as string), ' UTC') end as h2",
]


def raw_times(spark, d):
    return V.table(spark, d, "events").selectExpr(*RAW_TIME)


def parsed_times(spark, d):
    ts = cleaning.observation_time(F.col("d1"), F.col("h1"), F.col("d2"), F.col("h2"))
    return raw_times(spark, d).select("event_id", ts.alias("data_hora"))


@query("P5_timestamp_layouts", (), """
select event_id, case when event_id % 50 <> 0 then cast(floor(epoch(ts) / 60) as bigint) end as minuto from events""")
def timestamps(spark, d):
    return parsed_times(spark, d).select(
        "event_id", F.floor(F.unix_seconds("data_hora") / 60).cast("long").alias("minuto"))


@query("P6_drop_invalid_time", (), """
select count(*) as linhas, count(*) filter (event_id % 50 = 0) as rejeitadas from events""")
def invalid_time(spark, d):
    return parsed_times(spark, d).agg(
        F.count("*").alias("linhas"), F.count_if(F.col("data_hora").isNull()).alias("rejeitadas"))


@query("P6_counted_losses", (), """
select count(*) as linhas, count(*) filter (event_id % 50 <> 0) as mantidas, count(*) filter (event_id % 50 = 0) as hora_invalida,
  count(*) filter (event_id % 50 <> 0 and not value between 1 and 40) as value_anulados,
  count(*) filter (event_id % 50 <> 0 and value between 1 and 40) as com_valor from events""")
def counted_losses(spark, d):
    """The figures of the losses beside the result, from the pass that writes it."""
    rows = parsed_times(spark, d).join(V.table(spark, d, "events").select("event_id", "value"), "event_id")
    plausible = F.when(F.col("value").between(1, 40), F.col("value"))
    kept, losses = cleaning.counted_losses(rows, {"hora_invalida": F.col("data_hora").isNull()}, {"value": plausible})
    good = materialise(kept, "kept").agg(F.count("value").alias("com_valor"))
    return good.select(*[F.lit(n).cast("long").alias(c) for c, n in losses.get.items()], "com_valor")


@query("P7_required_columns", ["weather"], """
select count(*) as linhas, count(precipitacao) as com_chuva from weather""")
def required(spark, d):
    return cleaning.require_columns(V.weather(spark, d), config.REQUIRED_MEASURES).agg(
        F.count("*").alias("linhas"), F.count("precipitacao").alias("com_chuva"))


WILD = {
    "precipitacao": "mm_c / 30e0", "temperatura": "(a % 900) / 10e0 - 20e0", "umidade": "(a % 130) - 10e0",
    "pressao": "800e0 + (a * 7 % 3000) / 10e0", "vento": "(a * 3 % 900) / 10e0 - 5e0",
}


@query("P8_out_of_range_to_null", ["obs"], """
with w as (select station, h, """ + ", ".join(f"{e} as {c}" for c, e in WILD.items()) + """ from obs)
select station, h, """ + ", ".join(
    f"case when {c} between {config.RANGES[c][0]}::double and {config.RANGES[c][1]}::double then {c} end as {c}" for c in WILD) + " from w")
def ranges(spark, d):
    raw = V.obs(spark, d).selectExpr("station", "h", *[f"{e} as {c}" for c, e in WILD.items()])
    return cleaning.within_ranges(raw)


@query("P9_dedupe_keep_first", (), """
select station, h, event_id, value from (
  select user_id as station, cast(floor(epoch(ts) / 3600) as bigint) as h, event_id, value,
    row_number() over (partition by user_id, cast(floor(epoch(ts) / 3600) as bigint) order by event_type, event_id) as r
  from events) where r = 1""")
def dedupe(spark, d):
    rows = V.table(spark, d, "events").select(
        F.col("user_id").alias("station"), clock.epoch_hour(F.col("ts")).alias("h"), "event_type", "event_id", "value")
    return cleaning.keep_first(rows, ["station", "h"], ["event_type", "event_id"]).drop("event_type")


@query("P10_complete_rows", ["weather"], """
select station, h, pressao from weather
where temperatura is not null and umidade is not null and pressao is not null and vento is not null and a % 3 <> 0""")
def complete(spark, d):
    rows = V.weather(spark, d).withColumn("observado", F.col("a") % 3 != 0)
    return cleaning.complete_rows(rows, config.REQUIRED_MEASURES, "observado").select("station", "h", "pressao")


@query("P11_fill_zero", ["weather"], """
select station, h, coalesce(temperatura, 0e0) as temperatura, coalesce(pressao, 0e0) as pressao, umidade from weather""")
def zero_fill(spark, d):
    rows = V.weather(spark, d).select("station", "h", "temperatura", "pressao", "umidade")
    return cleaning.fill_zero(rows, ["temperatura", "pressao"])


@query("P12_event_label", ["obs"], f"""
select station, h, case when t > {V.HEAVY_C} then 1 else 0 end as evento_extremo, case when t > 100000 then 1 else 0 end as moderado
from (select station, h, {_last(24)} as t from obs)""")
def labels(spark, d):
    rows = windows.rolling_totals(V.obs(spark, d), "mm_c", [24])
    rows = cleaning.label_above(rows, "chuva_24h", V.HEAVY_C)
    return cleaning.label_above(rows, "chuva_24h", 100000, "moderado").select(
        "station", "h", "evento_extremo", "moderado")


@query("P13_emission_hours", ["obs"], "select station, h, mm_c from obs where h % 24 in (0, 12)")
def emission(spark, d):
    return cleaning.at_hours(V.obs(spark, d), [0, 12]).select("station", "h", "mm_c")


@query("P14_station_subset", ["obs_daily"], """
select station, dia, mm from obs_daily where station in (select s_suppkey from supplier where s_acctbal > 5000)""")
def subset(spark, d):
    keep = V.table(spark, d, "supplier").where("s_acctbal > 5000").selectExpr("s_suppkey as station")
    return cleaning.only_stations(V.daily(spark, d), keep).select("station", "dia", "mm")


@query("P15_warning_types", ["warnings"], """
select id, descricao, descricao in ('Chuvas Intensas', 'Tempestade', 'Acumulado de Chuva') as de_chuva
from warnings where descricao <> 'Baixa Umidade'""")
def types(spark, d):
    kept = cleaning.only_types(V.warnings(spark, d), config.GROUND_TRUTH_TYPES)
    return kept.select("id", "descricao", F.col("descricao").isin(config.RAIN_TYPES).alias("de_chuva"))


@query("P16_align_features", ["weather"], """
select cast(null as double) as soil_moisture, vento, precipitacao, cast(a as double) as a from weather""")
def align(spark, d):
    return cleaning.align_columns(V.weather(spark, d), ["soil_moisture", "vento", "precipitacao", "a"])


@query("P17_impute_monthly", ["weather"], """
with m as (select *, month(make_timestamp(h * 3600000000)) as mes from weather)
select station, h, round(coalesce(temperatura, avg(temperatura) over (partition by station, mes), avg(temperatura) over (), 0), 6) + 0e0 as temperatura,
  round(coalesce(pressao, avg(pressao) over (partition by station, mes), avg(pressao) over (), 0), 6) + 0e0 as pressao from m""")
def impute(spark, d):
    rows = V.weather(spark, d).withColumn("mes", F.month(clock.day_of_hour(F.col("h"))))
    out = cleaning.impute_monthly(rows, ["temperatura", "pressao"])
    return r6(out, "temperatura", "pressao").select("station", "h", "temperatura", "pressao")


# ------------------------------------------------------------------- F: expressions
@query("F1_haversine", ["stations"], """
select station, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat + 30) / 2), 2)
  + cos(radians(-30)) * cos(radians(lat)) * pow(sin(radians(lon + 51) / 2), 2))), 6) + 0e0 as km from stations""")
def haversine(spark, d):
    km = geo.haversine_km(F.lit(-30.0), F.lit(-51.0), F.col("lat"), F.col("lon"))
    return V.stations(spark, d).select("station", round6(km).alias("km"))


@query("F2_cyclic_time", ["obs"], """
select station, h, cast(h % 24 as integer) as hora, cast(month(make_timestamp(h * 3600000000)) as integer) as mes,
  round(sin(2 * pi() * (h % 24) / 24), 6) + 0e0 as hora_sin, round(cos(2 * pi() * (h % 24) / 24), 6) + 0e0 as hora_cos,
  round(sin(2 * pi() * month(make_timestamp(h * 3600000000)) / 12), 6) + 0e0 as mes_sin,
  round(cos(2 * pi() * month(make_timestamp(h * 3600000000)) / 12), 6) + 0e0 as mes_cos from obs""")
def cyclic_time(spark, d):
    rows = V.obs(spark, d).select(
        "station", "h", clock.hour_of_day(F.col("h")).alias("hora"),
        F.month(clock.day_of_hour(F.col("h"))).alias("mes"))
    (hs, hc), (ms, mc) = clock.cyclic(F.col("hora"), 24), clock.cyclic(F.col("mes"), 12)
    return r6(rows.withColumns({"hora_sin": hs, "hora_cos": hc, "mes_sin": ms, "mes_cos": mc}),
              "hora_sin", "hora_cos", "mes_sin", "mes_cos")


@query("F3_wind_vectors", ["weather"], """
select station, h, round(sin(radians(vento_dir)), 6) + 0e0 as vento_dir_sin, round(cos(radians(vento_dir)), 6) + 0e0 as vento_dir_cos,
  round(-cos(radians(vento_dir)) * vento, 6) + 0e0 as vento_norte, round(-sin(radians(vento_dir)) * vento, 6) + 0e0 as vento_leste from weather""")
def wind(spark, d):
    north, east = clock.wind_components(F.col("vento"), F.col("vento_dir"))
    rows = V.weather(spark, d).select(
        "station", "h", F.sin(F.radians("vento_dir")).alias("vento_dir_sin"),
        F.cos(F.radians("vento_dir")).alias("vento_dir_cos"),
        north.alias("vento_norte"), east.alias("vento_leste"))
    return r6(rows, "vento_dir_sin", "vento_dir_cos", "vento_norte", "vento_leste")


@query("F4_differences", ["weather"], """
select station, h, round(temperatura - orvalho, 6) + 0e0 as deficit_orvalho, round(rajada - vento, 6) + 0e0 as rajada_excesso,
  round(temp_max - temp_min, 6) + 0e0 as amplitude_temp, round(pressao_max - pressao_min, 6) + 0e0 as amplitude_pressao,
  round(temperatura * umidade, 6) + 0e0 as temp_umidade from weather""")
def differences(spark, d):
    from pluvia.plans.features import point_features

    cols = ["deficit_orvalho", "rajada_excesso", "amplitude_temp", "amplitude_pressao", "temp_umidade"]
    return r6(point_features(V.weather(spark, d)), *cols).select("station", "h", *cols)


@query("F5_log_score", (), "select event_id, round(ln(1 + greatest(value - 50, 0)), 6) + 0e0 as ifs_log from events")
def log_score(spark, d):
    return V.table(spark, d, "events").select(
        "event_id", round6(F.log1p(F.greatest(F.col("value") - 50, F.lit(0.0)))).alias("ifs_log"))


@query("F6_rain_criterion", ["warnings"], """
select id, case when id % 4 = 0 then cast(20 + id % 60 as double) when id % 4 = 1 then cast(20 + id % 40 as double) end as criterio_mm from warnings""")
def rain_criterion(spark, d):
    return V.warnings(spark, d).select("id", text.rain_criterion(F.col("riscos")).alias("criterio_mm"))


@query("F7_gust_criterion", ["warnings"], """
select id, round(case when id % 4 = 0 then 40 / 3.6e0 when id % 4 = 2 then 100 / 3.6e0 end, 6) as criterio_ms from warnings""")
def gust_criterion(spark, d):
    return V.warnings(spark, d).select("id", round6(text.gust_criterion(F.col("riscos"))).alias("criterio_ms"))


@query("F8_instants", (), """
select o_orderkey as id, cast(epoch(o_orderdate) / 60 as bigint) + (o_orderkey % 24) * 60 + o_orderkey % 60 as minuto,
  strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':00Z' as iso
from orders""")
def instants(spark, d):
    rows = V.table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00.000Z') as data",
        "concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', lpad(cast(o_orderkey % 60 as string), 2, '0')) as hora")
    at = clock.instant(F.col("data"), F.col("hora"))
    return rows.select("id", (F.unix_seconds(at) / 60).cast("long").alias("minuto"),
                       F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


EDGES = config.INTENSITY_EDGES


@query("F9_intensity_bins", (), "select l_orderkey, l_linenumber, case "
       + " ".join(f"when l_quantity * 2 >= {a} and l_quantity * 2 < {b} then {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
       + " end as faixa from lineitem")
def bins(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("v"))
    return metrics.with_intensity_bin(rows, "v").drop("v")


@query("F10_severity_rank", ["warnings"], """
select id, case severidade when 'Grande Perigo' then 3 when 'Perigo' then 2 when 'Perigo Potencial' then 1 else 0 end as gravidade from warnings""")
def severity(spark, d):
    from pluvia.operators.warnings import severity_rank

    return V.warnings(spark, d).select("id", severity_rank(F.col("severidade")).alias("gravidade"))


@query("F11_payload_shapes", (), """
select o_orderkey as id, o_orderkey % 5 < 3 as obtido, case when o_orderkey % 5 < 3 then o_orderpriority end as severidade from orders""")
def payloads(spark, d):
    from pluvia.sources.payloads import normalise_warning_payload

    landed = V.table(spark, d, "orders").selectExpr("o_orderkey as id", """case o_orderkey % 5
      when 0 then concat('{"id":', o_orderkey, ',"severidade":"', o_orderpriority, '"}')
      when 1 then concat('[{"id":', o_orderkey, ',"severidade":"', o_orderpriority, '"}]')
      when 2 then concat('{"hoje":[{"id":', o_orderkey, ',"severidade":"', o_orderpriority, '"}],"futuro":[]}')
      when 3 then '[]' end as payload""", "200 as http")
    return normalise_warning_payload(landed).select("id", "obtido", "severidade")


@query("F12_day_anchors", (), """
select event_id, cast(ts as date) as dia_utc, cast(ts - interval 12 hours as date) as dia_emissao,
  cast(date_trunc('hour', ts) + interval 11 hours as date) as dia_pluviometrico from events""")
def anchors(spark, d):
    h = clock.epoch_hour(F.col("ts"))
    return V.table(spark, d, "events").select(
        "event_id", clock.day_of_hour(h).alias("dia_utc"), clock.day_of_hour(h, -12).alias("dia_emissao"),
        clock.day_of_hour(h, 11).alias("dia_pluviometrico"))


@query("F13_output_format", (), """
select event_id, round(greatest(value - 20, 0), 2) as chuva_24h_prevista, round(value / 700, 4) as risco from events""")
def formatted(spark, d):
    return V.table(spark, d, "events").select(
        "event_id", F.round(F.greatest(F.col("value") - 20, F.lit(0.0)), 2).alias("chuva_24h_prevista"),
        F.round(F.col("value") / 700, 4).alias("risco"))
