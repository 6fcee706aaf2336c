"""Queries: the cleaned table and the feature table as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import config
from pluvia.operators import cleaning, tiling
from pluvia.plans import views as V
from pluvia.plans.catalog_joins import NEAR_SQL
from pluvia.plans.catalog_series import _at, _last, _next, r6
from pluvia.plans.features import feature_table
from pluvia.plans.registry import query

RAW = {
    "precipitacao": "case when a % 9 = 0 then -9999e0 else mm_c / 30e0 end",
    "temperatura": "(a % 900) / 10e0 - 20e0",
    "umidade": "(a % 130) - 10e0",
    "pressao": "800e0 + (a * 7 % 3000) / 10e0",
    "vento": "(a * 3 % 900) / 10e0 - 5e0",
}


def _clean_sql() -> str:
    typed = ", ".join(
        f"case when {c} between {config.RANGES[c][0]}::double and {config.RANGES[c][1]}::double then {c} end as {c}" for c in RAW)
    steps = ["raw as (select station, h, " + ", ".join(f"{e} as {c}" for c, e in RAW.items()) + " from obs)",
             f"typed as (select station, h, {typed}, row_number() over (partition by station order by h) as rn from raw)"]
    filled = []
    for c in RAW:
        pv, nv = f"last_value({c} ignore nulls) over w1", f"first_value({c} ignore nulls) over w2"
        pr = f"last_value(case when {c} is not null then rn end ignore nulls) over w1"
        nr = f"first_value(case when {c} is not null then rn end ignore nulls) over w2"
        filled.append(f"""round(case when {c} is not null then {c} when {pv} is not null and {nv} is not null then
          case when rn - {pr} <= 3 or {nr} - rn <= 3 then {pv} + ({nv} - {pv}) * (rn - {pr}) / ({nr} - {pr}) end
          when rn - {pr} <= 3 then {pv} when {nr} - rn <= 3 then {nv} end, 6) + 0e0 as {c}""")
    return "with " + ",\n".join(steps) + " select station, h, " + ",\n".join(filled) + """ from typed
      window w1 as (partition by station order by h rows between unbounded preceding and current row),
             w2 as (partition by station order by h rows between current row and unbounded following)"""


@query("P_clean_table", ["obs"], _clean_sql())
def clean_table(spark, d):
    """Duplicated raw rows -> sentinel, types, ranges, first copy, short gaps."""
    raw = V.obs(spark, d).selectExpr("station", "h", *[f"cast({e} as string) as {c}" for c, e in RAW.items()])
    copies = raw.withColumn("linha", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn(
        "vento", F.when(F.col("linha") == 1, F.col("vento")).otherwise(F.lit("7")))
    typed = cleaning.null_sentinel(cleaning.to_numbers(copies, list(RAW)), list(RAW))
    unique = cleaning.keep_first(cleaning.within_ranges(typed), ["station", "h"], ["linha"])
    out = tiling.fill_short_gaps(unique.select("station", "h", *RAW), ["station"], "h", list(RAW))
    return r6(out, *RAW)


COLUMNS = ["lag_6h", "chuva_24h", "chuva_72h", "rolling_std_24h", "queda_pressao_24h", "tendencia_orvalho_3h", "viz_chuva_3h",
           "viz_oeste_chuva_3h", "viz_queda_pressao_3h", "clima_chuva_p99", "clima_chuva_mes", "chuva_24h_rel", "deficit_orvalho", "chuva_futura_24h"]


@query("P_feature_table", ["weather", "stations"], f"""
with places as (select * from stations where station in (select station from weather)),
{NEAR_SQL.replace("from stations a join stations b", "from places a join places b")},
span as (select station, min(h) as a, max(h) as b from weather group by 1),
grid as (select g.station, g.h, w.precipitacao, w.pressao from (select station, unnest(generate_series(a, b)) as h from span) g left join weather w using (station, h)),
st as (select station, h, sum(precipitacao) over (partition by station order by h rows between 2 preceding and current row) as c3,
   lag(pressao, 1) over (partition by station order by h) - lag(pressao, 3) over (partition by station order by h) as q3 from grid),
viz as (select n.station, s.h, avg(c3) as v, avg(case when oeste then c3 end) as w, avg(q3) as q from near n join st s on s.station = n.viz group by 1, 2),
past as (select *, month(make_timestamp(h * 3600000000)) as mes from weather where h <= {V.CUTOFF_H}),
cl as (select station, quantile_cont(precipitacao, 0.99) as p99 from past group by 1),
cm as (select station, mes, avg(precipitacao) as mensal from past group by 1, 2),
win as (select *, month(make_timestamp(h * 3600000000)) as mes, {_at(1, "precipitacao")} as lag_1h, {_at(6, "precipitacao")} as lag_6h, {_at(24, "precipitacao")} as lag_24h,
  {_last(24, "sum", "precipitacao")} as chuva_24h, {_last(72, "sum", "precipitacao")} as chuva_72h, {_last(24, "stddev_samp", "precipitacao")} as sd,
  {_at(1, "pressao")} - {_at(24, "pressao")} as q24, orvalho - {_at(3, "orvalho")} as to3,
  case when {_next(24, "count", "precipitacao")} = 24 then {_next(24, "sum", "precipitacao")} end as alvo from weather)
select w.station, w.h, round(lag_6h, 4) + 0e0 as lag_6h, round(chuva_24h, 4) + 0e0 as chuva_24h, round(chuva_72h, 4) + 0e0 as chuva_72h, round(coalesce(sd, 0), 4) + 0e0 as rolling_std_24h,
  round(coalesce(q24, 0), 4) + 0e0 as queda_pressao_24h, round(to3, 4) + 0e0 as tendencia_orvalho_3h, round(v.v, 4) + 0e0 as viz_chuva_3h, round(v.w, 4) + 0e0 as viz_oeste_chuva_3h,
  round(v.q, 4) + 0e0 as viz_queda_pressao_3h, round(p99, 4) + 0e0 as clima_chuva_p99, round(mensal, 4) + 0e0 as clima_chuva_mes, round(chuva_24h / (p99 + 0.1), 4) + 0e0 as chuva_24h_rel,
  round(temperatura - orvalho, 4) + 0e0 as deficit_orvalho, round(alvo, 4) + 0e0 as chuva_futura_24h, case when alvo > 1300 then 1 else 0 end as evento_extremo
from win w left join viz v using (station, h) left join cl on cl.station = w.station left join cm on cm.station = w.station and cm.mes = w.mes
where temperatura is not null and umidade is not null and pressao is not null and vento is not null and lag_1h is not null and lag_6h is not null and lag_24h is not null and alvo is not null""")
def whole_feature_table(spark, d):
    rows = V.weather(spark, d).drop("a")
    places = V.stations(spark, d).join(rows.select("station").distinct(), "station", "left_semi")
    cfg = config.StudyConfig(extreme_mm=1300.0)
    out = feature_table(rows, places, V.CUTOFF_H, cfg)
    return out.select("station", "h", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in COLUMNS], "evento_extremo")
