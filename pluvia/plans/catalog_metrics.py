"""Queries: aggregations and verification metrics (G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions.rates import round6
from pluvia.operators import (
    bootstrap,
    cleaning,
    climatology,
    joins,
    metrics,
    ml,
    profile,
    quality,
    splits,
    warnings,
    windows,
)
from pluvia.operators.storage import materialise
from pluvia.plans import views as V
from pluvia.plans.catalog_joins import GAUGE_SQL, PANEL_SQL, gauge, ours, panel
from pluvia.plans.catalog_series import EDGES, _last, r6
from pluvia.plans.registry import query

FEATURE_SQL = f"""feat as (
  select w.station, w.h, greatest(w.precipitacao - 75, 0) as precipitacao, w.temperatura, w.umidade, w.pressao, w.vento, s.chuva_24h, s.chuva_futura_24h, s.y as evento_extremo,
    month(make_timestamp(w.h * 3600000000)) as mes, cast(sum(o.mm_c) over (partition by w.station order by w.h range between 47 preceding and current row) as bigint) as chuva_48h
  from weather w join obs o using (station, h) left join scored s using (station, h)),
f as (select * from feat where chuva_futura_24h is not null)"""


def features(spark, d):
    from pluvia.functions.clock import day_of_hour

    rain = windows.rolling_totals(V.obs(spark, d), "mm_c", [48]).select("station", "h", "chuva_48h")
    rows = V.weather(spark, d).select(
        "station", "h", F.greatest(F.col("precipitacao") - 75, F.lit(0.0)).alias("precipitacao"),
        "temperatura", "umidade", "pressao", "vento")
    target = V.scored(spark, d).select("station", "h", "chuva_24h", "chuva_futura_24h", F.col("y").alias("evento_extremo"))
    return rows.join(target, ["station", "h"]).join(rain, ["station", "h"]).withColumn(
        "mes", F.month(day_of_hour(F.col("h"))))


@query("G1_profile_summary", ["weather", "scored"], f"""
with {FEATURE_SQL} select count(*) as linhas, min(h) as inicio, max(h) as fim, count(distinct station) as estacoes, count(precipitacao) as n_chuva,
  round(avg(precipitacao), 6) as media_chuva, round(stddev_samp(precipitacao), 6) as desvio_chuva, min(precipitacao) as min_chuva, max(precipitacao) as max_chuva,
  round(avg(evento_extremo), 6) as taxa_evento, round(count(*) filter (precipitacao = 0) / count(*), 6) as taxa_zero from f""")
def summary(spark, d):
    return r6(profile.table_summary(features(spark, d)), "media_chuva", "desvio_chuva", "taxa_evento", "taxa_zero")


@query("G1_target_percentiles", ["scored"], """
select """ + ", ".join(f"round(quantile_cont(chuva_futura_24h, {q}), 4) as {n}" for n, q in
                        (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " from scored")
def percentiles(spark, d):
    out = profile.target_percentiles(V.scored(spark, d))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("G1_label_shares", ["scored"], """
select y as evento_extremo, round(count(*) / (select count(*) from scored), 6) as fracao from scored group by 1""")
def shares(spark, d):
    rows = V.scored(spark, d).withColumnRenamed("y", "evento_extremo")
    return r6(profile.label_shares(rows), "fracao")


@query("G1_event_rate_by_month", ["obs"], f"""
select month(dia) as mes, round(avg(case when mm > 50 then 1 else 0 end), 6) as taxa_evento from (
  select l_suppkey as station, cast(l_shipdate as date) as dia, cast(sum(l_quantity) as bigint) as mm from lineitem group by 1, 2) group by 1""")
def by_month(spark, d):
    rows = cleaning.label_above(V.daily(spark, d), "mm", 50).withColumn("mes", F.month("dia").cast("long"))
    return r6(profile.event_rate_by(rows, "mes"), "taxa_evento")


EPISODE_SQL = """c as (select *, case when y is distinct from lag(y) over (partition by station order by h) then 1 else 0 end as st from scored),
run as (select *, sum(st) over (partition by station order by h rows unbounded preceding) as run from c),
ep as (select station, run, count(*) as linhas, min(h) as inicio, max(h) as fim from run where y = 1 group by 1, 2)"""


@query("G2_episodes", ["scored"], f"with {EPISODE_SQL} select station, linhas, inicio, fim from ep")
def episodes(spark, d):
    return profile.episodes(V.scored(spark, d), "y")


@query("G2_episode_summary", ["scored"], f"""
with {EPISODE_SQL} select cast(sum(linhas) as bigint) as n_positivas, count(*) as n_episodios, quantile_cont(linhas, 0.5) as mediana_linhas from ep""")
def episode_summary(spark, d):
    return profile.episode_summary(V.scored(spark, d), "y")


NUMERIC = ["precipitacao", "temperatura", "umidade", "pressao", "vento", "chuva_24h", "chuva_48h", "chuva_futura_24h", "evento_extremo", "mes"]


@query("G3_target_correlations", ["weather", "scored"], f"""
with {FEATURE_SQL}, r as (""" + " union all ".join(
    f"select '{c}' as coluna, corr(cast({c} as double), cast(chuva_futura_24h as double)) as r from f" for c in NUMERIC)
       + ") select coluna, round(r, 6) as r from r where r is not null and not isnan(r) order by r desc limit 15")
def correlations(spark, d):
    return r6(profile.correlations(features(spark, d), NUMERIC, "chuva_futura_24h"), "r")


@query("G4_remarks", ["weather", "scored"], f"""
with {FEATURE_SQL}, {EPISODE_SQL}, v as (
  select 'esparso' as nota, (select count(*) filter (precipitacao = 0) / count(*) from f) as valor, 0.8 as acima, 1 as sinal
  union all select 'desbalanceado', (select avg(evento_extremo) from f), 0.02, -1
  union all select 'linhas_por_episodio', (select sum(linhas) / count(*) from ep), 10, 1
  union all select 'persistencia', (select corr(chuva_48h, chuva_futura_24h) from f), 0.5, 1)
select nota, round(valor, 6) as valor from v where sinal * valor > sinal * acima""")
def remarks(spark, d):
    rows = features(spark, d)
    out = profile.remarks(
        profile.table_summary(rows), profile.episode_summary(rows),
        profile.correlations(rows, NUMERIC, "chuva_futura_24h"))
    return r6(out, "valor")


@query("G5_station_climatology", ["weather"], f"""
with past as (select * from weather where h <= {V.CUTOFF_H})
select station, round(avg(precipitacao), 6) as clima_chuva_media, round(avg(umidade), 6) as clima_umidade_media,
  round(avg(pressao), 6) as clima_pressao_media, round(quantile_cont(precipitacao, 0.99), 6) as clima_chuva_p99 from past group by 1""")
def station_climate(spark, d):
    out = climatology.station_climatology(V.weather(spark, d), V.CUTOFF_H)
    return r6(out, "clima_chuva_media", "clima_umidade_media", "clima_pressao_media", "clima_chuva_p99")


@query("G5_station_climatology_whole_base", ["weather"], """
select station, round(avg(precipitacao), 6) as clima_chuva_media, round(quantile_cont(precipitacao, 0.99), 6) as clima_chuva_p99 from weather group by 1""")
def whole_base(spark, d):
    out = climatology.station_climatology(V.weather(spark, d), 0)
    return r6(out, "clima_chuva_media", "clima_chuva_p99").select("station", "clima_chuva_media", "clima_chuva_p99")


@query("G6_monthly_climatology", ["obs_daily"], """
select station, month(dia) as mes, round(avg(mm), 6) as clima_chuva_mes from obs_daily where dia <= date '1999-12-31' group by 1, 2""")
def monthly(spark, d):
    rows = V.daily(spark, d).withColumns({"mes": F.month("dia").cast("long"), "dia_n": F.unix_date("dia")})
    cutoff = 10956  # 1999-12-31
    return r6(climatology.monthly_climatology(rows, cutoff, rain="mm", hour="dia_n"), "clima_chuva_mes")


@query("G7_relative_total", ["obs"], f"""
with p as (select station, quantile_cont(mm_c, 0.99) as p99 from obs where h <= {V.CUTOFF_H} group by 1)
select station, h, round({_last(24).replace("station order", "o.station order")} / (p99 + 0.1), 6) as chuva_24h_rel from obs o join p using (station)""")
def relative(spark, d):
    from pluvia.operators.prefix import exact_quantiles

    rows = windows.rolling_totals(V.obs(spark, d), "mm_c", [24])
    p99 = exact_quantiles(climatology.before_cutoff(V.obs(spark, d), V.CUTOFF_H), ["station"], "mm_c", {"p99": 0.99})
    joined = joins.attach(rows, p99, ["station"], spread_by="h", how="inner")
    out = climatology.relative_total(joined, p99="p99")
    return r6(out, "chuva_24h_rel").select("station", "h", "chuva_24h_rel")


@query("G8_station_day_collapse", ["scored"], """
select station, cast(make_timestamp(h * 3600000000) as date) as dia, max(y) as y, max(prob) as prob from scored group by 1, 2""")
def collapse(spark, d):
    return metrics.station_day(V.scored(spark, d), "y", ["prob"])


@query("G9_observed_station_day", ["obs"], """
select station, cast(make_timestamp((h - 12) * 3600000000) as date) as dia, cast(sum(mm_c) as bigint) as chuva_24h_obs, max(n) as rajada_max_obs
from (select station, h, case when a % 9 = 0 then null else mm_c end as mm_c, n from obs) group by 1, 2 having count(mm_c) >= 18""")
def observed_days(spark, d):
    rows = V.obs(spark, d).selectExpr("station", "h", "case when a % 9 = 0 then null else mm_c end as mm", "n as gust")
    return metrics.observed_days(rows)


@query("G10_gauge_day", ["obs"], """
select station, cast(make_timestamp((h + 11) * 3600000000) as date) as dia, case when count(mm_c) >= 20 then cast(sum(mm_c) as bigint) end as chuva_nossa
from (select station, h, case when a % 9 = 0 then null else mm_c end as mm_c from obs) group by 1, 2""")
def gauge_day(spark, d):
    rows = V.obs(spark, d).selectExpr("station", "h", "case when a % 9 = 0 then null else mm_c end as mm")
    return metrics.gauge_days(rows, 20)


COMPARE_SQL = f"""{GAUGE_SQL}, j as (select g.station, g.dia, g.chuva_bdmep as b, o.chuva_nossa as a from gauge g left join ours o using (station, dia) where g.chuva_bdmep is not null),
cmp as (select station, count(a) as dias, 100e0 * count(a) / count(*) as cobertura_pct, corr(cast(a as double), case when a is not null then cast(b as double) end) as r,
  100 * avg(case when a is not null then case when abs(a - b) < 0.2 then 1e0 else 0e0 end end) as iguais_pct, avg(a - b) as vies_mm,
  cast(sum(a) as double) as total_nosso, cast(sum(case when a is not null then b end) as double) as total_referencia,
  count(*) filter (a > 50) as eventos_nossos, count(*) filter (a is not null and b > 50) as eventos_referencia from j group by 1)"""


def comparison(spark, d):
    return quality.compare_series(ours(spark, d), gauge(spark, d), "chuva_nossa", "chuva_bdmep")


@query("G11_series_comparison", ["obs_daily"], f"""
with {COMPARE_SQL} select station, dias, round(cobertura_pct, 6) as cobertura_pct, round(r, 6) as r, round(iguais_pct, 6) as iguais_pct, round(vies_mm, 6) + 0e0 as vies_mm,
  total_nosso, total_referencia, eventos_nossos, eventos_referencia, case when dias < 100 then 'poucos dias' else 'ok' end as situacao from cmp""")
def series_comparison(spark, d):
    return r6(comparison(spark, d), "cobertura_pct", "r", "iguais_pct", "vies_mm")


@query("G11_comparison_summary", ["obs_daily"], f"""
with {COMPARE_SQL} select count(*) as estacoes, count(*) filter (r > 0.99) as r_acima_99, round(quantile_cont(cobertura_pct, 0.5), 6) as cobertura_mediana,
  round(min(cobertura_pct), 6) as cobertura_min from cmp where dias >= 100""")
def comparison_summary(spark, d):
    from pluvia.operators.prefix import exact_quantiles

    ok = comparison(spark, d).where("situacao = 'ok'")
    median = exact_quantiles(ok, [], "cobertura_pct", {"m": 0.5}).scalar()
    counts = ok.agg(
        F.count("*").alias("estacoes"), F.count_if(F.col("r") > 0.99).alias("r_acima_99"),
        F.min("cobertura_pct").alias("cobertura_min"))
    return r6(counts.withColumn("cobertura_mediana", median), "cobertura_min", "cobertura_mediana")


PO_SQL = """po as (
  select p.*, o.chuva_24h_obs, o.rajada_max_obs,
    coalesce(o.chuva_24h_obs >= p.criterio_mm, false) or coalesce(o.rajada_max_obs >= p.criterio_ms, false) as confirmado,
    coalesce(o.chuva_24h_obs >= p.criterio_mm, false) as confirmado_chuva
  from pairs p join observed o using (station, dia))"""
SEVERITY_OF = {"8": "Grande Perigo", "7": "Perigo", "6": "Perigo Potencial"}


def pairs_observed(spark, d):
    joined = V.panel_pairs(spark, d).join(V.daily_observed(spark, d), ["station", "dia"])
    return warnings.with_confirmation(joined)


@query("G12_confirmation_flags", ["observed", "pairs"], f"""
with {PO_SQL} select station, dia, id, confirmado, confirmado_chuva from po""")
def confirmation(spark, d):
    return pairs_observed(spark, d).select("station", "dia", "id", "confirmado", "confirmado_chuva")


BASE_SQL = f"""{PO_SQL}, combos as (select distinct criterio_mm, criterio_ms from po union select distinct criterio_mm, cast(null as double) from po),
base as (select criterio_mm, criterio_ms, avg(case when coalesce(chuva_24h_obs >= criterio_mm, false) or coalesce(rajada_max_obs >= criterio_ms, false) then 1e0 else 0e0 end) as taxa_base
  from combos cross join observed group by 1, 2)"""


@query("G13_base_rates", ["observed", "pairs"], f"""
with {BASE_SQL} select criterio_mm, round(criterio_ms, 6) as criterio_ms, round(taxa_base, 6) as taxa_base from base""")
def base_rates(spark, d):
    rates = warnings.base_rates(V.daily_observed(spark, d), warnings.criteria_of(pairs_observed(spark, d)))
    return r6(rates, "criterio_ms", "taxa_base")


EXPECTED_SQL = f"""{BASE_SQL}, e as (select po.*, b.taxa_base as esperado from po join base b
  on po.criterio_mm is not distinct from b.criterio_mm and po.criterio_ms is not distinct from b.criterio_ms)"""


def with_expected(spark, d, rain_only=False):
    rows = materialise(pairs_observed(spark, d))
    rates = warnings.base_rates(V.daily_observed(spark, d), warnings.criteria_of(rows))
    return warnings.attach_base_rate(rows, rates, rain_only)


@query("G14_expected_rate", ["observed", "pairs"], f"""
with {EXPECTED_SQL} select descricao, round(avg(esperado), 6) as esperado from e group by 1""")
def expected(spark, d):
    return r6(with_expected(spark, d).groupBy("descricao").agg(F.avg("esperado").alias("esperado")), "esperado")


def _table_sql(group, flag="confirmado"):
    return f"""per as (select {group} as grupo, id, count(*) as n, count(*) filter ({flag}) as k, max(case when {flag} then 1 else 0 end) as alguma, sum(esperado) as se from e group by 1, 2),
g as (select grupo, count(*) as nw, sum(alguma) as kw, sum(n) as nr, sum(k) as kr, sum(se) / sum(n) as clima from per group by 1),
u as (select grupo, 'area' as unidade, cast(nw as bigint) as n, kw / nw as p, clima from g union all select grupo, 'ponto', cast(nr as bigint), kr / nr, clima from g),
t as (select grupo, unidade, n, round(p, 3) as taxa,
  round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4e0 * n * n)) / (1 + 1.96 * 1.96 / n)), 3) as ic_inf,
  round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4e0 * n * n)) / (1 + 1.96 * 1.96 / n)), 3) as ic_sup,
  round(clima, 3) as climatologia, case when clima > 0 then round(p / clima, 1) end as ganho from u)"""


@query("G15_confirmation_table", ["observed", "pairs"], f"""
with {EXPECTED_SQL}, {_table_sql("id_severidade")} select * from t""")
def confirmation_table(spark, d):
    return warnings.confirmation_table(with_expected(spark, d), "id_severidade")


@query("G15_confirmation_table_rain", ["observed", "pairs"], f"""
with {BASE_SQL}, e as (select po.*, b.taxa_base as esperado from po join base b on po.criterio_mm = b.criterio_mm and b.criterio_ms is null),
{_table_sql("descricao", "confirmado_chuva")} select * from t""")
def confirmation_table_rain(spark, d):
    rows = with_expected(spark, d, rain_only=True).where(F.col("criterio_mm").isNotNull())
    return warnings.confirmation_table(rows, "descricao", "confirmado_chuva")


GAP_SQL = f"""{EXPECTED_SQL}, {_table_sql("id_severidade")},
gap as (select grupo, max(case when unidade = 'area' then taxa end) as area, max(case when unidade = 'ponto' then taxa end) as ponto from t group by 1)"""


@query("G16_area_point_gap", ["observed", "pairs"], f"""
with {GAP_SQL} select grupo, area, ponto, case when ponto > 0 then round(area / ponto, 1) end as razao, round(area - ponto, 3) as diferenca from gap""")
def gap(spark, d):
    return warnings.gap_table(warnings.confirmation_table(with_expected(spark, d), "id_severidade"))


@query("G17_wilson_interval", ["obs_daily"], """
with g as (select station, count(*) as n, avg(case when mm > 60 then 1e0 else 0e0 end) as p from obs_daily group by 1)
select station, n, round(p, 6) as p,
  round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4e0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) + 0e0 as ic_inf,
  round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4e0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) + 0e0 as ic_sup from g""")
def wilson(spark, d):
    from pluvia.functions.rates import wilson as interval

    rows = V.daily(spark, d).groupBy("station").agg(
        F.count("*").alias("n"), F.avg((F.col("mm") > 60).cast("double")).alias("p"))
    low, high = interval(F.col("p"), F.col("n"))
    return r6(rows.withColumns({"ic_inf": low, "ic_sup": high}), "p", "ic_inf", "ic_sup")


@query("G18_warning_coverage", ["observed", "pairs"], f"""
with {PANEL_SQL} select count(*) as estacao_dias, round(avg(case when tem_aviso then 1e0 else 0e0 end), 6) as sob_aviso, count(*) filter (evento) as eventos,
  round(avg(case when evento then case when tem_aviso then 1e0 else 0e0 end end), 6) as recall from panel""")
def coverage(spark, d):
    return r6(warnings.coverage_summary(panel(spark, d)), "sob_aviso", "recall")


CURVE = [c * 1000 for c in (20, 50, 80, 100, 110, 120, 130, 140, 150, 200, 900)]


def _curve_sql(source, score, cuts, op=">=", label="y"):
    values = ", ".join(f"({float(c)!r}::double)" for c in cuts)
    return f"""k as (select c.corte, count(*) filter (s.{score} {op} c.corte) as alertas, count(*) filter (s.{score} {op} c.corte and s.{label} = 1) as acertos,
    count(*) filter (s.{label} = 1 and s.{score} is not null) as pos from {source} s cross join (values {values}) c(corte) group by 1),
curve as (select corte, alertas, acertos, case when alertas > 0 then acertos / alertas end as precisao, case when pos > 0 then acertos / pos end as recall,
    case when acertos > 0 then 2e0 * acertos / (alertas + pos) else 0e0 end as f1, pos - acertos as perdidos from k)"""


@query("G19_operating_curve", ["scored"], f"""
with {_curve_sql("scored", "previsto", CURVE)}
select corte, alertas, acertos, round(precisao, 6) as precisao, round(recall, 6) as recall, round(f1, 6) as f1, perdidos from curve""")
def curve(spark, d):
    return r6(metrics.operating_curve(V.scored(spark, d), "y", "previsto", CURVE), "precisao", "recall", "f1")


@query("G20_cut_for_recall", ["scored"], """
with p as (select *, previsto / 1000e0 as s from scored), cand as (select distinct round(s, 2) as corte from p where y = 1),
k as (select corte, count(*) filter (s >= corte) as alertas, count(*) filter (s >= corte and y = 1) as vp, (select sum(y) from scored) as pos from p cross join cand group by 1),
t as (select unnest([0.5::double, 0.6::double, 0.7::double, 0.8::double, 0.9::double]) as alvo)
select alvo, corte, alertas, round(vp / alertas, 6) as precisao, round(vp / pos, 6) as recall from (
  select *, row_number() over (partition by alvo order by corte desc) as r from t join k on vp / pos >= alvo and alertas > 0) where r = 1""")
def cut_for_recall(spark, d):
    rows = V.scored(spark, d).withColumn("s", F.col("previsto") / F.lit(1000.0))
    return r6(metrics.cut_for_recall(rows, "y", "s", config.TARGET_RECALLS), "precisao", "recall")


@query("G21_alerts_per_station_year", ["scored"], f"""
with {_curve_sql("scored", "previsto", CURVE)}
select corte, alertas, round(alertas / (select count(distinct station) * (floor((max(h) - min(h)) / 24) / 365.25) from scored), 4) as alertas_por_estacao_ano from curve""")
def per_year(spark, d):
    rows = V.scored(spark, d)
    out = metrics.alerts_per_station_year(metrics.operating_curve(rows, "y", "previsto", CURVE), rows)
    return out.select("corte", "alertas", F.round("alertas_por_estacao_ano", 4).alias("alertas_por_estacao_ano"))


BEST = "select corte as threshold, round(f1, 6) as f1 from curve order by curve.f1 desc, corte limit 1"


@query("G22_best_threshold", ["scored"], f"with {_curve_sql('scored', 'prob', config.THRESHOLD_GRID, '>')} {BEST}")
def threshold(spark, d):
    return r6(metrics.best_threshold(V.scored(spark, d), "y", "prob"), "f1")


@query("G22_best_threshold_station_day", ["scored"], f"""
with dayly as (select station, floor(h / 24) as dia, max(y) as y, max(prob) as prob from scored where janela = 'validacao' group by 1, 2),
{_curve_sql('dayly', 'prob', config.THRESHOLD_GRID, '>')} {BEST}""")
def threshold_day(spark, d):
    rows = metrics.station_day(V.scored(spark, d).where("janela = 'validacao'"), "y", ["prob"])
    return r6(metrics.best_threshold(rows, "y", "prob"), "f1")


def _ap_sql(source, score, group=None, label="y", weight="1"):
    g = f"{group}, " if group else ""
    part = f"partition by {group} " if group else ""
    by = f"group by {group}" if group else ""
    return f"""hist as (select {g}{score} as s, sum({weight}) as n, sum({weight} * {label}) as tp from {source} where {score} is not null group by all),
cum as (select *, sum(n) over ({part}order by s desc) as cn, sum(tp) over ({part}order by s desc) as ct from hist),
ap as (select {g}coalesce(sum(tp * (ct / cn)) / nullif(sum(tp), 0), 0) as pr_auc, cast(sum(n) as bigint) as n, cast(sum(tp) as bigint) as eventos from cum {by})"""


@query("G23_average_precision", ["scored"], f"""
with {_ap_sql("scored", "prob", "janela")} select janela, round(pr_auc, 6) as pr_auc, n, eventos from ap where janela is not null""")
def average_precision(spark, d):
    rows = V.scored(spark, d).where(F.col("janela").isNotNull())
    return r6(metrics.average_precision(rows, "y", "prob", ["janela"]), "pr_auc")


@query("G24_classification_scores", ["scored"], """
select janela, count(*) as n, count(*) filter (y = 1 and prob > 0.6) as vp, count(*) filter (y = 0 and prob > 0.6) as fp, count(*) filter (y = 1 and prob <= 0.6) as fn,
  count(*) filter (y = 0 and prob <= 0.6) as vn, round(avg((prob - y) * (prob - y)), 6) as brier,
  round(coalesce(vp / nullif(vp + fp, 0), 0), 6) as precision, round(coalesce(vp / nullif(vp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * vp / nullif(2 * vp + fp + fn, 0), 0), 6) as f1, round((vp + vn) / count(*), 6) as accuracy
from scored where janela is not null group by 1""")
def classification(spark, d):
    rows = V.scored(spark, d).where(F.col("janela").isNotNull())
    return r6(metrics.classification_scores(rows, "y", "prob", 0.6, ["janela"]), "brier", "precision", "recall", "f1", "accuracy")


@query("G25_error_scores", ["scored"], """
select janela, round(avg(abs(previsto - chuva_futura_24h)), 4) as mae, round(avg(case when chuva_futura_24h > 100000 then abs(previsto - chuva_futura_24h) end), 4) as mae_com_chuva,
  count(*) as n from scored where janela is not null group by 1""")
def errors(spark, d):
    rows = V.scored(spark, d).where(F.col("janela").isNotNull())
    out = metrics.error_scores(rows, "chuva_futura_24h", "previsto", ["janela"], wet_above=100000)
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "mae_com_chuva")})


@query("G25_fold_summary", ["scored"], """
with m as (select floor(h / 96) as fold, avg(abs(previsto - chuva_futura_24h)) as mae from scored group by 1)
select round(avg(mae), 4) as mae_cv_mean, round(stddev_pop(mae), 4) as mae_cv_std from m""")
def folds(spark, d):
    rows = V.scored(spark, d).withColumn("fold", F.floor(F.col("h") / 96))
    out = metrics.fold_summary(metrics.error_scores(rows, "chuva_futura_24h", "previsto", ["fold"]), "mae")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("G26_baselines", ["scored"], f"""
with te as (select *, (select avg(y) from scored where janela = 'treino') as base from scored where janela = 'teste'),
l as (select y, 'modelo' as candidato, prob as score from te union all select y, 'persistencia', chuva_24h from te union all select y, 'climatologia', base from te),
{_ap_sql("l", "score", "candidato")},
p as (select pr_auc as persistencia from ap where candidato = 'persistencia')
select candidato, round(pr_auc, 6) as pr_auc, round(100 * (pr_auc / persistencia - 1), 4) + 0e0 as ganho_pct from ap cross join p""")
def baselines(spark, d):
    rows = V.scored(spark, d)
    base = rows.where("janela = 'treino'").agg(F.avg("y")).scalar()
    test = rows.where("janela = 'teste'").withColumns(
        {"modelo": F.col("prob"), "persistencia": F.col("chuva_24h"), "climatologia": base})
    long = metrics.unpivot_scores(test, ["y"], ["modelo", "persistencia", "climatologia"])
    scores = metrics.average_precision(long, "y", "score", ["candidato"])
    reference = scores.where("candidato = 'persistencia'").select("pr_auc").scalar()
    return scores.select(
        "candidato", round6(F.col("pr_auc")).alias("pr_auc"),
        (F.round(100 * (F.col("pr_auc") / reference - 1), 4) + F.lit(0.0)).alias("ganho_pct"))


BIAS = """count(*) as n, round(avg(chuva_futura_24h), 4) as observado_medio, round(avg(previsto), 4) as previsto_medio,
  round(avg(chuva_futura_24h - previsto), 4) + 0e0 as vies, round(sum(chuva_futura_24h) / greatest(sum(previsto), 1e-9), 6) as razao"""


def _bias4(df):
    return df.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("observado_medio", "previsto_medio", "vies")} | {"razao": F.round("razao", 6)})


def isotonic_sql(points, asked):
    """`cal` (x, c): isotonic fit by its max-min formula over distinct x, linear between them, flat outside.

    points: x, mean m, weight w; asked: x.
    """
    return f"""pts as ({points}),
r as (select x, m, w, row_number() over (order by x) as i, sum(w) over (order by x) as cw, sum(w * m) over (order by x) as cm from pts),
means as (select a.i as j, b.i as k, (b.cm - a.cm + a.w * a.m) / (b.cw - a.cw + a.w) as mean from r a join r b on b.i >= a.i),
low as (select j, k, min(mean) over (partition by j order by k desc rows unbounded preceding) as least from means),
iso as (select r.x, max(low.least) as v from r join low on low.j <= r.i and low.k = r.i group by r.i, r.x),
asked as ({asked}),
near as (select a.x, max(case when i.x <= a.x then i.x end) as lo, min(case when i.x >= a.x then i.x end) as hi from asked a cross join iso i group by a.x),
cal as (select n.x, case when n.lo is null then h.v when n.hi is null or n.lo = n.hi then l.v else l.v + (h.v - l.v) * (n.x - n.lo) / (n.hi - n.lo) end as c
  from near n left join iso l on l.x = n.lo left join iso h on h.x = n.hi)"""


@query("G27_bias_by_station", ["scored"], f"select station, {BIAS} from scored group by 1")
def bias_station(spark, d):
    return _bias4(metrics.bias_table(V.scored(spark, d), "chuva_futura_24h", "previsto", ["station"]))


@query("G27_bias_by_intensity", ["scored"], "with b as (select *, case "
       + " ".join(f"when previsto / 3000e0 >= {a} and previsto / 3000e0 < {b} then {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
       + f" end as faixa from scored) select faixa, {BIAS} from b where faixa is not null group by 1")
def bias_intensity(spark, d):
    rows = V.scored(spark, d)
    out = metrics.bias_by_intensity(rows, "chuva_futura_24h", "previsto", [e * 3000 for e in EDGES])
    return _bias4(out)


@query("G28_variance_by_station", ["scored"], """
with r as (select station, cast(chuva_futura_24h - previsto as double) as x from scored), m as (select *, avg(x) over (partition by station) as ms, avg(x) over () as mg from r)
select count(*) as n, round(1 - sum((x - ms) * (x - ms)) / sum((x - mg) * (x - mg)), 6) as r2_estacao from m""")
def variance(spark, d):
    residual = (F.col("chuva_futura_24h") - F.col("previsto")).cast("double")
    return r6(metrics.variance_by_station(V.scored(spark, d), residual), "r2_estacao")


@query("G29_corrections", ["scored"], """
with fit as (select * from scored where janela = 'validacao'), s as (select station, avg(chuva_futura_24h - previsto) as v from fit group by 1),
g as (select avg(chuva_futura_24h - previsto) as v, sum(chuva_futura_24h) / sum(previsto) as f from fit),
""" + isotonic_sql("select previsto as x, avg(chuva_futura_24h) as m, count(*) as w from fit group by 1", "select distinct previsto as x from scored where janela = 'teste'") + """,
l as (select chuva_futura_24h as o, unnest(['cru', 'aditivo', 'fator', 'por_estacao', 'isotonica']) as correcao, unnest([previsto, previsto + g.v, previsto * g.f, previsto + coalesce(s.v, 0), cal.c]) as p
  from scored t cross join g left join s using (station) join cal on cal.x = t.previsto where t.janela = 'teste')
select correcao, round(avg(abs(p - o)), 4) as mae, round(avg(case when o > 1 then abs(p - o) end), 4) as mae_com_chuva, count(*) as n from l group by 1""")
def corrections(spark, d):
    rows = V.scored(spark, d)
    out = metrics.compare_corrections(
        rows.where("janela = 'validacao'"), rows.where("janela = 'teste'"), "chuva_futura_24h", "previsto",
        isotonic=lambda fit, part, name: ml.apply_isotonic(ml.fit_isotonic(fit, "previsto", "chuva_futura_24h"), part, "previsto", name))
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "mae_com_chuva")})


DRAWS = 2000


def _bootstrap_sql(unit):
    """The differences `d`: MD5 draws of the units, average precision of both scores in each repetition."""
    return f"""t as (select y, prob, previsto, {unit} as dia_n from scored where h % 24 in (0, 12)),
units as (select dia_n, row_number() over (order by dia_n) as i, count(*) over () as g from (select distinct dia_n from t)),
pick as (select r.rep, 1 + ('0x' || substr(md5('42-' || r.rep || '-' || (u.i - 1)), 1, 8))::bigint % u.g as i from units u cross join (select unnest(range({DRAWS})) as rep) r),
w as (select rep, i, count(*) as peso from pick group by 1, 2),
x as (select w.rep, t.y, t.prob, t.previsto, w.peso from w join units u using (i) join t using (dia_n)),
l as (select rep, y, peso, 'a' as k, cast(prob as double) as s from x union all select rep, y, peso, 'b', cast(previsto as double) from x),
hist as (select rep, k, s, sum(peso) as n, sum(peso * y) as tp from l group by all),
cum as (select *, sum(n) over (partition by rep, k order by s desc) as cn, sum(tp) over (partition by rep, k order by s desc) as ct from hist),
ap as (select rep, k, sum(tp * (ct / cn)) / sum(tp) as pr from cum group by 1, 2 having sum(tp) > 0),
d as (select a.rep, a.pr - b.pr as diferenca from ap a join ap b on a.rep = b.rep and a.k = 'a' and b.k = 'b'),
ic as (select avg(diferenca) as media, count(*) as reps, quantile_cont(diferenca, 0.025) as ic_inf, quantile_cont(diferenca, 0.975) as ic_sup from d)"""


IC = "round(media, 6) as media, reps, round(ic_inf, 6) as ic_inf, round(ic_sup, 6) as ic_sup"
ROW = "(station * 1000000 + h)"


def interval(spark, d, unit):
    rows = cleaning.at_hours(V.scored(spark, d), [0, 12]).withColumn("_unit", F.expr(unit))
    diffs = bootstrap.paired_difference(rows, "y", "previsto", "prob", "_unit", draws=DRAWS, seed=42)
    return bootstrap.difference_interval(diffs)


@query("G30_grouped_bootstrap", ["scored"], f"with {_bootstrap_sql('dia_n')} select {IC} from ic")
def grouped_bootstrap(spark, d):
    return r6(interval(spark, d, "dia_n"), "media", "ic_inf", "ic_sup")


@query("G30_row_bootstrap", ["scored"], f"with {_bootstrap_sql(ROW)} select {IC} from ic")
def row_bootstrap(spark, d):
    return r6(interval(spark, d, ROW), "media", "ic_inf", "ic_sup")


@query("G36_verdict_of_interval", ["scored"], f"""
with {_bootstrap_sql('dia_n')} select {IC}, case when ic_inf > 0 then 'melhor' when ic_sup > 0 then 'nao distinguivel' else 'pior' end as leitura,
  case when ic_inf <= 0 and ic_sup >= 0 then round(ic_sup, 6) end as ganho_maximo from ic""")
def interval_verdict(spark, d):
    """The reading of the bootstrap's interval, and the largest gain that an interval around zero leaves open."""
    return r6(metrics.read_interval(interval(spark, d, "dia_n")), "media", "ic_inf", "ic_sup", "ganho_maximo")


@query("G31_severity_points", ["observed", "pairs"], f"""
with {PANEL_SQL}, l as (select unnest([0, 6, 7, 8]) as nivel), p as (select case when evento then 1 else 0 end as y, coalesce(id_severidade, -1) as sev from panel)
select cast(nivel as double) as corte, count(*) filter (sev >= nivel) as alertas, count(*) filter (sev >= nivel and y = 1) as acertos,
  round(count(*) filter (sev >= nivel and y = 1) / nullif(count(*) filter (sev >= nivel), 0), 6) as precisao,
  round(count(*) filter (sev >= nivel and y = 1) / sum(y), 6) as recall from p cross join l group by 1""")
def severity_points(spark, d):
    out = warnings.severity_points(panel(spark, d), [0, 6, 7, 8])
    return r6(out, "precisao", "recall").select("corte", "alertas", "acertos", "precisao", "recall")


@query("G31_forecast_next_to_warnings", ["observed", "pairs"], f"""
with {PANEL_SQL}, s as (select case when evento then 1 else 0 end as y, chuva_24h_obs * 7 % 100 as previsto from panel), {_curve_sql("s", "previsto", config.WARNING_CUTS)}
select corte, alertas, acertos, round(precisao, 6) as precisao, round(recall, 6) as recall from curve""")
def forecast_points(spark, d):
    rows = panel(spark, d).selectExpr("cast(evento as int) as y", "chuva_24h_obs * 7 % 100 as previsto")
    out = metrics.operating_curve(rows, "y", "previsto", config.WARNING_CUTS)
    return r6(out, "precisao", "recall").select("corte", "alertas", "acertos", "precisao", "recall")


STUDY_CUTS = ", ".join(f"({float(c)!r}::double)" for c in config.WARNING_CUTS)


@query("warning_gap_study", ["observed", "pairs"], f"""
with {PANEL_SQL}, {EXPECTED_SQL}, {_table_sql("id_severidade")},
gap as (select grupo, max(case when unidade = 'area' then taxa end) as area, max(case when unidade = 'ponto' then taxa end) as ponto from t group by 1),
y as (select case when evento then 1 else 0 end as y, coalesce(id_severidade, -1) as sev, chuva_24h_obs * 7 % 100 as previsto from panel),
cuts as (select c.corte, 'curva' as tabela, count(*) filter (previsto >= corte) as alertas, count(*) filter (previsto >= corte and y = 1) as acertos
  from y cross join (values {STUDY_CUTS}) c(corte) group by 1
  union all select cast(nivel as double), 'pontos', count(*) filter (sev >= nivel), count(*) filter (sev >= nivel and y = 1)
  from y cross join (values (6), (7), (8)) l(nivel) group by 1),
m as (
  select 'cobertura' as tabela, '' as grupo, unnest(['estacao_dias', 'eventos']) as metrica, unnest([count(*), count(*) filter (evento)])::double as valor from panel
  union all select 'confirmacao', concat_ws(' / ', cast(grupo as varchar), unidade), unnest(['n', 'taxa', 'ic_inf', 'ic_sup', 'climatologia']),
    unnest([n::double, taxa, ic_inf, ic_sup, climatologia]) from t
  union all select 'lacuna', cast(grupo as varchar), unnest(['area', 'ponto', 'diferenca']), unnest([area, ponto, round(area - ponto, 3)]) from gap
  union all select tabela, cast(corte as varchar), unnest(['alertas', 'acertos']), unnest([alertas::double, acertos::double]) from cuts)
select tabela, grupo, metrica, round(valor, 6) as valor from m""")
def warning_gap_study(spark, d):
    """All tables of the warning study as one job, in the form that the metric store takes."""
    from pluvia.plans import studies
    from pluvia.sources.stores import tidy_metrics

    observed = V.daily_observed(spark, d)
    forecast = observed.select("station", "dia", (F.col("chuva_24h_obs") * 7 % 100).alias("ifs_chuva_24h"))
    tables = studies.warning_gap_study(
        observed, V.panel_pairs(spark, d), forecast, event_above=V.STUDY_EVENT_MM, group="id_severidade")
    wanted = {
        "cobertura": ([], ["estacao_dias", "eventos"]),
        "confirmacao": (["grupo", "unidade"], ["n", "taxa", "ic_inf", "ic_sup", "climatologia"]),
        "lacuna": (["grupo"], ["area", "ponto", "diferenca"]),
        "curva": (["corte"], ["alertas", "acertos"]),
        "pontos": (["corte"], ["alertas", "acertos"]),
    }
    tidy = [
        tidy_metrics(tables[name].select(*group, *columns), "r1", name, group)
        for name, (group, columns) in wanted.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), tidy)
    return rows.select(F.col("study").alias("tabela"), "grupo", "metrica", round6(F.col("valor")).alias("valor"))


SCENARIOS = [("alto, 12", 130000, (12,)), ("alto, 00+12", 130000, (0, 12)), ("medio, 12", 110000, (12,)), ("medio, 00+12", 110000, (0, 12)),
             ("medio, 12, leste", 110000, (12,), "station >= 2")]


@query("G32_scenario_grid", ["scored"], "with x as (" + " union all ".join(
    f"select '{n}' as cenario, case when chuva_futura_24h > {t} then 1 else 0 end as yy, previsto, janela from scored where h % 24 in ({', '.join(map(str, hs))}) and janela in ('treino', 'teste') and {(*subset, 'true')[0]}"
    for n, t, hs, *subset in SCENARIOS) + f"""),
ok as (select cenario from x group by 1 having sum(case when janela = 'treino' then yy else 0 end) >= 3 and sum(case when janela = 'teste' then yy else 0 end) >= 3),
v as (select * from x where janela = 'teste' and cenario in (select cenario from ok)), {_ap_sql("v", "previsto", "cenario", "yy")}
select cenario, round(pr_auc, 6) as pr_auc, n, eventos from ap""")
def scenarios(spark, d):
    from pluvia.plans.studies import scenario_rows, scenario_scores

    rows = V.scored(spark, d).where(F.col("janela").isin("treino", "teste"))
    grid = scenario_rows(rows, SCENARIOS, "chuva_futura_24h")
    return r6(scenario_scores(grid, "previsto", fit="treino", evaluation="teste", minimum=3), "pr_auc")


@query("G33_id_order_breaks", ["obs"], """
with s as (select o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as t from orders), l as (select *, lag(t) over (order by o_orderkey) - t as back from s)
select count(*) as n, count(*) filter (back > 0) as quebras, round(count(*) filter (back > 0) / count(*), 6) as fracao, max(case when back > 0 then back end) as maior_recuo from l""")
def order_breaks(spark, d):
    rows = V.table(spark, d, "orders").select(
        "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("t"))
    return r6(quality.order_breaks(rows, "o_orderkey", "t"), "fracao")


@query("G34_station_dimension", ["weather"], """
select station, arg_min(temperatura, h) filter (temperatura is not null) as temperatura, arg_min(umidade, h) filter (umidade is not null) as umidade,
  min(h) as inicio, max(h) as fim from weather group by 1""")
def dimension(spark, d):
    return joins.first_known(V.weather(spark, d), ["temperatura", "umidade"])


@query("G35_row_survival", ["weather"], """
select 'linhas' as medida, count(*) as valor from weather union all
select 'completas', count(*) filter (temperatura is not null and umidade is not null and pressao is not null) from weather union all
select 'nulos_temperatura', count(*) filter (temperatura is null) from weather union all
select 'nulos_umidade', count(*) filter (umidade is null) from weather union all
select 'nulos_pressao', count(*) filter (pressao is null) from weather""")
def survival(spark, d):
    return metrics.coverage(V.weather(spark, d), ["temperatura", "umidade", "pressao"])


@query("G36_in_and_out_of_sample", ["scored"], f"""
with l as (select y, janela, 'modelo' as variante, prob as s from scored union all select y, janela, 'previsto', previsto from scored),
f as (select *, variante || '/' || janela as g from l where janela in ('treino', 'teste')), {_ap_sql("f", "s", "g")},
w as (select variante, max(case when g = variante || '/treino' then pr_auc end) as dentro, max(case when g = variante || '/teste' then pr_auc end) as fora
  from ap join (select distinct variante, g as gg from f) on gg = g group by 1)
select variante, round(dentro, 6) as dentro, round(fora, 6) as fora from w""")
def samples(spark, d):
    rows = V.scored(spark, d).where(F.col("janela").isin("treino", "teste")).withColumn("modelo", F.col("prob"))
    long = metrics.unpivot_scores(rows, ["y", "janela"], ["modelo", "previsto"], "variante")
    ap = metrics.average_precision(long, "y", "score", ["variante", "janela"])
    wide = ap.groupBy("variante").agg(
        F.max(F.when(F.col("janela") == "treino", F.col("pr_auc"))).alias("dentro"),
        F.max(F.when(F.col("janela") == "teste", F.col("pr_auc"))).alias("fora"))
    return r6(wide, "dentro", "fora")


@query("G35_reach_of_the_fit", ["scored"], """
with e as (select * from scored where janela = 'teste' and h % 24 in (0, 12)), f as (select distinct station from scored where janela = 'validacao' and station <> 1)
select count(*) as linhas, round(avg(case when a % 3 <> 0 then 1e0 else 0e0 end), 6) as com_regua, count(distinct station) as estacoes,
  round(count(distinct case when station not in (select station from f) then station end) / count(distinct station), 6) as ineditas from e""")
def reach(spark, d):
    rows = V.scored(spark, d).withColumn("regua", F.when(F.col("a") % 3 != 0, F.col("previsto")))
    out = metrics.reach_of_fit(
        rows.where("janela = 'validacao' and station <> 1"), cleaning.at_hours(rows.where("janela = 'teste'"), [0, 12]), "regua")
    return r6(out, "com_regua", "ineditas")


@query("M1_time_split", ["scored"], """
select janela, count(*) as linhas, min(h) as inicio, max(h) as fim, round(avg(y), 6) as taxa_evento from scored where janela is not null group by 1""")
def time_split(spark, d):
    return r6(splits.split_summary(V.scored(spark, d), "y"), "taxa_evento")


@query("M1_fit_evaluation_split", ["obs"], f"""
select case when h between {V.CUTOFF_H - 200} and {V.CUTOFF_H} then 'ajuste' when h > {V.CUTOFF_H} + 24 then 'avaliacao' end as janela, count(*) as linhas from obs group by 1""")
def fit_split(spark, d):
    out = splits.with_fit_split(V.obs(spark, d), V.CUTOFF_H - 200, V.CUTOFF_H)
    return out.groupBy("janela").agg(F.count("*").alias("linhas"))


FOLD_SQL = """t as (select count(*) as n, count(*) // 6 as c, count(*) - 5 * (count(*) // 6) as f0 from obs),
hh as (select h, count(*) as k from obs group by 1), cum as (select h, sum(k) over (order by h) as cn, k from hh),
st as (select fold, h as test_from from cum, t, (select unnest(range(5)) as fold) where cn - k <= f0 + fold * c and cn > f0 + fold * c),
lim as (select cast(fold as integer) as fold, test_from - 24 as train_to, test_from, coalesce(lead(test_from) over (order by fold) - 1, (select max(h) from obs)) as test_to from st)"""


@query("M2_expanding_folds", ["obs"], f"with {FOLD_SQL} select * from lim")
def expanding(spark, d):
    return splits.expanding_folds(V.obs(spark, d), 5)


@query("M2_fold_roles", ["obs"], f"""
with {FOLD_SQL} select l.fold, case when o.h <= l.train_to then 'treino' else 'teste' end as papel, count(*) as linhas, min(o.h) as inicio, max(o.h) as fim
from obs o, lim l where o.h <= l.train_to or o.h between l.test_from and l.test_to group by 1, 2""")
def fold_roles(spark, d):
    rows = V.obs(spark, d)
    out = splits.with_fold_role(rows, splits.expanding_folds(rows, 5))
    return out.groupBy("fold", "papel").agg(F.count("*").alias("linhas"), F.min("h").alias("inicio"), F.max("h").alias("fim"))


@query("M3_positive_weight", ["scored"], """
select janela, round(coalesce((count(*) - sum(y)) / nullif(sum(y), 0), 1), 6) as peso_positivos from scored where janela is not null group by 1""")
def weight(spark, d):
    rows = V.scored(spark, d).where(F.col("janela").isNotNull())
    return r6(splits.positive_weight(rows, "y", ("janela",)), "peso_positivos")
