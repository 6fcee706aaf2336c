"""Area warnings: expansion to station-days, confirmation, base rates, choice of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions.clock import anchored_date
from pluvia.functions.rates import ratio, wilson
from pluvia.functions.text import code_count, gust_criterion, rain_criterion
from pluvia.operators.joins import attach
from pluvia.operators.metrics import operating_curve
from pluvia.operators.prefix import count_dominating
from pluvia.operators.storage import materialise
from pluvia.operators.spatial import points_in_polygons

ABSENT = -1e300  # in place of a NULL measure or criterion, below all others


def with_criteria(warnings: DataFrame, text: str = "riscos") -> DataFrame:
    return warnings.withColumns(
        {"criterio_mm": rain_criterion(F.col(text)), "criterio_ms": gust_criterion(F.col(text))}
    )


def severity_rank(name: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in config.SEVERITY_RANK.items() for v in kv])
    return F.coalesce(F.element_at(table, name), F.lit(0))


def touched_days(start: Column, end: Column, anchor: int = 12) -> Column:
    """Every emission-anchored day a validity interval touches; an early end counts as start."""
    return F.sequence(anchored_date(start, anchor), anchored_date(F.greatest(start, end), anchor))


def expand_station_days(warnings: DataFrame, stations: DataFrame, *, types: Sequence | None,
                        anchor: int = 12, type_column="descricao") -> DataFrame:
    """One row per (station, day, warning) for stations inside the polygon."""
    kept = warnings if types is None else warnings.where(F.col(type_column).isin(list(types)))
    slim = with_criteria(kept).drop("riscos")
    pairs = points_in_polygons(slim, stations)
    return pairs.withColumn("dia", F.explode(touched_days(F.col("inicio"), F.col("fim"), anchor))).select(
        "station", "dia", "id", type_column, "id_severidade", "criterio_mm", "criterio_ms"
    )


def station_day_panel(observed: DataFrame, pairs: DataFrame, event_above: float, *, key="station"):
    """Every observed station-day, with the severest warning on it if there was one."""
    covered = pairs.groupBy(key, "dia").agg(
        F.max("id_severidade").alias("id_severidade"),
        F.min("criterio_mm").alias("criterio_mm"),
        F.min("criterio_ms").alias("criterio_ms"),
    )
    return observed.join(covered, [key, "dia"], "left").withColumns(
        {
            "tem_aviso": F.col("id_severidade").isNotNull(),
            "evento": F.coalesce(F.col("chuva_24h_obs") > event_above, F.lit(False)),
        }
    )


def reached(observed: str, criterion: str) -> Column:
    return F.coalesce(F.col(observed) >= F.col(criterion), F.lit(False))


def with_confirmation(pairs: DataFrame) -> DataFrame:
    """Whether any announced phenomenon was observed, and whether the announced rain was."""
    rain = reached("chuva_24h_obs", "criterio_mm")
    gust = reached("rajada_max_obs", "criterio_ms")
    return pairs.withColumns({"confirmado": rain | gust, "confirmado_chuva": rain})


def criteria_of(rows: DataFrame) -> DataFrame:
    """The announced pairs of criteria, with and without their gust; the rows are read once."""
    both = F.struct("criterio_mm", "criterio_ms")
    rain_only = F.struct("criterio_mm", F.lit(None).cast("double").alias("criterio_ms"))
    return rows.select("criterio_mm", "criterio_ms").distinct().select(F.inline(F.array(both, rain_only)))


def base_rates(observed: DataFrame, criteria: DataFrame) -> DataFrame:
    """Share of all station-days that meet each distinct (mm, m/s) criterion pair.

    Either part may be NULL, and both parts NULL means never met. The observations shrink
    to counts of distinct values first; P(rain or gust) is P(rain) + P(gust) - P(both).
    """
    mm, ms = "criterio_mm", "criterio_ms"
    combos = materialise(
        criteria.select(F.col(mm).cast("double"), F.col(ms).cast("double")).distinct(), "criteria"
    )
    points = materialise(
        observed.groupBy(
            F.coalesce(F.col("chuva_24h_obs").cast("double"), F.lit(ABSENT)).alias("qx"),
            F.coalesce(F.col("rajada_max_obs").cast("double"), F.lit(ABSENT)).alias("qy"),
        ).agg(F.count("*").alias("_n")),
        "points",
    )
    rain, gust, floor = F.col(mm), F.col(ms), F.lit(ABSENT)
    asked = combos.withColumn(
        "_parts",
        F.array(
            F.struct(rain.alias("qx"), floor.alias("qy"), F.lit(1).alias("sinal")),
            F.struct(floor.alias("qx"), gust.alias("qy"), F.lit(1).alias("sinal")),
            F.struct(rain.alias("qx"), gust.alias("qy"), F.lit(-1).alias("sinal")),
        ),
    ).select(mm, ms, F.inline("_parts"))
    counted = count_dominating(points, asked.select("qx", "qy").dropna().distinct(), "qx", "qy", "_n")
    total = points.agg(F.sum("_n")).scalar()
    return (
        asked.join(counted, ["qx", "qy"], "left")
        .groupBy(mm, ms)
        .agg(F.sum(F.coalesce("n_ge", F.lit(0)) * F.col("sinal")).alias("_hits"))
        .select(mm, ms, ratio(F.col("_hits"), total).alias("taxa_base"))
    )


def attach_base_rate(pairs: DataFrame, rates: DataFrame, rain_only: bool = False,
                     name: str = "esperado") -> DataFrame:
    """Base rate of the criteria of each row; a missing part matches a missing part.

    A criterion that most warnings announce is a hot key, so the rows are spread over copies
    of the table's rows.
    """

    def coded(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(ABSENT))

    gust = F.lit(None) if rain_only else F.col("criterio_ms")
    keyed = pairs.withColumns({"_mm": coded(F.col("criterio_mm")), "_ms": coded(gust)})
    table = rates.select(
        coded(F.col("criterio_mm")).alias("_mm"), coded(F.col("criterio_ms")).alias("_ms"), F.col("taxa_base").alias(name)
    )
    return attach(keyed, table, ["_mm", "_ms"], spread_by="id").drop("_mm", "_ms")


def confirmation_table(pairs: DataFrame, group: str, flag: str = "confirmado", *,
                       expected: str = "esperado", minimum: int = 0) -> DataFrame:
    """Confirmation by area and by point per group, with Wilson interval and gain.

    Area: a warning is confirmed if any of its station-days is. Point: every (station,
    day, warning) counts. Both come from one pre-aggregation per warning.
    """
    per_warning = pairs.groupBy(group, "id").agg(
        F.count("*").alias("_rows"),
        F.sum(F.col(flag).cast("long")).alias("_hits"),
        F.max(F.col(flag).cast("long")).alias("_any"),
        F.sum(expected).alias("_exp"),
        F.count(expected).alias("_nexp"),
    )
    groups = per_warning.groupBy(F.col(group).alias("grupo")).agg(
        F.count("*").alias("_warnings"),
        F.sum("_any").alias("_any"),
        F.sum("_rows").alias("_rows"),
        F.sum("_hits").alias("_hits"),
        ratio(F.sum("_exp"), F.sum("_nexp")).alias("climatologia"),
    )
    units = F.array(
        F.struct(F.lit("area").alias("unidade"), F.col("_warnings").alias("n"), F.col("_any").alias("_k")),
        F.struct(F.lit("ponto").alias("unidade"), F.col("_rows").alias("n"), F.col("_hits").alias("_k")),
    )
    rows = groups.where(F.col("_warnings") >= minimum).select("grupo", "climatologia", F.inline(units))
    rate = ratio(F.col("_k"), F.col("n"))
    low, high = wilson(rate, F.col("n"))
    return rows.select(
        "grupo", "unidade", "n",
        F.round(rate, 3).alias("taxa"),
        F.round(low, 3).alias("ic_inf"),
        F.round(high, 3).alias("ic_sup"),
        F.round("climatologia", 3).alias("climatologia"),
        F.round(ratio(rate, F.col("climatologia")), 1).alias("ganho"),
    )


def gap_table(confirmation: DataFrame) -> DataFrame:
    """Area rate next to point rate, their ratio (NULL at point 0) and difference."""
    wide = confirmation.groupBy("grupo").agg(
        F.max(F.when(F.col("unidade") == "area", F.col("taxa"))).alias("area"),
        F.max(F.when(F.col("unidade") == "ponto", F.col("taxa"))).alias("ponto"),
    )
    return wide.withColumns(
        {
            "razao": F.round(ratio(F.col("area"), F.col("ponto")), 1),
            "diferenca": F.round(F.col("area") - F.col("ponto"), 3),
        }
    )


def coverage_summary(panel: DataFrame) -> DataFrame:
    """Station-days, share under a warning, events, share of events under a warning."""
    return panel.agg(
        F.count("*").alias("estacao_dias"),
        F.avg(F.col("tem_aviso").cast("double")).alias("sob_aviso"),
        F.count_if("evento").alias("eventos"),
        F.avg(F.when(F.col("evento"), F.col("tem_aviso").cast("double"))).alias("recall"),
    )


def severity_points(panel: DataFrame, levels: Sequence[int], *, label="evento") -> DataFrame:
    """Warnings as operating points: alert when the severity is at least the level."""
    scored = panel.withColumns(
        {
            "_y": F.col(label).cast("int"),
            "_sev": F.coalesce(F.col("id_severidade"), F.lit(-1)).cast("double"),
        }
    )
    return operating_curve(scored, "_y", "_sev", levels)


def severest(warnings: DataFrame, place: Sequence[str], *, severity="severidade", start="inicio",
             tie="id") -> DataFrame:
    """Per place the warning of highest severity, the latest start breaking a tie."""
    order = Window.partitionBy(*place).orderBy(
        severity_rank(F.col(severity)).desc(), F.col(start).desc(), F.col(tie)
    )
    return (
        warnings.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")
    )


def publishable(warnings: DataFrame, gaps: DataFrame, *, severity="severidade") -> DataFrame:
    """ISO validity, number of municipalities and the gap row of the severity, if any."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    gap = gaps.select(
        F.col("grupo").alias(severity), F.col("area").alias("taxa_area"),
        F.col("ponto").alias("taxa_ponto"), "razao",
    )
    return warnings.withColumns(
        {
            "inicio": F.date_format("inicio", iso),
            "fim": F.date_format("fim", iso),
            "municipios_total": code_count(F.col("geocodes")),
        }
    ).join(gap, severity, "left")


def feed_candidates(feed: DataFrame, stations: DataFrame,
                    types: Sequence = config.RAIN_TYPES) -> tuple[DataFrame, DataFrame]:
    """Open rain warnings that cover a station, and those of them with a field missing.

    A warning whose polygon cannot be read covers nothing and is skipped. The caller fails
    the job when the second result has rows.
    """
    is_open = ~F.coalesce(F.col("encerrado"), F.lit(False))
    rain = feed.where(is_open & F.col("descricao").isin(list(types)))
    covering = points_in_polygons(rain.select("id", "poligono"), stations).select("id").distinct()
    local = rain.join(covering, "id", "left_semi")
    missing = F.filter(
        F.array(
            *[
                F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c))
                for c in config.WARNING_REQUIRED_FIELDS
            ]
        ),
        lambda c: c.isNotNull(),
    )
    marked = local.withColumn("faltando", missing)
    good = marked.where(F.size("faltando") == 0).drop("faltando")
    return good, marked.where(F.size("faltando") > 0).select("id", "faltando")


def reports_in_force(reports: DataFrame, warnings: DataFrame, places: DataFrame) -> DataFrame:
    """Severest warning in force at the place and second of each report, NULL if none.

    ``reports``: ``report_id, station, ts_s``. ``warnings``: ``id, id_severidade, inicio_s,
    fim_s, poligono`` with both ends included. Warnings go to the hours they touch. Of those
    that span a whole hour at a place only the severest can win there, so one is kept per
    (place, hour); only warnings that begin or end inside the hour are kept one by one.
    """
    first, last = reports.agg(F.min("ts_s")).scalar(), reports.agg(F.max("ts_s")).scalar()
    current = warnings.where((F.col("fim_s") >= first) & (F.col("inicio_s") <= last))
    located = points_in_polygons(current, places.select("station", "lat", "lon")).select(
        "station", "id", "id_severidade", "inicio_s", "fim_s"
    )

    def buckets(rows: DataFrame, lo: Column, hi: Column, seconds: int, name: str) -> DataFrame:
        """Rows per time bucket they touch, where that place has a report at all."""
        wanted = reports.select("station", F.floor(F.col("ts_s") / seconds).alias(name)).distinct()
        span = F.sequence(F.floor(lo / seconds), F.floor(hi / seconds))
        return rows.withColumn(name, F.explode(span)).join(wanted, ["station", name], "left_semi")

    daily = buckets(located, F.col("inicio_s"), F.col("fim_s"), 86400, "_day")
    hourly = buckets(
        daily,
        F.greatest(F.col("inicio_s"), F.col("_day") * 86400),
        F.least(F.col("fim_s"), F.col("_day") * 86400 + 86399),
        3600,
        "h",
    )
    whole = (F.col("inicio_s") <= F.col("h") * 3600) & (F.col("fim_s") >= F.col("h") * 3600 + 3599)
    rank = F.struct("id_severidade", "inicio_s", F.col("id").alias("id"))
    spanning = (
        hourly.where(whole)
        .groupBy("station", "h")
        .agg(F.max(rank).alias("_w"))
        .select("station", "h", "_w.*", F.lit(None).cast("long").alias("fim_s"))
    )
    partial = hourly.where(~whole).select(
        "station", "h", "id_severidade", "inicio_s", "id", "fim_s"
    )
    in_hour = spanning.unionByName(partial)
    keyed = reports.withColumn("h", F.floor(F.col("ts_s") / 3600))
    matched = (
        keyed.join(in_hour, ["station", "h"])
        .where(
            F.col("fim_s").isNull()
            | F.col("ts_s").between(F.col("inicio_s"), F.col("fim_s"))
        )
        .groupBy("report_id")
        .agg(F.max(rank).alias("_w"))
        .select("report_id", F.col("_w.id").alias("id"), F.col("_w.id_severidade").alias("id_severidade"))
    )
    return reports.join(matched, "report_id", "left")
