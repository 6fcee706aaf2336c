"""Studies that chain operators: scenarios, candidates, source and window substitution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import config
from pluvia.operators import metrics, warnings
from pluvia.operators.storage import materialise


def scenario_rows(rows: DataFrame, scenarios: Sequence[tuple], target: str, *, hour="h") -> DataFrame:
    """Each row once per scenario it belongs to, labelled.

    A scenario is (name, limit, emission hours) or has a SQL condition on the station as its fourth member.
    """
    options = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("cenario"),
                    (F.col(target) > limit).cast("int").alias("rotulo"),
                    (F.pmod(F.col(hour), F.lit(24)).isin(list(hours)) & F.expr((*subset, "true")[0])).alias("vale"),
                )
                for name, limit, hours, *subset in scenarios
            ]
        ),
        lambda s: s["vale"],
    )
    return rows.select("*", F.inline(options)).drop("vale")


def scenario_scores(grid: DataFrame, score: str, *, fit="ajuste", evaluation="avaliacao",
                    minimum: int = 30, split="janela") -> DataFrame:
    """Average precision per scenario on the evaluation rows.

    Scenarios with fewer than ``minimum`` events on either side are not reported.
    """
    events = grid.groupBy("cenario").agg(
        *[
            F.sum(F.when(F.col(split) == side, F.col("rotulo")).otherwise(0)).alias(side)
            for side in (fit, evaluation)
        ]
    )
    kept = events.where((F.col(fit) >= minimum) & (F.col(evaluation) >= minimum)).select("cenario")
    scored = metrics.average_precision(
        grid.where(F.col(split) == evaluation), "rotulo", score, ["cenario"]
    )
    return scored.join(kept, "cenario", "left_semi")


def compare_candidates(rows: DataFrame, label: str, candidates: Sequence[str], *, emission: int = 12,
                       key="station", hour="h") -> DataFrame:
    """Average precision of each candidate score by station-day and at the emission hour."""
    long = metrics.unpivot_scores(rows, [key, hour, label], candidates)
    days = metrics.station_day(long, label, ["score"], group=["candidato"], key=key, hour=hour)
    at_emission = long.where(F.pmod(F.col(hour), F.lit(24)) == emission)
    by_day = metrics.average_precision(days, label, "score", ["candidato"], name="pr_auc_estacao_dia")
    by_hour = metrics.average_precision(
        at_emission, label, "score", ["candidato"], name="pr_auc_operacional"
    )
    return by_day.select("candidato", "pr_auc_estacao_dia").join(
        by_hour.select("candidato", "pr_auc_operacional"), "candidato"
    )


def warning_gap_study(observed: DataFrame, pairs: DataFrame, forecast: DataFrame, *,
                      event_above: float, group: str) -> dict[str, DataFrame]:
    """The tables of the warning study from observations, expanded warnings and forecasts."""
    pairs = materialise(pairs)
    panel = warnings.station_day_panel(observed, pairs, event_above)
    rows = warnings.with_confirmation(pairs.join(observed, ["station", "dia"]))
    rates = warnings.base_rates(observed, warnings.criteria_of(rows))
    table = warnings.confirmation_table(warnings.attach_base_rate(rows, rates), group)
    rainy = warnings.attach_base_rate(rows, rates, rain_only=True).where(
        F.col("criterio_mm").isNotNull()
    )
    together = panel.join(forecast, ["station", "dia"]).withColumn("_y", F.col("evento").cast("int"))
    return {
        "cobertura": warnings.coverage_summary(panel),
        "confirmacao": table,
        "lacuna": warnings.gap_table(table),
        "confirmacao_chuva": warnings.confirmation_table(rainy, group, "confirmado_chuva"),
        "curva": metrics.operating_curve(together, "_y", "ifs_chuva_24h", config.WARNING_CUTS),
        "pontos": warnings.severity_points(together, [6, 7, 8]),
    }


def degradation_study(observed_grid: DataFrame, forecast: DataFrame, score, columns: Sequence[str],
                      start_hour: int, label: str, *, emission: int = 12, key="station", hour="h"):
    """One model on four versions of its inputs: source and window alignment changed or not.

    ``score(rows)`` adds ``score``. A: as trained; B: forecast instead of reanalysis;
    C: mean of the next 24 hours instead of the current hour; D: both.
    """
    from pluvia.operators.joins import substitute_forecast
    from pluvia.operators.windows import future_mean

    swapped = substitute_forecast(observed_grid, forecast, columns, start_hour, key=key, hour=hour)
    versions = {
        "A referencia": observed_grid,
        "B origem": swapped,
        "C janela": future_mean(observed_grid, columns, key=key, hour=hour),
        "D ambas": future_mean(swapped, columns, key=key, hour=hour),
    }
    scored = None
    for name, rows in versions.items():
        part = score(rows).select(F.lit(name).alias("variante"), key, hour, label, "score")
        scored = part if scored is None else scored.unionByName(part)
    days = metrics.station_day(scored, label, ["score"], group=["variante"], key=key, hour=hour)
    at_emission = scored.where(F.pmod(F.col(hour), F.lit(24)) == emission)
    by_day = metrics.average_precision(days, label, "score", ["variante"], name="pr_auc_estacao_dia")
    by_hour = metrics.average_precision(at_emission, label, "score", ["variante"], name="op_pr_auc")
    return by_day.select("variante", "pr_auc_estacao_dia").join(
        by_hour.select("variante", "op_pr_auc", F.col("n").alias("op_n"), F.col("eventos").alias("op_eventos")),
        "variante",
    )
