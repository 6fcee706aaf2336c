"""Profile of a feature table: statistics, episodes, correlations, remarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.rates import correlation, ratio
from pluvia.operators.prefix import exact_quantiles
from pluvia.operators.tiling import with_run_id


def table_summary(df: DataFrame, *, rain="precipitacao", label="evento_extremo", key="station",
                  hour="h") -> DataFrame:
    """Size, period, stations, rain statistics, event rate and share of dry hours."""
    return df.agg(
        F.count("*").alias("linhas"),
        F.min(hour).alias("inicio"),
        F.max(hour).alias("fim"),
        F.approx_count_distinct(key).alias("_approx"),
        F.count_distinct(key).alias("estacoes"),
        F.count(rain).alias("n_chuva"),
        F.avg(rain).alias("media_chuva"),
        F.stddev_samp(rain).alias("desvio_chuva"),
        F.min(rain).alias("min_chuva"),
        F.max(rain).alias("max_chuva"),
        F.avg(label).alias("taxa_evento"),
        ratio(F.count_if(F.col(rain) == 0), F.count("*")).alias("taxa_zero"),
    ).drop("_approx")


def target_percentiles(df: DataFrame, target: str = "chuva_futura_24h") -> DataFrame:
    return exact_quantiles(
        df, [], target, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    )


def label_shares(df: DataFrame, label: str = "evento_extremo") -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(label).agg(ratio(F.count("*"), total).alias("fracao"))


def event_rate_by(df: DataFrame, group: str, label: str = "evento_extremo") -> DataFrame:
    return df.groupBy(group).agg(F.avg(label).alias("taxa_evento"))


def episodes(df: DataFrame, label: str = "evento_extremo", *, key="station", hour="h") -> DataFrame:
    """Runs of consecutive positive rows per station, with their length."""
    runs = with_run_id(df.select(key, hour, label), [key], hour, label, "_run")
    return (
        runs.where(F.col(label) == 1)
        .groupBy(key, "_run")
        .agg(F.count("*").alias("linhas"), F.min(hour).alias("inicio"), F.max(hour).alias("fim"))
        .drop("_run")
    )


def episode_summary(df: DataFrame, label: str = "evento_extremo", *, key="station", hour="h"):
    """Positive rows, independent episodes and median episode length."""
    return exact_quantiles(
        episodes(df, label, key=key, hour=hour), [], "linhas", {"mediana_linhas": 0.5},
        count="n_episodios", total="n_positivas",
    )


def correlations(df: DataFrame, columns: Sequence[str], target: str, top: int = 15) -> DataFrame:
    """Columns most correlated with the target, from one aggregation; undefined ones are left out."""
    row = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in columns])
    long = row.unpivot([], [F.col(c) for c in columns], "coluna", "r")
    return long.where(F.col("r").isNotNull()).orderBy(F.desc("r"), "coluna").limit(top)


def remarks(summary: DataFrame, episode: DataFrame, strongest: DataFrame,
            persistence: str = "chuva_48h") -> DataFrame:
    """Which of the four standing remarks apply, with the number behind each."""
    per_episode = episode.select(ratio(F.col("n_positivas"), F.col("n_episodios"))).scalar()
    r = strongest.where(F.col("coluna") == persistence).agg(F.max("r")).scalar()
    checks = F.array(
        F.struct(F.lit("esparso").alias("nota"), F.col("taxa_zero").alias("valor"), (F.col("taxa_zero") > 0.8).alias("vale")),
        F.struct(F.lit("desbalanceado").alias("nota"), F.col("taxa_evento").alias("valor"), (F.col("taxa_evento") < 0.02).alias("vale")),
        F.struct(F.lit("linhas_por_episodio").alias("nota"), per_episode.alias("valor"), (per_episode > 10).alias("vale")),
        F.struct(F.lit("persistencia").alias("nota"), r.alias("valor"), (r > 0.5).alias("vale")),
    )
    return summary.select(F.inline(checks)).where(F.col("vale")).select("nota", "valor")
