"""Completeness of stored data: empty variables, missing blocks and years, id order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.rates import correlation, ratio
from pluvia.operators.tiling import with_previous


def empty_variables(df: DataFrame, columns: Sequence[str], key: str = "station") -> DataFrame:
    """(station, variable) pairs that have rows but not one value."""
    counts = df.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    return (
        counts.unpivot([F.col(key)], [F.col(c) for c in columns], "variavel", "n")
        .where(F.col("n") == 0)
        .select(key, "variavel")
    )


def id_blocks(attempts: DataFrame, low: int, high: int, size: int, margin: int) -> DataFrame:
    """Coverage of an id range in fixed blocks, plus one margin block on each side.

    ``attempts``: one row per attempted id with ``obtido``. The result has every block, the
    ids attempted and obtained in it, and whether all were attempted.
    """
    spark = attempts.sparkSession
    core = spark.range(0, (high - low) // size + 1).select(
        (F.col("id") * size + low).alias("lo"),
        F.least(F.col("id") * size + low + size - 1, F.lit(high)).alias("hi"),
    )
    edges = core.sparkSession.range(2).select(
        F.when(F.col("id") == 0, F.lit(low - margin)).otherwise(F.lit(high + 1)).alias("lo"),
        F.when(F.col("id") == 0, F.lit(low - 1)).otherwise(F.lit(high + margin)).alias("hi"),
    )
    block = (
        F.when(F.col("id") < low, F.lit(low - margin))
        .when(F.col("id") > high, F.lit(high + 1))
        .otherwise(F.floor((F.col("id") - low) / size) * size + low)
    )
    counts = (
        attempts.where(F.col("id").between(low - margin, high + margin))
        .groupBy(block.cast("long").alias("lo"))
        .agg(
            F.count_distinct("id").alias("tentados"),
            F.count_distinct(F.when(F.col("obtido"), F.col("id"))).alias("obtidos"),
        )
    )
    return (
        core.unionByName(edges)
        .join(counts, "lo", "left")
        .fillna(0, ["tentados", "obtidos"])
        .withColumn("completo", F.col("tentados") == F.col("hi") - F.col("lo") + 1)
    )


def missing_years(expected: DataFrame, stored: DataFrame, *, key="station") -> DataFrame:
    """(station, year) expected from the series span and not stored complete.

    ``expected``: ``station, ano_inicio, ano_fim``. ``stored``: ``station, ano, completo``.
    """
    wanted = expected.select(key, F.explode(F.sequence("ano_inicio", "ano_fim")).alias("ano"))
    return wanted.join(stored.where(F.col("completo")), [key, "ano"], "left_anti")


def order_breaks(df: DataFrame, ident: str, moment: str) -> DataFrame:
    """How often a date goes back along the id order, and the largest step back.

    ``moment`` is a number, e.g. epoch days.
    """
    series = df.select(F.lit(0).alias("_g"), ident, F.col(moment).alias("_t"))
    step = with_previous(series, ["_g"], ident, "_t", "_before", width=1 << 16)
    back = F.col("_before") - F.col("_t")
    return step.agg(
        F.count("*").alias("n"),
        F.count_if(back > 0).alias("quebras"),
        ratio(F.count_if(back > 0), F.count("*")).alias("fracao"),
        F.max(F.when(back > 0, back)).alias("maior_recuo"),
    )


def compare_series(ours: DataFrame, reference: DataFrame, mine: str, theirs: str, *, key="station",
                   day="dia", min_days: int = 100, event_above: float = 50.0) -> DataFrame:
    """Agreement of two daily series per station; short overlaps are only counted.

    Coverage is the share of the reference's measured days that we have.
    """
    joined = reference.where(F.col(theirs).isNotNull()).join(
        ours.where(F.col(mine).isNotNull()), [key, day], "left"
    )
    both = F.col(mine).isNotNull()
    diff = F.col(mine) - F.col(theirs)
    a = F.when(both, F.col(mine)).cast("double")
    b = F.when(both, F.col(theirs)).cast("double")
    table = joined.groupBy(key).agg(
        F.count(mine).alias("dias"),
        (100 * ratio(F.count(mine), F.count("*"))).alias("cobertura_pct"),
        correlation(a, b).alias("r"),
        (100 * F.avg(F.when(both, (F.abs(diff) < 0.2).cast("double")))).alias("iguais_pct"),
        F.avg(diff).alias("vies_mm"),
        F.sum(a).alias("total_nosso"),
        F.sum(b).alias("total_referencia"),
        F.count_if(a > event_above).alias("eventos_nossos"),
        F.count_if(both & (F.col(theirs) > event_above)).alias("eventos_referencia"),
    )
    return table.withColumn(
        "situacao", F.when(F.col("dias") < min_days, "poucos dias").otherwise("ok")
    )


