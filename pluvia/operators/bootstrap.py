"""Paired, grouped bootstrap of a difference in average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.metrics import average_precisions
from pluvia.operators.prefix import exact_quantiles, running_totals
from pluvia.operators.storage import materialise

#: So many repetitions share a row, one column each; so many turns of them at most are drawn in one group.
REPS, TURNS = 20, 1 << 20


def draw_number(seed: int, draw: Column, turn: Column, upper: Column) -> Column:
    """Reproducible integer in [0, upper): eight hex digits of an MD5, modulo ``upper``."""
    text = F.concat_ws("-", F.lit(str(seed)), draw.cast("string"), turn.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % upper


def _weight(k: int) -> str:
    return f"_w{k}"


def weight_blocks(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """(unit, bloco, _w0, _w1, ...): how often a unit is drawn in the repetitions of a block, a column for each.

    The turns are dealt out by block before they are drawn, so draws are counted where they are made and a unit
    moves once a block; beyond TURNS units a block's turns are dealt to several tasks.
    """
    units = df.select(unit).where(F.col(unit).isNotNull()).distinct().withColumn("_one", F.lit(1))
    numbered = running_totals(units, [], unit, ["_one"]).select(
        unit, F.col("cum__one").cast("long").alias("_i")
    )
    size = units.agg(F.count("*")).scalar()
    blocks = -(-draws // REPS)
    turns = numbered.select(
        (F.col("_i") - 1).alias("_turn"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bloco")
    ).repartition("bloco", F.floor(F.col("_turn") / TURNS))
    first = F.col("bloco") * REPS
    picks = turns.select(
        "bloco", "_turn", F.explode(F.sequence(first, F.least(first + REPS, F.lit(draws)) - 1)).alias("rep")
    ).select(
        "bloco",
        (F.col("rep") - first).alias("_k"),
        (draw_number(seed, F.col("rep"), F.col("_turn"), size) + 1).alias("_i"),
    )
    weights = picks.groupBy("bloco", "_i").agg(*[F.count_if(F.col("_k") == k).alias(_weight(k)) for k in range(REPS)])
    return weights.join(numbered, "_i").select(unit, "bloco", *map(_weight, range(REPS)))


def group_weights(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """How often each unit is drawn, with replacement, in each repetition.

    Each repetition draws as many units as there are. The unit column is numeric.
    """
    each = F.array(*[
        F.struct((F.col("bloco") * REPS + k).alias("rep"), F.col(_weight(k)).alias("peso")) for k in range(REPS)
    ])
    return weight_blocks(df, unit, draws, seed).select(unit, F.inline(each)).where("peso > 0").select("rep", unit, "peso")


def paired_difference(df: DataFrame, label: str, base: str, other: str, unit: str, *,
                      draws: int = 2000, seed: int = 42) -> DataFrame:
    """Average precision of ``other`` minus ``base`` in each repetition.

    Rows are weighted by how often their unit was drawn, which equals repeating them.
    Rows are first counted per (unit, score, label) and meet the weights of a block of
    repetitions at a time; repetitions without a positive give no row.
    """
    weights = materialise(weight_blocks(df.select(unit), unit, draws, seed), "weights")

    sides = F.array(
        F.struct(F.lit("base").alias("_side"), F.col(base).cast("double").alias("_score")),
        F.struct(F.lit("other").alias("_side"), F.col(other).cast("double").alias("_score")),
    )
    counts = (
        df.select(unit, F.col(label).alias("_y"), F.inline(sides))
        .where(F.col("_score").isNotNull())
        .groupBy(unit, "_side", "_score", "_y")
        .agg(F.count("*").alias("_c"))
    )
    counts = materialise(counts, "counts")
    # A unit may own many rows (a day), so they are spread over its blocks. The planner takes the copies for as small
    # as the counts and would broadcast them all, so the kind of join is named.
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // REPS) - 1))).alias("bloco")
    names = [_weight(k) for k in range(REPS)]
    rows = counts.select("*", blocks).join(weights.hint("merge"), [unit, "bloco"])
    rows = rows.select("bloco", "_side", "_score", "_y", *[(F.col("_c") * F.col(w)).alias(w) for w in names])
    scores = average_precisions(rows, "_y", "_score", ["bloco", "_side"], names)
    each = scores.select("_side", (F.col("bloco") * REPS + F.col("_k")).alias("rep"), "_ap", "eventos")
    return (
        each.where(F.col("eventos") > 0)
        .groupBy("rep")
        .agg(
            F.max(F.when(F.col("_side") == "base", F.col("_ap"))).alias("_base"),
            F.max(F.when(F.col("_side") == "other", F.col("_ap"))).alias("_other"),
        )
        .select("rep", (F.col("_other") - F.col("_base")).alias("diferenca"))
        .where(F.col("diferenca").isNotNull())
    )


def difference_interval(differences: DataFrame) -> DataFrame:
    """Mean and 95 % percentile interval over the repetitions."""
    bounds = exact_quantiles(
        differences, [], "diferenca", {"ic_inf": 0.025, "ic_sup": 0.975}, count="reps", total="_sum"
    )
    return bounds.select((F.col("_sum") / F.col("reps")).alias("media"), "reps", "ic_inf", "ic_sup")
