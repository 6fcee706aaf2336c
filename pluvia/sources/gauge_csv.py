"""Daily gauge files: ten header lines, UTF-8, decimal point, the word null for missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions import text
from pluvia.operators.cleaning import number
from pluvia.operators.joins import attach

# Fixed value: canonical name of the rain column.
RAIN_HEADER = "PRECIPITACAO TOTAL, DIARIO (AUT)(MM)"
DATE_HEADER = "DATA MEDICAO"


def gauge_days(lines: DataFrame) -> DataFrame:
    """``estacao_codigo, dia, chuva_bdmep`` of every data line; ``lines`` has ``path, line``."""
    line = F.col("line")
    names = F.transform(F.split(line, ";"), text.canonical_header)
    is_names = text.canonical_header(line).startswith(DATE_HEADER)
    is_meta = ~is_names & line.contains(":") & ~line.rlike(r"^\d{4}-\d{2}-\d{2};")
    parts = F.split(line, ":", 2)
    code = F.when(is_meta & F.upper(parts[0]).contains("CODIGO"), F.trim(parts[1]))
    files = (
        lines.where(is_names | is_meta)
        .groupBy("path")
        .agg(F.max(code).alias("estacao_codigo"), F.max(F.when(is_names, names)).alias("colunas"))
    )
    rows = lines.where(line.rlike(r"^\d{4}-\d{2}-\d{2};")).select(
        "path", "line", F.split("line", ";").alias("_v")
    )
    joined = attach(rows, files, ["path"], spread_by="line", how="inner")

    def cell(name: str):
        return F.get(F.col("_v"), F.array_position("colunas", F.lit(name)).cast("int") - 1)

    return joined.select(
        "estacao_codigo",
        cell(DATE_HEADER).try_cast("date").alias("dia"),
        number(cell(RAIN_HEADER)).alias("chuva_bdmep"),
    )
