"""Station CSV files: eight header lines, then a semicolon table, Latin-1, decimal comma.

Files are read line by line, so a file of any size splits over tasks. What a line is
follows from its content: ``KEY:;value`` lines carry metadata, the line that starts with
DATA names the columns, lines that start with a date are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions import text
from pluvia.functions.clock import epoch_hour
from pluvia.operators.cleaning import observation_time
from pluvia.operators.joins import attach
from pluvia.operators import deltas

# Canonical names of the date and hour columns of both layouts.
OLD_DATE, OLD_HOUR = "DATA (YYYY-MM-DD)", "HORA (UTC)"
NEW_DATE, NEW_HOUR = "DATA", "HORA UTC"


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
               glob: str = "*.CSV") -> DataFrame:
    """``path, line, modified`` of every line below a folder."""
    reader = (
        spark.read.schema("line string")
        .option("sep", "\u0001")
        .option("quote", "\u0002")
        .option("escape", "\u0002")
        .option("encoding", encoding)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
    )
    return reader.csv(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("line"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def in_states(lines: DataFrame, states: Sequence[str] = ("RS",), path: str = "path") -> DataFrame:
    """Files of the wanted states, by the ``_RS_`` token of their path."""
    wanted = F.lit(False)
    for s in states:
        wanted = wanted | F.contains(F.upper(F.col(path)), F.lit(f"_{s}_"))
    return lines.where(wanted)


def _kind(line: Column) -> Column:
    """What a line is; NULL for a blank one. What is nothing else is a row, readable or not."""
    return (
        F.when(F.trim(line) == "", F.lit(None))
        .when(line.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2};"), "row")
        .when(line.rlike(r"^[^;:]+:"), "meta")
        .when(text.canonical_header(line).startswith("DATA"), "names")
        .otherwise("row")
    )


def file_metadata(lines: DataFrame) -> DataFrame:
    """One row per file: mapped metadata values and the canonical column names.

    Only header lines are aggregated, a handful per file.
    """
    line = F.col("line")
    key = text.letters_only(F.split(line, ":", 2)[0])
    value = F.trim(F.ltrim(F.trim(F.split(line, ":", 2)[1]), F.lit(";")))
    names = F.transform(F.split(line, ";"), text.canonical_header)
    head = lines.withColumn("_kind", _kind(line)).where(F.col("_kind").isin("meta", "names"))
    fields = sorted(set(config.METADATA_KEYS.values()))
    columns = []
    for field in fields:
        spellings = [k for k, v in config.METADATA_KEYS.items() if v == field]
        columns.append(
            F.max(F.when((F.col("_kind") == "meta") & key.isin(spellings), value)).alias(field)
        )
    return head.groupBy("path").agg(
        *columns, F.max(F.when(F.col("_kind") == "names", names)).alias("colunas")
    )


def station_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable files with station code and coordinates, and rejected ones with the reason."""
    files = lines.select("path").distinct().join(file_metadata(lines), "path", "left")
    described = files.select(
        "path",
        text.station_code(F.col("path")).alias("estacao_codigo"),
        F.col("estacao_nome"),
        *[text.decimal_comma(F.col(c)).alias(c) for c in ("latitude", "longitude", "altitude")],
        "colunas",
    ).withColumn("estacao_nome", F.coalesce("estacao_nome", "estacao_codigo"))
    reason = (
        F.when(F.col("estacao_codigo").isNull(), "no station code in the file name")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "no coordinates in the header")
        .when(F.col("colunas").isNull(), "no column names")
    )
    marked = described.withColumn("motivo", reason)
    return (
        marked.where(F.col("motivo").isNull()).drop("motivo"),
        marked.where(F.col("motivo").isNotNull()).select("path", "motivo"),
    )


def observations(lines: DataFrame, files: DataFrame,
                 measures: Sequence[str] = tuple(config.MEASURES)) -> DataFrame:
    """Typed hourly rows: station, hour, measurements, metadata, file path.

    Headers of both layouts lead to the same columns; where two headers mean the same
    column, the first with a number wins. Lines without a readable time, broken ones included,
    have NULL ``h`` (`unreadable_lines` lists them).
    """
    rows = lines.where(_kind(F.col("line")) == "row").select(
        "path", "line", F.split("line", ";").alias("_v")
    )
    joined = attach(rows, files, ["path"], spread_by="line", how="inner")

    def cell(name: str) -> Column:
        return F.get(F.col("_v"), F.array_position("colunas", F.lit(name)).cast("int") - 1)

    def measure(internal: str) -> Column:
        headers = [h for h, c in config.HEADERS.items() if c == internal]
        repeated = F.filter(
            F.transform(
                F.arrays_zip(F.col("colunas").alias("n"), F.col("_v").alias("v")),
                lambda z: F.when(z["n"].isin(headers), text.decimal_comma(z["v"])),
            ),
            lambda v: v.isNotNull(),
        )
        return F.nullif(F.get(repeated, F.lit(0)), F.lit(config.SENTINEL))

    when = observation_time(cell(OLD_DATE), cell(OLD_HOUR), cell(NEW_DATE), cell(NEW_HOUR))
    return joined.select(
        F.col("estacao_codigo").alias("station"),
        epoch_hour(when).alias("h"),
        *[measure(m).alias(m) for m in measures],
        "estacao_nome", "latitude", "longitude", "altitude", "path",
    )


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """``path, line, motivo`` of the data lines that do not begin with a date, to go with the rejected files."""
    bad = (_kind(F.col("line")) == "row") & ~F.col("line").rlike(r"^\d{4}[-/]\d{2}[-/]\d{2};")
    return lines.where(bad).select("path", "line", F.lit("no date at the beginning").alias("motivo"))


def unprocessed(lines: DataFrame, processed: DataFrame) -> DataFrame:
    """Lines of files that are new or changed since they were last processed."""
    return lines.join(processed.select("path", "modified"), ["path", "modified"], "left_anti")


def write_silver(rows: DataFrame, path: str, hour: str = "h", files: DataFrame | None = None) -> None:
    """Add rows to a store by year (`deltas.stored` reads it).

    All rows of a file replace what the store has of that file, in years that it no longer has as well; other files
    stay. `files` (path) lists the files of the batch where some of them may have no rows left.
    """
    year = F.year(F.timestamp_seconds(F.col(hour) * 3600))
    deltas.put(rows, path, ["path"], {"ano": year}, ["station", hour], own=files)


def processed_files(rows: DataFrame) -> DataFrame:
    """The table for `unprocessed`: which files, in which state, were read."""
    return rows.select("path", "modified").distinct()
