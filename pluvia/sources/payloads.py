"""JSON payloads landed as text: hourly series, warnings, feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions.clock import epoch_hour

WARNING_FIELDS = (
    "descricao", "severidade", "id_severidade", "aviso_cor", "data_inicio", "hora_inicio",
    "data_fim", "hora_fim", "riscos", "instrucoes", "geocodes", "poligono", "encerrado",
)


def hourly_rows(landed: DataFrame, variables: Sequence[str] = config.GRID_VARIABLES,
                payload: str = "payload", keep: Sequence[str] = ("station",)) -> DataFrame:
    """``{"hourly": {"time": [...], var: [...]}}`` -> one row per hour, variables renamed.

    A variable the payload does not have becomes a NULL column.
    """
    fields = ", ".join(f"`{v}`: array<double>" for v in variables)
    parsed = F.from_json(F.col(payload), f"hourly struct<time: array<string>, {fields}>")
    zipped = F.arrays_zip(
        F.col("_p.hourly.time").alias("time"),
        *[
            F.coalesce(F.col(f"_p.hourly.`{v}`"), F.array().cast("array<double>")).alias(v)
            for v in variables
        ],
    )
    rows = landed.select(*keep, parsed.alias("_p")).select(*keep, F.inline(zipped))
    when = F.coalesce(
        F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("time")
    )
    return rows.select(
        *keep,
        epoch_hour(when).alias("h"),
        *[F.col(v).alias(config.GRID_RENAMES.get(v, v)) for v in variables],
    )


def _parsed(landed: DataFrame, payload: str) -> DataFrame:
    """Adds the text as a variant ``_v``, NULL if it is no JSON (an object that names a field twice is none).

    The outer form of explode is a step that filters on what is read from the variant do not go below, where they
    would parse the text again.
    """
    return landed.select("*", F.explode_outer(F.array(F.try_parse_json(F.trim(F.col(payload))))).alias("_v"))


def _why_unread(payload: str, document: str) -> Column:
    blank = F.coalesce(F.trim(F.col(payload)) == "", F.lit(True))
    return F.when(blank, F.lit("sem documento")).when(F.col(document).isNull(), F.lit("ilegivel"))


def first_record(document: Column) -> Column:
    """The one warning of a document that is an object, a list, or ``{"hoje": [...]}``.

    NULL for an empty list, an empty object, a record that is no object, or no document.
    """
    today = F.try_variant_get(document, "$.hoje", "variant")
    bare = F.when(today.isNull() | F.is_variant_null(today), document)
    found = F.coalesce(
        F.try_variant_get(document, "$[0]", "variant"), F.try_variant_get(document, "$.hoje[0]", "variant"), bare
    )
    return F.when(F.schema_of_variant(found).like("OBJECT<_%>"), found)


def _fields(record: str) -> list[Column]:
    return [F.try_variant_get(record, f"$.{c}", "string").alias(c) for c in WARNING_FIELDS]


def normalise_warning_payload(landed: DataFrame) -> DataFrame:
    """One row per attempted id, obtained or not: ``id, http, obtido``, the fields and ``motivo``.

    ``landed``: ``id, http, payload``. A document is parsed once. ``motivo`` says why there is no record: no
    document, unreadable, or without a warning in it; it is NULL where one was obtained.
    """
    found = _parsed(landed, "payload").withColumn("_r", first_record(F.col("_v")))
    why = F.when(F.col("_r").isNull(), F.coalesce(_why_unread("payload", "_v"), F.lit("sem registro")))
    return found.select("id", "http", F.col("_r").isNotNull().alias("obtido"), *_fields("_r"), why.alias("motivo"))


def _feed(landed: DataFrame, payload: str) -> DataFrame:
    """The documents with their ``hoje`` list and the reason why there is none."""
    read = _parsed(landed, payload).withColumn("_hoje", F.try_variant_get("_v", "$.hoje", "array<variant>"))
    why = F.when(F.col("_hoje").isNull(), F.coalesce(_why_unread(payload, "_v"), F.lit("sem lista")))
    return read.withColumn("motivo", why)


def feed_records(landed: DataFrame, payload: str = "payload", *, strict: bool = True) -> DataFrame:
    """Records of the ``hoje`` list of a feed document, one row each.

    A document that is not ``{"hoje": [...]}`` fails the query, or, if not ``strict``, gives no rows here and one in
    `feed_rejects`.
    """
    feed = _feed(landed, payload)
    if strict:
        wrong = F.raise_error(F.concat(F.lit('unexpected feed: wanted {"hoje": [...]}, '), F.col("motivo")))
        feed = feed.withColumn("_hoje", F.when(F.col("motivo").isNull(), F.col("_hoje")).otherwise(wrong))
    records = feed.select(F.explode_outer("_hoje").alias("_r")).where(F.col("_r").isNotNull())
    return records.select(F.try_variant_get("_r", "$.id", "bigint").alias("id"), *_fields("_r")).withColumns(
        {
            "encerrado": F.lower("encerrado").isin("true", "1"),
            "id_severidade": F.col("id_severidade").try_cast("int"),
        }
    )


def feed_rejects(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Feed documents that cannot be used, all their columns kept, with the reason in ``motivo``."""
    return _feed(landed, payload).where(F.col("motivo").isNotNull()).drop("_v", "_hoje")


def read_landed_json(spark, path: str, **extra) -> DataFrame:
    """Whole JSON documents under a folder: ``path, payload`` (one document per file)."""
    return spark.read.option("wholetext", True).text(path, **extra).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )
