"""Structured Streaming forms of the incremental feeds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pluvia.operators.spatial import points_in_polygons
from pluvia.operators import deltas
from pluvia.operators.storage import materialise
from pluvia.operators.warnings import expand_station_days


#: Warnings and reports meet in blocks of so many hours; of warnings that come together at a place and in a block so many
#: at most share a row, and a task looks through so many at a time.
BLOCK_HOURS, SHARED, LOOK_THROUGH = 240, 256, 1 << 20
BLOCK_SECONDS = BLOCK_HOURS * 3600


def new_forecast_rows(snapshots: DataFrame, keys: Sequence[str] = ("station", "h", "dia_emissao"), *,
                      issued: str = "emitida_em", delay: str = "2 days") -> DataFrame:
    """Rows of landed forecast snapshots, each (station, hour, issue day) once.

    Repeats within the watermark and snapshots later than it are dropped.
    """
    return snapshots.withWatermark(issued, delay).dropDuplicatesWithinWatermark(list(keys))


def new_warning_days(warnings: DataFrame, stations: DataFrame, *, types: Sequence | None,
                     arrival: str = "colhido_em", delay: str = "1 day") -> DataFrame:
    """Station-days of warnings as they arrive, each warning id once."""
    slim = warnings.select(
        "id", "descricao", "id_severidade", "inicio", "fim", "riscos", "poligono", arrival
    )
    fresh = slim.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["id"])
    return expand_station_days(fresh, stations, types=types)


def rain_windows(observations: DataFrame, *, time="ts", value="value", key="station",
                 length: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Sliding rain totals per station; a window is final once the watermark passes its end."""
    return (
        observations.withWatermark(time, delay)
        .groupBy(key, F.window(time, length, slide).alias("janela"))
        .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        .select(key, F.col("janela.start").alias("inicio"), F.col("janela.end").alias("fim"), "total", "n")
    )


def episode_stream(rows: DataFrame, label: str = "evento_extremo", *, time="ts", key="station",
                   gap: str = "90 minutes", delay: str = "2 hours") -> DataFrame:
    """Episodes of positive rows per station as they end: rows less than ``gap`` apart are one episode.

    A late row, within the delay, lengthens its episode or joins two. An episode is final, and comes out, once the
    watermark is ``gap`` past its last row. Negative rows move the watermark only.
    """
    # A condition on the label alone would be pushed below the watermark, which would then stand still in dry spells.
    positive = rows.withWatermark(time, delay).where(F.when(F.col(time).isNotNull(), F.col(label)) == 1)
    return (
        positive.groupBy(key, F.session_window(time, gap).alias("sessao"))
        .agg(F.count("*").alias("linhas"), F.min(time).alias("inicio"), F.max(time).alias("fim"))
        .select(key, "linhas", "inicio", "fim")
    )


def reports_with_warnings(reports: DataFrame, warnings: DataFrame, places: DataFrame, *,
                          delay: str = "6 hours") -> DataFrame:
    """Flood reports joined to the warnings in force at their place and time, as both arrive.

    ``reports``: ``report_id, station, ts``. ``warnings``: ``id, id_severidade, inicio, fim,
    poligono``. State is keyed by (station, block of four days), so one busy place spreads over tasks and a
    warning is one row for each block that it touches. A row is late once its last hour in the block is.
    """
    slim = warnings.select("id", "id_severidade", "inicio", "fim", "poligono")
    first, last = (F.floor(F.unix_seconds(c) / BLOCK_SECONDS) for c in ("inicio", "fim"))
    last_hour = F.least(F.floor(F.unix_seconds("fim") / 3600) * 3600, F.col("bloco") * BLOCK_SECONDS + BLOCK_SECONDS - 3600)
    located = (
        points_in_polygons(slim, places.select("station", "lat", "lon"))
        .withColumn("bloco", F.explode(F.sequence(first, last)))
        .withColumn("hora", F.timestamp_seconds(last_hour))
        .select(F.col("station").alias("lugar"), "bloco", "hora", "id", "id_severidade", "inicio", "fim")
    )
    listed = sharing_rows(located.where("lugar is not null"), ["lugar", "bloco"], "hora").withWatermark("hora", delay)
    arriving = reports.withWatermark("ts", delay)
    # The block of a row holds its last hour and those before it; this also tells Spark when state can go.
    same_block = (F.col("ts") >= F.col("hora") - F.expr(f"interval {BLOCK_HOURS - 1} hours")) & (F.col("ts") < F.col("hora") + F.expr("interval 1 hour"))
    met = arriving.join(
        listed,
        (F.col("station") == F.col("lugar"))
        & (F.floor(F.unix_seconds("ts") / BLOCK_SECONDS) == F.col("bloco"))
        & same_block,
    )
    each = met.select("report_id", "station", "ts", F.inline(F.arrays_zip("id", "id_severidade", "inicio", "fim")))
    return each.where(F.col("ts").between(F.col("inicio"), F.col("fim"))).select("report_id", "station", "ts", "id", "id_severidade")


def sharing_rows(rows: DataFrame, keys: Sequence[str], latest: str) -> DataFrame:
    """Rows of the same keys (whole numbers) that come in one batch as lists in one row, with the greatest ``latest``.

    Of a stream's batch as of a table; nothing is kept between batches. Rows move by key first; a task looks through
    LOOK_THROUGH of them at a time, and a row holds SHARED at most, so that neither grows with the data.
    """
    values = [c for c in rows.columns if c not in (*keys, latest)]
    types = dict(rows.dtypes)
    schema = [f"{c} {types[c]}" for c in (*keys, latest)] + [f"{c} array<{types[c]}>" for c in values]

    def shared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        columns = [table[k].to_numpy() for k in keys]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]
        begin = np.flatnonzero(new)
        within = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        begin = np.flatnonzero(within % SHARED == 0)
        table = table.take(pa.array(order)).combine_chunks()
        when = table[latest].chunk(0)
        hours = np.maximum.reduceat(when.cast(pa.int64()).to_numpy(), begin)
        ends = pa.array(np.r_[begin, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, table[c].chunk(0)) for c in values]
        made = [*(pa.array(c[begin]) for c in columns), pa.array(hours).cast(when.type), *lists]
        whole = pa.RecordBatch.from_arrays(made, [*keys, latest, *values])
        for at in range(0, len(begin), 10_000):
            yield whole.slice(at, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOOK_THROUGH:
                yield from shared(held)
                held, n = [], 0
        if n:
            yield from shared(held)

    return rows.repartition(*keys).mapInArrow(run, ", ".join(schema))


#: The state store that timers and keyed state of their own need.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
#: For joins of streams with much state: it lies on disk, one store a task with bounded memory, and a batch writes its changes.
ROCKSDB_JOIN = ROCKSDB | {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


class LateRows(StreamingQueryListener):
    """Counts the rows that a query drops because they came after the watermark, over all of its batches."""

    def __init__(self) -> None:
        self.by_run: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.by_run[str(event.runId)] = {}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(x.numRowsDroppedByWatermark for x in progress.stateOperators)
        batches = self.by_run.setdefault(str(progress.runId), {})
        # A batch without new data reports the figures of the batch before once more.
        batches[progress.batchId] = dropped if progress.numInputRows else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query: StreamingQuery) -> int:
        return sum(self.by_run.get(str(query.runId), {}).values())


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = (), *,
                   rocksdb: bool = False, state: dict[str, str] | None = None) -> StreamingQuery:
    """Process everything that is available, append to parquet, stop. `rocksdb`: with that state store; `state`: with these settings of it."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(*partition)
    conf = stream.sparkSession.conf
    settings = state or (ROCKSDB if rocksdb else {})
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        query = writer.start()  # takes the settings as they are now
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    query.awaitTermination()
    return query


def run_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], *, latest: str | None = None,
               expand=None) -> StreamingQuery:
    """Process everything available; the rows of a key replace those stored under it before.

    Of several arrivals of a key in one batch the one with the greatest ``latest`` counts.
    ``expand(batch)`` turns the kept arrivals into the rows to store. A batch writes its own keys and rows
    only (`deltas.stored` reads the store); one that is run again after a failure replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        if latest is not None:
            newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(latest)))
            batch = batch.withColumn("_nth", newest).where(F.col("_nth") == 1).drop("_nth")
        batch = materialise(batch, "arrived")
        arrived = batch.select(*keys).distinct()
        rows = batch if expand is None else expand(batch)
        deltas.put(rows, path, keys, own=arrived)

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
