"""Keyed stores that grow by small immutable tables.

A write adds the new rows as a table of its own, a table of the keys they replace, and a manifest that names both;
nothing that is stored is read or written again, so a batch of k keys costs k keys. A manifest is one small file with
a number, put in place by a rename that fails where the number is taken: a writer that stops before it has changed
nothing, and two writers cannot lose each other's batch. Readers take the newest manifest and leave out the rows
whose key a later batch names. Compaction writes what is current as one table.

Keys may be null, and are compared as values; a key without rows is only removed; equal rows of one batch are all
kept; columns may differ from batch to batch (missing ones are null).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pluvia.operators.storage import remove

#: So many batches at most wait for compaction.
MOST_BATCHES = 32
ATTEMPTS = 10
_BATCH = "_batch"


class _Folder:
    """The files of one store, through the file system that its path belongs to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.at("").getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        if not self.files.exists(self.at(folder)):
            return []
        return [x.getPath().getName() for x in self.files.listStatus(self.at(folder))]

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def place(self, name: str, text: str) -> bool:
        """Write a file under a new name; false if there is one already."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.files.mkdirs(self.at(name).getParent())
        try:
            context = self.hadoop.FileContext.getFileContext(self.files.getUri(), self.conf)
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(self.at(name)), self.none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.toString():
                raise
            self.files.delete(draft, False)
            return False
        return True


def _newest(folder: _Folder) -> tuple[int, list[dict]]:
    """Number and batches of the newest manifest, 0 and none before the first."""
    numbers = [int(x) for x in folder.names("manifests") if x.isdigit()]
    if not numbers:
        return 0, []
    return max(numbers), json.loads(folder.read(f"manifests/{max(numbers):012d}"))


def _table(spark: SparkSession, path: str, entry: dict, kind: str) -> DataFrame:
    """One table of a batch. Its schema is kept, since that of partition columns cannot be seen in all files."""
    return spark.read.schema(StructType.fromJson(entry[kind]["schema"])).parquet(f"{path}/{entry[kind]['folder']}")


def _write(df: DataFrame, path: str, kind: str, partitions: Sequence[str] = (), sort: Sequence[str] = ()) -> dict:
    folder = f"{kind}/{uuid.uuid4().hex}"
    if partitions:
        df = df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *sort)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(f"{path}/{folder}")
    names = [c for c in df.columns if c not in partitions] + list(partitions)
    schema = StructType([df.schema[n] for n in names])
    for field in schema.fields:
        field.nullable = True
    return {"folder": folder, "schema": schema.jsonValue()}


def _current(spark: SparkSession, path: str, batches: list[dict]) -> DataFrame:
    parts = [_table(spark, path, b, "rows").withColumn(_BATCH, F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    replaced = [_table(spark, path, b, "marks").withColumn(_BATCH, F.lit(i)) for i, b in enumerate(batches) if i and b["marks"]]
    if not replaced:
        return rows.drop(_BATCH)
    keys = batches[-1]["keys"]
    marks = reduce(DataFrame.unionByName, replaced).groupBy(*keys).agg(F.max(_BATCH).alias("_last"))
    marks = marks.select("_last", *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    hidden = same & (F.col("_last") > F.col(_BATCH))
    return rows.join(marks, hidden, "left_anti").drop(_BATCH)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What a store holds now, None while it has no batch. Filters on partition columns reach the files."""
    _, batches = _newest(_Folder(spark, path))
    return _current(spark, path, batches) if batches else None


def put(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    partitions: dict[str, Column] | None = None,
    sort: Sequence[str] = (),
    own: DataFrame | None = None,
) -> None:
    """Add rows to a store; they replace all stored rows with the same keys.

    `own` lists the keys to replace where some of them have no rows any more.
    """
    spark, partitions = rows.sparkSession, partitions or {}
    folder = _Folder(spark, path)
    written = _write(rows.withColumns(partitions), path, "rows", list(partitions), sort)
    entry = {"keys": list(keys), "rows": written, "marks": None}
    named = _table(spark, path, entry, "rows") if own is None else own
    entry["marks"] = _write(named.select(*keys).distinct(), path, "marks")
    for _ in range(ATTEMPTS):
        number, batches = _newest(folder)
        if batches and batches[-1]["keys"] != list(keys):
            raise ValueError(f"the store is keyed by {batches[-1]['keys']}, not {list(keys)}")
        if folder.place(f"manifests/{number + 1:012d}", json.dumps([*batches, entry])):
            break
    else:
        raise RuntimeError(f"{path} is written to by too many at a time")
    if len(batches) + 1 > MOST_BATCHES:
        compact(spark, path, list(partitions), sort)


def compact(spark: SparkSession, path: str, partitions: Sequence[str] = (), sort: Sequence[str] = ()) -> bool:
    """Write what is current as one table. False if another writer came first; nothing has changed then."""
    folder = _Folder(spark, path)
    number, batches = _newest(folder)
    if len(batches) < 2:
        return True
    rows = _write(_current(spark, path, batches), path, "rows", partitions, sort)
    whole = {"keys": batches[-1]["keys"], "rows": rows, "marks": None}
    return folder.place(f"manifests/{number + 1:012d}", json.dumps([whole]))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the tables and manifests that the newest manifest does not need; how many tables.

    To run while nobody writes or reads older manifests.
    """
    folder = _Folder(spark, path)
    number, batches = _newest(folder)
    used = {b[kind]["folder"] for b in batches for kind in ("rows", "marks") if b[kind]}
    unused = [f"{kind}/{n}" for kind in ("rows", "marks") for n in folder.names(kind) if f"{kind}/{n}" not in used]
    old = [f"manifests/{n}" for n in folder.names("manifests") if n.isdigit() and int(n) < number]
    for name in [*unused, *old, "drafts"]:
        remove(spark, f"{path}/{name}")
    return len(unused)
