"""Keyed stores of immutable batches."""

import os

import pytest
from pyspark.sql import functions as F

from pluvia.operators import deltas
from pluvia.sources import station_csv, stores

SCHEMA = "path string, station string, h long, x double"
Y15, Y16 = 394488, 403248  # first hours of 2015 and 2016


def rows_of(spark, path, *columns):
    return sorted((tuple(r) for r in deltas.stored(spark, path).select(*columns).collect()), key=str)


@pytest.fixture
def put(spark, tmp_path):
    path = str(tmp_path / "store")

    def write(rows, **more):
        station_csv.write_silver(spark.createDataFrame(rows, SCHEMA), path, **more)
        return path

    return write


def test_rows_without_an_hour_stay(spark, put):
    put([("fA", "S1", None, 1.0), ("fA", "S1", Y15, 2.0)])
    path = put([("fB", "S1", None, 3.0)])
    assert rows_of(spark, path, "path", "h", "x") == [("fA", Y15, 2.0), ("fA", None, 1.0), ("fB", None, 3.0)]


def test_a_file_that_lost_a_year(spark, put):
    put([("fA", "S1", Y15, 1.0), ("fA", "S1", Y16, 2.0), ("fB", "S1", Y15, 3.0)])
    path = put([("fA", "S1", Y16, 9.0)])
    assert rows_of(spark, path, "path", "h", "x") == [("fA", Y16, 9.0), ("fB", Y15, 3.0)]
    gone = spark.createDataFrame([("fA",)], "path string")
    path = put([], files=gone)
    assert rows_of(spark, path, "path", "h") == [("fB", Y15)]


def test_two_stations_in_one_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    for station, extra in (("A", True), ("B", False), ("A", True)):
        rows = spark.createDataFrame([(station, 1, 1.0, 2.0)], "station string, h long, a double, b double")
        stores.write_forecast_archive(rows if extra else rows.drop("b"), path, "m", "w")
    got = stores.read_forecast_archive(spark, path, "m", "w", ["a"])
    assert sorted(r.station for r in got.collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="'b'"):
        stores.read_forecast_archive(spark, path, "m", "w", ["a", "b"])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_its_own_rows_only(spark, put):
    path = put([(f"f{i}", "S1", Y15 + i, float(i)) for i in range(2000)])
    before = {f: os.stat(f).st_mtime_ns for f in files(path)}
    put([("f7", "S1", Y15, -1.0)])
    assert {f: os.stat(f).st_mtime_ns for f in before} == before
    assert sum(spark.read.parquet(f).count() for f in files(path) - set(before)) == 2  # the row and its key
    assert deltas.stored(spark, path).count() == 2000


def test_a_writer_that_stops_before_the_swap(spark, put, monkeypatch):
    path = put([("fA", "S1", Y15, 1.0)])

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(deltas._Folder, "place", stop)
        with pytest.raises(KeyboardInterrupt):
            put([("fA", "S1", Y15, 2.0)])
    assert rows_of(spark, path, "x") == [(1.0,)]
    assert deltas.vacuum(spark, path) == 2
    assert rows_of(spark, path, "x") == [(1.0,)]


def test_two_writers_at_once(spark, put, monkeypatch):
    """Another batch is placed between reading the manifest and placing the own one."""
    path = put([("fA", "S1", Y15, 1.0)])
    newest, again = deltas._newest, []

    def slow(folder):
        found = newest(folder)
        if not again:
            again.append(1)
            put([("fB", "S1", Y15, 2.0)])
        return found

    monkeypatch.setattr(deltas, "_newest", slow)
    put([("fC", "S1", Y15, 3.0)])
    assert rows_of(spark, path, "path") == [("fA",), ("fB",), ("fC",)]


def test_compaction(spark, tmp_path, monkeypatch):
    path, want = str(tmp_path / "s"), {}
    monkeypatch.setattr(deltas, "MOST_BATCHES", 3)
    for i in range(9):
        batch = [(k % 5 if k % 5 else None, f"v{i}", k) for k in range(i, i + 4)]
        want = {k: v for k, v in want.items() if k not in {b[0] for b in batch}}
        for b in batch:
            want.setdefault(b[0], []).append(b)
        df = spark.createDataFrame(batch, "k long, v string, n long")
        deltas.put(df, path, ["k"], {"part": F.col("n") % 2}, ["n"])
        assert rows_of(spark, path, "k", "v", "n") == sorted((x for v in want.values() for x in v), key=str)
        assert len(deltas._newest(deltas._Folder(spark, path))[1]) <= 3
    before = rows_of(spark, path, "k", "v", "n")
    assert deltas.vacuum(spark, path) > 0 and rows_of(spark, path, "k", "v", "n") == before
    with pytest.raises(ValueError, match="keyed by"):
        deltas.put(spark.createDataFrame([(1, "v", 1)], "k long, v string, n long"), path, ["n"])


def test_years_are_pruned(spark, put):
    put([("fA", "S1", Y15, 1.0), ("fA", "S1", Y16, 2.0)])
    path = put([("fB", "S1", Y16, 2.0)])
    plan = stores.read_days(spark, path, "2016-01-01", "2016-01-02")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(ano") == 2
    assert deltas.stored(spark, path + "-none") is None
