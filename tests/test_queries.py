"""A sample of the registered queries against their oracles, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.01"
SAMPLE = [
    "E4_rolling_totals", "E7_future_target", "P9_dedupe_keep_first", "P_clean_table", "P_feature_table", "J1_canonical_coordinates",
    "J7_forecast_substitution", "G2_episodes", "G5_station_climatology", "G16_area_point_gap", "G19_operating_curve",
    "G23_average_precision", "M13_degradation_study", "A1_station_csv_rows", "A13_snapshot_archive", "S3_notification_stream",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(SAMPLE) <= set(oracles)
    without = {q for q in queries if q not in oracles}
    assert all(q == "pipeline" or q.startswith("op") for q in without)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["station", "dia", "evento_extremo", "chuva_24h", "chuva_48h"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    ok, note = check.compare(spark, check.tables(SF), name, SF, entry.oracle_sql()[name])
    assert ok, note


def test_require_splits_sees_all_values(spark):
    from pluvia.operators import splits

    many = spark.range(1000).selectExpr("concat('w', id % 200) as janela")
    assert splits.require_splits(many, ("w3", "w199")) is many
    with pytest.raises(ValueError, match="w200"):
        splits.require_splits(many, ("w3", "w200"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_their_shape(spark):
    from pluvia.operators import metrics, windows
    from pluvia.plans import views as V

    frames = windows.rolling_totals(spark.range(100).selectExpr("id % 3 as station", "id as h", "id as x"), "x")
    assert plan(frames).count("Exchange") == 1
    first = plan(entry.queries()["P9_dedupe_keep_first"](spark, SF))
    assert first.count("WindowGroupLimit") == 2
    ap = metrics.average_precision(V.scored(spark, SF), "y", "prob")
    ap.collect()
    for name in ("J9_station_in_polygon", "J3_neighbour_map", "J16_reports_in_force"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scan = plan(entry.queries()["G10_gauge_day"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in scan
