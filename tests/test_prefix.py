"""Running totals, quantiles and dominance counts against numpy."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvia.operators import prefix


def test_bucket_is_monotone(spark, rng):
    x = np.concatenate([rng.normal(size=4000), 10.0 ** rng.uniform(-300, 300, 2000), [0.0, 1, 2, 4, 5e-324, -1e-9]])
    edges = 2.0 ** np.arange(-60, 60)
    x = np.unique(np.concatenate([x, -x, edges, np.nextafter(edges, 0), np.nextafter(edges, np.inf)]))
    df = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("b", prefix.value_bucket(F.col("x")))
    got = df.toPandas().sort_values("x")
    assert (np.diff(got.b) >= 0).all()


def test_running_totals_both_directions(spark, rng):
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "v": np.round(rng.normal(scale=20, size=900), 2), "n": 1})
    pdf = pdf.groupby(["g", "v"], as_index=False).n.sum()
    df = spark.createDataFrame(pdf)
    for descending in (False, True):
        out = prefix.running_totals(df, ["g"], "v", ["n"], descending=descending, with_total=True).toPandas()
        ordered = out.sort_values(["g", "v"], ascending=[True, not descending])
        assert (ordered.groupby("g").n.cumsum() == ordered.cum_n).all()
        assert (ordered.groupby("g").n.transform("sum") == ordered.total_n).all()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = prefix.exact_quantiles(df, [], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99}).first()
    np.testing.assert_allclose([row.a, row.b, row.c, row.d], np.quantile(values, [0.0, 0.37, 0.5, 0.99]), rtol=1e-9, atol=1e-9)


def test_dominance_counts_equal_brute_force(spark, rng):
    pts = pd.DataFrame({"x": np.round(rng.gamma(2, 10, 800), 1), "y": np.round(rng.gamma(2, 5, 800), 1), "w": 1})
    pts.loc[::9, "y"] = np.nan
    qs = pd.DataFrame({"x": np.round(rng.gamma(2, 10, 60), 2), "y": np.round(rng.gamma(2, 5, 60), 2)}).drop_duplicates()
    points = spark.createDataFrame(pts).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).groupBy("x", "y").agg(F.sum("w").alias("w"))
    out = prefix.count_dominating(points, spark.createDataFrame(qs), "x", "y", "w").toPandas()
    assert len(out) == len(qs)
    for r in out.itertuples():
        assert r.n_ge == ((pts.x >= r.x) & (pts.y >= r.y)).sum()


def test_dominance_counts_over_several_digit_places(spark, rng):
    """More than 64 values on both axes, ties on the marks, queries above and below all points, no points at all."""
    pts = pd.DataFrame({"x": rng.integers(0, 900, 3000) / 2.0, "y": rng.integers(0, 300, 3000) / 2.0, "w": rng.integers(1, 9, 3000)})
    pts = pts.groupby(["x", "y"], as_index=False).w.sum()
    qs = pd.DataFrame({"x": rng.integers(-20, 1000, 700) / 2.0, "y": rng.integers(-20, 330, 700) / 2.0}).drop_duplicates()
    queries = spark.createDataFrame(qs)
    out = prefix.count_dominating(spark.createDataFrame(pts), queries, "x", "y", "w").toPandas()
    assert len(out) == len(qs) and qs.x.nunique() > 64 and qs.y.nunique() > 64
    want = [pts.w[(pts.x >= r.x) & (pts.y >= r.y)].sum() for r in out.itertuples()]
    assert out.n_ge.tolist() == want
    none = spark.createDataFrame([], "x double, y double, w long")
    assert prefix.count_dominating(none, queries, "x", "y", "w").where("n_ge <> 0").count() == 0
    assert prefix.count_dominating(spark.createDataFrame(pts), queries.limit(0), "x", "y", "w").count() == 0
