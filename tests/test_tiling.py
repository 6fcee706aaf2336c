"""Windows over tiles equal windows over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.operators import tiling, windows


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for station in (1, 2, 3):
        hours = np.sort(rng.choice(400, size=260, replace=False))
        if station == 3:
            hours = hours[(hours < 100) | (hours > 300)]
        for h in hours:
            x = None if rng.random() < 0.35 else float(rng.integers(0, 50))
            rows.append((station, int(h), x))
    pdf = pd.DataFrame(rows, columns=["station", "h", "x"])
    df = spark.createDataFrame(rows, "station long, h long, x double")
    return pdf, df


def collect(df, *columns):
    return df.select("station", "h", *columns).toPandas().sort_values(["station", "h"]).reset_index(drop=True)


def on_grid(group):
    full = pd.RangeIndex(group.h.min(), group.h.max() + 1)
    return group.set_index("h").x.reindex(full)


def expected(pdf, fn):
    parts = []
    for _, g in pdf.groupby("station"):
        grid = fn(on_grid(g))
        parts.append(grid.loc[g.sort_values("h").h].to_numpy())
    return np.concatenate(parts)


@pytest.mark.parametrize("width", [7, 1536])
def test_frames_equal_dense_grid(series, width):
    pdf, df = series
    out = windows.lags(df, "x", width=width)
    out = windows.rolling_totals(out, "x", width=width)
    out = windows.rolling_spread(out, "x", width=width)
    out = windows.future_total(out, "x", hours=4, width=width)
    got = collect(out, "lag_1h", "lag_24h", "chuva_3h", "chuva_72h", "rolling_std_24h", "rolling_max_24h", "chuva_futura_24h")
    want = {
        "lag_1h": lambda s: s.shift(1),
        "lag_24h": lambda s: s.shift(24),
        "chuva_3h": lambda s: s.rolling(3, min_periods=1).sum(),
        "chuva_72h": lambda s: s.rolling(72, min_periods=1).sum(),
        "rolling_std_24h": lambda s: s.rolling(24, min_periods=1).std(),
        "rolling_max_24h": lambda s: s.rolling(24, min_periods=1).max(),
        "chuva_futura_24h": lambda s: s.iloc[::-1].shift(1).rolling(4, min_periods=4).sum().iloc[::-1],
    }
    for name, fn in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), expected(pdf, fn), atol=1e-6, err_msg=name)


def test_target_does_not_cross_a_gap(spark):
    rows = [(1, h, 1.0) for h in list(range(30)) + list(range(100, 130))]
    out = windows.future_total(spark.createDataFrame(rows, "station long, h long, x double"), "x")
    got = {r.h: r.chuva_futura_24h for r in out.collect()}
    assert got[5] == 24.0 and got[6] is None and got[29] is None and got[105] == 24.0


@pytest.mark.parametrize("width", [5, 64, 4096])
def test_row_position_previous_and_runs(series, width):
    pdf, df = series
    df = df.withColumn("flag", (F.col("x") > 20).cast("int"))
    out = tiling.with_row_position(df, ["station"], "h", "rn", width)
    out = tiling.with_previous(out, ["station"], "h", "x", "before", width)
    out = tiling.with_run_id(out, ["station"], "h", "flag", "run", width)
    got = collect(out, "rn", "before", "run")
    pdf = pdf.sort_values(["station", "h"]).reset_index(drop=True)
    flag = pd.Series(np.where(pdf.x.isna(), -1, (pdf.x > 20).astype(int)))
    runs = flag.groupby(pdf.station).transform(lambda s: (s != s.shift()).cumsum())
    assert (got.rn == pdf.groupby("station").cumcount()).all()
    np.testing.assert_array_equal(got.before.to_numpy(float), pdf.groupby("station").x.shift().to_numpy())
    assert (got.run == runs).all()


@pytest.mark.parametrize("width", [4, 90, 4096])
def test_short_gaps_equal_pandas(series, width):
    pdf, df = series
    got = collect(tiling.fill_short_gaps(df, ["station"], "h", ["x"], 3, width), "x")
    pdf = pdf.sort_values(["station", "h"])
    want = pdf.groupby("station").x.transform(lambda s: s.interpolate(limit=3, limit_direction="both"))
    np.testing.assert_allclose(got.x.to_numpy(float), want.to_numpy())


@pytest.mark.parametrize("width", [6, 4096])
def test_future_mean_by_row_spans_gaps(series, width):
    pdf, df = series
    out = windows.future_mean(df, ["x"], 5, by_row=True, suffix="_m", width=width)
    want = pdf.sort_values(["station", "h"]).groupby("station").x.transform(
        lambda s: s.iloc[::-1].shift(1).rolling(5, min_periods=1).mean().iloc[::-1])
    np.testing.assert_allclose(collect(out, "x_m").x_m.to_numpy(float), want.to_numpy())


def test_grid_has_every_hour_once(series):
    pdf, df = series
    out = windows.hourly_grid(df).toPandas()
    for station, g in pdf.groupby("station"):
        part = out[out.station == station]
        assert sorted(part.h) == list(range(g.h.min(), g.h.max() + 1))
        assert part.observado.sum() == len(g)
