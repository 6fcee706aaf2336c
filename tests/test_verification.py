"""Curves, average precision, intervals, base rates, bootstrap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.functions.rates import wilson
from pluvia.operators import bootstrap, metrics, quality, splits, warnings


def scored(spark, y, s, **more):
    return spark.createDataFrame(pd.DataFrame({"y": y, "s": np.asarray(s, float), **more}))


def ap(y, s, w=None):
    y, s = np.asarray(y), np.asarray(s, float)
    w = np.ones(len(y)) if w is None else np.asarray(w)
    total, value, before = (w * y).sum(), 0.0, 0.0
    for cut in np.unique(s)[::-1]:
        hit = s >= cut
        tp = (w * y)[hit].sum()
        value += (tp - before) / total * tp / w[hit].sum()
        before = tp
    return value


def test_curve_by_hand(spark):
    df = scored(spark, [1, 0, 1, 0, 1], [10, 20, 30, 5, 2])
    rows = {r.corte: r for r in metrics.operating_curve(df, "y", "s", [10, 40]).collect()}
    assert (rows[10.0].alertas, rows[10.0].acertos, rows[10.0].perdidos) == (3, 2, 1)
    assert rows[10.0].precisao == pytest.approx(2 / 3) and rows[10.0].recall == pytest.approx(2 / 3)
    assert rows[40.0].alertas == 0 and rows[40.0].precisao is None and rows[40.0].f1 == 0.0
    best = metrics.cut_for_recall(df, "y", "s", [0.5, 1.0]).collect()
    assert {r.alvo: r.corte for r in best} == {0.5: 10.0, 1.0: 2.0}


def test_average_precision_with_ties_and_weights(spark, rng):
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)
    w = rng.integers(1, 4, 300)
    df = scored(spark, y, s, w=w)
    assert metrics.average_precision(df, "y", "s").first().pr_auc == pytest.approx(ap(y, s))
    weighted = metrics.average_precision(df, "y", "s", weight="w").first().pr_auc
    assert weighted == pytest.approx(ap(np.repeat(y, w), np.repeat(s, w)))
    assert metrics.average_precision(scored(spark, [0, 0], [1, 2]), "y", "s").first().pr_auc == 0.0


def test_best_threshold_first_best_wins_and_default(spark):
    assert metrics.best_threshold(scored(spark, [0, 1, 1], [0.1, 0.4, 0.9]), "y", "s").first().threshold == pytest.approx(0.1)
    assert metrics.best_threshold(scored(spark, [0, 0], [0.1, 0.9]), "y", "s").first().threshold == 0.5


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0.0, 10), (1.0, 10), (0.5, 0), (0.5, 20)], "p double, n long")
    low, high = wilson(F.col("p"), F.col("n"))
    got = [(r.l, r.h) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert got[0][0] == 0.0 and 0 < got[0][1] < 0.35
    assert got[1][1] == 1.0 and 0.65 < got[1][0] < 1
    assert got[2] == (None, None)
    assert got[3][0] == pytest.approx(0.299, abs=1e-3) and got[3][1] == pytest.approx(0.701, abs=1e-3)


def test_base_rates_with_nulls(spark, rng):
    obs = pd.DataFrame({"chuva_24h_obs": rng.integers(0, 80, 500).astype(float), "rajada_max_obs": rng.integers(0, 30, 500).astype(float)})
    obs.loc[::7, "rajada_max_obs"] = None
    combos = [(50.0, 11.11), (50.0, None), (None, 20.0), (None, None), (20.5, 25.0)]
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in obs.itertuples(index=False)], "chuva_24h_obs double, rajada_max_obs double")
    rates = warnings.base_rates(df, spark.createDataFrame(combos * 2, "criterio_mm double, criterio_ms double"))
    got = {(r.criterio_mm, r.criterio_ms): r.taxa_base for r in rates.collect()}
    assert len(got) == 5
    for mm, ms in combos:
        want = np.zeros(len(obs), bool)
        if mm is not None:
            want |= obs.chuva_24h_obs >= mm
        if ms is not None:
            want |= obs.rajada_max_obs >= ms
        assert got[(mm, ms)] == pytest.approx(want.mean())


def test_grouped_interval_is_wider_than_plain(spark, rng):
    days = np.repeat(np.arange(40), 15)
    storm = rng.random(40) < 0.2
    y = (storm[days] & (rng.random(600) < 0.8)).astype(int)
    s1 = storm[days] * 1.0 + rng.normal(size=600)
    s2 = storm[days] * 1.5 + rng.normal(size=40)[days]
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": s1, "b": s2, "dia": days, "linha": np.arange(600)}))
    width, reps = {}, 60
    for unit in ("dia", "linha"):
        r = bootstrap.difference_interval(bootstrap.paired_difference(df, "y", "a", "b", unit, draws=reps)).first()
        assert r.ic_inf <= r.media <= r.ic_sup and r.reps <= reps
        width[unit] = r.ic_sup - r.ic_inf
    assert width["dia"] > width["linha"]
    same = bootstrap.paired_difference(df, "y", "a", "a", "dia", draws=20).collect()
    assert len(same) == 20 and all(r.diferenca == 0 for r in same)
    weights = bootstrap.group_weights(df, "dia", 20, 42).groupBy("rep").agg(F.sum("peso").alias("n")).collect()
    assert {r.n for r in weights} == {40}


def test_bootstrap_copies_are_not_broadcast(spark, rng, monkeypatch):
    """Rows are copied once a block of repetitions; the planner takes them for small, the driver must not hold them."""
    n, plans = 60, []

    def seen(rows, *more, old=bootstrap.average_precisions):
        rows.collect()
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return old(rows, *more)

    monkeypatch.setattr(bootstrap, "average_precisions", seen)
    df = spark.createDataFrame(pd.DataFrame({"u": np.arange(n), "y": rng.integers(0, 2, n), "a": rng.random(n), "b": rng.random(n)}))
    assert bootstrap.paired_difference(df, "y", "a", "b", "u", draws=45).count() == 45
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_bootstrap_repetitions_share_rows(spark, rng):
    """A unit is one row for each block of repetitions, and the differences are those of repeated rows."""
    import hashlib

    def precision(rows, score):
        """Average precision from the rows as they are, one threshold a distinct score."""
        cuts = sorted(set(rows[score]), reverse=True)
        above = [rows[rows[score] >= c] for c in cuts]
        steps = np.diff([0, *[x.y.sum() for x in above]])
        return sum(n * x.y.mean() for n, x in zip(steps, above)) / rows.y.sum()

    pdf = pd.DataFrame({"dia": np.repeat(np.arange(9), 7), "y": (rng.random(63) < 0.3).astype(int)})
    pdf["a"], pdf["b"] = rng.integers(0, 6, 63), pdf.y + rng.normal(size=63)
    df, draws = spark.createDataFrame(pdf), 45
    blocks = bootstrap.weight_blocks(df, "dia", draws, 42)
    assert blocks.count() <= 9 * -(-draws // bootstrap.REPS)
    got = {r.rep: r.diferenca for r in bootstrap.paired_difference(df, "y", "a", "b", "dia", draws=draws).collect()}
    for rep in range(draws):
        days = [int(hashlib.md5(f"42-{rep}-{i}".encode()).hexdigest()[:8], 16) % 9 for i in range(9)]
        rows = pd.concat([pdf[pdf.dia == x] for x in days])
        if rows.y.sum():
            assert got.pop(rep) == pytest.approx(precision(rows, "b") - precision(rows, "a"))
    assert not got


def test_gauge_day_boundary_and_minimum_hours(spark):
    base = 24 * 20000
    rows = [(1, base + 13, 10.0), (1, base + 24 + 12, 5.0), (1, base + 24 + 13, 7.0), (1, base + 48 + 14, None)]
    df = spark.createDataFrame(rows, "station long, h long, mm double").withColumn("dia_n", F.lit(0))
    out = {str(r.dia): r.chuva_nossa for r in metrics.gauge_days(df).collect()}
    days = sorted(out)
    assert [out[d] for d in days] == [15.0, 7.0, None]
    assert metrics.gauge_days(df, 2).where("chuva_nossa is not null").count() == 1


def test_compare_series_counts_only_shared_days(spark):
    theirs = spark.createDataFrame([(1, i, float(i % 60)) for i in range(200)], "station long, dia long, b double")
    mine = spark.createDataFrame([(1, i, float(i % 60) + (1 if i % 10 == 0 else 0)) for i in range(150)], "station long, dia long, a double")
    r = quality.compare_series(mine, theirs, "a", "b").first()
    assert (r.dias, r.cobertura_pct, r.iguais_pct, r.situacao) == (150, 75.0, 90.0, "ok")
    assert r.vies_mm == pytest.approx(0.1) and r.r > 0.99
    assert quality.compare_series(mine.where("dia < 50"), theirs, "a", "b").first().situacao == "poucos dias"


def test_split_edges_and_folds(spark):
    df = spark.createDataFrame([(h,) for h in range(1000)], "h long")
    out = splits.with_split(df, 500, 700).groupBy("janela").agg(F.min("h").alias("a"), F.max("h").alias("b")).collect()
    assert {r.janela: (r.a, r.b) for r in out if r.janela} == {"treino": (0, 476), "validacao": (501, 700), "teste": (725, 999)}
    with pytest.raises(ValueError):
        splits.require_splits(splits.with_split(df, 5000, 7000), ("treino", "teste"))
    folds = splits.expanding_folds(df, 3).orderBy("fold").collect()
    assert [(f.test_from, f.test_to, f.train_to) for f in folds] == [(250, 499, 226), (500, 749, 476), (750, 999, 726)]
