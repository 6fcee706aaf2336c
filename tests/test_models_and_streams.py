"""Calibration, scoring, notification policy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.operators import deltas, metrics, ml
from pluvia.streaming import feeds, notify


def pool(x, y):
    """Pool adjacent violators on sorted distinct x."""
    blocks = []
    for value in pd.Series(y).groupby(x).agg(["mean", "size"]).itertuples():
        blocks.append([value.mean, value.size, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, k = blocks.pop()
            p, q, j = blocks.pop()
            blocks.append([(p * q + m * n) / (q + n), q + n, j + k])
    return np.concatenate([[b[0]] * b[2] for b in blocks])


def test_isotonic_equals_pooling(spark, rng):
    x = np.round(rng.random(400), 2)
    y = (rng.random(400) < x).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    model = ml.fit_isotonic(df, "x", "y")
    probe = spark.createDataFrame([(float(v),) for v in [-5.0, *np.unique(x), 5.0]], "x double")
    got = [r.calibrado for r in ml.apply_isotonic(model, probe, "x").orderBy("x").collect()]
    want = pool(x, y)
    np.testing.assert_allclose(got, [want[0], *want, want[-1]], atol=1e-9)


def test_logistic_on_one_score_keeps_its_ranking(spark, rng):
    s = rng.gamma(2, 10, 500)
    y = (rng.random(500) < s / 60).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"ifs_log": np.log1p(s), "s": s, "rotulo": y}))
    scored = ml.scored_by(ml.combiner(["ifs_log"], 500).fit(df), df, ["rotulo", "s"])
    through = metrics.average_precision(scored, "rotulo", "score").first().pr_auc
    assert through == pytest.approx(metrics.average_precision(df, "rotulo", "s").first().pr_auc)


def test_train_save_and_score(spark, rng, tmp_path):
    n = 900
    x, z = rng.normal(size=n), rng.normal(size=n)
    target = np.maximum(0, 10 * x + rng.normal(size=n) + 5)
    pdf = pd.DataFrame({"station": 1, "h": np.arange(n), "a": x, "b": z, "chuva_futura_24h": target, "evento_extremo": (target > 12).astype(int)})
    pdf["janela"] = np.where(pdf.h < 500, "treino", np.where(pdf.h < 700, "validacao", "teste"))
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("h") % 3 > 0, F.col("b"))).withColumn("vazia", F.lit(None).cast("double"))
    scores = {(r.unidade, r.metrica): r.valor for r in ml.train(df, ["a", "b", "vazia"], str(tmp_path), trees=5).collect()}
    assert scores[("linha", "pr_auc")] > 0.7 and scores[("regressao", "mae")] < 4
    out = ml.score_batch(df.where("janela = 'teste'").drop("b"), str(tmp_path), ["station", "h"]).toPandas()
    assert len(out) == 200 and (out.chuva_24h_prevista >= 0).all() and out.risco_evento_extremo.between(0, 1).all()
    assert ml.load_metadata(str(tmp_path), spark)["feature_columns"] == ["a", "b"]


H = 3600
CASES = [
    (1, 0, 1, 7), (1, 2 * H, 2, 7), (1, 3 * H, 3, 8), (1, 4 * H, 4, 7), (1, 5 * H, 5, 8), (1, 9 * H, 6, 7), (1, 20 * H, 7, 6),
    (2, 0, 8, 8), (2, 0, 9, 7), (2, 6 * H, 10, 8), (2, 12 * H - 1, 11, 8), (3, 10 * H, 12, 6),
]


def oracle(events):
    sent = []
    for place in {e[0] for e in events}:
        last = None
        for _, ts, ident, level in sorted((e for e in events if e[0] == place and e[3] >= 7), key=lambda e: (e[1], -e[3], e[2])):
            if last and ts - last[0] < 6 * H and level <= last[1]:
                continue
            last = (ts, level)
            sent.append((place, ts, ident))
    return sorted(sent)


def test_notification_policy(spark, rng):
    events = CASES + [(4 + int(i % 2), int(t), 100 + i, int(rng.integers(6, 9))) for i, t in enumerate(rng.integers(0, 40 * 86400, 300))]
    df = spark.createDataFrame(events, "station long, ts_s long, id long, id_severidade int")
    got = sorted((r.station, r.ts_s, r.id) for r in notify.notifications(df).collect())
    assert got == oracle(events)
    assert (1, 3 * H, 3) in got and (1, 5 * H, 5) not in got and (2, 0, 9) not in got
    assert {r.canal for r in notify.notifications(df.where("id = 8")).collect()} == {"interrompe"}


@pytest.fixture
def notified(spark, tmp_path):
    """Runs a batch of events through the stream and its checkpoint; all notifications so far, and the query."""
    source, out, schema = tmp_path / "in", tmp_path / "out", "station long, ts_s long, id long, id_severidade int"

    def batch(events, delay):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = notify.notification_stream(spark.readStream.schema(schema).parquet(str(source)), delay=delay)
        query = feeds.run_to_parquet(stream, str(out), str(tmp_path / "checkpoint"), rocksdb=True)
        return sorted((r.station, r.ts_s, r.id) for r in spark.read.parquet(str(out)).collect()), query

    return batch


END = [(99, 9000 * H, 99, 8)]  # moves the watermark past all others


def later(events):
    """The watermark begins at the epoch, events have to come after it."""
    return [(place, ts + 1000 * H, ident, level) for place, ts, ident, level in events]


def test_notification_stream_keeps_state_between_batches(notified):
    notified(later(CASES[:4]), "12 hours")
    notified(later(CASES[4:]), "12 hours")
    got, query = notified(END, "12 hours")
    assert [x for x in got if x[0] != 99] == oracle(later(CASES))
    # One place is left: the last events sent before were forgotten six hours later.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_late_event_is_judged_at_its_time(spark, notified, rng):
    """Batches in which older events follow newer ones of the batch before, within the delay."""
    events = [(1 + int(i % 3), int(t), 100 + i, int(rng.integers(6, 9))) for i, t in enumerate(rng.integers(0, 6 * 86400, 240))]
    events = later(sorted(events, key=lambda e: (e[1] // (24 * H), e[2])))
    batches = [events[i : i + 60] for i in range(0, 240, 60)]
    batches[0], batches[1] = batches[0] + batches[1][::2], batches[1][1::2]
    for some in batches:
        notified(some, "3 days")
    got, _ = notified(END, "3 days")
    assert [x for x in got if x[0] != 99] == oracle(events)


class CountedState:
    """Stands for the handle, its states and the timers of one place; counts the calls."""

    def __init__(self, kind=""):
        self.kind, self.states, self.calls, self.timers, self.values, self.list = kind, [], 0, set(), None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return self.answer(name, args)

        return call

    def answer(self, name, args):
        if name in ("getListState", "getMapState", "getValueState"):
            self.states.append(CountedState(name))
            return self.states[-1]
        if name == "registerTimer":
            self.timers.add(args[0])
        elif name == "appendValue":
            self.list.append(args[0])
        elif name in ("update", "updateValue"):
            self.values = args[-1]
        elif name == "clear":
            self.values, self.list = None, []
        elif name == "get":
            return iter(list(self.list)) if self.kind == "getListState" else self.values
        return None


def test_state_calls_do_not_grow_with_the_events_of_a_place():
    n = 500
    pdf = pd.DataFrame({"ts_s": [i * 7 * H for i in range(n)], "id": range(n), "id_severidade": 8})

    class Now:
        def getCurrentWatermarkInMs(self):
            return n * 7 * H * 1000

    class Timer:
        def getExpiryTimeInMs(self):
            return min(handle.timers)

    handle, notifier = CountedState(), notify.Notifier()
    notifier.init(handle)
    assert list(notifier.handleInputRows((1,), iter([pdf]), Now())) == []
    (sent,) = notifier.handleExpiredTimer((1,), Now(), Timer())
    assert sent["id"].tolist() == list(range(n))
    assert handle.calls + sum(s.calls for s in handle.states) <= 20


def test_events_beyond_the_watermark_wait_on(notified):
    """A batch of which the watermark passes a part: the rest is judged later, against what was sent before."""
    events = later([(1, 0, 1, 7), (1, H, 2, 7), (1, 5 * H, 3, 8), (1, 6 * H, 4, 8), (1, 30 * H, 5, 7)])
    notified(events, "24 hours")
    first, _ = notified([(9, 1007 * H + H // 2, 9, 8)], "24 hours")
    got, _ = notified(END, "24 hours")
    assert first == oracle(events[:4])[:len(first)] and len(first) == 2
    assert [x for x in got if x[0] != 99 and x[0] != 9] == oracle(events)


def test_too_late_events_are_counted(spark, notified):
    counter = feeds.LateRows()
    spark.streams.addListener(counter)
    try:
        notified([(1, 100 * H, 1, 8)], "1 hour")
        got, query = notified([(1, 50 * H, 2, 8), (2, 60 * H, 3, 8), (1, 101 * H, 4, 8)], "1 hour")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert counter.total(query) == 2
        got, _ = notified(END, "1 hour")
        assert [x for x in got if x[0] != 99] == [(1, 100 * H, 1)]
    finally:
        spark.streams.removeListener(counter)


def test_repeated_snapshot_rows_are_dropped_across_batches(spark, tmp_path):
    schema = "station long, h long, dia_emissao int, emitida_em timestamp, x double"
    import datetime

    t0 = datetime.datetime(2026, 1, 1, 12)
    for x in (1.0, 2.0):
        rows = [(1, 5, 1, t0, x), (1, 6, 1, t0, x)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.new_forecast_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        feeds.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.h, r.x) for r in out) == [(5, 1.0), (6, 1.0)]


def test_changed_warnings_replace_their_rows(spark, tmp_path):
    """Two batches: a warning that changed, one that no longer covers anything, a new one and an old one."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id long, n long, colhido_em timestamp"

    def arrive(rows):
        spark.createDataFrame([(i, n, pd.Timestamp(t).to_pydatetime()) for i, n, t in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        expand = lambda batch: batch.where("n > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("dia"))
        feeds.run_upsert(stream, out, str(tmp_path / "state"), ["id"], latest="colhido_em", expand=expand)
        return sorted((r.id, r.dia) for r in deltas.stored(spark, out).collect())

    first = [(1, 2, "2024-01-01"), (1, 3, "2024-01-02"), (2, 1, "2024-01-01"), (3, 1, "2024-01-01")]
    assert arrive(first) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    assert arrive([(1, 1, "2024-01-03"), (2, -5, "2024-01-03"), (4, 2, "2024-01-03")]) == [(1, 1), (3, 1), (4, 1), (4, 2)]


def test_a_late_row_joins_two_episodes(spark, tmp_path):
    """Batches of (minute, label): 0 and 60 are one episode, 200 another until 130 arrives."""
    source, out, schema = tmp_path / "in", tmp_path / "out", "station long, ts timestamp, y int"

    def batch(*rows):
        frame = spark.createDataFrame([(1, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime(), y) for m, y in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(source))
        stream = feeds.episode_stream(spark.readStream.schema(schema).parquet(str(source)), "y", delay="3 hours")
        feeds.run_to_parquet(stream, str(out), str(tmp_path / "c"))
        start = pd.Timestamp("2024-01-01")
        return sorted(((r.inicio - start).seconds // 60, (r.fim - start).seconds // 60, r.linhas) for r in spark.read.parquet(str(out)).collect())

    assert batch((0, 1), (60, 1), (200, 1), (90, 0)) == []
    assert batch((130, 1), (500, 1)) == [(0, 200, 4)]
    assert batch((1000, 0)) == [(0, 200, 4), (500, 500, 1)]


def test_losses_are_counted_beside_the_result(spark, tmp_path):
    from pluvia.operators import cleaning

    rows = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, id) as ts", "if(id % 7 = 0, null, id % 20) as x")
    drops = {"sem_hora": F.col("ts").isNull(), "par": F.col("id") % 4 == 0}
    nulls = {"x": F.when(F.col("x") < 15, F.col("x"))}
    kept, losses = cleaning.counted_losses(rows, drops, nulls)
    assert kept.columns == rows.columns
    got = [tuple(r) for r in kept.collect()]
    want = [i for i in range(1000) if i % 10 and i % 4]
    assert sorted(i for i, *_ in got) == want and all(x is None or x < 15 for *_, x in got)
    nulled = sum(i % 7 != 0 and i % 20 >= 15 for i in want)
    assert losses.get == {"linhas": 1000, "mantidas": len(want), "sem_hora": 100, "par": 200, "x_anulados": nulled}
    rows.write.parquet(str(tmp_path / "in"))
    stream, name = cleaning.counted_losses(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), drops, nulls)
    query = feeds.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert query.recentProgress[0].observedMetrics[name].asDict() == losses.get


def test_search_is_the_same_one_by_one_and_at_once(spark, rng):
    """Folds prepared once and eight fits at a time give the scores of one fit after the other; a failed fit fails all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    n = 400
    pdf = pd.DataFrame({"h": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["alvo"] = 2 * pdf.a - pdf.b + rng.normal(size=n)
    rows = ml.as_features(spark.createDataFrame(pdf), ["a", "b"], ["h", "alvo"])
    limits = spark.createDataFrame([(0, 199, 200, 299), (1, 299, 300, 399)], "fold int, train_to long, test_from long, test_to long")
    candidates = [{"regParam": x} for x in (0.0, 0.5, 50.0)]

    def linear(params):
        return LinearRegression(labelCol="alvo", predictionCol="previsto", **params)

    def error(predictions):
        return predictions.agg(F.avg(F.abs(F.col("alvo") - F.col("previsto"))).alias("valor"))

    stages = ml.vector_stages(["a", "b"])
    single = ml.search(rows, limits, candidates, lambda p: Pipeline(stages=[*stages, linear(p)]), error, maximise=False, concurrent=1)
    together = ml.search(rows, limits, candidates, linear, error, maximise=False, prepare=stages, concurrent=8)
    one, many = single.toPandas(), together.toPandas()
    assert one.candidato.tolist() == many.candidato.tolist() and many.parametros.iloc[-1] == '{"regParam": 50.0}'
    np.testing.assert_allclose(one.media, many.media, rtol=1e-9)
    np.testing.assert_allclose(one.desvio, many.desvio, rtol=1e-6, atol=1e-9)
    with pytest.raises(Exception):
        ml.search(rows, limits, [{"regParam": -1.0}], linear, error, maximise=False, prepare=stages)


def test_rows_of_a_fit_are_dealt_to_all_cores_and_read_once(spark, tmp_path):
    """The vectors of a fit are few bytes; tasks sized by bytes left all rows to one core. Weather follows from the same rows."""
    from pyspark.sql import types as T

    from pluvia.plans import catalog_models as C
    from pluvia.plans import views as V

    n, start = 60, 473600
    rows = [(s * 1000 + i, (start + i) * 3600, s * 38, float(i % 9)) for s in (0, 1, 2) for i in range(n)]
    rows += [(9000 + i, (start + i) * 3600, None, 1.0) for i in range(n)] + [(9100, None, 0, 1.0), (9101, start * 3600, 0, None)]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(("event_id", "s", "user_id", "value"), (T.LongType(), T.LongType(), T.LongType(), T.DoubleType()))])
    events = spark.createDataFrame(rows, schema).select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = C.training_rows(spark, str(tmp_path))
    assert len(got.inputFiles()) == len(V.obs(spark, str(tmp_path)).inputFiles())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    wide = V.weather(spark, str(tmp_path)).select("station", "h", "umidade", "vento")
    want = V.scored(spark, str(tmp_path)).join(wide, ["station", "h"]).select("station", "h", "umidade", "vento", "y")
    pick = got.select("station", "h", "umidade", "vento", F.col("evento_extremo").alias("y"))
    assert pick.count() == 3 * (n - 24) and pick.exceptAll(want).isEmpty() and want.exceptAll(pick).isEmpty()
    shares = C.parts(spark, str(tmp_path))[0].rdd.glom().map(len).collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(shares) == cores and max(shares) <= sum(shares) / cores + cores


def test_fits_of_a_search_share_the_cores(spark, rng):
    """Folds are dealt over so many tasks that all fits of a time have two for each core, however the rows were stored."""
    from pyspark.ml import Estimator
    from pyspark.ml.feature import SQLTransformer

    seen = []

    class Count(Estimator):
        def _fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return SQLTransformer(statement="select * from __THIS__")

    rows = ml.as_features(spark.range(400).select(F.col("id").alias("h"), F.rand(1).alias("a")), ["a"], ["h"]).coalesce(1)
    limits = spark.createDataFrame([(0, 199, 200, 299), (1, 299, 300, 399)], "fold int, train_to long, test_from long, test_to long")
    out = ml.search(rows, limits, [{"p": 1}, {"p": 2}], lambda p: Count(), lambda df: df.agg(F.count("features").cast("double").alias("valor")),
                    prepare=ml.vector_stages(["a"]), concurrent=4, maximise=True)
    assert [r.media for r in out.collect()] == [100.0, 100.0]
    assert seen == [max(2, -(-2 * spark.sparkContext.defaultParallelism // 4))] * 4


def test_both_models_are_fitted_at_the_same_time(spark, rng, tmp_path, monkeypatch):
    """Each fit waits for the other; one after the other, the first would wait in vain."""
    import threading

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    both = threading.Barrier(2, timeout=120)
    for kind in (GBTClassifier, GBTRegressor):
        def fit(self, df, old=kind._fit):
            both.wait()
            return old(self, df)

        monkeypatch.setattr(kind, "_fit", fit)
    n = 300
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"station": 1, "h": np.arange(n), "a": x, "chuva_futura_24h": np.maximum(0, 10 * x), "evento_extremo": (x > 0.7).astype(int)})
    pdf["janela"] = np.where(pdf.h < 150, "treino", np.where(pdf.h < 220, "validacao", "teste"))
    ml.train(spark.createDataFrame(pdf), ["a"], str(tmp_path), trees=2)
    assert ml.load_metadata(str(tmp_path), spark)["feature_columns"] == ["a"]
    with pytest.raises(ZeroDivisionError):
        ml.at_once(spark, [lambda: 1, lambda: 1 / 0])


def test_report_stream_keeps_a_warning_once_a_day(spark, tmp_path):
    """Warnings meet reports at every hour of their validity, with one row of state for each day and place."""
    square = '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,9],[0,0]]]}'
    hours = [(1, 0, 50), (2, 23, 24), (3, 30, 70)]
    at = "timestamp_seconds(946684800 + {} * 3600)".format
    spark.createDataFrame([(i, 7, a, b, square) for i, a, b in hours], "id long, id_severidade int, a int, b int, poligono string").selectExpr(
        "id", "id_severidade", f"{at('a')} as inicio", f"{at('b')} as fim", "poligono").write.parquet(f"{tmp_path}/w")
    spark.range(0, 160).selectExpr("id as report_id", "id % 2 as station", f"{at('(id div 2)')} as ts").write.parquet(f"{tmp_path}/r")
    places = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0)], "station long, lat double, lon double")
    frames = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in "rw"]
    query = feeds.run_to_parquet(feeds.reports_with_warnings(*frames, places), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.report_id, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((k, i) for k in range(160) for i, a, b in hours if a <= k // 2 <= b)
    kept = max(x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"])
    assert kept <= 160 + 2 * (3 + 2 + 2)


def test_warnings_that_come_together_share_state(spark, tmp_path, monkeypatch):
    """Sixty warnings of a place and block are few rows of state; they meet reports of their batch, earlier and later ones."""
    square = '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,9],[0,0]]]}'
    at = "timestamp_seconds(946684800 + {} * 3600)".format
    hours = [(i, i % 30, i % 30 + 5 + i % 7) for i in range(60)] + [(60, 200, 500), (61, 20, None), (62, 30, 20)]
    rows = [(i, None if i % 9 == 0 else 7, a, b, square) for i, a, b in hours]
    for part in range(2):
        spark.createDataFrame(rows, "id long, id_severidade int, a int, b int, poligono string").where(f"id % 2 = {part}").selectExpr(
            "id", "id_severidade", f"{at('a')} as inicio", f"{at('b')} as fim", "poligono").coalesce(1).write.mode("append").parquet(f"{tmp_path}/w")
        spark.range(part * 40, part * 40 + 40, 1, 1).selectExpr("id as report_id", "id % 2 as station", f"{at('id')} as ts").write.mode("append").parquet(f"{tmp_path}/r")
    places = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0), (None, 3.0, 3.0)], "station long, lat double, lon double")
    want = sorted((k, k % 2, i, i % 9 == 0) for k in range(80) for i, a, b in hours if b is not None and a <= k <= b)

    def run(name, **more):
        frames = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}") for x in "rw"]
        query = feeds.run_to_parquet(feeds.reports_with_warnings(*frames, places, delay="40 days"), f"{tmp_path}/{name}", f"{tmp_path}/c{name}", **more)
        got = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert sorted((r.report_id, r.station, r.id, r.id_severidade is None) for r in got) == want
        return max(x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"])

    assert run("memory") <= 80 + 2 * (1 + 1 + 3)
    monkeypatch.setattr(feeds, "LOOK_THROUGH", 7)
    monkeypatch.setattr(feeds, "SHARED", 3)
    run("disk", state=feeds.ROCKSDB_JOIN)
    assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion", "2") == "2"


def test_scores_after_an_observed_metric(spark, rng):
    """A session that has observed a metric cannot be sent to tasks; a fitted model must not carry it there."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5
    rows = spark.createDataFrame(pd.DataFrame({"h": np.arange(60), "x": rng.normal(size=60), "y": np.arange(60) % 2}))
    model = ml.combiner(["x"], 60, label="y").fit(rows)
    assert ml.scored_by(model, rows, ["h"]).repartition(2).agg(F.count("score")).first()[0] == 60
