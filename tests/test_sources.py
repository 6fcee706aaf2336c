"""Files, payloads and stores."""

import pytest
from pyspark.sql import functions as F

from pluvia.functions import text
from pluvia.operators import cleaning, deltas, warnings
from pluvia.sources import gauge_csv, payloads, station_csv, stores

HEAD = "REGI\xc3O:;S\nUF:;RS\nESTA\xc7\xc3O:;PORTO ALEGRE\nCODIGO (WMO):;A801\nLATITUDE:;-30,05\nLONGITUDE:;-51,17\nALTITUDE:;46,97\nDATA DE FUNDA\xc7\xc3O:;22/09/00\n"
OLD = "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITA\xc7\xc3O TOTAL, HOR\xc1RIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (\xb0C);RADIACAO GLOBAL (KJ/m\xb2);\n"
NEW = "Data;Hora UTC;PRECIPITA\xc7\xc3O TOTAL, HOR\xc1RIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (\xb0C);RADIACAO GLOBAL (Kj/m\xb2);\n"


def write(folder, name, content, encoding="latin-1"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))


def test_station_files_of_both_layouts(spark, tmp_path):
    write(tmp_path, "2018/INMET_S_RS_A801_PORTO ALEGRE_01-01-2018.CSV", HEAD + OLD + "2018-01-01;05:00;0,4;25,1;12;\n2018-01-01;06:00;-9999;;,5;\n")
    write(tmp_path, "2021/INMET_S_RS_A802_X_01-01-2021.CSV", HEAD.replace("ESTA\xc7\xc3O", "ESTAC?O") + NEW + "2021/01/01;0700 UTC;12,5;20,0;3,5;\n")
    write(tmp_path, "2021/INMET_S_RS_SEMCODIGO.CSV", HEAD + NEW)
    write(tmp_path, "2021/INMET_S_RS_A803_Y.CSV", HEAD.replace("LATITUDE:;-30,05\n", "") + NEW + "2021/01/01;0700 UTC;1;1;1;\n")
    write(tmp_path, "2021/INMET_S_SC_A804_Z.CSV", HEAD + NEW + "2021/01/01;0700 UTC;1;1;1;\n")
    lines = station_csv.in_states(station_csv.read_lines(spark, str(tmp_path)))
    good, bad = station_csv.station_files(lines)
    rows = {(r.station, r.h): r for r in station_csv.observations(lines, good, ["precipitacao", "temperatura", "radiacao"]).collect()}
    assert len(rows) == 3
    h = 17532 * 24  # 2018-01-01
    first = rows[("A801", h + 5)]
    assert (first.precipitacao, first.temperatura, first.radiacao) == (0.4, 25.1, 12.0)
    assert (first.latitude, first.altitude, first.estacao_nome) == (-30.05, 46.97, "PORTO ALEGRE")
    second = rows[("A801", h + 6)]
    assert second.precipitacao is None and second.temperatura is None and second.radiacao == 0.5
    assert rows[("A802", (18628 * 24) + 7)].precipitacao == 12.5
    reasons = {r.path.rsplit("/", 1)[1]: r.motivo for r in bad.collect()}
    assert reasons == {"INMET_S_RS_SEMCODIGO.CSV": "no station code in the file name", "INMET_S_RS_A803_Y.CSV": "no coordinates in the header"}


def test_gauge_file(spark, tmp_path):
    body = "Nome: X\nCodigo Estacao: A801\nLatitude: -30\nLongitude: -51\nAltitude: 1\nSituacao: ok\nInicio: 2020\nFim: 2021\nPeriodicidade: Diaria\n\nData Medicao;PRECIPITACAO TOTAL, DIARIO (AUT)(mm);\n2020-01-01;3.4;\n2020-01-02;null;\n"
    write(tmp_path, "d.csv", body, "utf-8")
    out = gauge_csv.gauge_days(station_csv.read_lines(spark, str(tmp_path), "UTF-8", "*.csv")).orderBy("dia").collect()
    assert [(r.estacao_codigo, str(r.dia), r.chuva_bdmep) for r in out] == [("A801", "2020-01-01", 3.4), ("A801", "2020-01-02", None)]


@pytest.mark.parametrize("sentence, mm, ms", [
    ("Pancadas de 15 a 25 mm/h; acumulado de 48 mm/dia; rajadas de 45-70 km/h.", 48.0, 45 / 3.6),
    ("Volume entre 33 e 90 mm / dia, com 12 mm/h no pico", 33.0, None),
    ("Total de 5 mm/dia no norte, entre 70,5 a 90 mm/dia no sul", 70.5, None),
    ("de 20 a 45mm/dia", 20.0, None),
    ("(80 mm/dia), vento de 100km/h ou 60 a 90 km/h", 80.0, 100 / 3.6),
    ("mm/dia sem valor, depois 9 mm/dia", 9.0, None),
    ("Chuva de 30 mm/h", None, None),
    ("Chuva de 12,5 mm/dia", 12.5, None),
    (None, None, None),
])
def test_announced_criteria(spark, sentence, mm, ms):
    row = spark.createDataFrame([(sentence,)], "t string").select(
        text.rain_criterion(F.col("t")).alias("mm"), text.gust_criterion(F.col("t")).alias("ms")).first()
    assert row.mm == mm and (row.ms == pytest.approx(ms) if ms else row.ms is None)


def test_payload_shapes(spark):
    docs = [(1, 200, '{"id": 1, "descricao": "Tempestade"}'), (2, 200, '[{"id": 2, "descricao": "X"}]'), (3, 200, '{"hoje": [{"descricao": "Y"}], "futuro": []}'),
            (4, 200, "[]"), (5, 404, None), (6, 200, "{}"), (7, 200, '{"hoje": [], "futuro": [{"descricao": "Z"}]}')]
    out = payloads.normalise_warning_payload(spark.createDataFrame(docs, "id int, http int, payload string")).orderBy("id").collect()
    assert [r.obtido for r in out] == [True, True, True, False, False, False, False]
    assert [r.descricao for r in out[:3]] == ["Tempestade", "X", "Y"]


def test_feed_must_have_its_shape(spark):
    ok = spark.createDataFrame([('{"hoje": [], "futuro": []}',)], "payload string")
    assert payloads.feed_records(ok).count() == 0
    with pytest.raises(Exception, match="unexpected feed"):
        payloads.feed_records(spark.createDataFrame([('{"outro": 1}',)], "payload string")).collect()


def test_unusable_documents_keep_their_reason(spark):
    docs = [(1, '{"hoje": [{"id": "7", "encerrado": true, "id_severidade": 2}, {"id": 8, "riscos": null}]}'), (2, '{"hoje": [{"id": 1}'), (3, None), (4, "   "),
            (5, '{"hoje": {"id": 1}}'), (6, "[1]"), (7, '{"hoje": null}'), (8, '{"hoje": [], "hoje": [{"id": 3}]}'), (9, '{"hoje": [3, {"id": 9}]}')]
    landed = spark.createDataFrame(docs, "n int, payload string")
    reasons = {r.n: r.motivo for r in payloads.feed_rejects(landed).collect()}
    assert reasons == {2: "ilegivel", 3: "sem documento", 4: "sem documento", 5: "sem lista", 6: "sem lista", 7: "sem lista", 8: "ilegivel"}
    rows = payloads.feed_records(landed, strict=False)
    assert sorted((r.id or 0, r.encerrado, r.id_severidade, r.riscos) for r in rows.collect()) == [
        (0, None, None, None), (7, True, 2, None), (8, None, None, None), (9, None, None, None)]
    assert payloads.feed_rejects(landed.limit(0)).count() == 0 and payloads.feed_records(landed.limit(0)).count() == 0


def test_attempts_keep_their_reason_and_parse_once(spark):
    docs = [(1, 200, '{"descricao": 5, "poligono": {"type": "Point"}}'), (2, 200, "[]"), (3, 200, "<html>"), (4, 404, None), (5, 200, "[3]"), (6, 200, '{"hoje": null, "riscos": "r"}')]
    out = payloads.normalise_warning_payload(spark.createDataFrame(docs, "id int, http int, payload string"))
    rows = {r.id: r for r in out.collect()}
    assert {i: r.motivo for i, r in rows.items()} == {1: None, 2: "sem registro", 3: "ilegivel", 4: "sem documento", 5: "sem registro", 6: None}
    assert rows[1].descricao == "5" and rows[1].poligono == '{"type":"Point"}' and rows[6].riscos == "r"
    landed = spark.createDataFrame(docs, "id int, http int, payload string")
    for df in (out.where("obtido"), payloads.feed_records(landed).where("id > 3"), payloads.feed_rejects(landed)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_feed_candidates_reject_incomplete_local_warning(spark):
    square = '{"type":"Polygon","coordinates":[[[-52,-31],[-50,-31],[-50,-29],[-52,-29],[-52,-31]]]}'
    base = dict(id=1, descricao="Tempestade", severidade="Perigo", id_severidade=7, aviso_cor="#f00", data_inicio="2026-01-01", hora_inicio="10:00",
                data_fim="2026-01-02", hora_fim="10:00", riscos="x", instrucoes="y", geocodes="1,2", poligono=square, encerrado=False)
    rows = [base, {**base, "id": 2, "encerrado": True}, {**base, "id": 3, "descricao": "Vendaval"}, {**base, "id": 4, "poligono": "bad"},
            {**base, "id": 5, "riscos": ""}, {**base, "id": 6, "poligono": square.replace("-52", "10").replace("-50", "12")}]
    good, bad = warnings.feed_candidates(spark.createDataFrame(rows), spark.createDataFrame([("A801", -30.05, -51.17)], "station string, lat double, lon double"))
    assert [r.id for r in good.collect()] == [1]
    assert [(r.id, r.faltando) for r in bad.collect()] == [(5, ["riscos"])]


def test_snapshot_days_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "s")
    one = spark.createDataFrame([(1, 10, 1.0)], "station int, dia_emissao int, x double")
    two = spark.createDataFrame([(1, 10, 9.0), (1, 11, 2.0)], "station int, dia_emissao int, x double")
    stores.append_snapshot(spark, one, path)
    stores.append_snapshot(spark, two, path)
    assert {(r.dia_emissao, r.x) for r in spark.read.parquet(path).collect()} == {(10, 1.0), (11, 2.0)}
    stores.append_snapshot(spark, two.where("dia_emissao = 10"), path, force=True)
    assert {(r.dia_emissao, r.x) for r in spark.read.parquet(path).collect()} == {(10, 9.0), (11, 2.0)}
    with pytest.raises(ValueError):
        stores.append_snapshot(spark, one.where("false"), path)


def test_archive_refuses_a_variable_it_lacks(spark, tmp_path):
    path = str(tmp_path / "a")
    stores.write_forecast_archive(spark.createDataFrame([(1, 5, 2.0)], "station int, h long, precipitation double"), path, "m", "w")
    assert stores.read_forecast_archive(spark, path, "m", "w", ["precipitation"]).count() == 1
    with pytest.raises(ValueError, match="cape"):
        stores.read_forecast_archive(spark, path, "m", "w", ["cape"])


def test_failed_sensor_keeps_the_row(spark):
    df = spark.createDataFrame([(12.5, 250.0, -5.0), (8.0, 100.0, 75.0), (-9999.0, 0.0, 0.0)], "precipitacao double, umidade double, vento double")
    out = cleaning.within_ranges(cleaning.null_sentinel(df, df.columns)).collect()
    assert [tuple(r) for r in out] == [(12.5, None, None), (8.0, 100.0, 75.0), (None, 0.0, 0.0)]


def station_file(code, rows):
    head = ["REGIAO:;S", "UF:;RS", "ESTACAO:;LUGAR", f"CODIGO (WMO):;{code}", "LATITUDE:;-30,5", "LONGITUDE:;-51,5", "ALTITUDE:;10",
            "DATA DE FUNDACAO:;01/01/00", "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITAÇÃO TOTAL, HORÁRIO (mm);"]
    return "\n".join(head + rows) + "\n"


def test_lines_of_no_known_form_are_told(spark, tmp_path):
    rows = ["2024-01-01;00:00;1,5;", "01/02/2024;01:00;2,0;", "broken", "", "2024-01-01;xx;2,0;"]
    write(tmp_path, "INMET_S_RS_A801_X.CSV", station_file("A801", rows), "ISO-8859-1")
    lines = station_csv.read_lines(spark, str(tmp_path))
    good, bad = station_csv.station_files(lines)
    out = station_csv.observations(lines, good, ["precipitacao"]).collect()
    assert bad.count() == 0 and len(out) == 4 and sum(r.h is None for r in out) == 3
    assert sorted(r.line for r in station_csv.unreadable_lines(lines).collect()) == ["01/02/2024;01:00;2,0;", "broken"]


def test_stores_keep_other_stations(spark, tmp_path):
    def series(station, hours, x):
        return spark.createDataFrame([(station, h, x, f"/{station}.csv") for h in hours], "station string, h long, x double, path string")

    first, other, changed = series("A801", [473352, 473353, 482136], 1.0), series("A802", [473352], 2.0), series("A801", [473352], 9.0)
    by_year = str(tmp_path / "yearly")
    for batch in (first, other, changed):
        stores.write_by_year(batch, by_year)
    got = {(r.station, r.h): r.x for r in deltas.stored(spark, by_year).collect()}
    assert got == {("A801", 473352): 9.0, ("A801", 482136): 1.0, ("A802", 473352): 2.0}
    silver = str(tmp_path / "silver")
    for batch in (first, other, changed):
        station_csv.write_silver(batch, silver)
    got = {(r.station, r.h): r.x for r in deltas.stored(spark, silver).collect()}
    assert got == {("A801", 473352): 9.0, ("A802", 473352): 2.0}  # the file came again, without its second year


def test_archive_checks_its_own_model(spark, tmp_path):
    rows = spark.createDataFrame([("A801", 1, 1.0, 2.0)], "station string, h long, a double, b double")
    path = str(tmp_path / "archive")
    stores.write_forecast_archive(rows, path, "m1", "2024")
    stores.write_forecast_archive(rows.drop("b"), path, "m2", "2024")
    assert stores.read_forecast_archive(spark, path, "m1", "2024", ["a", "b"]).first().b == 2.0
    for model, window in (("m2", "2024"), ("m3", "2024")):
        with pytest.raises(ValueError, match="not in the archive"):
            stores.read_forecast_archive(spark, path, model, window, ["a", "b"])
