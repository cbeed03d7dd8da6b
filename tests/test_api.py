"""Parameter normalisation, metric selection and the small options."""

import pytest
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.operators import measures as M
from regstat.operators import questions as QA
from regstat.plans import api
from regstat.plans import catalog as K
from tests.conftest import SF_SMALL


def test_normalise():
    assert api.normalizar(" ayacucho ", "2023") == api.Peticion("AYACUCHO", 2023, 2023)
    assert api.normalizar("ALL", "0") == api.Peticion(None, None, cfg.SOURCE.default_trend_year)
    assert api.normalizar(None, "x").anio is None


def test_metric_selection(spark):
    fact, pob = K._fact(spark, SF_SMALL), K._pob(spark, SF_SMALL)
    p = api.normalizar("africa", None, cfg.STANDIN)
    assert {r["departamento"] for r in api.estadistica("tasa", fact, pob, p).collect()} == {"AFRICA"}
    assert api.estadistica("ranking", fact, pob, p).count() == fact.select("departamento").distinct().count()
    with pytest.raises(ValueError):
        api.estadistica("otra", fact, pob, p)
    nat = api.panel(fact, api.normalizar(None, None, cfg.STANDIN), cfg.STANDIN)
    assert {r["seccion"] for r in nat.collect()} == {"total", "ranking"}


def test_approximate_median_option(spark):
    fact = K._fact(spark, SF_SMALL)
    exact = {(r["departamento"], r["anio"]): r["mediana"] for r in M.atenciones(fact).collect()}
    approx = {(r["departamento"], r["anio"]): r["mediana"] for r in M.atenciones(fact, aproximado=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[k] - approx[k]) <= 1.0 for k in exact)


def test_whole_word_place_option(spark):
    qs = spark.createDataFrame([(1, "¿qué significa 2024 para ica?"), (2, "¿qué significa 2024?")],
                               "pregunta_id long, texto string")
    out = {r["pregunta_id"]: r["departamento"] for r in
           QA.detectar_filtros(qs, spark.createDataFrame(
               [(n, i) for i, n in enumerate(cfg.DEPARTMENTS)], "nombre string, orden int"),
               cfg.SOURCE.years, palabra_completa=True).collect()}
    assert out == {1: "ICA", 2: None}


def test_hash_id_option(spark):
    from regstat.operators import clean as CL
    from tests.test_cleaning import raw_rows
    raw = raw_rows(spark, [{"UUID": "0123456789abcdefXYZ"}])
    assert CL.limpiar_nacional(raw).collect()[0]["uuid_hash"] == "0123456789abcdef"
    h = CL.limpiar_nacional(raw, hash_id=True).collect()[0]["uuid_hash"]
    assert len(h) == 64


def test_department_panel_by_request(spark):
    fact = K._fact(spark, SF_SMALL)
    p = api.normalizar("africa", "1999", cfg.STANDIN)
    rows = api.panel(fact, p, cfg.STANDIN).collect()
    assert {r["departamento"] for r in rows} == {"AFRICA"}
    secs = {r["seccion"] for r in rows}
    assert secs == {"por_anio", "sexo", "edad", "provincias", "mensual"}
    # the yearly series ignores the year filter; sex counts are for 1999 only
    por_anio = sum(r["casos"] for r in rows if r["seccion"] == "por_anio")
    sexo = sum(r["casos"] for r in rows if r["seccion"] == "sexo")
    mensual = sum(r["casos"] for r in rows if r["seccion"] == "mensual")
    assert por_anio == fact.where(F.col("departamento") == "AFRICA").count()
    assert sexo == mensual == fact.where((F.col("departamento") == "AFRICA") & (F.col("anio") == 1999)).count()


def test_parameterised_sql_scan_matches_operator(spark):
    fact = K._fact(spark, SF_SMALL)
    a = sorted(map(tuple, api.casos_por_anio_sql(spark, fact, "ASIA").collect()))
    b = sorted(map(tuple, M.casos_por_anio(fact, "ASIA").collect()))
    assert a == b and len(a) == 7
    one = api.casos_por_anio_sql(spark, fact, "ASIA'; DROP TABLE x; --", 1999).collect()
    assert one == []   # a hostile value is data, not SQL
