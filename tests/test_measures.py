"""Measures, rates, trend, rankings: golden values and edge fixtures."""

import pytest
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.operators import chunks as X
from regstat.operators import measures as M
from regstat.operators import ranking as W
from regstat.operators import trend as T
from regstat.sources.population import read_population

FACT_SCHEMA = ("departamento string, provincia string, distrito string, anio int, mes int, "
               "sexo string, edad int, grupo_etario string, cant_atenciones int")

# Fixed values from the source's one published output (regional report):
# year -> (cases, population, rate).
GOLDEN = {2022: (417, 670579, 62.19), 2023: (435, 670377, 64.89),
          2024: (433, 669737, 64.65), 2025: (402, 669020, 60.09)}


def expand(spark, counts, region="AYACUCHO"):
    """Fact rows from (year, month) -> cases marginals."""
    rows = []
    for (y, m), n in counts.items():
        rows += [(region, "HUAMANGA", "", y, m, "FEMENINO", 40, "31-40", None)] * n
    return spark.createDataFrame(rows, FACT_SCHEMA)


def golden_fact_pop(spark):
    fact = expand(spark, {(y, 1): v[0] for y, v in GOLDEN.items()})
    pob = spark.createDataFrame([("AYACUCHO", y, v[1], v[1] // 2, v[1] - v[1] // 2) for y, v in GOLDEN.items()],
                                "departamento string, anio int, total long, hombres long, mujeres long")
    return fact, pob


def test_golden_rates(spark):
    fact, pob = golden_fact_pop(spark)
    got = {r["anio"]: (r["casos"], r["poblacion"], r["tasa"])
           for r in M.tasa_incidencia(fact, pob).collect()}
    assert got == GOLDEN


def test_golden_trend(spark):
    fact, pob = golden_fact_pop(spark)
    r = T.tendencia_regresion(fact, pob).collect()[0]
    assert r["pendiente"] == -0.65
    assert r["intercepto"] == 1386.32
    assert r["r_cuadrado"] == 0.139
    assert r["desviacion"] == 1.96
    assert r["media_tasa"] == 62.96
    assert T.tendencia_clase(fact, pob).collect()[0]["tendencia"] == "decreciente"


def test_trend_edges(spark):
    pob_rows, fact_counts = [], {}
    # one usable year -> null fit; constant rates -> slope 0, R^2 null, stable
    for y in (2022, 2023, 2024):
        fact_counts[(y, 1)] = 5
        pob_rows.append(("CONST", y, 100000, 50000, 50000))
    pob_rows.append(("ONE", 2022, 100000, 50000, 50000))
    fact = expand(spark, fact_counts, "CONST").unionByName(
        expand(spark, {(2022, 1): 3, (2023, 1): 4}, "ONE"))
    pob = spark.createDataFrame(pob_rows, "departamento string, anio int, total long, hombres long, mujeres long")
    res = {r["departamento"]: r for r in T.tendencia_regresion(fact, pob).collect()}
    assert res["ONE"]["pendiente"] is None and res["ONE"]["n_puntos"] == 1
    assert res["CONST"]["pendiente"] == 0.0 and res["CONST"]["r_cuadrado"] is None
    cls = {r["departamento"]: r["tendencia"] for r in T.tendencia_clase(fact, pob).collect()}
    assert cls == {"CONST": "estable", "ONE": None}
    proj = T.tendencia_proyeccion(fact, pob).where(F.col("departamento") == "CONST").collect()
    assert {r["tasa_proyectada"] for r in proj} == {5.0}


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(1.005,), (-2.5,), (2.5,), (0.125,)], "x double")
    got = df.select(C.round_half_up("x", 0).alias("a"), C.round_half_up("x", 2).alias("b")).collect()
    assert [r["a"] for r in got] == [1, -2, 3, 0]
    assert got[3]["b"] == 0.13


def test_visits_stats(spark):
    rows = [("R", "P", "", 2022, 1, "FEMENINO", 30, "21-30", v) for v in (1, 2, 10, 20, None)]
    fact = spark.createDataFrame(rows, FACT_SCHEMA)
    r = M.atenciones(fact).collect()[0]
    assert (r["promedio"], r["mediana"], r["maximo"]) == (8.25, 6.0, 20)


def test_population_sheets(spark):
    rows = [("050000", " Ayacucho ", "100", "40", "60", "0", "0", "0", "x", "1", "1"),
            ("000000", "PERU", "9", "9", "9", "9", "9", "9", "9", "9", "9"),
            ("050100", "HUAMANGA", "9", "9", "9", "9", "9", "9", "9", "9", "9")]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(11)))
    out = read_population({"2021-2023": (df, (2021, 2022, 2023))}, cfg.SOURCE).collect()
    # 2021 outside the range, 2023 total not a number -> 0 -> dropped, 2022 kept
    assert [(r["departamento"], r["anio"], r["total"]) for r in out] == []  # 2022 total is 0
    rows[0] = ("050000", "ayacucho", "100", "40", "60", "250", "100", "150", "x", "1", "1")
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(11)))
    out = read_population({"2021-2023": (df, (2021, 2022, 2023))}, cfg.SOURCE).collect()
    assert [(r["departamento"], r["anio"], r["total"], r["hombres"]) for r in out] == [("AYACUCHO", 2022, 250, 100)]


def test_peak_month_tie_and_chunk_threshold(spark):
    fact = expand(spark, {(2022, 1): 7, (2022, 2): 7, (2023, 1): 1, (2023, 2): 1})
    peak = W.pico_mensual(fact).where(F.col("anio") == 2022).collect()[0]
    assert peak["mes_pico"] == 1
    assert X.chunk_mensual(fact).count() == 0           # 2 months -> no chunk
    fact3 = fact.unionByName(expand(spark, {(2022, 3): 2}))
    rows = X.chunk_mensual(fact3).collect()
    assert len(rows) == 1
    assert "Ene=7, Feb=7, Mar=2" in rows[0]["content"] and "pico se registró en Ene" in rows[0]["content"]


def test_breakdowns_sum_to_total_and_shares_bounded(spark):
    from regstat.plans import catalog as K
    from tests.conftest import SF_SMALL
    fact = K._fact(spark, SF_SMALL)
    total = fact.count()
    for fn in (M.distribucion_sexo, M.provincias):
        assert fn(fact).agg(F.sum("casos")).collect()[0][0] == total
    share = W.participacion(fact).agg(F.min("pct"), F.max("pct")).collect()[0]
    assert 0 <= share[0] <= share[1] <= 100


def test_top5_is_prefix_of_full_ranking(spark):
    from regstat.plans import catalog as K
    from tests.conftest import SF_SMALL
    fact = K._fact(spark, SF_SMALL)
    full = [r["departamento"] for r in M.ordenar_ranking(M.ranking_departamentos(fact)).collect()]
    top = [r["departamento"] for r in W.top_departamentos(fact, 3).orderBy("posicion").collect()]
    assert top == full[:3]


@pytest.mark.parametrize("parts", [1, 7])
def test_partition_independence(spark, parts):
    from regstat.plans import catalog as K
    from tests.conftest import SF_SMALL
    fact = K._fact(spark, SF_SMALL)
    pob = K._pob(spark, SF_SMALL)
    a = sorted(map(tuple, T.tendencia_regresion(fact, pob).collect()))
    b = sorted(map(tuple, T.tendencia_regresion(fact.repartition(parts), pob).collect()))
    assert a == b
