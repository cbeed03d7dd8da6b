"""Expansion test against the source's one published regional report:
its month x year counts (and per-year sex marginals) are expanded into raw
registry rows, the regional report is recomputed, and its month, year, sex
and rate sections must equal the published values."""

from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.operators import reports as R
from regstat.sources.population import read_population
from regstat.sources.registry import REGISTRY_COLUMNS

# The published report (one department, 2022-2025).
POR_MES = {
    2022: (38, 31, 45, 32, 36, 33, 28, 32, 59, 37, 22, 24),
    2023: (37, 34, 38, 31, 33, 36, 39, 40, 35, 51, 32, 29),
    2024: (40, 33, 40, 46, 33, 30, 33, 29, 38, 47, 40, 24),
    2025: (42, 24, 30, 37, 35, 40, 27, 34, 38, 50, 45),
}
FEMENINO = {2022: 261, 2023: 276, 2024: 279, 2025: 265}
POBLACION = {2022: (670579, 344027, 326552), 2023: (670377, 344301, 326076),
             2024: (669737, 344337, 325400), 2025: (669020, 344337, 324683)}
TASA = {2022: 62.19, 2023: 64.89, 2024: 64.65, 2025: 60.09}
CASOS = {2022: 417, 2023: 435, 2024: 433, 2025: 402}


def _raw(spark):
    rows, i = [], 0
    for y, months in POR_MES.items():
        k = 0
        for m, n in enumerate(months, start=1):
            for _ in range(n):
                sexo = "FEMENINO" if k < FEMENINO[y] else "MASCULINO"
                rec = {"UUID": f"u{i}", "HISTORIA": str(i), "FEC_FILIACION": f"{y}{m:02d}15",
                       "SEXO": sexo, "EDAD": "50", "LUGAR_RESIDENCIA": " AYACUCHO-HUAMANGA-AYACUCHO",
                       "CANT_ATENCIONES_CEX": ""}
                rows.append(tuple(rec.get(c, "") for c in REGISTRY_COLUMNS))
                i += 1
                k += 1
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REGISTRY_COLUMNS))


def _population(spark):
    def cells(y):
        t = POBLACION.get(y, (0, 0, 0))
        return [str(v) for v in t]
    schema = ", ".join(f"c{i} string" for i in range(11))
    s1 = spark.createDataFrame([("050000", "Ayacucho", *cells(2021), *cells(2022), *cells(2023))], schema)
    s2 = spark.createDataFrame([("050000", "Ayacucho", *cells(2024), *cells(2025), *cells(2026))], schema)
    return read_population({"2021-2023": (s1, (2021, 2022, 2023)), "2024-2026": (s2, (2024, 2025, 2026))},
                           cfg.SOURCE)


def test_regional_report_reproduces_published_values(spark):
    gaz = spark.createDataFrame([(n, i) for i, n in enumerate(cfg.DEPARTMENTS)], "nombre string, orden int")
    rep = R.reporte_regional(_raw(spark), gaz, _population(spark), cfg.SOURCE) \
        .where(F.col("departamento") == "AYACUCHO").collect()
    get = {(r["seccion"], r["anio"], r["clave"]): r["valor"] for r in rep}
    for y, months in POR_MES.items():
        for m, n in enumerate(months, start=1):
            assert get[("por_mes", str(y), str(m))] == n
        assert get[("por_anio", str(y), "casos")] == CASOS[y] == sum(months)
        assert get[("por_anio", str(y), "poblacion")] == POBLACION[y][0]
        assert get[("por_anio", str(y), "tasa_por_100k")] == TASA[y]
        assert get[("por_anio", str(y), "completo")] == (0.0 if y == 2025 else 1.0)
        assert get[("por_sexo", str(y), "FEMENINO")] == FEMENINO[y]
        assert get[("poblacion_inei", str(y), "hombres")] == POBLACION[y][1]
        # no visit values -> zeros, as in the source
        assert get[("atenciones", str(y), "mediana")] == 0.0
    assert get[("por_sexo", "total", "FEMENINO")] == 1081
    assert get[("por_sexo", "total", "MASCULINO")] == 606
    assert sum(v for (s, a, _), v in get.items() if s == "por_provincia" and a == "total") == 1687
    # places without rows still get their zero-filled frame
    other = R.reporte_regional(_raw(spark), gaz, _population(spark), cfg.SOURCE) \
        .where((F.col("departamento") == "LIMA") & (F.col("seccion") == "por_anio")
               & (F.col("clave") == "casos")).collect()
    assert len(other) == 4 and all(r["valor"] == 0.0 for r in other)
