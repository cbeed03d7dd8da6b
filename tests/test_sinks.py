"""Sink round trips: star reload (K1), report document (K2 + S3), chunk
table with vectors (K3 + S4)."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.operators import publish as PUB
from regstat.operators import reports as R
from regstat.operators import vectors as V
from regstat.operators import warehouse as WH
from regstat.plans import catalog as K
from regstat.sources import registry as RG
from regstat.sources import standard as S
from tests.conftest import SF_SMALL


def test_star_reload_round_trip(spark, scratch_dir):
    star = K._star(spark, SF_SMALL)
    out = os.path.join(scratch_dir, "estrella")
    one, two = PUB.guardar_estrella(star, out), PUB.guardar_estrella(star, out)
    assert set(one["anios"].values()) != set(two["anios"].values())  # every load goes to folders of its own
    a, b = PUB.tablas_de(spark, out, one), PUB.tablas_de(spark, out, two)
    for name, df in star.items():
        assert a[name].count() == df.count()
    assert "1995" in one["anios"]
    # idempotent ids: both loads hold the same fact rows
    a, b = (x["fact_casos"].select("tiempo_id", "geografia_id", "paciente_id") for x in (a, b))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_report_document_and_reader(spark, scratch_dir):
    long = R.reporte_regional(K._raw(spark, SF_SMALL), S.gazetteer_regiones(spark, SF_SMALL),
                              K._pob(spark, SF_SMALL), cfg.STANDIN)
    doc = R.reporte_documentos(long).where("departamento = 'AFRICA'").collect()[0]
    casos = {y: m["casos"] for y, m in doc["por_año"].items()}
    assert sum(casos.values()) == sum(
        r["valor"] for r in long.where((F.col("departamento") == "AFRICA") & (F.col("seccion") == "por_anio")
                                       & (F.col("clave") == "casos")).collect())
    assert set(doc["por_sexo"]["total"]) == set(cfg.SEXES)
    # S3: read a document in the source's shape (values of the published report)
    path = os.path.join(scratch_dir, "reporte.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump({"meta": {"departamento": "AYACUCHO"},
                   "por_año": {"2022": {"casos": 417, "poblacion": 670579, "tasa_por_100k": 62.19, "completo": True}},
                   "atenciones_cex": {"promedio_total": 11.54,
                                      "por_año": {"2022": {"promedio": 14.28, "mediana": 7, "max": 175}}}},
                  fh, ensure_ascii=False, indent=2)
    r = RG.read_report(spark, path).collect()[0]
    assert r["por_año"]["2022"]["tasa_por_100k"] == 62.19
    assert r["atenciones_cex"]["por_año"]["2022"]["max"] == 175


def test_chunk_table_round_trip_and_blob(spark, scratch_dir):
    fact, pob = K._fact(spark, SF_SMALL), K._pob(spark, SF_SMALL)
    from regstat.operators import chunks as X
    emb = V.embed(X.chunks_todos(fact, pob, cfg.STANDIN), "content", 16)
    path = os.path.join(scratch_dir, "chunks")
    RG.guardar_chunks(emb, path)
    back = RG.scan_chunks(spark.read.parquet(path))
    assert back.count() == emb.count()
    assert back.where(F.col("chunk_type") == cfg.CHUNK_DEPTO_ANIO).where(F.col("meta_anio").isNull()).count() == 0
    vec = np.array([0.5, -1.25, 3.0], dtype="<f4")
    blobs = spark.createDataFrame([(bytearray(vec.tobytes()),), (None,)], "b binary")
    got = [r[0] for r in blobs.select(RG.decodificar_blob("b")).collect()]
    assert list(got[0]) == [0.5, -1.25, 3.0] and got[1] is None


def test_star_matches_declared_schemas(spark):
    star = K._star(spark, SF_SMALL)
    sch = WH.esquemas()
    for name, df in star.items():
        assert WH.conforme(df, sch[name]), (name, df.schema.simpleString())


def test_point_lookup_of_region_code(spark):
    from regstat.sources.population import population_for_code
    sheets = S.hojas_poblacion(spark, SF_SMALL, cfg.STANDIN)
    rows = {r["anio"]: r["total"] for r in population_for_code(sheets, "010000").collect()}
    assert len(rows) == 12 and all(v > 0 for v in rows.values())
    long = {r["anio"]: r["total"] for r in K._pob(spark, SF_SMALL)
            .where(F.col("departamento") == "AFRICA").collect()}
    assert all(rows[y] == long[y] for y in long)


def test_report_documents_round_trip_through_reader(spark, scratch_dir):
    long = R.reporte_regional(K._raw(spark, SF_SMALL), S.gazetteer_regiones(spark, SF_SMALL),
                              K._pob(spark, SF_SMALL), cfg.STANDIN)
    docs = R.reporte_documentos(long)
    assert docs.count() == 5
    path = os.path.join(scratch_dir, "reportes")
    R.guardar_reportes(docs, path)
    back = RG.read_report(spark, os.path.join(path, "departamento=AFRICA")).collect()[0]
    rows = {(r["seccion"], r["anio"], r["clave"]): r["valor"]
            for r in long.where(F.col("departamento") == "AFRICA").collect()}
    for y in cfg.STANDIN.report_years:
        yy = str(y)
        entry = back["por_año"][yy]
        assert entry["casos"] == rows[("por_anio", yy, "casos")]
        assert entry["tasa_por_100k"] == rows[("por_anio", yy, "tasa_por_100k")]
        assert entry["completo"] == (y != cfg.STANDIN.partial_year)
        assert back["atenciones_cex"]["por_año"][yy]["mediana"] == rows[("atenciones", yy, "mediana")]
        assert back["poblacion_inei"][yy]["total"] == rows[("poblacion_inei", yy, "total")]
    assert back["atenciones_cex"]["promedio_total"] == rows[("atenciones", "total", "promedio_total")]
    assert back["por_sexo"]["total"]["FEMENINO"] == rows[("por_sexo", "total", "FEMENINO")]
    assert int(back["meta"]["total_casos"]) == sum(v for (s, a, k), v in rows.items()
                                                    if s == "por_anio" and k == "casos")


def test_published_version_is_the_last_one(spark, scratch_dir):
    out = os.path.join(scratch_dir, "estrella")
    assert PUB.abrir_estrella(spark, out) is None
    star = K._star(spark, SF_SMALL)
    PUB.publicar_estrella(spark, star, out)
    PUB.publicar_estrella(spark, {**star, "fact_casos": star["fact_casos"].where("anio = 1996")}, out)
    PUB.guardar_estrella(star, out)  # written but never published
    now = PUB.abrir_estrella(spark, out)
    assert [r["anio"] for r in now["fact_casos"].select("anio").distinct().collect()] == [1996]
    assert set(now) == set(WH.TABLAS)


def test_integrity_finds_planted_faults(spark):
    star = dict(K._star(spark, SF_SMALL))
    fact = star["fact_casos"]
    one = fact.limit(1)
    star["fact_casos"] = (fact.unionByName(one.withColumn("tiempo_id", F.lit(5).cast("bigint")))
                          .unionByName(one.withColumn("paciente_id", F.lit(None).cast("bigint")))
                          .unionByName(one.withColumn("uuid_hash", F.lit(None).cast("string"))))
    dim = star["dim_geografia"]
    star["dim_geografia"] = dim.unionByName(dim.limit(1).withColumn("distrito", F.lit("OTRO")))
    got = {(r["chequeo"], r["detalle"]): r["n"] for r in WH.integridad_referencial(star).collect()
           if r["chequeo"] != "sin_poblacion" and r["n"]}
    assert got == {("fk_huerfana", "tiempo_id"): 1, ("nulo", "paciente_id"): 1, ("nulo", "uuid_hash"): 1,
                   ("colision_id", "geografia_id"): 1}


def test_report_reader_keeps_age_bands(spark, scratch_dir):
    path = os.path.join(scratch_dir, "reporte.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump({"meta": {"departamento": "AYACUCHO", "año_parcial": 2025},
                   "por_grupo_etario": {"grupos": ["0-9", "10-19"], "2022": {"0-9": 4}, "total": {"0-9": 4, "10-19": 1}}},
                  fh, ensure_ascii=False, indent=2)
    r = RG.read_report(spark, path).collect()[0]
    assert r["grupos"] == ["0-9", "10-19"] and r["meta"]["año_parcial"] == "2025"
    assert r["por_grupo_etario"] == {"2022": {"0-9": 4}, "total": {"0-9": 4, "10-19": 1}}


def test_place_match_equals_contains(spark):
    from regstat.operators import clean as CL
    places = ["LIMA-LIMA", "significa", "x", "", None, "ica", "LIMA-LIMA", "AB", "zzab"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "i int, lugar_crudo string")
    names = ["LIMA", "ICA", "AB", "X", "LORETO"]
    gaz = spark.createDataFrame([(n,) for n in names], "nombre string")
    got = sorted((r["i"], r["departamento"]) for r in CL.asignar_regiones(rows, gaz).collect())
    assert got == sorted((i, n) for i, p in enumerate(places) if p is not None for n in names if n in p.upper())
