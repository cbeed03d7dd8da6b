"""Loads, publication, reloads, validated writes, file order and row groups."""

import os
import re

import pytest
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.operators import clean as CL
from regstat.operators import measures as M
from regstat.operators import publish as PUB
from regstat.operators import warehouse as WH
from regstat.plans import catalog as K
from regstat.sources import standard as S
from regstat.sources.registry import REGISTRY_COLUMNS, read_registry
from tests.conftest import SF_SMALL

HEADER = ",".join(REGISTRY_COLUMNS)
POB = "departamento string, anio int, total long, hombres long, mujeres long"


def record(i, fecha="20230105", lugar="LIMA-LIMA-X", ubigeo="150101"):
    return f"u{i},{i},{fecha},FEMENINO,40,{ubigeo},{lugar},2,20250801"


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write("\n".join([HEADER, *lines, ""]).encode("latin-1"))


def clean_of(spark, folder):
    return CL.limpiar_nacional(read_registry(spark, folder, header_names=list(REGISTRY_COLUMNS), detalle=True))


def test_first_seen_code_follows_the_files(spark, scratch_dir):
    src = os.path.join(scratch_dir, "in")
    write(src, "a.csv", [record(1, "20221", ubigeo="000000"), record(2, ubigeo="159999"), record(3, ubigeo="150101")])
    write(src, "b.csv", [record(4, ubigeo="100000"), record(5, lugar="ICA-ICA-Y", ubigeo="110202"),
                         record(6, lugar="ICA-ICA-Y", ubigeo="110101")])
    key = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size, parts in (("128m", 1), ("100b", 1), ("64b", 7)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        clean = clean_of(spark, src).repartition(parts)
        geo = WH.dimensiones(clean.where("valido"))["dim_geografia"]
        seen.append(sorted((r["departamento"], r["ubigeo"]) for r in geo.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", key)
    assert seen == [[("ICA", "110202"), ("LIMA", "159999")]] * 3  # the first row is discarded


def test_malformed_records_are_counted(spark, scratch_dir):
    src, out = os.path.join(scratch_dir, "in"), os.path.join(scratch_dir, "estrella")
    write(src, "a.csv", [record(1), record(2) + ",x,y", ",".join(record(3).split(",")[:6]), "", record(4, "2023")])
    rows = {r["HISTORIA"]: r for r in read_registry(spark, src, detalle=True).collect()}
    assert [rows[h]["_corrupto"] is not None for h in ("1", "2", "3", "4")] == [False, True, True, False]
    assert rows["3"]["LUGAR_RESIDENCIA"] is None and rows["2"]["FECHA_CORTE"] == "20250801"
    PUB.cargar(spark, clean_of(spark, src), spark.createDataFrame([("LIMA", 2023, 9, 4, 5)], POB), out)
    got = {r["metrica"]: r["valor"] for r in PUB.auditoria_publicada(spark, out).collect()}
    assert (got["leidos"], got["corruptos"], got["insertados"], got["descartados"], got["fecha_corta"]) == (4, 2, 3, 1, 1)


def test_observed_audit_equals_a_recount(spark):
    clean = CL.limpiar_nacional(K._raw(spark, SF_SMALL), K.P)
    want = {r["metrica"]: r["valor"] for r in WH.auditoria_carga(clean, K._pob(spark, SF_SMALL)).collect()}
    got = {r["metrica"]: r["valor"] for r in PUB.auditoria_publicada(spark, K._raiz(spark, SF_SMALL)).collect()}
    assert {k: got[k] for k in want} == want
    assert got["leidos"] == got["insertados"] + sum(got[m] for m in PUB.MOTIVOS)


def test_a_load_reads_its_source_once(spark, scratch_dir):
    src, out = os.path.join(scratch_dir, "in"), os.path.join(scratch_dir, "estrella")
    write(src, "a.csv", [record(i, "20230105" if i % 4 else "2023") for i in range(40)])
    clean, read = clean_of(spark, src), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    star = PUB.cargar(spark, clean.mapInPandas(counted, clean.schema),
                      spark.createDataFrame([("LIMA", 2023, 9, 4, 5)], POB), out)
    assert read.value == 40
    assert star["fact_casos"].count() == 30 and star["bocetos"].first()["n_valores"] == 30
    assert os.listdir(os.path.join(out, PUB.ETAPA)) == []
    os.makedirs(os.path.join(out, PUB.ETAPA, "carga=c1"))  # as a load that failed leaves it
    assert PUB.limpiar_versiones(spark, out, 3600) == []
    assert PUB.limpiar_versiones(spark, out, 0) == [f"{out}/{PUB.ETAPA}/carga=c1"]


def method_sizes(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]


def test_cleaning_is_short_enough_to_be_compiled(spark):
    """The JVM interprets methods of over 8000 bytes."""
    clean = CL.limpiar_nacional(S.registro_csv(spark, SF_SMALL, detalle=True), K.P)
    sizes = method_sizes(PUB._observada(clean, K.P)[1].where("valido"))
    assert sizes and max(sizes) < 8000


def test_dimension_keys_are_hashed_set_by_set(spark, scratch_dir, monkeypatch):
    src, seen = os.path.join(scratch_dir, "in"), []
    write(src, "a.csv", [record(i, f"2023{i % 12 + 1:02d}05", f"LIMA-LIMA-X{i % 10}") for i in range(120)])
    monkeypatch.setattr(WH, "materializar", lambda df: seen.append(df) or df)
    WH.dimensiones(clean_of(spark, src).where("valido"))
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_registry_text_is_made_after_the_sort(spark):
    plan = S.registro_ordenado(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("rangepartitioning", 1)
    assert "lpad(" in above and "lpad(" not in below


def test_one_of_two_concurrent_loads_wins(spark, scratch_dir):
    out = os.path.join(scratch_dir, "estrella")
    star = K._star(spark, SF_SMALL)
    PUB.publicar_estrella(spark, star, out)
    base = PUB.publicacion(spark, out)["numero"]
    first = PUB.guardar_estrella({**star, "fact_casos": star["fact_casos"].where("anio = 1996")}, out)
    second = PUB.guardar_estrella({**star, "fact_casos": star["fact_casos"].where("anio = 1997")}, out)
    before = PUB.abrir_estrella(spark, out)
    PUB.publicar(spark, out, first, base)
    with pytest.raises(PUB.CargaPerdida):
        PUB.publicar(spark, out, second, base)
    assert [n for n in os.listdir(os.path.join(out, "publicaciones")) if n.endswith(".json")] \
        and PUB.publicaciones(spark, out) == [1, 2]
    # a reader of the old version still reads all of it
    assert before["fact_casos"].count() == star["fact_casos"].count()
    assert {r["anio"] for r in PUB.abrir_estrella(spark, out)["fact_casos"].select("anio").collect()} == {1996}


def test_reload_of_single_years_and_cleaning(spark, scratch_dir):
    out = os.path.join(scratch_dir, "estrella")
    pob = spark.createDataFrame([("LIMA", 2023, 9, 4, 5)], POB)
    one, two, three = (os.path.join(scratch_dir, n) for n in ("one", "two", "three"))
    write(one, "a.csv", [record(1, "20220101"), record(2, "20230101"), record(3, "20230201"), record(4, "20240101")])
    write(two, "a.csv", [record(9, "20230301", "ICA-ICA-Z", "110101"), record(8, "20240301"),
                         record(7, "20230401", ubigeo="999999")])
    PUB.cargar(spark, clean_of(spark, one), pob, out)
    old = PUB.abrir_estrella(spark, out)
    new = PUB.cargar(spark, clean_of(spark, two), pob, out, anios=[2023])
    fact = WH.vista_analitica(new)
    assert sorted((r["anio"], r["departamento"], r["mes"]) for r in fact.collect()) == [
        (2022, "LIMA", 1), (2023, "ICA", 3), (2023, "LIMA", 4), (2024, "LIMA", 1)]
    assert {(r["departamento"], r["ubigeo"]) for r in new["dim_geografia"].collect()} == {
        ("LIMA", "150101"), ("ICA", "110101")}
    got = {r["metrica"]: r["valor"] for r in PUB.auditoria_publicada(spark, out).collect()}
    assert got["insertados"] == 4 and got["leidos"] == 4
    assert old["fact_casos"].count() == 4  # the version before is whole
    write(three, "a.csv", [record(5, "20210101")])
    empty = PUB.cargar(spark, clean_of(spark, three), pob, out, anios=[2022, 2023])
    assert [r["anio"] for r in empty["fact_casos"].collect()] == [2024]
    assert PUB.limpiar_versiones(spark, out, 3600) == []
    gone = PUB.limpiar_versiones(spark, out, 0)
    assert gone and PUB.publicaciones(spark, out) == [3]
    assert [r["anio"] for r in PUB.abrir_estrella(spark, out)["fact_casos"].collect()] == [2024]
    with pytest.raises(ValueError):
        PUB.cargar(spark, clean_of(spark, two), pob, os.path.join(scratch_dir, "none"), anios=[2023])


def test_validated_write_splits_the_rows(spark, scratch_dir):
    schema = PUB.T.StructType([PUB.T.StructField("a", PUB.T.StringType(), False),
                               PUB.T.StructField("b", PUB.T.IntegerType()), PUB.T.StructField("d", PUB.T.DateType())])
    rows = [("x", "1", "2020-01-02", None), (None, "2", None, None), ("y", "two", "nope", None), ("z", None, None, "z,,"),
            ("w", " 7 ", "2021-02-03", None)]
    df = spark.createDataFrame(rows, "a string, b string, d string, _corrupto string")
    path = os.path.join(scratch_dir, "v")
    PUB.escribir_validado(df, schema, path)
    good, bad = PUB.leer_validado(spark, schema, path)
    assert sorted((r["a"], r["b"], str(r["d"])) for r in good.collect()) == [("w", 7, "2021-02-03"), ("x", 1, "2020-01-02")]
    assert good.schema.names == schema.names and [f.dataType for f in good.schema] == [f.dataType for f in schema]
    assert sorted(tuple(r["motivos"]) for r in bad.collect()) == [("corrupto",), ("nulo:a",), ("tipo:b", "tipo:d")]
    got = {(r["estado"], r["motivo"]): r["n"] for r in PUB.conteo_validado(good, bad).collect()}
    assert got == {("aceptada", ""): 2, ("rechazada", ""): 3, ("rechazada", "corrupto"): 1, ("rechazada", "nulo:a"): 1,
                   ("rechazada", "tipo:b"): 1, ("rechazada", "tipo:d"): 1}
    clean_path = os.path.join(scratch_dir, "w")
    PUB.escribir_validado(df.limit(1), schema, clean_path)
    good, bad = PUB.leer_validado(spark, schema, clean_path)
    assert good.count() == 1 and bad.count() == 0


def test_region_filter_reaches_the_fact_scan(spark):
    df = M.casos_por_anio(K._fact(spark, SF_SMALL), "EUROPE", 1997)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region_id" in plan and "PartitionFilters" in plan
    paths = K._star(spark, SF_SMALL)["fact_casos"].where("anio = 1997").inputFiles()
    for p in paths:  # inside a file the regions' rows stand together
        ids = [r[0] for r in spark.read.parquet(p).select("region_id").collect()]
        assert ids == sorted(ids)


def test_chunks_read_the_fact_once(spark):
    chunks = K.Q["chunks_todos"](spark, SF_SMALL)  # the cube is built by now
    assert not [f for f in chunks.inputFiles() if "/fact_casos/" in f]


def test_fixture_is_in_record_order(spark):
    rows = (S.registro_csv(spark, SF_SMALL, detalle=True).select("_orden", F.col("HISTORIA").cast("long").alias("h"))
            .orderBy("_orden").collect())
    assert [r["h"] for r in rows] == sorted(r["h"] for r in rows)
    assert cfg.STANDIN is K.P


def test_sketches_merge_upwards(spark):
    rows = [("LIMA", y, "P", f"D{i % 60}", i % 997) for y in (2022, 2023) for i in range(6000)]
    rows += [("ICA", 2023, "P", "D", 5), ("ICA", 2023, "P", "D", None), ("PUNO", 2022, "P", "D", None)]
    valid = spark.createDataFrame(rows, "departamento string, anio int, provincia string, distrito string, "
                                        "cant_atenciones int")
    sketches = WH.bocetos(valid.repartition(5))
    got = {r["departamento"]: r for r in M.atenciones_bocetos(sketches, "departamento").collect()}
    values = sorted(r[4] for r in rows if r[0] == "LIMA")
    place = values.index(got["LIMA"]["mediana"]) / len(values)
    assert abs(place - 0.5) <= cfg.SKETCH_RANK_ERROR and got["LIMA"]["n_valores"] == 12_000
    assert abs(got["LIMA"]["geografias"] - 60) <= 60 * cfg.SKETCH_DISTINCT_ERROR
    assert (got["ICA"]["n_valores"], got["ICA"]["mediana"], got["PUNO"]["mediana"]) == (1, 5, None)
    whole = M.atenciones_bocetos(sketches).collect()[0]
    assert whole["n_valores"] == 12_001
    assert M.atenciones_bocetos(sketches, "departamento", "anio").count() == 4


RETRY = '''
import sys
from pyspark import TaskContext
from regstat.operators import clean as CL, publish as PUB
from regstat.session import get_session
from regstat.sources.registry import REGISTRY_COLUMNS
spark = get_session("local[2,4]", 2, extra={"spark.checkpoint.dir": sys.argv[1] + "/ckpt"})
rows = [tuple(f"u{i}" if c == "UUID" else "20230105" if c == "FEC_FILIACION" and i % 4 else "2023" if c == "FEC_FILIACION"
              else "LIMA-LIMA-X" if c == "LUGAR_RESIDENCIA" else "1" for c in REGISTRY_COLUMNS) for i in range(40)]
raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)).repartition(2)

def flaky(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first try")

clean = CL.limpiar_nacional(raw).mapInPandas(flaky, CL.limpiar_nacional(raw).schema)
pob = spark.createDataFrame([("LIMA", 2023, 9, 4, 5)], "departamento string, anio int, total long, hombres long, mujeres long")
PUB.cargar(spark, clean, pob, sys.argv[1] + "/estrella")
print("AUDIT", PUB.publicacion(spark, sys.argv[1] + "/estrella")["auditoria"])
'''


def test_retried_tasks_do_not_count_twice(scratch_dir):
    import ast
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", RETRY, scratch_dir], cwd=root, capture_output=True, text=True, timeout=240,
                         env=os.environ | {"PYTHONPATH": root})
    line = [x for x in run.stdout.splitlines() if x.startswith("AUDIT ")]
    assert line, run.stderr[-2000:]
    audit = ast.literal_eval(line[0][6:])
    assert (audit["leidos"], audit["insertados"], audit["fecha_corta"], audit["anio_2023"]) == (40, 30, 10, 30)
