"""Incremental load: two CSV drops, one available-now run, exactly once."""

import os

from regstat import config as cfg
from regstat.sources.registry import REGISTRY_COLUMNS
from regstat.streaming import ingest


def write_csv(path, rows):
    with open(path, "wb") as fh:
        fh.write((",".join(REGISTRY_COLUMNS) + "\n").encode("latin-1"))
        for r in rows:
            fh.write((",".join(r) + "\n").encode("latin-1"))


def row(i, fecha, lugar="ÁNCASH-HUARAZ-X"):
    return [f"u{i}", str(i), fecha, "FEMENINO", "40", "020101", lugar, "2", ""]


def test_incremental_load(spark, scratch_dir):
    src = os.path.join(scratch_dir, "in")
    os.makedirs(src)
    write_csv(os.path.join(src, "a.csv"), [row(1, "20230105"), row(2, "20221"), row(3, "20240301")])
    write_csv(os.path.join(src, "b.csv"), [row(4, "20250101", "LIMA-LIMA-LIMA"), row(5, "ABCDEFGH")])
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    q = ingest.iniciar_carga(spark, src, out, ck, cfg.SOURCE)
    q.awaitTermination(120)
    acc = spark.read.parquet(out)
    assert sorted(r["uuid_hash"] for r in acc.collect()) == ["u1", "u3", "u4"]
    # a second run over the same files adds nothing (exactly once)
    ingest.iniciar_carga(spark, src, out, ck, cfg.SOURCE).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    pob = spark.createDataFrame([("LIMA", 2025, 10, 5, 5)],
                                "departamento string, anio int, total long, hombres long, mujeres long")
    star = ingest.estrella_desde_registro(spark, out, pob, cfg.SOURCE)
    assert star["dim_geografia"].count() == 2
    assert star["fact_casos"].count() == 3
