"""K1, K4: loading, publishing and reloading the star.

A load writes its tables to folders of its own (``carga=<id>``), the fact by
year, and then publishes a numbered entry that names, for every table and for
every year of the fact, the folder that holds it. Readers follow the last
entry, so they see one version or the other, never a mix; a reload of single
years publishes new folders for those years beside the old ones of the rest.

Publishing is compare-and-append: entry n + 1 is created by a rename that
fails if the file exists, so of two loads that started from the same version
one wins and the other raises ``CargaPerdida`` (its folders stay unreferenced
until ``limpiar_versiones`` removes them). The file system of the folder must
rename without overwriting, as HDFS and local file systems do.

A load reads its source once: the accepted rows are written to a folder of
their own (``_etapa/carga=<id>``), from which the fact, the dimensions and the
sketches are built, and which goes when the load ends. The load audit (A18) is
observed while they are written, in the stage that reads the source (the
metrics of a retried task replace those of its first try), and stored in the
entry.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat import config as cfg
from regstat.operators import warehouse as WH

#: reasons for which the national load discards a row, in the order tested
MOTIVOS = ("fecha_corta", "fecha_ilegible", "anio_fuera", "mes_fuera")


class CargaPerdida(RuntimeError):
    """Another load has published since the version this one started from."""


# ---------------------------------------------------------------------------
# Files of the publication log
# ---------------------------------------------------------------------------
def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with their modification times (ms); {} if missing."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path)}


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Create a whole file, or return False if it exists already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, fs = _path(spark, name)
    whole = fs.makeQualified(path)
    part = hadoop.Path(whole.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, whole, options)
        return True
    except Exception:
        if not fs.exists(path):
            raise
        fs.delete(part, False)
        return False


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/publicaciones"


def publicaciones(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, _log(root)) if n.endswith(".json") and n[:-5].isdigit())


def publicacion(spark: SparkSession, root: str, numero: int | None = None) -> dict | None:
    """The entry of a version (default: the last), or None before the first."""
    known = publicaciones(spark, root)
    if numero is None and not known:
        return None
    name = f"{_log(root)}/{known[-1] if numero is None else numero:08d}.json"
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


# ---------------------------------------------------------------------------
# Writing and publishing
# ---------------------------------------------------------------------------
def _folder(root: str, table: str, carga: str) -> str:
    return f"{root.rstrip('/')}/{table}/carga={carga}"


def _write_fact(fact: DataFrame, root: str, carga: str) -> dict[str, str]:
    """The fact by year; inside a file the rows of a region stand together, so
    a region's filter skips row groups by their statistics. Returns the years
    written, each with its ``carga``."""
    path = _folder(root, "fact_casos", carga)
    (fact.sortWithinPartitions("anio", "region_id").write.mode("errorifexists").partitionBy("anio").parquet(path))
    return {n.split("=", 1)[1]: carga for n in _names(fact.sparkSession, path) if n.startswith("anio=")}


def guardar_estrella(star: dict, root: str) -> dict:
    """Write every table of a star to fresh folders, unpublished; returns the
    entry's ``tablas`` and ``anios``."""
    carga = "c" + uuid.uuid4().hex[:12]
    anios = _write_fact(star["fact_casos"], root, carga)
    for name, df in star.items():
        if name != "fact_casos":
            df.write.mode("errorifexists").parquet(_folder(root, name, carga))
    return {"tablas": {name: carga for name in star if name != "fact_casos"}, "anios": anios}


def publicar(spark: SparkSession, root: str, entrada: dict, esperada: int) -> dict:
    """Publish ``entrada`` as the version after ``esperada`` (0: the first);
    raises ``CargaPerdida`` if that version exists already."""
    full = {**entrada, "numero": esperada + 1, "publicado_en": time.time()}
    if not _create(spark, f"{_log(root)}/{esperada + 1:08d}.json", json.dumps(full, ensure_ascii=False)):
        raise CargaPerdida(f"version {esperada + 1} of {root} has been published by another load")
    return full


def tablas_de(spark: SparkSession, root: str, entrada: dict) -> dict:
    """The tables that an entry names."""
    schemas = WH.esquemas()
    base = f"{root.rstrip('/')}/fact_casos"
    paths = [f"{base}/carga={c}/anio={y}" for y, c in sorted(entrada["anios"].items())]
    fact = schemas["fact_casos"]
    if paths:
        out = (spark.read.option("basePath", base).parquet(*paths).drop("carga")
               .select(*[F.col(f.name).cast(f.dataType) for f in fact]))
    else:
        out = spark.createDataFrame([], fact)
    return {"fact_casos": out, **{name: spark.read.parquet(_folder(root, name, c))
                                  for name, c in entrada["tablas"].items()}}


def abrir_estrella(spark: SparkSession, root: str) -> dict | None:
    """The tables of the version published last, or None before the first."""
    entry = publicacion(spark, root)
    return None if entry is None else tablas_de(spark, root, entry)


def publicar_estrella(spark: SparkSession, star: dict, root: str, esperada: int | None = None) -> dict:
    """Write and publish a star given as tables; returns them as read back."""
    base = (publicaciones(spark, root) or [0])[-1] if esperada is None else esperada
    return tablas_de(spark, root, publicar(spark, root, guardar_estrella(star, root), base))


# ---------------------------------------------------------------------------
# Loads with an observed audit
# ---------------------------------------------------------------------------
def motivo_descarte(params: cfg.Params = cfg.SOURCE) -> F.Column:
    """Why a cleaned row is discarded (null: accepted)."""
    bad = [F.length("fecha") < 6, F.col("anio").isNull() | F.col("mes").isNull(),
           ~F.col("anio").between(params.first_year, params.last_year), ~F.col("mes").between(1, 12)]
    out = F.when(F.col("valido"), F.lit(None).cast("string"))
    for name, cond in zip(MOTIVOS, bad):
        out = out.when(F.coalesce(cond, F.lit(True)), F.lit(name))
    return out


def _observada(clean: DataFrame, params: cfg.Params) -> tuple[Observation, DataFrame]:
    obs = Observation(f"carga-{uuid.uuid4().hex}")
    clean = clean.withColumn("_motivo", motivo_descarte(params))  # read by several counts
    broken = F.count_if(F.col("_corrupto").isNotNull()) if "_corrupto" in clean.columns else F.sum(F.lit(0))
    return obs, clean.observe(
        obs, F.count(F.lit(1)).alias("leidos"), F.coalesce(broken, F.lit(0)).alias("corruptos"),
        F.count_if("valido").alias("insertados"),
        F.count_if(F.col("valido") & F.col("uuid_hash").isNull()).alias("uuid_nulo"),
        *[F.count_if(F.col("_motivo") == m).alias(m) for m in MOTIVOS],
        *[F.count_if(F.col("valido") & (F.col("anio") == y)).alias(f"anio_{y}") for y in params.years])


ETAPA = "_etapa"


def _aceptadas(spark: SparkSession, clean: DataFrame, params: cfg.Params, path: str) -> tuple[DataFrame, dict]:
    """The accepted rows, written to ``path`` and read back, and the audit
    observed on the way."""
    obs, observed = _observada(clean, params)
    rows = observed.where("valido").drop("fecha", "valido", "_corrupto", "_motivo")
    rows.write.mode("errorifexists").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), {k: int(v or 0) for k, v in obs.get.items()}


def cargar(spark: SparkSession, clean: DataFrame, poblacion: DataFrame, root: str,
           params: cfg.Params = cfg.SOURCE, anios: list | None = None) -> dict:
    """Load the cleaned registry and publish it; returns the tables.

    Without ``anios`` the whole star is replaced. With them only those years
    of the fact are: the other years keep their folders, new dimension keys
    are added and known ones keep their attributes, a year without accepted
    rows becomes empty, and the audit keeps the counts of the rows read by the
    last whole load. The audit counts while the accepted rows are written.
    """
    before = publicacion(spark, root)
    if anios is not None and before is None:
        raise ValueError("a reload of single years needs a published star")
    if anios is not None:
        clean = clean.where(F.col("valido") & F.col("anio").isin([int(y) for y in anios]))
    carga = "c" + uuid.uuid4().hex[:12]
    valid, audit = _aceptadas(spark, clean, params, _folder(root, ETAPA, carga))
    years = _write_fact(WH.fact_casos(valid), root, carga)
    star = {**WH.dimensiones(valid, params), "dim_fuente": WH.dim_fuente(spark),
            "poblacion": poblacion, "bocetos": WH.bocetos(valid)}
    if anios is not None:
        old = tablas_de(spark, root, before)
        for name, key in (("dim_tiempo", "tiempo_id"), ("dim_geografia", "geografia_id"),
                          ("dim_paciente", "paciente_id")):
            star[name] = old[name].unionByName(star[name].join(old[name].select(key), key, "left_anti"))
        wanted = {str(int(y)) for y in anios}
        star["bocetos"] = old["bocetos"].where(~F.col("anio").isin([int(y) for y in anios])).unionByName(star["bocetos"])
        years = {**{y: c for y, c in before["anios"].items() if y not in wanted}, **years}
        old_audit = before["auditoria"]
        audit = {**old_audit, **{f"anio_{y}": audit[f"anio_{y}"] for y in sorted(wanted)}}
        audit["insertados"] = sum(v for k, v in audit.items() if k.startswith("anio_"))
    for name, df in star.items():
        df.write.mode("errorifexists").parquet(_folder(root, name, carga))
    path, fs = _path(spark, _folder(root, ETAPA, carga))
    fs.delete(path, True)
    entry = {"tablas": {name: carga for name in star}, "anios": years, "auditoria": audit}
    return tablas_de(spark, root, publicar(spark, root, entry, before["numero"] if before else 0))


def auditoria_publicada(spark: SparkSession, root: str) -> DataFrame:
    """The audit of the published version, (metrica, valor): rows
    read, inserted and discarded (in all and by reason) as observed by the
    load, and the distinct keys, which are the rows of the stored dimensions."""
    entry = publicacion(spark, root)
    star, seen = tablas_de(spark, root, entry), entry["auditoria"]
    rows = [(k, seen[k]) for k in ("leidos", "corruptos", "insertados", *MOTIVOS)]
    rows.append(("descartados", sum(seen[m] for m in MOTIVOS)))
    out = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metrica"), F.lit(v).cast("bigint").alias("valor")) for k, v in rows])))
    n = F.count(F.lit(1)).cast("bigint").alias("valor")
    for name, df in (("geografias", star["dim_geografia"]), ("periodos", star["dim_tiempo"]),
                     ("grupos_paciente", star["dim_paciente"]),
                     ("departamentos", star["dim_geografia"].select("departamento").distinct()),
                     ("regiones_poblacion", star["poblacion"].select("departamento").distinct())):
        out = out.unionByName(df.agg(n).select(F.lit(name).alias("metrica"), "valor"))
    return out


def conteo_tablas(star: dict) -> DataFrame:
    """Rows of every stored table (from the files' own counts)."""
    out = None
    for name in WH.TABLAS:
        one = star[name].agg(F.count(F.lit(1)).cast("bigint").alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = one if out is None else out.unionByName(one)
    return out


def limpiar_versiones(spark: SparkSession, root: str, segundos: float) -> list[str]:
    """Remove entries older than ``segundos`` (never the last one) and folders
    that no kept entry names and that are as old: a running load's folders are
    younger, a reader of an old version has that long to finish. Returns what
    was removed."""
    limit = time.time() - segundos
    numbers = publicaciones(spark, root)
    entries = {n: publicacion(spark, root, n) for n in numbers}
    kept = [n for n in numbers if n == numbers[-1] or entries[n]["publicado_en"] >= limit]
    used = {(t, c) for n in kept for t, c in entries[n]["tablas"].items()}
    used |= {("fact_casos", c) for n in kept for c in entries[n]["anios"].values()}
    gone = []
    for table in (*WH.TABLAS, ETAPA):  # a failed load leaves its rows behind
        for name, changed in _names(spark, f"{root.rstrip('/')}/{table}").items():
            carga = name.partition("carga=")[2]
            if carga and (table, carga) not in used and changed / 1000 <= limit:
                gone.append(_folder(root, table, carga))
    gone += [f"{_log(root)}/{n:08d}.json" for n in numbers if n not in kept]
    for name in gone:
        path, fs = _path(spark, name)
        fs.delete(path, True)
    return gone


# ---------------------------------------------------------------------------
# K4: declared schemas enforced at write
# ---------------------------------------------------------------------------
def validar(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of ``schema`` in its type, with ``motivos`` (array) and
    ``crudo`` (the row as JSON, for rejected rows). Reasons: ``nulo:c`` for a
    null in a NOT NULL column, ``tipo:c`` for a value that has not the type,
    ``corrupto`` for a record the reader marked. One projection."""
    typed, reasons = [], []
    for f in schema:
        raw = F.col(f.name)
        value = raw if df.schema[f.name].dataType == f.dataType else raw.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        if not f.nullable:
            reasons.append(F.when(raw.isNull(), F.lit(f"nulo:{f.name}")))
        if df.schema[f.name].dataType != f.dataType:
            reasons.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"tipo:{f.name}")))
    if "_corrupto" in df.columns:
        reasons.append(F.when(F.col("_corrupto").isNotNull(), F.lit("corrupto")))
    motivos = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    crudo = F.to_json(F.struct(*[c for c in df.columns if c != "_orden"]))
    return (df.select(*typed, motivos.alias("motivos"), crudo.alias("crudo"))
            .withColumn("crudo", F.when(F.size("motivos") > 0, F.col("crudo"))))


def escribir_validado(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Write accepted and rejected rows to tables of their own, in one job."""
    estado = F.when(F.size("motivos") > 0, "rechazada").otherwise("aceptada")
    validar(df, schema).withColumn("estado", estado).write.mode("overwrite").partitionBy("estado").parquet(path)


def leer_validado(spark: SparkSession, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the typed rows, and (crudo, motivos)."""
    def part(name, columns, empty):
        try:
            return spark.read.parquet(f"{path}/estado={name}").select(*columns)
        except AnalysisException:
            return spark.createDataFrame([], empty)
    return (part("aceptada", schema.names, schema),
            part("rechazada", ["crudo", "motivos"], "crudo string, motivos array<string>"))


ESQUEMA_REGISTRO = T.StructType([
    T.StructField("UUID", T.StringType(), False), T.StructField("HISTORIA", T.LongType(), False),
    T.StructField("FEC_FILIACION", T.StringType(), False), T.StructField("SEXO", T.StringType()),
    T.StructField("EDAD", T.IntegerType()), T.StructField("UBIGEO_LUGAR_RESIDENCIA", T.StringType(), False),
    T.StructField("LUGAR_RESIDENCIA", T.StringType(), False), T.StructField("CANT_ATENCIONES_CEX", T.IntegerType()),
    T.StructField("FECHA_CORTE", T.StringType())])


def conteo_validado(aceptadas: DataFrame, rechazadas: DataFrame) -> DataFrame:
    """(estado, motivo, n): accepted rows, rejected rows, and rejected rows by
    reason (a row counts under each of its reasons)."""
    n = F.count(F.lit(1)).cast("bigint").alias("n")

    def total(df, estado):
        return df.agg(n).select(F.lit(estado).alias("estado"), F.lit("").alias("motivo"), "n")
    by = (rechazadas.select(F.explode("motivos").alias("motivo")).groupBy("motivo").agg(n)
          .select(F.lit("rechazada").alias("estado"), "motivo", "n"))
    return total(aceptadas, "aceptada").unionByName(total(rechazadas, "rechazada")).unionByName(by)
