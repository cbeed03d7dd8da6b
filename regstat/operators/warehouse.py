"""National star schema: dimensions, fact, audit and integrity.

Surrogate keys are deterministic 64-bit hashes of the natural key
(``xxhash64``), so the fact gets its foreign keys by a projection - no
join against the dimensions and no global ordering - and reloading the same
input gives the same ids. Dimensions are distinct natural keys (partial
aggregation keeps their shuffle tiny). Audit counts come from one grouping-
sets aggregation over the cleaned rows (one scan, one shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.functions.sizing import materializar

TIME_KEY = ("anio", "mes")
GEO_KEY = ("departamento", "provincia", "distrito")
PATIENT_KEY = ("sexo", "grupo_etario")
TABLAS = ("fact_casos", "dim_tiempo", "dim_geografia", "dim_paciente", "dim_fuente", "poblacion", "bocetos")


def _id(*cols) -> F.Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def dim_fuente(spark: SparkSession) -> DataFrame:
    """The one source row (name, date range, note)."""
    row = [(cfg.SOURCE_NAME, cfg.SOURCE_RANGE, cfg.SOURCE_NOTE)]
    df = spark.createDataFrame(row, "nombre string, rango_fechas string, nota string")
    return df.select(F.xxhash64("nombre").alias("fuente_id"), "*")


def fact_casos(valid: DataFrame) -> DataFrame:
    """Fact rows with hashed foreign keys (one row per accepted record).
    ``region_id``, the region's own hash, is what rows are clustered by."""
    return valid.select(
        "uuid_hash",
        _id(*TIME_KEY).alias("tiempo_id"),
        _id(*GEO_KEY).alias("geografia_id"),
        _id(*PATIENT_KEY).alias("paciente_id"),
        F.xxhash64(F.lit(cfg.SOURCE_NAME)).alias("fuente_id"),
        _id("departamento").alias("region_id"),
        "edad", "cant_atenciones", "anio")


def _claves(valid: DataFrame) -> tuple[DataFrame, dict]:
    """The keys of the three dimensions from one grouping-sets pass over the
    rows, and the grouping id of each. Every set is grouped by itself (the
    combinations of all keys would be nearly as many as the rows). With
    ``_orden``, a geography has a row per code, file and block, with the least
    number in it: a long, so the grouping hashes, where a struct would sort."""
    place = {"_archivo": "_orden.archivo", "_bloque": "_orden.bloque"} if "_orden" in valid.columns else {}
    n = F.col("_orden.n") if place else F.lit(0)
    sets = {"t": TIME_KEY, "g": (*GEO_KEY, "ubigeo", *place), "p": PATIENT_KEY}
    cols = [c for s in sets.values() for c in s]
    rows = valid.select(*TIME_KEY, *GEO_KEY, "ubigeo", *[F.col(c).alias(a) for a, c in place.items()], *PATIENT_KEY,
                        n.alias("_n"))
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets.values()], *cols) \
        .agg(F.min("_n").alias("_n"), F.grouping_id().alias("_set"))
    return g, {name: sum((c not in s) << (len(cols) - 1 - i) for i, c in enumerate(cols)) for name, s in sets.items()}


def dimensiones(valid: DataFrame, params: cfg.Params = cfg.SOURCE) -> dict:
    """The three dimensions from ONE grouping-sets pass over the
    accepted rows: time (with C7, C8), geography and patient keys. The code of
    a geography is the one seen first in the order of the files (``_orden`` of
    the reader), whatever the partitioning; rows that come from no file give
    the smallest code. Each dimension is a filter of the shared, small grouped
    result, so a load reads the rows once for all of them."""
    g, gid = _claves(valid)
    # Small result read by three filters: materialized once (see
    # ``reports._sets``), otherwise each filter would be pushed into the
    # Expand and each dimension would rescan the rows.
    g = materializar(g)
    t, geo, pac = (g.where(F.col("_set") == gid[name]) for name in ("t", "g", "p"))
    seen = [c for c in ("_archivo", "_bloque") if c in g.columns]
    geo = geo.groupBy(*GEO_KEY).agg(F.min(F.struct(*seen, "_n", "ubigeo"))["ubigeo"].alias("ubigeo"))
    return {
        "dim_tiempo": t.select(_id(*TIME_KEY).alias("tiempo_id"), *TIME_KEY,
                               C.quarter("mes").alias("trimestre"),
                               (F.col("anio") != F.lit(params.partial_year)).alias("completo")),
        "dim_geografia": geo.select(_id(*GEO_KEY).alias("geografia_id"), *GEO_KEY, "ubigeo"),
        "dim_paciente": pac.select(_id(*PATIENT_KEY).alias("paciente_id"), *PATIENT_KEY),
    }


def bocetos(valid: DataFrame, k: int = cfg.SKETCH_K, lg: int = cfg.SKETCH_LG) -> DataFrame:
    """A13, A15, approximate: per (region, year) a quantile sketch (KLL) of the
    visits and a distinct sketch (HLL) of the geographies. Sketches are merged
    upwards (``measures.atenciones_bocetos``), so any union of regions and
    years has its median and distinct count without the fact. They are built
    with partial aggregation; a row has a few kilobytes, whatever it counts."""
    return valid.groupBy("departamento", "anio").agg(
        F.count("cant_atenciones").alias("n_valores"),
        F.kll_sketch_agg_bigint(F.col("cant_atenciones").cast("bigint"), k).alias("atenciones"),
        F.hll_sketch_agg(_id(*GEO_KEY), lg).alias("geografias"))


def construir_estrella(spark: SparkSession, clean: DataFrame, poblacion: DataFrame,
                       params: cfg.Params = cfg.SOURCE) -> dict:
    """All star tables as DataFrames. The dimensions come from one pass over
    the accepted rows, run at once (``dimensiones``); the fact is computed
    when it is written."""
    valid = clean.where(F.col("valido"))
    return {
        "fact_casos": fact_casos(valid),
        **dimensiones(valid, params),
        "dim_fuente": dim_fuente(spark),
        "poblacion": poblacion,
        "bocetos": bocetos(valid),
    }


def vista_analitica(star: dict) -> DataFrame:
    """Fact joined back to its dimensions (the analytic fact of the
    measures). The broadcast decision is left to size evidence: persisted
    dimensions are broadcast by the planner from their file size, and
    dimensions computed in the same job are broadcast by AQE from the
    measured size of their shuffle output (a sort-merge join otherwise).
    The year is the fact's own column, by which it is stored, so a year
    filter prunes its folders; ``region_id`` lets a region filter reach the
    fact's scan (``measures.filtrar``)."""
    f = star["fact_casos"]
    t, g, p = star["dim_tiempo"].drop("anio"), star["dim_geografia"].drop("ubigeo"), star["dim_paciente"]
    return (f.join(t, "tiempo_id").join(g, "geografia_id").join(p, "paciente_id")
            .select("departamento", "provincia", "distrito", "anio", "mes", "sexo",
                    "edad", "grupo_etario", "cant_atenciones", "region_id"))


def _grouped_counts(clean: DataFrame) -> DataFrame:
    """One grouping-sets pass: rows per validity flag and the distinct keys
    of every dimension among accepted rows."""
    sets = {"valido": ("valido",), "departamentos": ("valido", "departamento"),
            "geografias": ("valido",) + GEO_KEY, "periodos": ("valido",) + TIME_KEY,
            "grupos_paciente": ("valido",) + PATIENT_KEY}
    cols = sorted({c for s in sets.values() for c in s})
    pre = clean.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))  # the Expand sees keys, not rows
    g = pre.groupingSets([[F.col(c) for c in s] for s in sets.values()], *cols) \
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # grouping_id bit i (from the left, over ``cols``) is 1 when cols[i] is
    # aggregated away; map each set to its id.
    ids = {}
    for name, s in sets.items():
        gid = 0
        for c in cols:
            gid = (gid << 1) | (0 if c in s else 1)
        ids[name] = gid
    metric = F.lit(None).cast("string")
    for name, gid in ids.items():
        metric = F.when(F.col("gid") == gid, F.lit(name)).otherwise(metric)
    return g.select(metric.alias("metrica"), "valido", "n")


def auditoria_carga(clean: DataFrame, poblacion: DataFrame) -> DataFrame:
    """Load audit in long form (metrica, valor): inserted and
    discarded rows, distinct regions, geography keys, periods, patient groups
    (one grouping-sets pass over the cleaned rows) and population regions."""
    g = _grouped_counts(clean)
    m, acc = F.col("metrica"), F.col("valido")
    row = g.agg(
        F.coalesce(F.sum(F.when((m == "valido") & acc, F.col("n"))), F.lit(0)).cast("bigint").alias("insertados"),
        F.coalesce(F.sum(F.when((m == "valido") & ~acc, F.col("n"))), F.lit(0)).cast("bigint").alias("descartados"),
        *[F.count_if((m == name) & acc).alias(name)
          for name in ("departamentos", "geografias", "periodos", "grupos_paciente")])
    names = ("insertados", "descartados", "departamentos", "geografias", "periodos", "grupos_paciente")
    long = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metrica"), F.col(n).cast("bigint").alias("valor"))
                                         for n in names])))
    pob = poblacion.agg(F.count_distinct("departamento").cast("bigint").alias("valor")) \
        .select(F.lit("regiones_poblacion").alias("metrica"), "valor")
    return long.unionByName(pob)


def integridad_referencial(star: dict) -> DataFrame:
    """K5: orphan foreign keys, nulls in NOT NULL columns, hash-id collisions
    and fact regions without population; long form (chequeo, detalle, n).

    One pass over the fact: it is grouped by its foreign keys first (a hot
    key is one partial row per task), the groups are left-joined to every
    dimension and reduced to one row per region, from which every fact check
    is derived. Collisions are counted on the dimensions themselves.
    """
    keys = {"tiempo_id": "dim_tiempo", "geografia_id": "dim_geografia",
            "paciente_id": "dim_paciente", "fuente_id": "dim_fuente"}
    j = star["fact_casos"].groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("uuid_hash").isNull()).alias("z_uuid_hash"))
    for key, dim in keys.items():
        extra = ["departamento"] if key == "geografia_id" else []
        # one row per id, so that a repeated id cannot multiply the fact
        d = star[dim].groupBy(key).agg(F.lit(True).alias(f"_in_{key}"), *[F.min(c).alias(c) for c in extra])
        j = j.join(d, key, "left")
    not_null = ("uuid_hash", "tiempo_id", "geografia_id", "paciente_id", "fuente_id")

    def rows(bad):
        return F.sum(F.when(bad, F.col("n")).otherwise(F.lit(0)))
    # One row per region; read by the totals and the population check, so
    # it is materialized once (one pass over the fact).
    per_dep = materializar(j.groupBy("departamento").agg(
        F.sum("n").alias("n"), F.sum("z_uuid_hash").alias("z_uuid_hash"),
        *[rows(F.col(k).isNotNull() & F.col(f"_in_{k}").isNull()).alias(f"o_{k}") for k in keys],
        *[rows(F.col(k).isNull()).alias(f"z_{k}") for k in keys]))
    items = ([("fk_huerfana", k, f"o_{k}") for k in keys]
             + [("nulo", c, f"z_{c}") for c in not_null])
    totals = per_dep.agg(*[F.sum(col).alias(col) for _, _, col in items]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("chequeo"), F.lit(d).alias("detalle"),
                 F.coalesce(F.col(col), F.lit(0)).cast("bigint").alias("n"))
        for c, d, col in items])))
    pob = star["poblacion"].select("departamento").distinct()
    sin_pob = (per_dep.where(F.col("departamento").isNotNull()).join(pob, "departamento", "left_anti")
               .select(F.lit("sin_poblacion").alias("chequeo"), F.col("departamento").alias("detalle"),
                       F.col("n").cast("bigint").alias("n")))
    out = totals.unionByName(sin_pob)
    for dim, key in (("dim_tiempo", "tiempo_id"), ("dim_geografia", "geografia_id"),
                     ("dim_paciente", "paciente_id")):
        out = out.unionByName(star[dim].agg(
            (F.count(F.lit(1)) - F.count_distinct(key)).cast("bigint").alias("n"))
            .select(F.lit("colision_id").alias("chequeo"), F.lit(key).alias("detalle"), "n"))
    return out


# K4: table schemas of the star (NOT NULL columns are nullable=False here and
# are enforced by the checks of ``integridad_referencial``).
def _f(name, typ, nullable=True):
    from pyspark.sql import types as T
    return T.StructField(name, getattr(T, typ)(), nullable)


def esquemas():
    from pyspark.sql import types as T
    return {
        "dim_tiempo": T.StructType([_f("tiempo_id", "LongType", False), _f("anio", "IntegerType", False),
                                    _f("mes", "IntegerType", False), _f("trimestre", "IntegerType"),
                                    _f("completo", "BooleanType", False)]),
        "dim_geografia": T.StructType([_f("geografia_id", "LongType", False),
                                       _f("departamento", "StringType", False),
                                       _f("provincia", "StringType", False), _f("distrito", "StringType"),
                                       _f("ubigeo", "StringType")]),
        "dim_paciente": T.StructType([_f("paciente_id", "LongType", False), _f("sexo", "StringType", False),
                                      _f("grupo_etario", "StringType", False)]),
        "dim_fuente": T.StructType([_f("fuente_id", "LongType", False), _f("nombre", "StringType", False),
                                    _f("rango_fechas", "StringType"), _f("nota", "StringType")]),
        "fact_casos": T.StructType([_f("uuid_hash", "StringType", False), _f("tiempo_id", "LongType", False),
                                        _f("geografia_id", "LongType", False), _f("paciente_id", "LongType", False),
                                        _f("fuente_id", "LongType", False), _f("region_id", "LongType", False),
                                        _f("edad", "IntegerType"),
                                        _f("cant_atenciones", "IntegerType"), _f("anio", "IntegerType", False)]),
        "poblacion": T.StructType([_f("departamento", "StringType", False), _f("anio", "IntegerType", False),
                                   _f("total", "LongType", False), _f("hombres", "LongType"),
                                   _f("mujeres", "LongType")]),
        "bocetos": T.StructType([_f("departamento", "StringType", False), _f("anio", "IntegerType", False),
                                 _f("n_valores", "LongType", False), _f("atenciones", "BinaryType"),
                                 _f("geografias", "BinaryType")]),
        "embeddings": T.StructType([_f("chunk_type", "StringType", False), _f("chunk_key", "StringType", False),
                                    _f("content", "StringType", False),
                                    T.StructField("embedding", T.ArrayType(T.FloatType())),
                                    _f("metadata_json", "StringType")]),
    }


def conforme(df: DataFrame, schema) -> bool:
    """Column names and types equal the declared schema (nullability is
    checked by the data checks, not by the plan)."""
    return [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
