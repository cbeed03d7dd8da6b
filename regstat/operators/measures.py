"""Aggregations over the analytic fact.

All functions take the analytic fact (``departamento, provincia, distrito,
anio, mes, sexo, edad, grupo_etario, cant_atenciones``) and compute every
region in one grouped job; the optional ``departamento`` / ``anio``
arguments are plain filters (F1) that Catalyst pushes to the scans.
Counts are ``COUNT(*)`` with map-side partial aggregation, so a region
holding a third of all rows costs one partial row per task, not a hot task.

A single measure groups the fact directly (one exchange, only its own
columns). A bundle of several breakdowns passes them the ``cubo`` instead
(region, province, year, month, sex, band -> cases, sum and count of ages),
whose size is bounded by the dimension cardinalities, not by the fact; each
branch then has the same cube plan, so Spark reuses one exchange and the fact
is scanned once. Sums of integer counts and of integer ages are exact, so
both ways give equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C

CUBE_KEYS = ("departamento", "provincia", "anio", "mes", "sexo", "grupo_etario")


def cubo(fact: DataFrame) -> DataFrame:
    """Pre-aggregate of the fact over the low-cardinality dimensions (a cube
    stays as it is)."""
    if "casos" in fact.columns:
        return fact
    return fact.groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("casos"),
        F.sum("edad").cast("bigint").alias("suma_edad"),
        F.count("edad").alias("n_edad"))


def filas(fact: DataFrame) -> DataFrame:
    """Fact rows in the columns of the cube, one case each (a cube stays as
    it is); no aggregation, and unused columns are pruned from the scan."""
    if "casos" in fact.columns:
        return fact
    return fact.select(*CUBE_KEYS, F.lit(1).alias("casos"), F.col("edad").alias("suma_edad"),
                       F.col("edad").isNotNull().cast("int").alias("n_edad"))


def cases():
    """COUNT(*) of the fact, as a sum over cube rows."""
    return F.sum("casos").cast("bigint").alias("casos")


def mean_age():
    """AVG(edad) of the fact over cube rows (null when no age is known)."""
    return F.sum("suma_edad") / F.nullif(F.sum("n_edad"), F.lit(0))


def females():
    return F.sum(F.when(F.col("sexo") == "FEMENINO", F.col("casos")).otherwise(F.lit(0))).cast("bigint")


def males():
    return F.sum(F.when(F.col("sexo") == "MASCULINO", F.col("casos")).otherwise(F.lit(0))).cast("bigint")


def filtrar(fact: DataFrame, departamento: str | None = None, anio: int | None = None) -> DataFrame:
    """optional equality filters, added only when given. On the star's
    rows the region also filters ``region_id``, which the fact is sorted by:
    Parquet skips the row groups of other regions before any join."""
    if departamento is not None:
        fact = fact.where(F.col("departamento") == F.lit(departamento))
        if "region_id" in fact.columns:
            fact = fact.where(F.col("region_id") == F.xxhash64(F.lit(departamento)))
    if anio is not None:
        fact = fact.where(F.col("anio") == F.lit(int(anio)))
    return fact


def casos_por_anio(fact: DataFrame, departamento: str | None = None,
                   anio: int | None = None) -> DataFrame:
    """A1: cases per (region, year)."""
    return filas(filtrar(fact, departamento, anio)).groupBy("departamento", "anio").agg(cases())


def con_poblacion(agg: DataFrame, poblacion: DataFrame,
                  scale: int = cfg.RATE_SCALE) -> DataFrame:
    """J4/J5 + C17: attach population and crude rate to (region, year) rows.

    The aggregate is computed first and joined afterwards, so duplicate
    population rows can never multiply cases; the population side is a
    small aggregate that AQE broadcasts once its real size is known.
    """
    pob = poblacion.select("departamento", "anio", F.col("total").alias("_pob"))
    out = agg.join(pob, ["departamento", "anio"], "left")
    return (out.withColumn("poblacion", F.coalesce(F.col("_pob"), F.lit(0).cast("bigint")))
            .withColumn("tasa", C.crude_rate(F.col("casos"), F.col("_pob"), scale))
            .drop("_pob"))


def tasa_incidencia(fact: DataFrame, poblacion: DataFrame, departamento: str | None = None,
                    scale: int = cfg.RATE_SCALE) -> DataFrame:
    """A2: cases, population (0 when absent) and rate per (region, year)."""
    return con_poblacion(casos_por_anio(fact, departamento), poblacion, scale)


def distribucion_sexo(fact: DataFrame, departamento: str | None = None,
                      anio: int | None = None) -> DataFrame:
    """A3: cases per sex."""
    return filas(filtrar(fact, departamento, anio)).groupBy("departamento", "sexo").agg(cases())


def distribucion_edad(fact: DataFrame, departamento: str | None = None,
                      anio: int | None = None) -> DataFrame:
    """A4 (+F2): cases per age band, unknown band excluded."""
    return (filas(filtrar(fact, departamento, anio)).where(F.col("grupo_etario") != cfg.UNKNOWN)
            .groupBy("departamento", "grupo_etario").agg(cases()))


def ranking_departamentos(fact: DataFrame, anio: int | None = None) -> DataFrame:
    """A5: cases per region (order: cases desc, then name)."""
    return filas(filtrar(fact, None, anio)).groupBy("departamento").agg(cases())


def ordenar_ranking(ranking: DataFrame) -> DataFrame:
    return ranking.orderBy(F.col("casos").desc(), F.col("departamento").asc())


def tendencia_mensual(fact: DataFrame, departamento: str | None = None,
                      anio: int | None = None) -> DataFrame:
    """A6 (+C14): cases per (region, year, month) with the month label."""
    return (filas(filtrar(fact, departamento, anio)).groupBy("departamento", "anio", "mes").agg(cases())
            .withColumn("etiqueta", C.month_label("mes")))


def provincias(fact: DataFrame, departamento: str | None = None,
               anio: int | None = None) -> DataFrame:
    """Cases per province."""
    return filas(filtrar(fact, departamento, anio)).groupBy("departamento", "provincia").agg(cases())


def _sex_counts():
    return [females().alias("femenino"), males().alias("masculino")]


def resumen_depto_anio(fact: DataFrame, poblacion: DataFrame,
                       scale: int = cfg.RATE_SCALE) -> DataFrame:
    """A8 + J5: per (region, year) cases, women, men, mean age (1 digit),
    population flag and rate (0 without population)."""
    agg = (filas(fact).groupBy("departamento", "anio")
           .agg(cases(), *_sex_counts(), C.round_half_up(mean_age(), 1).alias("edad_promedio")))
    pob = poblacion.select("departamento", "anio", F.col("total").alias("_pob"))
    return (agg.join(pob, ["departamento", "anio"], "left")
            .withColumn("con_poblacion", F.col("_pob").isNotNull())
            .withColumn("tasa", C.crude_rate(F.col("casos"), F.col("_pob"), scale))
            .drop("_pob"))


def resumen_depto_total(fact: DataFrame) -> DataFrame:
    """Per region cases, women and mean age (1 digit)."""
    return filas(fact).groupBy("departamento").agg(
        cases(), females().alias("femenino"),
        C.round_half_up(mean_age(), 1).alias("edad_promedio"))


def mensual_detalle(fact: DataFrame) -> DataFrame:
    """A10: cases per (region, year, month)."""
    return filas(fact).groupBy("departamento", "anio", "mes").agg(cases())


def edad_por_depto(fact: DataFrame) -> DataFrame:
    """Cases per (region, band), unknown excluded."""
    return distribucion_edad(fact)


def atenciones(fact: DataFrame, departamento: str | None = None,
               visits: str = "cant_atenciones", aproximado: bool = False,
               precision: int = 10000) -> DataFrame:
    """Visits per (region, year): mean (2 digits), exact median, max;
    nulls excluded, zeros when a group has no value.

    Spark's exact ``median`` keeps a value -> count map per group, so memory
    follows the number of distinct visit counts, not the group size, and it
    merges partial maps across tasks; a hot region is not a hot task. With
    ``aproximado`` the median is ``percentile_approx`` (bounded sketch, for
    values with very many distinct levels); it is then not interpolated.
    """
    v = F.col(visits)
    med = F.percentile_approx(v, 0.5, precision) if aproximado else F.median(v)
    return (filtrar(fact, departamento).groupBy("departamento", "anio")
            .agg(F.coalesce(C.round_half_up(F.avg(v), 2), F.lit(0.0)).alias("promedio"),
                 F.coalesce(med.cast("double"), F.lit(0.0)).alias("mediana"),
                 F.coalesce(F.max(v).cast("bigint"), F.lit(0).cast("bigint")).alias("maximo"),
                 F.count(v).alias("n_valores")))


def atenciones_bocetos(bocetos: DataFrame, *por: str) -> DataFrame:
    """A13, A15 from the stored sketches, merged to the columns ``por``
    (departamento, anio, both or none): n_valores (exact), the approximate
    median of the visits (its rank is within ``config.SKETCH_RANK_ERROR`` of
    one half) and the approximate number of geographies."""
    merged = bocetos.groupBy(*por).agg(
        F.sum("n_valores").cast("bigint").alias("n_valores"),
        F.kll_merge_agg_bigint("atenciones").alias("_k"), F.hll_union_agg("geografias").alias("_h"))
    return merged.select(
        *por, "n_valores",
        F.when(F.col("n_valores") > 0, F.kll_sketch_get_quantile_bigint("_k", F.lit(0.5))).alias("mediana"),
        F.hll_sketch_estimate("_h").alias("geografias"))


def error_bocetos(bocetos: DataFrame, fact: DataFrame, geografias: DataFrame) -> DataFrame:
    """The sketches' answers per region held against the exact ones: whether
    the approximate median's rank and the distinct count are within their
    bounds. The fact is reduced to counts per value first."""
    values = (fact.where(F.col("cant_atenciones").isNotNull()).groupBy("departamento", "cant_atenciones")
              .agg(F.count(F.lit(1)).alias("_n")))
    exact = geografias.groupBy("departamento").agg(F.count(F.lit(1)).alias("_geo"))
    a = atenciones_bocetos(bocetos, "departamento")
    rank = (a.join(values, "departamento", "left").groupBy("departamento", "n_valores", "mediana", "geografias").agg(
        F.coalesce(F.sum(F.when(F.col("cant_atenciones") < F.col("mediana"), F.col("_n"))), F.lit(0)).alias("_lt"),
        F.coalesce(F.sum(F.when(F.col("cant_atenciones") <= F.col("mediana"), F.col("_n"))), F.lit(0)).alias("_le")))
    e = F.lit(cfg.SKETCH_RANK_ERROR) * F.col("n_valores")
    half = F.col("n_valores") / 2
    return (rank.join(exact, "departamento", "left").select(
        "departamento", "n_valores",
        F.coalesce((F.col("_lt") <= half + e) & (F.col("_le") >= half - e), F.col("n_valores") == 0).alias("mediana_en_cota"),
        (F.abs(F.col("geografias") - F.col("_geo")) <= F.lit(cfg.SKETCH_DISTINCT_ERROR) * F.col("_geo"))
        .alias("geografias_en_cota")))
