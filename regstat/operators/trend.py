"""Trend statistics per region.

Ordinary least squares of the crude rate on the year, per region, in one
grouped aggregation over the (region, year) rate table. Rates of 0 (no
population or no cases) are left out of the fit; fewer than two points give
nulls. The sums are taken on integers (rate x 100 as an exact bigint, year
as bigint) and each statistic is one double division of exact integer
numerators, so the result does not depend on summation order (identical on
any partitioning, and equal to an independent SQL engine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.operators import measures as M


def _sums(rates: DataFrame) -> DataFrame:
    pt = F.col("y100").isNotNull() & (F.col("y100") != 0)
    x = F.col("anio").cast("bigint")
    y = F.col("y100")

    def s(e):
        return F.sum(F.when(pt, e)).cast("bigint")
    return rates.groupBy("departamento").agg(
        F.count_if(pt).alias("n_puntos"), s(x).alias("sx"), s(y).alias("sy"),
        s(x * y).alias("sxy"), s(x * x).alias("sxx"), s(y * y).alias("syy"))


def coeficientes(fact: DataFrame, poblacion: DataFrame,
                 min_points: int = cfg.MIN_TREND_POINTS,
                 scale: int = cfg.RATE_SCALE) -> DataFrame:
    """Unrounded slope ``m`` and intercept ``b`` plus the exact sums."""
    return coeficientes_desde(M.casos_por_anio(fact), poblacion, min_points, scale)


def tasas(agg: DataFrame, poblacion: DataFrame, scale: int = cfg.RATE_SCALE) -> DataFrame:
    """(departamento, anio, casos) + population, rate and exact rate x 100."""
    pob = poblacion.select("departamento", "anio", F.col("total").alias("_pob"))
    return (agg.join(pob, ["departamento", "anio"], "left")
            .withColumn("poblacion", F.coalesce(F.col("_pob"), F.lit(0).cast("bigint")))
            .withColumn("tasa", C.crude_rate(F.col("casos"), F.col("_pob"), scale))
            .withColumn("y100", C.rate_hundredths(F.col("casos"), F.col("_pob"), scale))
            .drop("_pob"))


def coeficientes_desde(agg: DataFrame, poblacion: DataFrame,
                       min_points: int = cfg.MIN_TREND_POINTS,
                       scale: int = cfg.RATE_SCALE) -> DataFrame:
    """Same, from precomputed (departamento, anio, casos) rows."""
    return coeficientes_de_tasas(tasas(agg, poblacion, scale), min_points)


def coeficientes_de_tasas(rates: DataFrame, min_points: int = cfg.MIN_TREND_POINTS) -> DataFrame:
    """Same, from a rate table with the exact ``y100`` column."""
    s = _sums(rates)
    n = F.col("n_puntos").cast("bigint")
    ok = F.col("n_puntos") >= min_points
    dx = (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    num = (n * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    dy = (n * F.col("syy") - F.col("sy") * F.col("sy")).cast("double")
    bnum = (F.col("sy") * F.col("sxx") - F.col("sx") * F.col("sxy")).cast("double")
    return s.select(
        "departamento", "n_puntos",
        F.when(ok, num / dx / F.lit(100)).alias("m"),
        F.when(ok, bnum / dx / F.lit(100)).alias("b"),
        F.when(ok & (dy != 0), num * num / (dx * dy)).alias("r2"),
        F.when(ok, F.col("sy").cast("double") / n).alias("media100"),
        F.when(ok, F.sqrt(dy) / n).alias("sd100"))


def tendencia_regresion(fact: DataFrame, poblacion: DataFrame) -> DataFrame:
    """Slope, intercept (2 digits), R^2 (3 digits; null when all
    rates are equal), mean and population standard deviation of the rates."""
    k = coeficientes(fact, poblacion)
    return k.select(
        "departamento", "n_puntos",
        C.round_half_up("m", 2).alias("pendiente"),
        C.round_half_up("b", 2).alias("intercepto"),
        C.round_half_up("r2", 3).alias("r_cuadrado"),
        (F.floor(F.col("media100") + F.lit(0.5)) / F.lit(100)).alias("media_tasa"),
        (F.floor(F.col("sd100") + F.lit(0.5)) / F.lit(100)).alias("desviacion"))


def clasificar(m) -> "F.Column":
    """T4: rising above +0.5, falling below -0.5, else stable (unrounded)."""
    m = C.col_(m)
    up, down, flat = cfg.TREND_LABELS
    return (F.when(m > cfg.TREND_THRESHOLD, F.lit(up))
            .when(m < -cfg.TREND_THRESHOLD, F.lit(down))
            .when(m.isNotNull(), F.lit(flat)))


def tendencia_clase(fact: DataFrame, poblacion: DataFrame) -> DataFrame:
    """T4 per region (null label when there is no fit)."""
    k = coeficientes(fact, poblacion)
    return k.select("departamento", C.round_half_up("m", 2).alias("pendiente"),
                    clasificar("m").alias("tendencia"))


def tendencia_proyeccion(fact: DataFrame, poblacion: DataFrame) -> DataFrame:
    """T5: projected rate m*x + b (2 digits) for every year of the region,
    including years left out of the fit."""
    rates = tasas(M.casos_por_anio(fact), poblacion)
    k = coeficientes_de_tasas(rates).select("departamento", "m", "b")
    return (rates.join(k, "departamento", "left")
            .withColumn("tasa_proyectada",
                        C.round_half_up(F.col("m") * F.col("anio") + F.col("b"), 2))
            .select("departamento", "anio", "casos", "tasa", "tasa_proyectada"))
