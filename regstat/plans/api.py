"""Request-level entry points: parameter normalisation (C19) and metric
selection (R7). Parameters are resolved in Python before any plan is built;
they only ever become typed filter arguments, never SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from regstat import config as cfg
from regstat.operators import measures as M
from regstat.operators import reports as R
from regstat.operators import trend as T


@dataclass(frozen=True)
class Peticion:
    departamento: str | None
    anio: int | None
    anio_mensual: int


def normalizar(departamento: str | None = None, anio=None,
               params: cfg.Params = cfg.SOURCE) -> Peticion:
    """Upper-case region; absent or ``ALL`` means national; a year of
    0 / absent / not a number means no year; months default to the
    configured trend year."""
    dep = (departamento or "").strip().upper()
    dep = None if dep in ("", "ALL") else dep
    try:
        y = int(anio) if anio not in (None, "") else 0
    except (TypeError, ValueError):
        y = 0
    year = y or None
    return Peticion(dep, year, year or params.default_trend_year)


METRICAS = ("ranking", "tendencia", "tasa", "resumen")


def estadistica(metrica: str, fact: DataFrame, poblacion: DataFrame,
                peticion: Peticion) -> DataFrame:
    """Metric name -> DataFrame. ``ranking`` honours the year; the
    others are per region (all regions when none is given)."""
    if metrica == "ranking":
        return M.ordenar_ranking(M.ranking_departamentos(fact, peticion.anio))
    dep_fact = M.filtrar(fact, peticion.departamento)
    if metrica == "tendencia":
        return T.tendencia_regresion(dep_fact, poblacion)
    if metrica == "tasa":
        return M.tasa_incidencia(dep_fact, poblacion)
    if metrica == "resumen":
        return R.resumen_departamento(dep_fact, poblacion)
    raise ValueError(f"unknown metric {metrica!r}; expected one of {METRICAS}")


def panel(fact: DataFrame, peticion: Peticion, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """R2 / R3 by request: a region panel or the national panel."""
    if peticion.departamento is None:
        return R.panel_nacional(fact, peticion.anio)
    return R.panel_departamento(M.filtrar(fact, peticion.departamento), peticion.anio,
                                cfg.Params(**{**params.__dict__,
                                              "default_trend_year": peticion.anio_mensual}))


def casos_por_anio_sql(spark, fact: DataFrame, departamento: str, anio: int | None = None) -> DataFrame:
    """The parameterised scan as Spark SQL with bound positional
    parameters (values are never spliced into the SQL text); the fact is
    passed as a DataFrame argument."""
    sql = ("SELECT departamento, anio, COUNT(*) AS casos FROM {fact} "
           "WHERE departamento = ? AND (? IS NULL OR anio = ?) GROUP BY departamento, anio")
    return spark.sql(sql, args=[departamento, anio, anio], fact=fact)
