"""Window-shaped operators, top-k and derived measures.

Every window is partitioned by a low-cardinality key over *aggregated*
rows (regions x years x provinces), never over raw facts, so window
partitions are small no matter how large or skewed the fact is. Top-k
per group uses ``row_number`` <= k, which Spark prunes early with
``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.operators import measures as M


def top_departamentos(fact: DataFrame, n: int = 5, anio: int | None = None) -> DataFrame:
    """Global top-n regions (cases desc, name asc) with position;
    planned as a single TakeOrderedAndProject."""
    ranked = M.ordenar_ranking(M.ranking_departamentos(fact, anio)).limit(n)
    w = Window.orderBy(F.col("casos").desc(), F.col("departamento").asc())
    return ranked.withColumn("posicion", F.row_number().over(w).cast("int"))


def _top_por(df: DataFrame, group: list, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("posicion", F.row_number().over(w).cast("int"))
            .where(F.col("posicion") <= n))


def top_provincia(fact: DataFrame) -> DataFrame:
    """Top province per region (cases desc, name asc)."""
    return _top_por(M.provincias(fact), ["departamento"],
                    [F.col("casos").desc(), F.col("provincia").asc()], 1).drop("posicion")


def top_provincias(fact: DataFrame, n: int = cfg.TOP_PROVINCES,
                   min_provincias: int = cfg.MIN_PROVINCES_FOR_CHUNK) -> DataFrame:
    """W3 (+F6, W7): top-n provinces per region, only regions with at least
    ``min_provincias`` provinces; share of the region's total cases."""
    prov = M.provincias(fact)
    region = Window.partitionBy("departamento")
    prov = (prov.withColumn("total_depto", F.sum("casos").over(region))
            .withColumn("n_provincias", F.count(F.lit(1)).over(region)))
    top = _top_por(prov, ["departamento"], [F.col("casos").desc(), F.col("provincia").asc()], n)
    return (top.where(F.col("n_provincias") >= min_provincias)
            .withColumn("pct", C.share_pct("casos", "total_depto"))
            .select("departamento", "posicion", "provincia", "casos", "pct"))


def ranking_anual(fact: DataFrame, n: int = cfg.TOP_RANKING_CHUNK) -> DataFrame:
    """Top-n regions per year with position and the year's national
    total (the total is over all regions, not only the top n)."""
    agg = M.casos_por_anio(fact)
    year = Window.partitionBy("anio")
    agg = agg.withColumn("total_nacional", F.sum("casos").over(year).cast("bigint"))
    return _top_por(agg, ["anio"], [F.col("casos").desc(), F.col("departamento").asc()], n)


def participacion(fact: DataFrame) -> DataFrame:
    """Share (integer %) of each sex, band and province in its region."""
    def share(df, key, seccion):
        w = Window.partitionBy("departamento")
        return (df.withColumn("total", F.sum("casos").over(w))
                .select("departamento", F.lit(seccion).alias("seccion"),
                        F.col(key).alias("clave"), "casos",
                        C.share_pct("casos", "total").alias("pct")))
    fact = M.cubo(fact)
    return (share(M.distribucion_sexo(fact), "sexo", "sexo")
            .unionByName(share(M.distribucion_edad(fact), "grupo_etario", "edad"))
            .unionByName(share(M.provincias(fact), "provincia", "provincia")))


def intensidad(fact: DataFrame) -> DataFrame:
    """Value relative to the group maximum (maximum floored at 1) for
    provinces within a region and months within a region-year, in double."""
    def rel(df, group, key, seccion):
        w = Window.partitionBy(*group)
        mx = F.greatest(F.max("casos").over(w), F.lit(1)).cast("double")
        return df.select("departamento", F.lit(seccion).alias("seccion"),
                         (F.col("anio") if "anio" in group else F.lit(None).cast("int")).alias("anio"),
                         F.col(key).cast("string").alias("clave"), "casos",
                         (F.col("casos").cast("double") / mx).alias("relativo"))
    fact = M.cubo(fact)
    return (rel(M.provincias(fact), ["departamento"], "provincia", "provincia")
            .unionByName(rel(M.mensual_detalle(fact), ["departamento", "anio"], "mes", "mes")))


def pico_mensual(fact: DataFrame) -> DataFrame:
    """Peak month per (region, year); ties go to the earliest month."""
    return (M.mensual_detalle(fact).groupBy("departamento", "anio")
            .agg(F.max_by("mes", F.struct(F.col("casos"), -F.col("mes"))).alias("mes_pico"),
                 F.max("casos").alias("casos_pico")))


def kpi_departamento(fact: DataFrame) -> DataFrame:
    """R5 (W7, W10, W2): per region total, last year and its cases, % women
    over all sexes, top province and its cases."""
    fact = M.cubo(fact)
    by_year = (M.casos_por_anio(fact).groupBy("departamento")
               .agg(F.sum("casos").cast("bigint").alias("total_casos"),
                    F.max("anio").alias("ultimo_anio"),
                    F.max_by("casos", "anio").alias("casos_ultimo_anio")))
    sexo = (fact.groupBy("departamento")
            .agg(M.females().alias("femenino"), F.sum("casos").alias("total_sexo")))
    top = top_provincia(fact).select("departamento", F.col("provincia").alias("top_provincia"),
                                     F.col("casos").alias("casos_top_provincia"))
    return (by_year.join(sexo, "departamento").join(top, "departamento", "left")
            .withColumn("pct_femenino", C.share_pct("femenino", "total_sexo"))
            .drop("total_sexo"))


def kpi_nacional(fact: DataFrame, anio: int | None = None) -> DataFrame:
    """National total, number of regions with data, #1 and #2 (cases
    desc, name asc). Only the two first regions are sorted out (top-k
    per task), whatever the number of regions."""
    ranking = M.ranking_departamentos(fact, anio)
    first = ranking.orderBy(F.col("casos").desc(), F.col("departamento").asc()).limit(2)
    top = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("casos")).alias("neg"), "departamento"))).alias("_o"))
    totals = ranking.agg(F.sum("casos").cast("bigint").alias("total_casos"),
                         F.count(F.lit(1)).alias("departamentos"))
    both = (totals.withColumn("_o", F.lit(None).cast(top.schema["_o"].dataType))
            .unionByName(top, allowMissingColumns=True))  # two rows, folded into one
    return (both.agg(*[F.max(c).alias(c) for c in ("total_casos", "departamentos", "_o")])
            .select("total_casos", "departamentos",
                    F.get("_o", 0)["departamento"].alias("primero"),
                    (-F.get("_o", 0)["neg"]).alias("casos_primero"),
                    F.get("_o", 1)["departamento"].alias("segundo"),
                    (-F.get("_o", 1)["neg"]).alias("casos_segundo")))


def escala_mapa(fact: DataFrame, anio: int | None = None) -> DataFrame:
    """Choropleth colour per region: intensity = cases / max cases,
    channels base + slope * intensity rounded half up; the zone colour is
    the fallback when a region has no cases (not reachable from a ranking)
    and grey when the region has no zone."""
    # The ranking holds one row per region (a small dimension), so the
    # global maximum window runs over aggregated rows only.
    ranking = M.ranking_departamentos(fact, anio)
    mx = F.max("casos").over(Window.partitionBy()).cast("double")
    inten = F.col("casos").cast("double") / mx

    def channel(base_slope):
        base, slope = base_slope
        return C.round_half_up(F.lit(base) + inten * F.lit(slope), 0).cast("string")
    zones = F.create_map(*[x for k, v in cfg.ZONE_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return ranking.select(
        "departamento", "casos",
        C.round_half_up(inten, 4).alias("intensidad"),
        F.concat(F.lit("rgb("), channel(cfg.MAP_RED), F.lit(","), channel(cfg.MAP_GREEN),
                 F.lit(","), channel(cfg.MAP_BLUE), F.lit(")")).alias("color"),
        F.coalesce(F.try_element_at(zones, F.col("departamento")),
                   F.lit(cfg.MAP_DEFAULT_FILL)).alias("color_zona"))
