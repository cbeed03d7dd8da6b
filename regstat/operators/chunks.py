"""Text chunks for retrieval.

Six families of summary sentences built from grouped aggregates of the
analytic fact, with their key and JSON metadata. Sentences are assembled
with ``concat`` / ``format_number`` on the executors; lists inside a
sentence come from ``collect_list`` over groups that are bounded by
construction (<= 12 months, <= 8 age bands, <= 5 provinces, <= 10 ranks).
Numbers are printed the way the source prints them (no trailing zeros,
en-US thousands separators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.functions.sizing import materializar
from regstat.operators import measures as M
from regstat.operators import ranking as W

CHUNK_COLUMNS = ("chunk_type", "chunk_key", "content", "metadata_json")


def _s(c) -> F.Column:
    return C.col_(c).cast("string")


def _out(df: DataFrame, tipo: str, key, content, meta) -> DataFrame:
    return df.select(F.lit(tipo).alias("chunk_type"), key.alias("chunk_key"),
                     content.alias("content"), meta.alias("metadata_json"))


def chunk_depto_anio(fact: DataFrame, poblacion: DataFrame,
                     params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """One sentence per (region, year): cases, rate (omitted without
    population), % women and 100 - % women, mean age, partial-year note."""
    a = M.resumen_depto_anio(fact, poblacion)
    pct = C.share_pct("femenino", "casos")
    edad = F.coalesce(C.js_number("edad_promedio", 1), F.lit("null"))
    tasa = C.js_number("tasa", 2)
    parcial = F.when(F.col("anio") == params.partial_year, F.lit(cfg.PARTIAL_NOTE_LONG)).otherwise(F.lit(""))
    tasa_txt = F.when(F.col("con_poblacion"), C.template(cfg.TPL_DEPTO_ANIO_TASA, tasa=tasa)).otherwise(F.lit(""))
    content = C.template(cfg.TPL_DEPTO_ANIO, anio=F.col("anio"), parcial=parcial,
                         departamento=F.col("departamento"), casos=F.col("casos"), fuente=cfg.SOURCE_NAME,
                         tasa=tasa_txt, pct_femenino=pct, pct_masculino=F.lit(100) - pct, edad=edad)
    meta = F.concat(F.lit('{"departamento":'), C.json_string("departamento"), F.lit(',"año":'), _s("anio"),
                    F.lit(',"casos":'), _s("casos"), F.lit(',"tasa":'), tasa, F.lit("}"))
    key = F.concat(F.col("departamento"), F.lit("_"), _s("anio"))
    return _out(a, cfg.CHUNK_DEPTO_ANIO, key, content, meta)


def chunk_depto_total(fact: DataFrame, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """One sentence per region: total (thousands separators), % women,
    mean age and the top province with its share."""
    fact = M.cubo(fact)
    a = M.resumen_depto_total(fact)
    top = W.top_provincia(fact).select("departamento", F.col("provincia").alias("top_prov"),
                                       F.col("casos").alias("top_casos"))
    a = a.join(top, "departamento", "left")
    pct = C.share_pct("femenino", "casos")
    edad = F.coalesce(C.js_number("edad_promedio", 1), F.lit("null"))
    prov = F.when(F.col("top_prov").isNotNull(), C.template(
        cfg.TPL_DEPTO_TOTAL_PROV, provincia=F.col("top_prov"), casos=F.col("top_casos"),
        pct=C.share_pct("top_casos", "casos"))).otherwise(F.lit(""))
    content = C.template(cfg.TPL_DEPTO_TOTAL, departamento=F.col("departamento"), casos=C.thousands("casos"),
                         desde=str(params.first_year), hasta=str(params.last_year), fuente=cfg.SOURCE_NAME,
                         pct_femenino=pct, edad=edad, provincia=prov)
    meta = F.concat(F.lit('{"departamento":'), C.json_string("departamento"),
                    F.lit(',"casos":'), _s("casos"), F.lit("}"))
    key = F.concat(F.col("departamento"), F.lit("_total"))
    return _out(a, cfg.CHUNK_DEPTO_TOTAL, key, content, meta)


def chunk_mensual(fact: DataFrame, min_months: int = cfg.MIN_MONTHS_FOR_CHUNK) -> DataFrame:
    """Monthly series per (region, year) with at least ``min_months``
    months: ``Ene=n, ...`` in month order, the peak (earliest month on
    ties) and the mean over the months present."""
    m = M.mensual_detalle(fact)
    g = (m.groupBy("departamento", "anio")
         .agg(F.array_sort(F.collect_list(F.struct("mes", "casos"))).alias("serie"),
              F.max_by("mes", F.struct(F.col("casos"), -F.col("mes"))).alias("mes_pico"),
              F.max("casos").alias("casos_pico"),
              F.sum("casos").alias("suma"), F.count(F.lit(1)).alias("n_meses"))
         .where(F.col("n_meses") >= min_months))
    serie = F.concat_ws(cfg.TPL_LIST_SEPARATOR, F.transform("serie", lambda x: C.template(
        cfg.TPL_MENSUAL_ITEM, mes=C.month_label(x["mes"]), casos=x["casos"])))
    prom = C.round_half_up(F.col("suma") / F.col("n_meses"), 0)
    content = C.template(cfg.TPL_MENSUAL, departamento=F.col("departamento"), anio=F.col("anio"),
                         serie=serie, mes_pico=C.month_label("mes_pico"), casos_pico=F.col("casos_pico"),
                         promedio=prom)
    meta = F.concat(F.lit('{"departamento":'), C.json_string("departamento"),
                    F.lit(',"año":'), _s("anio"), F.lit("}"))
    key = F.concat(F.col("departamento"), F.lit("_"), _s("anio"))
    return _out(g, cfg.CHUNK_MENSUAL, key, content, meta)


def chunk_ranking(fact: DataFrame, params: cfg.Params = cfg.SOURCE,
                  n: int = cfg.TOP_RANKING_CHUNK) -> DataFrame:
    """Top-n regions per year of the year list, with the national total;
    a year without cases still gets its (empty) sentence."""
    spark = fact.sparkSession
    years = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in params.years])).alias("anio"))
    top = W.ranking_anual(fact, n)
    per_year = (top.groupBy("anio")
                .agg(F.array_sort(F.collect_list(F.struct("posicion", "departamento", "casos"))).alias("top"),
                     F.max("total_nacional").alias("total")))
    g = years.join(per_year, "anio", "left")
    rank = F.concat_ws(cfg.TPL_LIST_SEPARATOR, F.transform(
        F.coalesce("top", F.array().cast(per_year.schema["top"].dataType)),
        lambda x: C.template(cfg.TPL_RANKING_ITEM, posicion=x["posicion"], departamento=x["departamento"],
                             casos=x["casos"])))
    parcial = F.when(F.col("anio") == params.partial_year, F.lit(cfg.PARTIAL_NOTE_SHORT)).otherwise(F.lit(""))
    content = C.template(cfg.TPL_RANKING, fuente=cfg.SOURCE_NAME, anio=F.col("anio"), parcial=parcial,
                         ranking=rank, total=C.thousands(F.coalesce(F.col("total"), F.lit(0).cast("bigint"))))
    meta = F.concat(F.lit('{"año":'), _s("anio"), F.lit("}"))
    key = F.concat(F.lit("ranking_"), _s("anio"))
    return _out(g, cfg.CHUNK_RANKING, key, content, meta)


def chunk_edad(fact: DataFrame, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """Age bands per region (label order) with their share, and the
    band with most cases (lowest label on ties)."""
    e = M.edad_por_depto(fact)
    g = (e.groupBy("departamento")
         .agg(F.array_sort(F.collect_list(F.struct("grupo_etario", "casos"))).alias("grupos"),
              F.sum("casos").alias("total"),
              F.min_by("grupo_etario", F.struct(-F.col("casos"), F.col("grupo_etario"))).alias("g_max"),
              F.max("casos").alias("c_max")))
    grupos = F.concat_ws(cfg.TPL_LIST_SEPARATOR, F.transform("grupos", lambda x: C.template(
        cfg.TPL_EDAD_ITEM, grupo=x["grupo_etario"], casos=x["casos"],
        pct=C.share_pct(x["casos"], F.col("total")))))
    content = C.template(cfg.TPL_EDAD, departamento=F.col("departamento"), desde=str(params.first_year),
                         hasta=str(params.last_year), grupos=grupos, grupo=F.col("g_max"),
                         casos=F.col("c_max"), pct=C.share_pct("c_max", "total"))
    meta = F.concat(F.lit('{"departamento":'), C.json_string("departamento"), F.lit("}"))
    key = F.concat(F.col("departamento"), F.lit("_edad"))
    return _out(g, cfg.CHUNK_EDAD, key, content, meta)


def chunk_provincias(fact: DataFrame, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """Top-5 provinces per region (regions with >= 2 provinces) with
    their share of the region's total."""
    t = W.top_provincias(fact)
    g = (t.groupBy("departamento")
         .agg(F.array_sort(F.collect_list(F.struct("posicion", "provincia", "casos", "pct"))).alias("p")))
    provs = F.concat_ws(cfg.TPL_LIST_SEPARATOR, F.transform("p", lambda x: C.template(
        cfg.TPL_PROVINCIAS_ITEM, provincia=x["provincia"], casos=x["casos"], pct=x["pct"])))
    content = C.template(cfg.TPL_PROVINCIAS, departamento=F.col("departamento"), desde=str(params.first_year),
                         hasta=str(params.last_year), provincias=provs)
    meta = F.concat(F.lit('{"departamento":'), C.json_string("departamento"), F.lit("}"))
    key = F.concat(F.col("departamento"), F.lit("_provincias"))
    return _out(g, cfg.CHUNK_PROVINCIAS, key, content, meta)


def chunks_todos(fact: DataFrame, poblacion: DataFrame, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """The six families appended (bag union) over one cube. It is small
    and materialized once (``materializar``): as a plan, every family would
    push its own filters and columns into it and scan the fact again."""
    fact = materializar(M.cubo(fact))
    return (chunk_depto_anio(fact, poblacion, params)
            .unionByName(chunk_depto_total(fact, params))
            .unionByName(chunk_mensual(fact))
            .unionByName(chunk_ranking(fact, params))
            .unionByName(chunk_edad(fact, params))
            .unionByName(chunk_provincias(fact, params)))
