"""Report bundles (R1-R4, K2) in long form (departamento, seccion, clave, ...).

Each bundle reads the fact once: the count sections come from a single
``groupingSets`` aggregation (partial aggregation before the shuffle), and
every later step works on that small grouped result. Zero-filled frames
(region x year x sex) are built by exploding the fixed year / sex lists on
the small gazetteer, never by crossing large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.functions.sizing import materializar
from regstat.operators import clean as CL
from regstat.operators import measures as M
from regstat.operators import trend as T


def _sets(df: DataFrame, sets: dict, aggs: list) -> DataFrame:
    """groupingSets + a ``seccion`` label per set (from grouping_id),
    materialized once (``materializar``).

    The result is small (bounded by the dimensions) and every section reads
    it. Left as a plan, each section's ``seccion = X`` filter (on the
    grouping id, a grouping expression) and its own column pruning would be
    pushed below the aggregate into the Expand, so every section would
    recompute the whole input; the checkpoint makes it one computation.
    """
    cols = sorted({c for s in sets.values() for c in s})
    g = df.groupingSets([[F.col(c) for c in s] for s in sets.values()], *cols) \
        .agg(*aggs, F.grouping_id().alias("_gid"))
    label = F.lit(None).cast("string")
    for name, s in sets.items():
        gid = 0
        for c in cols:
            gid = (gid << 1) | (0 if c in s else 1)
        label = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(label)
    return materializar(g.withColumn("seccion", label).drop("_gid"))


def _long(df: DataFrame, seccion: str, clave, valor) -> DataFrame:
    return df.select("departamento", F.lit(seccion).alias("seccion"),
                     C.col_(clave).cast("string").alias("clave"), C.col_(valor).cast("double").alias("valor"))


def resumen_departamento(fact: DataFrame, poblacion: DataFrame,
                         departamento: str | None = None) -> DataFrame:
    """R1 for every region (or one): total and mean age (A14), cases per
    year, sex, age band (unknown excluded), province, and the trend
    (T1-T5) - long form (departamento, seccion, clave, valor)."""
    if departamento is not None:
        fact = fact.where(F.col("departamento") == F.lit(departamento))
    sets = {"total": ("departamento",), "por_anio": ("departamento", "anio"),
            "sexo": ("departamento", "sexo"), "edad": ("departamento", "grupo_etario"),
            "provincias": ("departamento", "provincia")}
    g = _sets(M.cubo(fact), sets, [M.cases(), M.mean_age().alias("edad_avg")])
    sec = F.col("seccion")
    total = g.where(sec == "total")
    parts = [
        _long(total, "total", F.lit("casos"), "casos"),
        _long(total, "total", F.lit("edad_promedio"),
              F.coalesce(C.round_half_up("edad_avg", 1), F.lit(0.0))),
        _long(g.where(sec == "por_anio"), "por_anio", "anio", "casos"),
        _long(g.where(sec == "sexo"), "sexo", "sexo", "casos"),
        _long(g.where((sec == "edad") & (F.col("grupo_etario") != cfg.UNKNOWN)), "edad", "grupo_etario", "casos"),
        _long(g.where(sec == "provincias"), "provincias", "provincia", "casos"),
    ]
    per_year = g.where(sec == "por_anio").select("departamento", "anio", "casos")
    k = T.coeficientes_desde(per_year, poblacion)
    stats = k.select("departamento", F.inline(F.array(*[
        F.struct(F.lit(n).alias("clave"), e.cast("double").alias("valor")) for n, e in (
            ("pendiente", C.round_half_up("m", 2)), ("intercepto", C.round_half_up("b", 2)),
            ("r_cuadrado", C.round_half_up("r2", 3)),
            ("media_tasa", F.floor(F.col("media100") + F.lit(0.5)) / F.lit(100)),
            ("desviacion", F.floor(F.col("sd100") + F.lit(0.5)) / F.lit(100)))])))
    parts.append(stats.select("departamento", F.lit("tendencia").alias("seccion"), "clave", "valor"))
    parts.append(k.where(F.col("m").isNotNull()).select(
        "departamento", F.lit("tendencia_clase").alias("seccion"), T.clasificar("m").alias("clave"),
        C.round_half_up("m", 2).alias("valor")))
    rates = per_year.join(poblacion.select("departamento", "anio", F.col("total").alias("_pob")),
                          ["departamento", "anio"], "left")
    proj = rates.join(k.select("departamento", "m", "b"), "departamento").where(F.col("m").isNotNull())
    parts.append(_long(proj, "tasa_proyectada", "anio",
                       C.round_half_up(F.col("m") * F.col("anio") + F.col("b"), 2)))
    parts.append(_long(rates, "tasa", "anio", C.crude_rate("casos", "_pob")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def panel_departamento(fact: DataFrame, anio: int | None = None,
                       params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """R2 for every region: cases per year (year filter NOT applied), sex,
    age band and province for the year (all years when none), months for the
    year or the default year - long form (departamento, seccion, clave, casos)."""
    mes_year = anio if anio is not None else params.default_trend_year
    in_year = F.lit(True) if anio is None else (F.col("anio") == F.lit(int(anio)))
    f = M.cubo(fact).withColumn("_y", in_year).withColumn("_m", F.col("anio") == F.lit(int(mes_year)))
    sets = {"por_anio": ("departamento", "anio"), "sexo": ("departamento", "_y", "sexo"),
            "edad": ("departamento", "_y", "grupo_etario"), "provincias": ("departamento", "_y", "provincia"),
            "mensual": ("departamento", "_m", "mes")}
    g = _sets(f, sets, [M.cases()])
    sec = F.col("seccion")
    key = (F.when(sec == "por_anio", F.col("anio").cast("string"))
           .when(sec == "sexo", F.col("sexo")).when(sec == "edad", F.col("grupo_etario"))
           .when(sec == "provincias", F.col("provincia")).otherwise(F.col("mes").cast("string")))
    keep = ((sec == "por_anio") | ((sec == "mensual") & F.col("_m"))
            | (sec.isin("sexo", "provincias") & F.col("_y"))
            | ((sec == "edad") & F.col("_y") & (F.col("grupo_etario") != cfg.UNKNOWN)))
    return g.where(keep).select("departamento", "seccion", key.alias("clave"), "casos")


def panel_nacional(fact: DataFrame, anio: int | None = None) -> DataFrame:
    """National total (A16) and the ranking (A5) for the year or all
    years ("todos") - long form (seccion, clave, casos, anio)."""
    f = M.cubo(fact) if anio is None else M.cubo(fact).where(F.col("anio") == F.lit(int(anio)))
    g = f.rollup("departamento").agg(M.cases(), F.grouping_id().alias("_gid"))
    label = F.lit("todos") if anio is None else F.lit(str(anio))
    return g.select(F.when(F.col("_gid") == 1, F.lit("total")).otherwise(F.lit("ranking")).alias("seccion"),
                    F.coalesce(F.col("departamento"), F.lit("PERU")).alias("clave"),
                    "casos", label.alias("anio"))


def reporte_regional(raw: DataFrame, gazetteer: DataFrame, poblacion: DataFrame,
                     params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """R4 (A12, A13, C17) for every gazetteer place at once, regional-mode
    semantics: a row counts for each place its raw residence text contains.

    Long form (departamento, seccion, anio, clave, valor) with ``anio`` the
    year text or ``total``. Zero-filled: per-year cases, sex per year and in
    total; visit statistics and population per year. Sparse: months, bands,
    provinces.
    """
    years = [str(y) for y in params.report_years]
    reg = (CL.asignar_regiones(CL.limpiar_regional(raw, params), gazetteer)
           .where(F.col("incluido"))
           .select("departamento", F.col("anio").cast("string").alias("anio_t"),
                   F.coalesce(F.col("mes").cast("string"), F.lit("NaN")).alias("mes_t"),
                   "sexo", "grupo_etario", "provincia", "cant_atenciones"))
    # One row per finest key; everything below works on these (bounded) rows.
    pre = materializar(reg.groupBy(*reg.columns).agg(F.count(F.lit(1)).alias("n")))
    sets = {"mes": ("departamento", "anio_t", "mes_t"), "sexo": ("departamento", "anio_t", "sexo"),
            "sexo_t": ("departamento", "sexo"), "grupo": ("departamento", "anio_t", "grupo_etario"),
            "grupo_t": ("departamento", "grupo_etario"), "prov": ("departamento", "anio_t", "provincia"),
            "prov_t": ("departamento", "provincia"), "anio": ("departamento", "anio_t")}
    g = _sets(pre, sets, [F.sum("n").alias("n")])
    sec = F.col("seccion")
    # Visit statistics, weighted by the counts; the exact median's state is a
    # value -> count map, bounded by the distinct visit counts.
    v, n = F.col("cant_atenciones"), F.col("n")
    avg = (F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))).alias("avg")
    visits = pre.groupBy("departamento", "anio_t").agg(
        avg, F.percentile(v, 0.5, n).alias("med"), F.max(v).alias("mx"))

    def sparse(seccion, name, key, total):
        return g.where(sec == name).select(
            "departamento", F.lit(seccion).alias("seccion"),
            (F.lit("total") if total else F.col("anio_t")).alias("anio"),
            F.col(key).alias("clave"), F.col("n").cast("double").alias("valor"))

    frame = (gazetteer.select(F.col("nombre").alias("departamento"))
             .select("departamento", F.explode(F.array(*[F.lit(y) for y in years])).alias("anio_t")))
    per_year = (frame.join(g.where(sec == "anio").select("departamento", "anio_t", "n"),
                           ["departamento", "anio_t"], "left")
                .join(poblacion.select("departamento", F.col("anio").cast("string").alias("anio_t"),
                                       "total", "hombres", "mujeres"), ["departamento", "anio_t"], "left")
                .join(visits, ["departamento", "anio_t"], "left"))
    casos = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    pob = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    anio_items = [("casos", casos), ("poblacion", pob),
                  ("tasa_por_100k", C.crude_rate(casos, F.nullif(pob, F.lit(0)))),
                  ("completo", F.when(F.col("anio_t") != str(params.partial_year), 1.0).otherwise(0.0))]
    visit_items = [("promedio", F.coalesce(C.round_half_up("avg", 2), F.lit(0.0))),
                   ("mediana", F.coalesce(F.col("med"), F.lit(0.0))),
                   ("max", F.coalesce(F.col("mx"), F.lit(0)))]
    pob_items = [("total", pob), ("hombres", F.coalesce(F.col("hombres"), F.lit(0))),
                 ("mujeres", F.coalesce(F.col("mujeres"), F.lit(0)))]

    def fan(df, items_by_section):
        structs = [F.struct(F.lit(s).alias("seccion"), F.lit(k).alias("clave"), e.cast("double").alias("valor"))
                   for s, items in items_by_section for k, e in items]
        return df.select("departamento", F.col("anio_t").alias("anio"), F.inline(F.array(*structs))) \
                 .select("departamento", "seccion", "anio", "clave", "valor")

    fixed = fan(per_year, [("por_anio", anio_items), ("atenciones", visit_items),
                           ("poblacion_inei", pob_items)])
    sex_frame = (gazetteer.select(F.col("nombre").alias("departamento"))
                 .select("departamento", F.explode(F.array(*[F.lit(y) for y in years + ["total"]])).alias("anio"))
                 .select("departamento", "anio", F.explode(F.array(*[F.lit(s) for s in cfg.SEXES])).alias("clave")))
    sex_counts = (g.where(sec.isin("sexo", "sexo_t") & F.col("sexo").isNotNull())
                  .select("departamento",
                          F.when(sec == "sexo_t", F.lit("total")).otherwise(F.col("anio_t")).alias("anio"),
                          F.col("sexo").alias("clave"), "n"))
    sexo = (sex_frame.join(sex_counts, ["departamento", "anio", "clave"], "left")
            .select("departamento", F.lit("por_sexo").alias("seccion"), "anio", "clave",
                    F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("valor")))
    avg_total = pre.groupBy("departamento").agg(avg)
    promedio_total = (gazetteer.select(F.col("nombre").alias("departamento"))
                      .join(avg_total, "departamento", "left")
                      .select("departamento", F.lit("atenciones").alias("seccion"), F.lit("total").alias("anio"),
                              F.lit("promedio_total").alias("clave"),
                              F.coalesce(C.round_half_up("avg", 2), F.lit(0.0)).alias("valor")))
    return (fixed.unionByName(sexo).unionByName(promedio_total)
            .unionByName(sparse("por_mes", "mes", "mes_t", False))
            .unionByName(sparse("por_grupo_etario", "grupo", "grupo_etario", False))
            .unionByName(sparse("por_grupo_etario", "grupo_t", "grupo_etario", True))
            .unionByName(sparse("por_provincia", "prov", "provincia", False))
            .unionByName(sparse("por_provincia", "prov_t", "provincia", True)))


def reporte_documentos(long: DataFrame, meta: dict | None = None,
                       params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """K2 for every place: one row per department with the source's typed
    document shape (``por_anio`` holds casos / poblacion / tasa_por_100k /
    completo, visits and population are structs, the other sections are
    year -> key -> count maps). Every fold is a group-by on the
    department (one small row each); sections are joined on it. ``meta``
    adds to, or replaces, the descriptive fields of the header."""
    fields = {"fuente_casos": cfg.SOURCE_NAME, "fuente_poblacion": "", "fecha_corte": "",
              "año_parcial": str(params.partial_year), "nota": cfg.SOURCE_NOTE, **(meta or {})}
    def val(name, typ):
        return F.max(F.when(F.col("clave") == name, F.col("valor"))).cast(typ)

    def by_year(seccion, fields):
        rows = (long.where(F.col("seccion") == seccion).groupBy("departamento", "anio")
                .agg(F.struct(*[val(n, t).alias(n) for n, t in fields]).alias("v")))
        return rows.groupBy("departamento").agg(
            F.map_from_entries(F.collect_list(F.struct("anio", "v"))).alias(seccion))

    def counts(seccion):
        inner = (long.where(F.col("seccion") == seccion).groupBy("departamento", "anio")
                 .agg(F.map_from_entries(F.collect_list(F.struct("clave", F.col("valor").cast("bigint"))))
                      .alias("m")))
        return inner.groupBy("departamento").agg(
            F.map_from_entries(F.collect_list(F.struct("anio", "m"))).alias(seccion))

    anio = by_year("por_anio", [("casos", "bigint"), ("poblacion", "bigint"), ("tasa_por_100k", "double"),
                                ("completo", "boolean")])
    visitas = by_year("atenciones", [("promedio", "double"), ("mediana", "double"), ("max", "bigint")])
    total_visitas = (long.where((F.col("seccion") == "atenciones") & (F.col("clave") == "promedio_total"))
                     .select("departamento", F.col("valor").alias("promedio_total")))
    pob = by_year("poblacion_inei", [("total", "bigint"), ("hombres", "bigint"), ("mujeres", "bigint")])
    doc = anio
    for part in (counts("por_mes"), counts("por_sexo"), counts("por_grupo_etario"), counts("por_provincia"),
                 pob, visitas.join(total_visitas, "departamento", "left")):
        doc = doc.join(part, "departamento", "left")
    casos_total = F.aggregate(F.map_values("por_anio"), F.lit(0).cast("bigint"), lambda a, x: a + x["casos"])
    return doc.select(
        "departamento",
        F.create_map(*[F.lit(x) for kv in fields.items() for x in kv],
                     F.lit("departamento"), F.col("departamento"),
                     F.lit("total_casos"), casos_total.cast("string")).alias("meta"),
        F.map_filter("por_anio", lambda k, v: k != "total").alias("por_año"),
        "por_mes", "por_sexo", "por_grupo_etario", "por_provincia",
        F.struct(F.col("promedio_total"), F.map_filter("atenciones", lambda k, v: k != "total").alias("por_año"))
         .alias("atenciones_cex"),
        F.col("poblacion_inei"))


def guardar_reportes(docs: DataFrame, path: str) -> None:
    """K2 sink: one JSON document set per department (folder per value)."""
    docs.write.mode("overwrite").partitionBy("departamento").json(path)


def reporte_largo(docs: DataFrame) -> DataFrame:
    """S3 back to the long form of ``reporte_regional``: one row per figure of
    the documents read (departamento, seccion, anio, clave, valor)."""
    def anual(seccion, column, fields):
        items = [F.struct(F.lit(k).alias("clave"), F.col("v")[k].cast("double").alias("valor")) for k in fields]
        return (docs.select("departamento", F.explode(column).alias("anio", "v"))
                .select("departamento", F.lit(seccion).alias("seccion"), "anio", F.inline(F.array(*items))))

    def conteos(seccion):
        return (docs.select("departamento", F.explode(seccion).alias("anio", "m"))
                .select("departamento", F.lit(seccion).alias("seccion"), "anio", F.explode("m").alias("clave", "_n"))
                .select("departamento", "seccion", "anio", "clave", F.col("_n").cast("double").alias("valor")))
    out = docs.select("departamento", F.lit("atenciones").alias("seccion"), F.lit("total").alias("anio"),
                      F.lit("promedio_total").alias("clave"), F.col("atenciones_cex.promedio_total").alias("valor"))
    for part in (anual("por_anio", "por_año", ("casos", "poblacion", "tasa_por_100k", "completo")),
                 anual("atenciones", "atenciones_cex.por_año", ("promedio", "mediana", "max")),
                 anual("poblacion_inei", "poblacion_inei", ("total", "hombres", "mujeres")),
                 *[conteos(s) for s in ("por_mes", "por_sexo", "por_grupo_etario", "por_provincia")]):
        out = out.unionByName(part)
    return out


def objeto_json(nivel: int, **campos) -> F.Column:
    """JSON text of an object as the source prints it: indented by two per
    level, one field a line. The values are JSON texts already."""
    inner = "  " * (nivel + 1)
    parts = []
    for i, (k, e) in enumerate(campos.items()):
        parts += [F.lit(f'{",\n" if i else "{\n"}{inner}"{k}": '), e]
    return F.concat(*parts, F.lit("\n" + "  " * nivel + "}"))


def lista_json(nivel: int, items) -> F.Column:
    """JSON text of a list (an array column of JSON texts), one item a line."""
    inner = "\n" + "  " * (nivel + 1)
    return F.when(F.size(items) > 0, F.concat(F.lit("[" + inner), F.concat_ws("," + inner, items),
                                              F.lit("\n" + "  " * nivel + "]"))).otherwise(F.lit("[]"))


def resumen_vacio(departamento) -> F.Column:
    """The summary object of a region without cases."""
    empty = F.lit("[]")
    return objeto_json(0, **{
        "departamento": C.json_string(departamento), "total_casos": F.lit("0"), "edad_promedio": F.lit("0"),
        "por_año": empty, "sexo": empty, "edad": empty, "provincias": empty, "tendencia": F.lit("null")})


def ranking_json(fact: DataFrame) -> DataFrame:
    """The ranking object of the prompt: (anio, datos_sql) per year, and for
    all years under anio 0; ten regions each."""
    from regstat.operators import ranking as W

    by_year = W.ranking_anual(fact, cfg.TOP_RANKING_CONTEXT).select("anio", "posicion", "departamento", "casos")
    overall = W.top_departamentos(fact, cfg.TOP_RANKING_CONTEXT).select(
        F.lit(0).alias("anio"), "posicion", "departamento", "casos")
    item = objeto_json(2, departamento=C.json_string("departamento"), casos=F.col("casos").cast("string"))
    return (by_year.unionByName(overall).withColumn("j", item).groupBy("anio")
            .agg(F.array_sort(F.collect_list(F.struct("posicion", "j"))).alias("l"))
            .select("anio", objeto_json(0, ranking=lista_json(1, F.transform("l", lambda x: x["j"]))).alias("datos_sql")))


def resumen_json(fact: DataFrame, poblacion: DataFrame) -> DataFrame:
    """R1 as the JSON object of the prompt, one row (departamento, datos_sql)
    per region: total, mean age, cases per year, sex, age band (label order)
    and province (cases desc, name), and the trend with its yearly points
    (``null`` below two points). Every list is one of the region's breakdowns,
    so a row is as long as a region has provinces, as the feature asks."""
    c = materializar(M.cubo(fact))

    def s(x):
        return C.col_(x).cast("string")

    def lista(df, name, nivel, order, **campos):
        return (df.select("departamento", F.struct(*order, objeto_json(nivel + 1, **campos).alias("j")).alias("x"))
                .groupBy("departamento").agg(F.array_sort(F.collect_list("x")).alias("x"))
                .select("departamento", lista_json(nivel, F.transform("x", lambda x: x["j"])).alias(name)))

    def texto(col):
        return C.json_string(col)

    base = c.groupBy("departamento").agg(M.cases(), F.coalesce(
        C.round_half_up(M.mean_age(), 1), F.lit(0.0)).alias("edad_promedio"))
    anios = M.casos_por_anio(c)
    rates = T.tasas(anios, poblacion)
    k = T.coeficientes_de_tasas(rates).where(F.col("m").isNotNull())
    points = rates.join(k.select("departamento", "m", "b"), "departamento")
    parts = [
        lista(anios, "_anios", 1, ["anio"], **{"año": s("anio"), "casos": s("casos")}),
        lista(M.distribucion_sexo(c), "_sexo", 1, ["sexo"], sexo=texto("sexo"), casos=s("casos")),
        lista(M.distribucion_edad(c), "_edad", 1, ["grupo_etario"],
              grupo_etario=texto("grupo_etario"), casos=s("casos")),
        lista(M.provincias(c), "_prov", 1, [(-F.col("casos")).alias("o"), "provincia"],
              provincia=texto("provincia"), casos=s("casos")),
        lista(points, "_datos", 2, ["anio"], **{
            "año": s("anio"), "casos": s("casos"), "tasa": C.js_number("tasa", 2),
            "tasa_proyectada": C.js_number(C.round_half_up(F.col("m") * F.col("anio") + F.col("b"), 2), 2)}),
        k,
    ]
    out = base
    for p in parts:
        out = out.join(p, "departamento", "left")

    def cents(x):
        return C.js_number(F.floor(F.col(x) + F.lit(0.5)) / F.lit(100), 2)

    trend = objeto_json(
        1, pendiente=C.js_number(C.round_half_up("m", 2), 2), intercepto=C.js_number(C.round_half_up("b", 2), 2),
        r_cuadrado=F.coalesce(C.js_number(C.round_half_up("r2", 3), 3), F.lit("null")),
        tendencia=texto(T.clasificar("m")), media_tasa=cents("media100"), desviacion=cents("sd100"),
        datos=F.col("_datos"))
    empty = F.lit("[]")
    return out.select("departamento", objeto_json(0, **{
        "departamento": texto("departamento"), "total_casos": s("casos"),
        "edad_promedio": C.js_number("edad_promedio", 1), "por_año": F.col("_anios"), "sexo": F.col("_sexo"),
        "edad": F.coalesce("_edad", empty), "provincias": F.col("_prov"),
        "tendencia": F.when(F.col("m").isNotNull(), trend).otherwise(F.lit("null"))}).alias("datos_sql"))
