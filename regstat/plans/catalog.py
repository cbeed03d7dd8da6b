"""Query catalog: key -> callable(spark, sf_dir) -> DataFrame.

Each key wires the stand-in inputs (``regstat.sources.standard``) into one
operator of the library and computes it over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.operators import chunks as X
from regstat.operators import clean as CL
from regstat.operators import measures as M
from regstat.operators import publish as PUB
from regstat.operators import questions as QA
from regstat.operators import ranking as W
from regstat.operators import reports as R
from regstat.operators import trend as T
from regstat.operators import vectors as V
from regstat.operators import warehouse as WH
from regstat.plans import api as API
from regstat.sources import standard as S
from regstat.sources.population import population_for_code
from regstat.sources.registry import codificar_blob, decodificar_blob, guardar_chunks, read_report, scan_chunks

P = cfg.STANDIN
Q: dict = {}


def key(name: str):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _raiz(spark, sf) -> str:
    """Folder of the dataset's published star: loaded from the registry CSV
    and the population sheets the first time."""
    root = f"{S.carpeta(spark, sf)}/estrella"
    if not PUB.publicaciones(spark, root):
        clean = CL.limpiar_nacional(S.registro_csv(spark, sf, detalle=True), P)
        PUB.cargar(spark, clean, S.poblacion_desde_hojas(spark, sf, P), root, P)
    return root


def _star(spark, sf):
    return PUB.abrir_estrella(spark, _raiz(spark, sf))


def _fact(spark, sf):
    return WH.vista_analitica(_star(spark, sf))


def _pob(spark, sf):
    return _star(spark, sf)["poblacion"]


@key("casos_por_anio")
def _q_casos_por_anio(spark: SparkSession, sf: str) -> DataFrame:
    return M.casos_por_anio(_fact(spark, sf))


@key("tasa_incidencia")
def _q_tasa_incidencia(spark: SparkSession, sf: str) -> DataFrame:
    return M.tasa_incidencia(_fact(spark, sf), _pob(spark, sf))


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------


def _simple(name, fn):
    Q[name] = lambda spark, sf: fn(_fact(spark, sf))


_simple("distribucion_sexo", M.distribucion_sexo)
_simple("distribucion_edad", M.distribucion_edad)
_simple("ranking_departamentos", M.ranking_departamentos)
_simple("tendencia_mensual", M.tendencia_mensual)
_simple("provincias", M.provincias)
_simple("resumen_depto_total", M.resumen_depto_total)
_simple("mensual_detalle", M.mensual_detalle)
_simple("edad_por_depto", M.edad_por_depto)
_simple("atenciones", M.atenciones)
Q["resumen_depto_anio"] = lambda spark, sf: M.resumen_depto_anio(_fact(spark, sf), _pob(spark, sf))

# ---------------------------------------------------------------------------
# Windows, top-k, KPIs
# ---------------------------------------------------------------------------
_simple("top5_departamentos", lambda f: W.top_departamentos(f, 5))
_simple("top_provincia", W.top_provincia)
_simple("top_provincias", W.top_provincias)
_simple("ranking_anual", W.ranking_anual)
_simple("participacion", W.participacion)
_simple("intensidad", W.intensidad)
_simple("pico_mensual", W.pico_mensual)
_simple("kpi_departamento", W.kpi_departamento)
_simple("kpi_nacional", W.kpi_nacional)
_simple("escala_mapa", W.escala_mapa)

# ---------------------------------------------------------------------------
# Trend (T1-T5)
# ---------------------------------------------------------------------------
Q["tendencia_regresion"] = lambda spark, sf: T.tendencia_regresion(_fact(spark, sf), _pob(spark, sf))
Q["tendencia_clase"] = lambda spark, sf: T.tendencia_clase(_fact(spark, sf), _pob(spark, sf))
Q["tendencia_proyeccion"] = lambda spark, sf: T.tendencia_proyeccion(_fact(spark, sf), _pob(spark, sf))


# ---------------------------------------------------------------------------
# Raw registry cleaning, star schema, audit
# ---------------------------------------------------------------------------


def _raw(spark, sf):
    return S.registro_csv(spark, sf)


def _modes(national, regional):
    return lambda spark, sf: CL.comparar_modos(_raw(spark, sf), national, regional, P)


Q["limpiar_texto"] = _modes(["uuid_hash", "sexo"], ["sexo"])
Q["entero_tolerante"] = _modes(["edad", "cant_atenciones"], [])
Q["periodo_valido"] = _modes(["fecha", "anio", "mes", "valido"], ["incluido"])
Q["grupo_etario"] = _modes(["edad", "grupo_etario"], ["grupo_etario"])
Q["separar_lugar"] = _modes(["departamento", "provincia", "distrito"], ["provincia"])


@key("filtro_contiene")
def _q_filtro_contiene(spark, sf):
    reg = CL.asignar_regiones(CL.limpiar_regional(_raw(spark, sf), P), S.gazetteer_regiones(spark, sf))
    return reg.groupBy("departamento").agg(F.count(F.lit(1)).alias("filas"),
                                           F.count_if("incluido").alias("filas_incluidas"))


Q["dim_tiempo"] = lambda spark, sf: _star(spark, sf)["dim_tiempo"].drop("tiempo_id")
Q["dim_geografia"] = lambda spark, sf: _star(spark, sf)["dim_geografia"].drop("geografia_id")
Q["dim_paciente"] = lambda spark, sf: _star(spark, sf)["dim_paciente"].drop("paciente_id")
Q["auditoria_carga"] = lambda spark, sf: PUB.auditoria_publicada(spark, _raiz(spark, sf))
Q["conteo_tablas"] = lambda spark, sf: PUB.conteo_tablas(_star(spark, sf))
Q["integridad_referencial"] = lambda spark, sf: WH.integridad_referencial(_star(spark, sf))


@key("atenciones_bocetos")
def _q_atenciones_bocetos(spark, sf):
    star = _star(spark, sf)
    return M.error_bocetos(star["bocetos"], WH.vista_analitica(star), star["dim_geografia"])


@key("registro_validado")
def _q_registro_validado(spark, sf):
    path = S.escrito(spark, f"{S.carpeta(spark, sf)}/validado", lambda p: PUB.escribir_validado(
        S.registro_danado_csv(spark, sf), PUB.ESQUEMA_REGISTRO, p))
    return PUB.conteo_validado(*PUB.leer_validado(spark, PUB.ESQUEMA_REGISTRO, path))


# ---------------------------------------------------------------------------
# Text chunks
# ---------------------------------------------------------------------------

Q["chunk_depto_anio"] = lambda spark, sf: X.chunk_depto_anio(_fact(spark, sf), _pob(spark, sf), P)
Q["chunk_depto_total"] = lambda spark, sf: X.chunk_depto_total(_fact(spark, sf), P)
Q["chunk_mensual"] = lambda spark, sf: X.chunk_mensual(_fact(spark, sf))
Q["chunk_ranking"] = lambda spark, sf: X.chunk_ranking(_fact(spark, sf), P)
Q["chunk_edad"] = lambda spark, sf: X.chunk_edad(_fact(spark, sf), P)
Q["chunk_provincias"] = lambda spark, sf: X.chunk_provincias(_fact(spark, sf), P)
Q["chunks_todos"] = lambda spark, sf: X.chunks_todos(_fact(spark, sf), _pob(spark, sf), P)


# ---------------------------------------------------------------------------
# Vectors (S4, V1-V4, F4)
# ---------------------------------------------------------------------------

TOPK_TYPES = [cfg.CHUNK_MENSUAL, cfg.CHUNK_PROVINCIAS]


def _scan(spark, sf):
    return scan_chunks(S.corpus(spark, sf))


@key("chunks_scan")
def _q_chunks_scan(spark, sf):
    return _scan(spark, sf).select("vec_id", "chunk_type", "meta_departamento", "meta_anio",
                                   F.size("embedding").alias("dim"),
                                   C.round_half_up(V.norma("embedding"), 6).alias("norma"))


def _guardados(spark, sf):
    """K3: the chunk table with its vectors, written and read back."""
    c = S.corpus(spark, sf).select("chunk_type", F.col("vec_id").cast("string").alias("chunk_key"),
                                   F.concat(F.lit("fragmento "), "vec_id").alias("content"), "embedding", "metadata_json")
    return spark.read.parquet(S.escrito(spark, f"{S.carpeta(spark, sf)}/fragmentos", lambda p: guardar_chunks(c, p)))


@key("chunks_guardados")
def _q_chunks_guardados(spark, sf):
    return scan_chunks(_guardados(spark, sf)).select(
        "chunk_key", "content", "chunk_type", "meta_departamento", "meta_anio",
        C.round_half_up(V.norma("embedding"), 6).alias("norma"))


@key("vectores_blob")
def _q_vectores_blob(spark, sf):
    """S4 in the legacy form: vectors as bytes, decoded."""
    blobs = _guardados(spark, sf).select("chunk_key", codificar_blob("embedding").alias("b"))
    decoded = blobs.select("chunk_key", F.octet_length("b").alias("bytes"), decodificar_blob("b").alias("v"))
    return decoded.where("v is not null").select("chunk_key", "bytes", F.size("v").alias("dim"),
                                                 C.round_half_up(V.norma("v"), 6).alias("norma"))


def _with_rep(spark, sf):
    c = _scan(spark, sf)
    return c.join(V.representantes(c), "label")


@key("vector_coseno")
def _q_vector_coseno(spark, sf):
    return _with_rep(spark, sf).select(
        "vec_id", "label", C.round_half_up(V.coseno("embedding", "q_embedding"), 6).alias("coseno"))


@key("vector_boost")
def _q_vector_boost(spark, sf):
    j = _with_rep(spark, sf)
    s = V.boost(V.coseno("embedding", "q_embedding"), "meta_departamento", "meta_anio",
                "q_departamento", "q_anio")
    return j.select("vec_id", "label", C.round_half_up(s, 6).alias("puntaje"))


def _topk(spark, sf, types=None):
    c = _scan(spark, sf)
    q = c.where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_embedding"),
        F.col("meta_departamento").alias("q_departamento"), F.col("meta_anio").alias("q_anio"))
    r = V.topk(q, c, cfg.TOP_K, types)
    return r.select("query_id", "vec_id", "posicion", C.round_half_up("score", 6).alias("puntaje"))


Q["vector_topk"] = lambda spark, sf: _topk(spark, sf)
Q["vector_topk_tipo"] = lambda spark, sf: _topk(spark, sf, TOPK_TYPES)


@key("embeber_chunks")
def _q_embeber_chunks(spark, sf):
    ch = X.chunks_todos(_fact(spark, sf), _pob(spark, sf), P)
    e = V.embed(ch, "content", 64)
    return e.select("chunk_type", "chunk_key", F.size("embedding").alias("dim"),
                    C.round_half_up(V.norma("embedding"), 6).alias("norma"),
                    F.size(F.filter("embedding", lambda x: x != 0)).alias("no_cero"),
                    C.round_half_up(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
                    .alias("suma"))


# ---------------------------------------------------------------------------
# Questions and answers (Q1, Q2, Q4-Q7)
# ---------------------------------------------------------------------------


@key("detectar_filtros")
def _q_detectar_filtros(spark, sf):
    return QA.detectar_filtros(S.preguntas(spark, sf), S.gazetteer_regiones(spark, sf), P.years)


def _parsed(spark, sf):
    return QA.parsear_respuestas(S.respuestas(spark, sf))


Q["parsear_respuestas"] = lambda spark, sf: _parsed(spark, sf).select(
    "conv_id", "turn", "texto", "tiene_grafica", "grafica_tipo", "n_datos")
Q["grafica_valida"] = lambda spark, sf: QA.grafica_valida(_parsed(spark, sf), ["conv_id", "turn"])
Q["historial"] = lambda spark, sf: QA.historial(S.conversaciones(spark, sf))
Q["historial_listas"] = lambda spark, sf: QA.historial_listas(S.conversaciones(spark, sf))


# ---------------------------------------------------------------------------
# Report bundles (R1-R4) and the population sheets
# ---------------------------------------------------------------------------

Q["resumen_departamento"] = lambda spark, sf: R.resumen_departamento(_fact(spark, sf), _pob(spark, sf))
Q["panel_departamento"] = lambda spark, sf: R.panel_departamento(_fact(spark, sf), None, P)
Q["panel_nacional"] = lambda spark, sf: R.panel_nacional(_fact(spark, sf))
Q["reporte_regional"] = lambda spark, sf: R.reporte_regional(
    _raw(spark, sf), S.gazetteer_regiones(spark, sf), _pob(spark, sf), P)


@key("reporte_documentos")
def _q_reporte_documentos(spark, sf):
    """K2 and S3: the documents written as JSON files and read back."""
    def write(path):
        R.guardar_reportes(R.reporte_documentos(R.reporte_regional(
            _raw(spark, sf), S.gazetteer_regiones(spark, sf), _pob(spark, sf), P), params=P), path)
    return R.reporte_largo(read_report(spark, S.escrito(spark, f"{S.carpeta(spark, sf)}/reportes", write)))


Q["poblacion_unpivot"] = lambda spark, sf: S.poblacion_desde_hojas(spark, sf, P)


# ---------------------------------------------------------------------------
# Context assembly (Q3): questions -> filters -> embedded chunks -> prompt
# ---------------------------------------------------------------------------
EMBED_DIM = 64


@key("contexto_preguntas")
def _q_contexto_preguntas(spark, sf):
    fact, pob = _fact(spark, sf), _pob(spark, sf)
    qs = QA.detectar_filtros(S.preguntas(spark, sf), S.gazetteer_regiones(spark, sf), P.years)
    chunks = scan_chunks(V.embed(X.chunks_todos(fact, pob, P), "content", EMBED_DIM))
    return QA.contexto_preguntas(qs, chunks, R.resumen_json(fact, pob), R.ranking_json(fact), EMBED_DIM)


# ---------------------------------------------------------------------------
# The same operators by request (C19, F1, R2, R3, R7, S5): region and year
# ---------------------------------------------------------------------------
PETICION = API.normalizar(" europe ", "1997", P)
SOLO_DEPTO = API.normalizar("EUROPE", "x", P)
SOLO_ANIO = API.normalizar("all", 1997, P)


def _request(name, fn):
    Q[name] = lambda spark, sf: fn(_fact(spark, sf), PETICION.departamento, PETICION.anio)


_request("casos_por_anio_filtro", M.casos_por_anio)
_request("distribucion_sexo_filtro", M.distribucion_sexo)
_request("distribucion_edad_filtro", M.distribucion_edad)
_request("tendencia_mensual_filtro", M.tendencia_mensual)
_request("provincias_filtro", M.provincias)
_request("casos_por_anio_sql", lambda f, dep, anio: API.casos_por_anio_sql(f.sparkSession, f, dep, anio))
Q["panel_departamento_anio"] = lambda spark, sf: API.panel(_fact(spark, sf), PETICION, P)
Q["panel_nacional_anio"] = lambda spark, sf: API.panel(_fact(spark, sf), SOLO_ANIO, P)
Q["estadistica_ranking"] = lambda spark, sf: API.estadistica("ranking", _fact(spark, sf), _pob(spark, sf), SOLO_ANIO)
Q["estadistica_tasa"] = lambda spark, sf: API.estadistica("tasa", _fact(spark, sf), _pob(spark, sf), SOLO_DEPTO)
Q["estadistica_tendencia"] = lambda spark, sf: API.estadistica(
    "tendencia", _fact(spark, sf), _pob(spark, sf), SOLO_DEPTO)
Q["poblacion_codigo"] = lambda spark, sf: population_for_code(S.hojas_poblacion(spark, sf, P), "040000")


def queries() -> dict:
    return dict(Q)
