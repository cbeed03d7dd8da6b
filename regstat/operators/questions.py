"""Question and answer processing in batch (Q1-Q7).

Questions and answers are tables. Years, answers and charts are projections;
places are found by a join of text windows with the leading characters of
the names, so the gazetteer may have any size; conversations are cut into
numbered pieces of bounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.functions.sizing import materializar

WORD = "A-Za-z0-9_"
#: leading characters of a name that a window of the text must equal
LEAD = 6


def year_pattern(years) -> str:
    """Word-bounded alternation of the years (ASCII word characters, as a
    JavaScript ``\\b`` sees them; ``ñ`` is not a word character)."""
    alt = "|".join(str(int(y)) for y in years)
    return f"(^|[^{WORD}])({alt})([^{WORD}]|$)"


def detectar_anio(text, years) -> F.Column:
    """Q1: first year of the list mentioned as a whole word, else null."""
    hit = F.regexp_extract(C.col_(text), year_pattern(years), 2)
    return F.when(hit != "", hit.cast("int"))


def lugares_mencionados(texts: DataFrame, gazetteer: DataFrame, text: str = "texto",
                        palabra_completa: bool = False) -> DataFrame:
    """Q2: (``text``, departamento) for every distinct text that names a place
    of ``gazetteer`` (nombre, orden): the first name of the list (smallest
    orden) contained in the upper-cased text. Plain substring semantics
    (SIGNIFICA contains ICA), accents not folded; ``palabra_completa`` only
    accepts names standing as whole words (ASCII word boundaries).

    Every position of a text gives windows of the lengths that the names'
    leading characters have (at most ``LEAD`` + 1 lengths), which meet the
    names in an equi-join; the rest of the name, and its borders, are compared
    afterwards. No list is collected and no size is assumed.
    """
    names = (gazetteer.select("nombre", "orden").where("nombre is not null")
             .groupBy("nombre").agg(F.min("orden").alias("orden"))
             .withColumn("_k", F.left("nombre", F.lit(LEAD))))
    sizes = names.agg(F.collect_set(F.length("_k")).alias("leads"), F.max(F.length("nombre")).alias("longest")).first()
    leads, longest = sorted(sizes["leads"]), sizes["longest"] or 0
    distinct = materializar(texts.select(F.col(text).alias("_t")).where(F.col(text).isNotNull()).distinct()
                            .withColumn("_id", F.monotonically_increasing_id()))
    up = distinct.select("_id", F.upper("_t").alias("_u"))
    at = up.select("_id", "_u", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_u"), F.lit(1)))).alias("_p"))
    windows = at.select(
        "_id", F.substr("_u", F.col("_p"), F.lit(longest + 1)).alias("_rest"),
        F.when(F.col("_p") > 1, F.substr("_u", F.col("_p") - 1, F.lit(1))).alias("_before"),
        F.explode(F.array(*[F.substr("_u", F.col("_p"), F.lit(n)) for n in leads]) if leads
                  else F.array().cast("array<string>")).alias("_k"))
    found = windows.join(names, "_k").where(F.startswith("_rest", "nombre"))
    if palabra_completa:
        after = F.substr("_rest", F.length("nombre") + 1, F.lit(1))
        found = found.where(~F.coalesce(F.col("_before").rlike(f"[{WORD}]"), F.lit(False))
                            & ~after.rlike(f"[{WORD}]"))
    first = found.groupBy("_id").agg(F.min_by("nombre", F.struct("orden", "nombre")).alias("departamento"))
    return distinct.join(first, "_id").select(F.col("_t").alias(text), "departamento")


def detectar_filtros(questions: DataFrame, gazetteer: DataFrame, years, text: str = "texto",
                     palabra_completa: bool = False) -> DataFrame:
    """Q1 + Q2 for every question; ``gazetteer`` is a table (nombre, orden)."""
    places = lugares_mencionados(questions, gazetteer, text, palabra_completa)
    return (questions.drop("anio", "departamento").withColumn("anio", detectar_anio(text, years))
            .join(places, text, "left").select(*[c for c in questions.columns if c not in ("anio", "departamento")],
                                               "anio", "departamento"))


FENCE_OPEN = "(?i)^```(?:json)?\\s*"
FENCE_CLOSE_FIRST = "(?s)^(.*?)\\s*```(?m:$)"


def limpiar_respuesta(raw) -> F.Column:
    """Q4 step 1: trim, drop an opening code fence and the first closing
    fence at a line end, trim again."""
    x = C.js_trim(C.col_(raw))
    x = F.regexp_replace(x, FENCE_OPEN, "")
    x = F.regexp_replace(x, FENCE_CLOSE_FIRST, "$1")
    return C.js_trim(x)


CHART_DATA = T.ArrayType(T.StructType([T.StructField("nombre", T.StringType()),
                                       T.StructField("valor", T.DoubleType())]))


def parsear_respuestas(answers: DataFrame, raw: str = "respuesta") -> DataFrame:
    """Q4: structured answers. ``texto`` is the JSON string field ``texto``
    when the cleaned answer is a JSON object holding one, else the raw
    answer; the chart is the ``grafica`` member unless absent or JSON null.
    Adds texto, tiene_grafica, grafica_tipo, n_datos and the typed chart
    data ``datos`` (kept for Q5/Q6)."""
    clean = limpiar_respuesta(raw)
    # A JSON object that repeats a key is no variant; its last value counts.
    last = F.from_json(clean, "texto variant, grafica variant")
    repeated = F.when(clean.startswith("{") & (last["texto"].isNotNull() | last["grafica"].isNotNull()),
                      F.to_variant_object(last))
    v = F.coalesce(F.try_parse_json(clean), repeated)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    texto_v = F.try_variant_get(v, "$.texto", "variant")
    texto_ok = is_obj & F.coalesce(F.schema_of_variant(texto_v) == "STRING", F.lit(False))
    graf = F.try_variant_get(v, "$.grafica", "variant")
    tiene = is_obj & graf.isNotNull() & ~F.coalesce(F.is_variant_null(graf), F.lit(True))
    tipo_v = F.try_variant_get(v, "$.grafica.tipo", "variant")
    tipo = F.when(tiene & F.coalesce(F.schema_of_variant(tipo_v) == "STRING", F.lit(False)),
                  F.try_variant_get(v, "$.grafica.tipo", "string"))
    # The path is null whenever there is no chart object; gating it with the
    # chart flag adds nothing (and trips code generation when exploded).
    datos = F.try_variant_get(v, "$.grafica.datos", CHART_DATA.simpleString())
    return answers.select(
        "*",
        F.when(texto_ok, F.try_variant_get(v, "$.texto", "string")).otherwise(F.col(raw)).alias("texto"),
        tiene.alias("tiene_grafica"), tipo.alias("grafica_tipo"),
        F.when(tiene, F.size(datos)).alias("_n"), datos.alias("datos"),
    ).withColumn("n_datos", F.when(F.col("_n") >= 0, F.col("_n"))).drop("_n")


def grafica_valida(parsed: DataFrame, keys: list) -> DataFrame:
    """Q5/Q6: valid charts (known type, non-empty data) exploded to one row
    per data point with its integer share of the chart total and, for pie
    charts, the label ``name pct%``. The data list belongs to one answer,
    so the share is a per-row array aggregate, not a window."""
    ok = parsed.where(F.col("grafica_tipo").isin(*cfg.CHART_TYPES) & (F.col("n_datos") > 0))
    total = F.aggregate("datos", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["valor"], F.lit(0.0)))
    ex = ok.select(*keys, F.col("grafica_tipo").alias("tipo"), total.alias("_total"),
                   F.posexplode("datos").alias("pos", "d"))
    pct = C.share_pct(F.col("d.valor"), F.col("_total"))
    return ex.select(*keys, "tipo", (F.col("pos") + 1).cast("int").alias("posicion"),
                     F.col("d.nombre").alias("nombre"), F.col("d.valor").alias("valor"),
                     pct.alias("pct"),
                     F.when(F.col("tipo") == "pie",
                            F.concat(F.coalesce(F.col("d.nombre"), F.lit("")), F.lit(" "),
                                     pct.cast("string"), F.lit("%"))).alias("etiqueta"))


def historial(turns: DataFrame) -> DataFrame:
    """Q7: conversation turns as the model expects them: ``assistant`` ->
    ``model``, anything else -> ``user``, in turn order (a range-partitioned
    sort, so a very long conversation is split across tasks)."""
    return (turns.select("conv_id", "turn",
                         F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.lit("user")).alias("rol"),
                         F.col("text").alias("texto"))
            .orderBy("conv_id", "turn"))


#: turns in one piece of a conversation's list
PIEZA = 1000


def historial_listas(turns: DataFrame, ultimos: int | None = None, pieza: int = PIEZA) -> DataFrame:
    """Q7 as the model receives it: per conversation the ordered list of
    ``{role, parts: [{text}]}``, as JSON: conv_id, pieza, n_turnos, historial.

    A conversation of more than ``pieza`` turns comes in numbered pieces (from
    0) of that length, whose lists follow each other; ``ultimos`` keeps the
    last turns only (default: all). Turns are ordered by turn (nulls first),
    equal ones by role and text; repeated turns are turns; a null text is JSON
    null; a null conv_id is one conversation.

    Places are counted in two levels, so that no task holds a conversation: a
    running sum over ranges of ``pieza`` turn numbers, and a row number inside
    a range.
    """
    role = F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.lit("user"))
    t = turns.select("conv_id", "turn", role.alias("_rol"), F.col("text").alias("_text"),
                     F.floor(F.col("turn") / F.lit(pieza)).alias("_r"))
    ranges = t.groupBy("conv_id", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    ranges = ranges.select(F.col("conv_id").alias("_c"), F.col("_r").alias("_cr"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(whole).alias("_total"))
    inside = Window.partitionBy("conv_id", "_r").orderBy("turn", "_rol", "_text")
    placed = (t.withColumn("_in", F.row_number().over(inside) - 1)
              .join(ranges, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_r").eqNullSafe(F.col("_cr")))
              .withColumn("_pos", F.col("_start") + F.col("_in")))
    if ultimos is not None:
        skipped = F.greatest(F.col("_total") - F.lit(int(ultimos)), F.lit(0))
        placed = placed.withColumn("_pos", F.col("_pos") - skipped).where("_pos >= 0")
    entry = F.struct(F.col("_rol").alias("role"), F.array(F.struct(F.col("_text").alias("text"))).alias("parts"))
    return (placed.groupBy("conv_id", F.floor(F.col("_pos") / F.lit(pieza)).alias("pieza"))
            .agg(F.array_sort(F.collect_list(F.struct("_pos", entry.alias("e")))).alias("l"))
            .select("conv_id", "pieza", F.size("l").alias("n_turnos"),
                    F.to_json(F.transform("l", lambda x: x["e"]), {"ignoreNullFields": "false"}).alias("historial")))


# ---------------------------------------------------------------------------
# Q3: context assembly
# ---------------------------------------------------------------------------
def _fragmentos(corpus: DataFrame) -> DataFrame:
    """The chunks in the order of their texts with increasing integers
    ``vec_id``, so that equal scores are ordered by text without shipping it."""
    return materializar(
        corpus.select(F.coalesce("content", F.lit("")).alias("content"), "embedding", "meta_departamento", "meta_anio")
        .repartitionByRange("content").sortWithinPartitions("content")
        .withColumn("vec_id", F.monotonically_increasing_id()))


def contexto_rag(questions: DataFrame, corpus: DataFrame, dim: int, k: int = cfg.TOP_K,
                 embedder=None, text: str = "texto", **blocks) -> DataFrame:
    """Retrieved context per question: the texts of its top-k chunks by
    boosted cosine (V1-V3), joined by a blank line in score order, equal
    scores by text.

    Questions and corpus stay partitioned and go through ``vectors.topk``,
    whatever their sizes; chunks travel as integers, and the texts are joined
    back for the k winners only.
    """
    from regstat.operators import vectors as V

    chunks = _fragmentos(corpus)
    emb = V.embed(questions.select("pregunta_id", text, "departamento", "anio"), text, dim, "q_embedding",
                  embedder=embedder)
    q = materializar(emb.select(F.col("pregunta_id").cast("long").alias("query_id"), "q_embedding",
                                F.col("departamento").alias("q_departamento"), F.col("anio").alias("q_anio")))
    hits = V.topk(q, chunks.withColumn("chunk_type", F.lit(None).cast("string")), k, **blocks)
    found = (hits.select("query_id", "vec_id", "posicion").join(chunks.select("vec_id", "content"), "vec_id")
             .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("posicion", "content"))).alias("c"))
             .select(F.col("query_id").alias("pregunta_id"), F.size("c").cast("int").alias("n_chunks"),
                     F.concat_ws("\n\n", F.transform("c", lambda x: x["content"])).alias("contexto")))
    return (q.select(F.col("query_id").alias("pregunta_id")).join(found, "pregunta_id", "left")
            .select("pregunta_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                    F.coalesce("contexto", F.lit("")).alias("contexto")))


def contexto_preguntas(questions: DataFrame, corpus: DataFrame, resumen_json: DataFrame,
                       ranking_json: DataFrame, dim: int, k: int = cfg.TOP_K,
                       template: str = cfg.PROMPT_TEMPLATE, embedder=None) -> DataFrame:
    """Q3: prompt per question. Exact figures: the region summary (JSON) when
    a region was detected (zeros and empty lists for one without cases), else
    the top-10 ranking for the detected year or all years (``anio`` 0 in
    ``ranking_json``), an empty ranking for a year without cases; a fallback
    text for an empty context.
    ``resumen_json``: departamento, datos_sql; ``ranking_json``: anio, datos_sql."""
    ctx = contexto_rag(questions, corpus, dim, k, embedder)
    q = questions.select("pregunta_id", "departamento", "anio")
    rs = resumen_json.select("departamento", F.col("datos_sql").alias("_rs"))
    rk = ranking_json.select(F.col("anio").alias("_ranio"), F.col("datos_sql").alias("_rk"))
    j = (q.join(ctx, "pregunta_id", "left")
         .join(rs, "departamento", "left")
         .join(rk, F.coalesce(F.col("anio"), F.lit(0)) == F.col("_ranio"), "left"))
    from regstat.operators.reports import objeto_json, resumen_vacio

    sql = F.when(F.col("departamento").isNotNull(), F.coalesce("_rs", resumen_vacio("departamento"))).otherwise(
        F.coalesce(F.col("_rk"), objeto_json(0, ranking=F.lit("[]"))))
    rag = F.coalesce(F.nullif(F.col("contexto"), F.lit("")), F.lit(cfg.NO_CONTEXT))
    data = F.coalesce(F.nullif(sql, F.lit("")), F.lit(cfg.NO_SQL_DATA))
    prompt = F.replace(F.replace(F.lit(template), F.lit(cfg.CONTEXT_PLACEHOLDER), rag),
                       F.lit(cfg.SQL_PLACEHOLDER), data)
    return j.select("pregunta_id", "departamento", "anio",
                    F.coalesce(F.col("n_chunks"), F.lit(0)).alias("n_chunks"), prompt.alias("prompt"))
