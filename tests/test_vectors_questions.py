"""Vectors, questions, answers and the star schema against brute force."""

import json

import numpy as np
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.operators import questions as QA
from regstat.operators import vectors as V
from regstat.operators import warehouse as WH

CORPUS = "vec_id long, embedding array<float>, chunk_type string, meta_departamento string, meta_anio int"


def make_corpus(spark, n=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim).astype(np.float32)
        if i == 5:
            v[:] = 0.0                      # zero vector: never ranked
        if i == 7:
            v = np.asarray(rows[6][1], dtype=np.float32)   # exact copy: tie broken by id
        rows.append((i, [float(x) for x in v], cfg.CHUNK_TYPES[i % 6],
                     ["LIMA", "ICA", None][i % 3], [2023, 2024, None][i % 3]))
    return spark.createDataFrame(rows, CORPUS), rows


def brute(rows, q, qdep, qyear, k, types=None, tie=None):
    out = []
    qv = np.asarray(q, dtype=np.float32).astype(np.float64)
    for vid, emb, t, dep, yr in rows:
        if types and t not in types:
            continue
        e = np.asarray(emb, dtype=np.float32).astype(np.float64)
        den = np.sqrt((e * e).sum()) * np.sqrt((qv * qv).sum())
        if den == 0:
            continue
        s = float((e * qv).sum() / den)
        if qdep is not None and dep == qdep:
            s *= cfg.REGION_BOOST
        if qyear is not None and yr == qyear:
            s *= cfg.YEAR_BOOST
        out.append((-s, tie[vid] if tie else vid, vid))
    return [vid for _, _, vid in sorted(out)[:k]]


def test_topk_matches_brute_force(spark):
    corpus, rows = make_corpus(spark)
    queries = [(100, rows[6][1], "LIMA", 2024), (101, rows[10][1], None, None), (102, rows[3][1], "ICA", None)]
    qdf = spark.createDataFrame(queries, "query_id long, q_embedding array<float>, q_departamento string, q_anio int")
    for types in (None, [cfg.CHUNK_MENSUAL, cfg.CHUNK_EDAD]):
        got = V.topk(qdf, corpus.repartition(5), 8, types).collect()
        for qid, q, dep, yr in queries:
            mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == qid),
                                                key=lambda r: r["posicion"])]
            assert mine == brute(rows, q, dep, yr, 8, types)
            assert 5 not in mine


def test_cosine_column_and_zero_norm(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.coseno("a", "b")).collect()]
    assert abs(got[0] - 1 / np.sqrt(2)) < 1e-12 and got[1] is None


def nombres(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "nombre string, orden int")


def test_detect_filters_source_gazetteer(spark):
    qs = spark.createDataFrame([(1, "¿qué significa 2024?"), (2, "casos en Junín"),
                                (3, "Casos en La Libertad el2023"), (4, "ranking 2022 y 2025")],
                               "pregunta_id long, texto string")
    out = {r["pregunta_id"]: (r["anio"], r["departamento"])
           for r in QA.detectar_filtros(qs, nombres(spark, cfg.DEPARTMENTS), cfg.SOURCE.years).collect()}
    assert out[1] == (2024, "ICA")           # substring rule: SIGNIFICA contains ICA
    assert out[2] == (None, None)            # accents are not folded
    assert out[3] == (None, "LA LIBERTAD")   # 'el2023' is not word-bounded
    assert out[4] == (2022, None)            # first mention wins


def test_parse_answers(spark):
    fenced = '```json\n{"texto":"hola","grafica":{"tipo":"pie","datos":[{"nombre":"a","valor":1},{"nombre":"b","valor":3}]}}\n```'
    raws = [fenced, '{"texto":"plano","grafica":null}', "null", "[1]", '{"texto":5}', "texto libre"]
    raws += ['{"texto":"a","texto":"b","grafica":null}', '{"texto":"a","grafica":{"tipo":"bar"},"grafica":null}',
             '{"texto":"a","texto":7}', '{"texto":"x","texto":"y"', "[1,1]"]
    df = spark.createDataFrame(list(enumerate(raws)), "conv_id long, respuesta string") \
        .withColumn("turn", F.lit(0).cast("long"))
    p = {r["conv_id"]: r for r in QA.parsear_respuestas(df).collect()}
    assert p[0]["texto"] == "hola" and p[0]["tiene_grafica"] and p[0]["grafica_tipo"] == "pie"
    assert p[1]["texto"] == "plano" and not p[1]["tiene_grafica"]
    for i in (2, 3, 4, 5):
        assert p[i]["texto"] == raws[i] and not p[i]["tiene_grafica"]
    # a repeated key: its last value counts
    assert [p[i]["texto"] for i in range(6, 11)] == ["b", "a", raws[8], raws[9], "[1,1]"]
    assert not any(p[i]["tiene_grafica"] for i in range(6, 11))
    g = QA.grafica_valida(QA.parsear_respuestas(df), ["conv_id", "turn"]).orderBy("posicion").collect()
    assert [(r["nombre"], r["pct"], r["etiqueta"]) for r in g] == [("a", 25, "a 25%"), ("b", 75, "b 75%")]


def test_history_roles(spark):
    t = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "system", "c")],
                              "conv_id long, turn long, role string, text string")
    assert [(r["turn"], r["rol"]) for r in QA.historial(t).collect()] == [(1, "user"), (2, "model"), (3, "user")]


def test_context_matches_brute_force(spark):
    texts = [f"casos en region {i} durante {2022 + i % 4} con detalle {i * 7}" for i in range(30)]
    dim = 16
    embs = V.hash_embed_texts(texts, dim)
    rows = [(i, [float(x) for x in embs[i]], cfg.CHUNK_TYPES[0], ["LIMA", "ICA", None][i % 3],
             [2023, 2024, None][i % 3]) for i in range(30)]
    corpus = spark.createDataFrame(rows, CORPUS).withColumn("content", F.lit(None).cast("string"))
    corpus = corpus.withColumn("content", F.element_at(F.array(*[F.lit(t) for t in texts]),
                                                       (F.col("vec_id") + 1).cast("int")))
    qtexts = ["region 3 durante 2024", "detalle 49 en lima", "nada que ver"]
    qs = spark.createDataFrame([(i, t, d, y) for i, (t, d, y) in
                                enumerate(zip(qtexts, ["LIMA", None, "ICA"], [2024, None, None]))],
                               "pregunta_id long, texto string, departamento string, anio int")
    got = {r["pregunta_id"]: r for r in QA.contexto_rag(qs, corpus, dim, 4).collect()}
    qv = V.hash_embed_texts(qtexts, dim)
    for i, (dep, yr) in enumerate(zip(["LIMA", None, "ICA"], [2024, None, None])):
        ids = brute(rows, qv[i], dep, yr, 4, tie=texts)  # equal scores: text order
        assert got[i]["contexto"] == "\n\n".join(texts[j] for j in ids)
        assert got[i]["n_chunks"] == len(ids)


def test_star_ids_deterministic_and_one_geo_row(spark):
    rows = [("20230101", "LIMA-LIMA-MIRAFLORES", "150101"), ("20230201", "LIMA-LIMA-MIRAFLORES", "150199")]
    raw = spark.createDataFrame([(f"u{i}", str(i), d, "FEMENINO", "40", u, p, "1", "")
                                 for i, (d, p, u) in enumerate(rows)],
                                "UUID string, HISTORIA string, FEC_FILIACION string, SEXO string, EDAD string, "
                                "UBIGEO_LUGAR_RESIDENCIA string, LUGAR_RESIDENCIA string, "
                                "CANT_ATENCIONES_CEX string, FECHA_CORTE string")
    from regstat.operators import clean as CL
    clean = CL.limpiar_nacional(raw, cfg.SOURCE)
    pob = spark.createDataFrame([("LIMA", 2023, 10, 5, 5)], "departamento string, anio int, total long, hombres long, mujeres long")
    star1 = WH.construir_estrella(spark, clean, pob)
    star2 = WH.construir_estrella(spark, CL.limpiar_nacional(raw.repartition(3), cfg.SOURCE), pob)
    geo = star1["dim_geografia"].collect()
    assert len(geo) == 1 and geo[0]["ubigeo"] == "150101"
    assert sorted(map(tuple, star1["fact_casos"].collect())) == sorted(map(tuple, star2["fact_casos"].collect()))
    checks = {(r["chequeo"], r["detalle"]): r["n"] for r in WH.integridad_referencial(star1).collect()}
    assert all(v == 0 for (c, _), v in checks.items() if c != "sin_poblacion")
    view = WH.vista_analitica(star1).collect()
    assert len(view) == 2 and {r["mes"] for r in view} == {1, 2}


def test_topk_same_rows_for_any_blocks(spark):
    corpus, rows = make_corpus(spark, n=40)
    queries = [(100 + i, rows[i][1], None, None) for i in range(9)]
    qdf = spark.createDataFrame(queries, "query_id long, q_embedding array<float>, q_departamento string, q_anio int")
    whole = sorted(map(tuple, V.topk(qdf, corpus, 5).collect()))
    for blocks in ({"query_block": 2, "corpus_block": 7}, {"query_block": 100, "corpus_block": 1}):
        assert sorted(map(tuple, V.topk(qdf.repartition(3), corpus.repartition(5), 5, **blocks).collect())) == whole
    assert len(whole) == 8 * 5   # query 5 is the zero vector: no hits


def test_context_with_shared_chunk_keys(spark):
    """Two families share every chunk_key; blocks and partitions vary."""
    texts = [f"texto {i} sobre region {i % 5}" for i in range(40)]
    emb = V.hash_embed_texts(texts, 8)
    crow = [(i, [float(x) for x in emb[i]], cfg.CHUNK_TYPES[i % 2], None, None, texts[i], f"k{i // 2}")
            for i in range(40)]
    cdf = spark.createDataFrame(crow, CORPUS + ", content string, chunk_key string")
    qs = spark.createDataFrame([(1, "region 3", None, None), (2, "texto 7", None, None)],
                               "pregunta_id long, texto string, departamento string, anio int")
    want = sorted(map(tuple, QA.contexto_rag(qs, cdf, 8, 4).collect()))
    assert [w[1] for w in want] == [4, 4] and all(len(set(w[2].split("\n\n"))) == 4 for w in want)
    got = QA.contexto_rag(qs.repartition(2), cdf.repartition(6), 8, 4, query_block=1, corpus_block=9)
    assert sorted(map(tuple, got.collect())) == want


def test_metadata_keeps_json_types(spark):
    from regstat.sources.registry import scan_chunks
    df = spark.createDataFrame(
        [(1, [1.0], '{"departamento":"LIMA","año":2024}'), (2, [1.0], '{"departamento":5,"año":"2024"}'),
         (3, [1.0], None), (4, [1.0], '{"año":2024.0}'), (5, None, '{}')],
        "vec_id long, embedding array<float>, metadata_json string")
    got = {r["vec_id"]: (r["meta_departamento"], r["meta_anio"]) for r in scan_chunks(df).collect()}
    assert got == {1: ("LIMA", 2024), 2: (None, None), 3: (None, None), 4: (None, 2024)}


QUERIES = "query_id long, q_embedding array<float>, q_departamento string, q_anio int"


def clustered(spark, n=600, groups=6, dim=16, seed=8):
    """Rows around a few far directions, with copies, a zero and odd lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 5
    rows = []
    for i in range(n):
        v = (centres[i % groups] + rng.normal(size=dim) * 0.3).astype(np.float32)
        if i == 11:
            v[:] = 0
        if i % 50 == 7:
            v = np.asarray(rows[1][1], np.float32)
        rows.append((i, [float(x) for x in v], cfg.CHUNK_TYPES[i % 6], ["LIMA", "ICA", None][i % 3],
                     [2023, 2024, None][i % 3]))
    return spark.createDataFrame(rows, CORPUS), rows


def test_pruned_search_equals_full_search(spark):
    corpus, rows = clustered(spark)
    queries = [(1000 + i, rows[i][1], rows[i][3] if i % 2 else None, rows[i][4] if i % 4 else None)
               for i in range(0, 600, 25)] + [(2000, [0.0] * 16, None, None), (2001, None, None, None)]
    qdf = spark.createDataFrame(queries, QUERIES)
    counts = {}
    got = V.topk(qdf, corpus.repartition(4), 5, query_block=4, corpus_block=40, conteo=counts).collect()
    whole = V.topk(qdf, corpus, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
    for qid, q, dep, yr in queries[:-2]:
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["posicion"])]
        assert mine == brute(rows, q, dep, yr, 5)
    assert not any(r["query_id"] >= 2000 for r in got)
    assert 0 < counts["visitados"] < 0.5 * counts["pares"], counts


def test_scores_are_the_sequential_fold(spark):
    corpus, rows = clustered(spark, n=80)
    q = spark.createDataFrame([(1, rows[3][1], None, None)], QUERIES)
    got = {r["vec_id"]: r["score"] for r in V.topk(q, corpus, 10, corpus_block=16).collect()}

    def fold(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += float(x) * float(y)
        return s
    for vid, score in got.items():
        a, b = rows[vid][1], rows[3][1]
        assert score == fold(a, b) / (np.sqrt(fold(a, a)) * np.sqrt(fold(b, b)))


def test_search_leaves_out_what_has_no_cosine(spark):
    bad = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a", None, None), (2, [1.0, 0.0, 0.0], "a", None, None), (3, [], "a", None, None),
            (4, None, "a", None, None), (5, [bad[0], 1.0], "a", None, None), (6, [bad[1], 1.0], "a", None, None),
            (7, [None, 1.0], "a", None, None), (8, [0.5, 0.5], "a", None, None)]
    corpus = spark.createDataFrame(rows, CORPUS)
    q = spark.createDataFrame([(1, [1.0, 0.0], None, None), (2, [0.0, 1.0, 0.0], None, None), (3, [2.0], None, None)],
                              QUERIES)
    for blocks in ({}, {"corpus_block": 1}):
        got = sorted((r["query_id"], r["posicion"], r["vec_id"]) for r in V.topk(q, corpus, 4, **blocks).collect())
        assert got == [(1, 1, 1), (1, 2, 8), (2, 1, 2)]
    assert V.topk(q.limit(0), corpus, 4).collect() == [] == V.topk(q, corpus.limit(0), 4).collect()


def test_places_from_any_gazetteer(spark):
    """Fifty thousand names; the first of the list wins, whole words on request."""
    names = [f"SANTO PUEBLO {i}" for i in range(50_000)] + ["ICA", "AB", "LIMA", "A", ""]
    gaz = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "nombre string, orden int")
    texts = ["casos en santo pueblo 49999?", "santo pueblo 7 y santo pueblo 3", "¿qué significa?", "lima", "xyz", "", None,
             "santo pueblo", "en ica-lima", "zabz", "lima"]
    qs = spark.createDataFrame(list(enumerate(texts)), "pregunta_id long, texto string")

    def want(t, whole):
        import re
        for n in names:
            if t is not None and n in t.upper() and (not whole or re.search(
                    rf"(^|[^A-Za-z0-9_]){re.escape(n)}([^A-Za-z0-9_]|$)", t.upper())):
                return n
        return None
    for whole in (False, True):
        got = {r["pregunta_id"]: r["departamento"]
               for r in QA.detectar_filtros(qs, gaz, (2022,), palabra_completa=whole).collect()}
        assert got == {i: want(t, whole) if t else ("" if t == "" else None) for i, t in enumerate(texts)}, whole
    none = QA.detectar_filtros(qs, gaz.limit(0), (2022,)).collect()
    assert len(none) == len(texts) and not any(r["departamento"] for r in none)


def test_history_lists_of_a_hot_conversation(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(600)]
    rows += [(100 + i, t, "user", f"x{i}") for i in range(300) for t in range(4)]
    rows += [(None, None, "system", None), (None, 2, "assistant", 'q"\n')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)

    def lists(**args):
        out = {}
        for r in sorted(QA.historial_listas(df, **args).collect(), key=lambda r: r["pieza"]):
            part = json.loads(r["historial"])
            assert len(part) == r["n_turnos"] <= args.get("pieza", QA.PIEZA)
            out.setdefault(r["conv_id"], []).extend((e["role"], e["parts"][0]["text"]) for e in part)
        return out
    hot = [("model" if t % 2 else "user", f"t{t}") for t in range(600)]
    for args in ({}, {"pieza": 64}, {"pieza": 7}):
        got = lists(**args)
        assert got[7] == hot and got[None] == [("user", None), ("model", 'q"\n')]
        assert len(got) == 302 and got[105] == [("user", "x5")] * 4
    last = lists(pieza=64, ultimos=100)
    assert last[7] == hot[-100:] and last[105] == [("user", "x5")] * 4


def test_region_without_cases_has_a_summary(spark):
    emb = V.hash_embed_texts(["algo"], 8)
    corpus = spark.createDataFrame([(0, [float(x) for x in emb[0]], "a", None, None, "algo")], CORPUS + ", content string")
    qs = spark.createDataFrame([(1, "casos en LIMA", "LIMA", None), (2, "casos", None, 1999), (3, 'en "X"\t', 'A "b"\t', None)],
                               "pregunta_id long, texto string, departamento string, anio int")
    none = spark.createDataFrame([], "departamento string, datos_sql string")
    ranks = spark.createDataFrame([], "anio int, datos_sql string")
    got = {r["pregunta_id"]: r["prompt"] for r in QA.contexto_preguntas(
        qs, corpus, none, ranks, 8, template=cfg.CONTEXT_PLACEHOLDER + "|" + cfg.SQL_PLACEHOLDER).collect()}
    zero = {"total_casos": 0, "edad_promedio": 0, "por_año": [], "sexo": [], "edad": [], "provincias": [],
            "tendencia": None}
    assert got[1].split("|")[1] == json.dumps({"departamento": "LIMA", **zero}, indent=2, ensure_ascii=False)
    assert json.loads(got[3].split("|")[1])["departamento"] == 'A "b"\t'
    assert got[2].split("|")[1] == json.dumps({"ranking": []}, indent=2)


def test_prompt_json_is_printed_with_an_indent(spark):
    from regstat.operators import reports as R
    from regstat.plans import catalog as K
    from tests.conftest import SF_SMALL
    fact, pob = K._fact(spark, SF_SMALL), K._pob(spark, SF_SMALL)
    for df in (R.resumen_json(fact, pob), R.ranking_json(fact)):
        texts = [r["datos_sql"] for r in df.collect()]
        assert texts and all(t == json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts)
