"""Stand-in inputs built from the test tables.

The source application reads a patient registry and population sheets that
are not available; these functions derive equivalent inputs from the
TPC-H-like tables so every operator runs on data whose size grows with the
scale factor:

* ``registro``   the raw registry text (all strings, with malformed cells)
* ``hojas_poblacion``  wide population sheets (and their long form, read by S2)
* ``corpus``     chunk table over ``embeddings``
* ``preguntas``  questions; ``respuestas`` model answers; ``historial`` turns

Every derivation is a projection, a broadcastable dimension join or a
partial-aggregated group-by; the only large joins are orders x customer and
orders x per-order line counts, which the planner runs as shuffle joins
(or broadcast joins when AQE sees a small side at runtime).
"""

from __future__ import annotations

import hashlib
import inspect
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.sources.population import read_population
from regstat.sources.registry import REGISTRY_COLUMNS, read_registry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation x region (+ line count per order)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # Visits = lines per order; unique per key, so Catalyst drops this join
    # entirely when a query does not use the visit count.
    visits = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
              .agg(F.count(F.lit(1)).cast("int").alias("cant_atenciones")))
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(geo, customer.c_nationkey == geo.n_nationkey)
            .join(visits, orders.o_orderkey == visits.l_orderkey, "left"))


def registro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registry text: every column a string, as read from the CSV.

    Malformed cells are injected by fixed rules on the order's day of month
    and priority (short / non-numeric / out-of-range dates, month 13, quoted
    and lower-case text, JavaScript-only white space, lenient numbers,
    one-part and empty-middle places, a department named at a lower level).
    """
    return _texto(_orders_customers(spark, sf_dir))


def registro_ordenado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``registro`` in the order of the record numbers. The typed columns are
    sorted and the text is made of the sorted rows: the sort samples its input
    in a pass of its own, which then makes no text, and moves fewer bytes."""
    return _texto(_orders_customers(spark, sf_dir).orderBy("o_orderkey"))


def _texto(b: DataFrame) -> DataFrame:
    """The registry text of joined orders, row by row."""
    d = F.dayofmonth("o_orderdate")
    p = F.col("o_orderpriority")
    urgent, high, medium = p == "1-URGENT", p == "2-HIGH", p == "3-MEDIUM"
    unspecified, low = p == "4-NOT SPECIFIED", p == "5-LOW"
    ymd = F.date_format("o_orderdate", "yyyyMMdd")
    fecha = (F.when(d == 31, F.substring(ymd, 1, 5))
             .when((d == 30) & urgent, F.concat(F.substring(ymd, 1, 4), F.lit("13"), F.substring(ymd, 7, 2)))
             .when((d == 29) & urgent, F.lit("ABCDEFGH"))
             .when((d == 28) & urgent, F.concat((F.year("o_orderdate") - 10).cast("string"), F.substring(ymd, 5, 4)))
             .when((d == 27) & urgent, F.concat(F.lit(' "'), ymd, F.lit('"')))
             .otherwise(ymd))
    sexo_base = (F.when(F.col("o_orderstatus") == "F", F.lit("FEMENINO"))
                 .when(F.col("o_orderstatus") == "O", F.lit("MASCULINO"))
                 .otherwise(F.lit("X")))
    sexo = (F.when(high, F.concat(F.lit(' "'), F.lower(sexo_base), F.lit('" ')))
            .when(medium & (d <= 3), F.concat(F.lit('" '), F.lower(sexo_base), F.lit(' "')))
            .otherwise(sexo_base))
    edad_txt = F.floor(F.abs(F.col("c_acctbal")) / F.lit(100)).cast("int").cast("string")
    edad = (F.when(d == 1, F.concat(edad_txt, F.lit(".7")))
            .when(d == 2, F.concat(edad_txt, F.lit("abc")))
            .when((d == 3) & low, F.lit(""))
            .when((d == 4) & low, F.lit("-1"))
            .when((d == 5) & low, F.concat(F.lit(" "), edad_txt))
            .otherwise(edad_txt))
    lugar_base = F.concat(F.lit(" "), F.col("r_name"), F.lit("-"), F.col("n_name"),
                          F.lit("-"), F.col("c_mktsegment"))
    lugar = (F.when(unspecified & (d == 5), F.concat(F.lit(" "), F.col("r_name")))
             .when(unspecified & (d == 6), F.concat(F.col("r_name"), F.lit("--"), F.col("c_mktsegment")))
             .when(unspecified & (d == 7), F.concat(F.col("r_name"), F.lit("-  -"), F.col("c_mktsegment")))
             .when(unspecified & (d == 8), F.concat(F.col("n_name"), F.lit("-"), F.col("n_name"),
                                                   F.lit("-"), F.col("r_name")))
             .when(low & (d == 9), F.lower(lugar_base))
             .when(medium & (d == 10), F.concat(F.char(F.lit(9)), lugar_base, F.char(F.lit(160))))
             .when(high & (d == 11), F.concat(F.lit('"'), lugar_base, F.lit('"')))
             .otherwise(lugar_base))
    ubigeo = F.concat(F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0"),
                      F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("01"))
    cex = (F.when(low & (d == 12), F.concat(F.lit(" "), F.col("cant_atenciones").cast("string"), F.lit("x")))
           .otherwise(F.coalesce(F.col("cant_atenciones").cast("string"), F.lit(""))))
    return b.select(
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("-"),
                 F.col("o_orderpriority"), F.lit("-"), F.lower("c_mktsegment")).alias("UUID"),
        F.col("o_orderkey").cast("string").alias("HISTORIA"),
        fecha.alias("FEC_FILIACION"),
        sexo.alias("SEXO"),
        edad.alias("EDAD"),
        ubigeo.alias("UBIGEO_LUGAR_RESIDENCIA"),
        lugar.alias("LUGAR_RESIDENCIA"),
        cex.alias("CANT_ATENCIONES_CEX"),
        F.lit("20010801").alias("FECHA_CORTE"),
    )


_CARPETAS: dict = {}


def carpeta(spark: SparkSession, sf_dir: str) -> str:
    """Shared folder of what is derived from a dataset. Its name follows the
    data: the path as given (it may be a URI), one hash of the input files'
    names, sizes and times (a listing, once per session and path; no content
    is read), and the code that derives from them."""
    from regstat.operators import clean, publish, warehouse
    from regstat.session import checkpoint_dir
    from regstat.sources import population, registry
    root = sf_dir.rstrip("/")
    known = (spark.sparkContext.applicationId, root)
    if known not in _CARPETAS:
        files = spark.read.format("binaryFile").load(
            [f"{root}/{t}.parquet" for t in ("orders", "customer", "nation", "region", "lineitem")])
        one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        n, total = files.agg(F.count(F.lit(1)), F.sum(one)).first()
        code = [inspect.getsource(m) for m in (cfg, C, clean, publish, warehouse, population, registry,
                                               sys.modules[__name__])]
        key = hashlib.sha1(repr((root, n, str(total), code)).encode()).hexdigest()[:16]
        _CARPETAS[known] = f"{checkpoint_dir(spark).rstrip('/')}/regstat-fixtures/{key}"
    return _CARPETAS[known]


def escrito(spark: SparkSession, path: str, write) -> str:
    """``path``, written by ``write`` unless a whole write is there."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(f"{path}/_SUCCESS").limit(1).collect()
    except AnalysisException:
        write(path)
    return path


def registro_csv(spark: SparkSession, sf_dir: str, detalle: bool = False) -> DataFrame:
    """The raw registry as the source receives it: a Latin-1 CSV file set in
    the order of the record numbers, read back with the S1 reader (header,
    all strings).

    The text is derived from the test tables once per dataset and written
    to the shared checkpoint folder (``spark.checkpoint.dir``); later reads
    reuse it. Writing keeps leading/trailing blanks, which are part of the
    test cases.
    """
    def write(path):
        (registro_ordenado(spark, sf_dir).write.mode("overwrite")
         .option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))

    path = escrito(spark, f"{carpeta(spark, sf_dir)}/registro", write)
    return read_registry(spark, path, header_names=list(REGISTRY_COLUMNS), detalle=detalle)


def registro_danado_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with damaged records, read back with the marks of the S1
    reader: among the low-priority orders those of the 15th lack the last two
    fields, those of the 16th have one too many, those of the 17th have an
    empty identifier."""
    def write(path):
        raw = registro(spark, sf_dir)
        low, day = F.col("UUID").contains("-5-LOW-"), F.substring("FEC_FILIACION", 7, 2)

        def quoted(c):
            return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        fields = [quoted(c) for c in REGISTRY_COLUMNS]
        line = (F.when(low & (day == "15"), F.concat_ws(",", *fields[:-2]))
                .when(low & (day == "16"), F.concat_ws(",", *fields, F.lit('"x"')))
                .when(low & (day == "17"), F.concat_ws(",", F.lit(""), *fields[1:]))
                .otherwise(F.concat_ws(",", *fields)))
        # one column whose text holds the commas: nothing is quoted again
        (raw.select(line.alias(",".join(REGISTRY_COLUMNS))).write.mode("overwrite")
         .option("header", True).option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "\u0000")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))

    path = escrito(spark, f"{carpeta(spark, sf_dir)}/registro-danado", write)
    return read_registry(spark, path, header_names=list(REGISTRY_COLUMNS), detalle=True)


def hojas_poblacion(spark: SparkSession, sf_dir: str,
                    params: cfg.Params = cfg.STANDIN) -> dict:
    """Wide population sheets: ``{sheet: (DataFrame c0..c10, years)}``.

    Rows: one per region (code ``RR0000``), one per nation (``RRNN00``,
    not a department) and the national total (``000000``). Population of a
    group in year y = customers x 1000 growing by 7 per customer per year;
    men = customers with a non-negative balance on the same rule. The region
    'MIDDLE EAST' has '-' cells (no population).
    """
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    per_nation = (customer.groupBy("c_nationkey")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.count_if(F.col("c_acctbal") >= 0).alias("h"))
                  .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    nations = per_nation.select(
        F.concat(F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0"),
                 F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("00")).alias("c0"),
        F.lower(F.col("n_name")).alias("c1"), "n", "h", F.lit(True).alias("has_pop"))
    regions = (per_nation.groupBy("r_regionkey", "r_name")
               .agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
               .select(F.concat(F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0"),
                                F.lit("0000")).alias("c0"),
                       F.concat(F.lit(" "), F.lower(F.col("r_name")), F.lit(" ")).alias("c1"),
                       "n", "h", (F.col("r_name") != "MIDDLE EAST").alias("has_pop")))
    total = (per_nation.agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
             .select(F.lit("000000").alias("c0"), F.lit("TOTAL").alias("c1"), "n", "h",
                     F.lit(True).alias("has_pop")))
    rows = nations.unionByName(regions).unionByName(total)
    base_year = min(min(ys) for ys in params.sheet_years.values())
    sheets = {}
    for name, years in params.sheet_years.items():
        cols = [F.col("c0"), F.col("c1")]
        for i, y in enumerate(years):
            step = y - base_year
            tot = F.col("n") * 1000 + F.col("n") * (7 * step)
            men = F.col("h") * 1000 + F.col("h") * (7 * step)
            for j, v in enumerate((tot, men, tot - men)):
                cell = F.when(F.col("has_pop"), v.cast("string")).otherwise(F.lit("-"))
                cols.append(cell.alias(f"c{2 + 3 * i + j}"))
        sheets[name] = (rows.select(*cols), tuple(years))
    return sheets


def poblacion_desde_hojas(spark: SparkSession, sf_dir: str,
                          params: cfg.Params = cfg.STANDIN) -> DataFrame:
    """S2 over the wide stand-in sheets."""
    return read_population(hojas_poblacion(spark, sf_dir, params), params)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk table over ``embeddings``: vec_id, chunk_type, embedding,
    metadata_json (null for one family). Type and metadata follow fixed
    rules on the label and on the signs of the first two components."""
    e = table(spark, sf_dir, "embeddings")
    lab = F.col("label")
    tipo = (F.when(lab <= 1, F.lit(cfg.CHUNK_DEPTO_ANIO))
            .when(lab <= 3, F.lit(cfg.CHUNK_DEPTO_TOTAL))
            .when(lab <= 5, F.lit(cfg.CHUNK_MENSUAL))
            .when(lab == 6, F.lit(cfg.CHUNK_RANKING))
            .when(lab == 7, F.lit(cfg.CHUNK_EDAD))
            .otherwise(F.lit(cfg.CHUNK_PROVINCIAS)))
    bit0 = F.when(F.get("embedding", 0) >= 0, 1).otherwise(0)
    bit1 = F.when(F.get("embedding", 1) >= 0, 1).otherwise(0)
    depto = F.concat(F.lit("NATION_"), (lab * 2 + bit0).cast("string"))
    anio = (F.lit(1995) + F.floor(lab / 2).cast("int") + bit1).cast("string")
    meta = (F.when(lab == 9, F.lit(None).cast("string"))
            .when(lab == 6, F.concat(F.lit('{"año":'), anio, F.lit("}")))
            .otherwise(F.concat(F.lit('{"departamento":"'), depto, F.lit('","año":'), anio, F.lit("}"))))
    return e.select("vec_id", "label", tipo.alias("chunk_type"), "embedding", meta.alias("metadata_json"))


def preguntas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer (pregunta_id, texto); phrasing by market
    segment, year by a fixed rule on the key (some years fall outside the
    detected range, some are not word-bounded, one names two regions)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    b = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    y = (F.lit(1995) + F.pmod(F.col("c_custkey"), F.lit(8))).cast("string")
    r, n, s = F.lower("r_name"), F.lower("n_name"), F.col("c_mktsegment")
    texto = (F.when(s == "AUTOMOBILE", F.concat(F.lit("¿Cuántos casos hubo en "), r, F.lit(" durante "), y, F.lit("?")))
             .when(s == "BUILDING", F.concat(F.lit("Casos en "), n, F.lit(" ("), r, F.lit(") en el año "), y))
             .when(s == "FURNITURE", F.concat(F.lit("Resumen general sin filtros, año"), y))
             .when(s == "HOUSEHOLD", F.concat(F.lit("Compare eurasia con "), r, F.lit(" en "), y, F.lit("x")))
             .otherwise(F.concat(F.lit("¿qué significa "), y, F.lit(" para "), n, F.lit("?"))))
    return b.select(F.col("c_custkey").alias("pregunta_id"), texto.alias("texto"))


def gazetteer_regiones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place list in list order: (nombre, orden) from ``region``."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("nombre"), F.col("r_regionkey").alias("orden"))


def respuestas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers (conv_id, turn, raw) built from assistant turns: fenced
    JSON, plain JSON, free text, ``null``, ``[1]`` and a non-string texto,
    with bar / pie / invalid / empty charts."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    tipo = (F.when(F.pmod(F.col("conv_id"), F.lit(4)) == 0, F.lit("bar"))
            .when(F.pmod(F.col("conv_id"), F.lit(4)) == 1, F.lit("pie"))
            .when(F.pmod(F.col("conv_id"), F.lit(4)) == 2, F.lit("scatter"))
            .otherwise(F.lit("line")))
    datos = F.when(F.pmod(F.col("turn"), F.lit(5)) == 4, F.lit("[]")).otherwise(F.concat(
        F.lit('[{"nombre":"a","valor":'), F.length("text").cast("string"),
        F.lit('},{"nombre":"b","valor":'), (F.col("turn") + 1).cast("string"),
        F.lit('},{"nombre":"c","valor":'), F.col("conv_id").cast("string"), F.lit("}]")))
    obj = F.concat(F.lit('{"texto":"respuesta '), F.col("conv_id").cast("string"), F.lit("-"),
                   F.col("turn").cast("string"), F.lit('","grafica":{"tipo":"'), tipo,
                   F.lit('","titulo":"t","datos":'), datos, F.lit(',"ejeX":"x","ejeY":"y"}}'))
    raw = (F.when(k == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
           .when(k == 1, obj)
           .when(k == 2, F.col("text"))
           .when(k == 3, F.lit("null"))
           .when(k == 4, F.lit("[1]"))
           .otherwise(F.lit('{"texto":5}')))
    return c.select("conv_id", "turn", raw.alias("respuesta"))


def conversaciones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
