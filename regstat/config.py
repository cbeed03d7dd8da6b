"""Fixed values and dataset parameters.

The first block holds values that must equal the source application's for
equal results; they are stated as plain text, in their natural order.
The ``Params`` dataclass carries the dataset-dependent settings (year range,
partial year, ...). Its defaults are the source's; the stand-in dataset built
from the test tables uses ``STANDIN``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's)
# ---------------------------------------------------------------------------
AGE_BAND_UPPER_BOUNDS = (20, 30, 40, 50, 60, 70, 80)
AGE_BANDS = ("0-20", "21-30", "31-40", "41-50", "51-60", "61-70", "71-80", "81+")
UNKNOWN = "DESCONOCIDO"
UNKNOWN_BAND_REGIONAL = "desconocido"
UNKNOWN_PROVINCE_REGIONAL = "DESCONOCIDA"
SEXES = ("FEMENINO", "MASCULINO")
MONTH_LABELS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun",
                "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
RATE_SCALE = 100000
DEPARTMENTS = (
    "AMAZONAS", "ANCASH", "APURIMAC", "AREQUIPA", "AYACUCHO", "CAJAMARCA",
    "CALLAO", "CUSCO", "HUANCAVELICA", "HUANUCO", "ICA", "JUNIN",
    "LA LIBERTAD", "LAMBAYEQUE", "LIMA", "LORETO", "MADRE DE DIOS",
    "MOQUEGUA", "PASCO", "PIURA", "PUNO", "SAN MARTIN", "TACNA", "TUMBES",
    "UCAYALI",
)
REGION_BOOST = 1.3
YEAR_BOOST = 1.2
TOP_K = 8
EMBED_BATCH = 20
CHART_TYPES = ("bar", "line", "pie", "area")
TREND_THRESHOLD = 0.5
TREND_LABELS = ("creciente", "decreciente", "estable")
MIN_MONTHS_FOR_CHUNK = 3
MIN_PROVINCES_FOR_CHUNK = 2
MIN_TREND_POINTS = 2
TOP_PROVINCES = 5
TOP_RANKING_CHUNK = 10
TOP_RANKING_CONTEXT = 10
# Choropleth: channel = base + slope * intensity, rounded half up.
MAP_RED = (30, 200)
MAP_GREEN = (60, -30)
MAP_BLUE = (120, -90)
MAP_DEFAULT_FILL = "#374151"
ZONE_COAST = "#1565C0"
ZONE_CALLAO = "#1976D2"
ZONE_HIGHLANDS = "#6D4C41"
ZONE_AYACUCHO = "#B71C1C"
ZONE_JUNGLE = "#2E7D32"
ZONE_COLORS = {
    "TUMBES": ZONE_COAST, "PIURA": ZONE_COAST, "LAMBAYEQUE": ZONE_COAST,
    "LA LIBERTAD": ZONE_COAST, "ANCASH": ZONE_COAST, "LIMA": ZONE_COAST,
    "ICA": ZONE_COAST, "AREQUIPA": ZONE_COAST, "MOQUEGUA": ZONE_COAST,
    "TACNA": ZONE_COAST, "CALLAO": ZONE_CALLAO, "CAJAMARCA": ZONE_HIGHLANDS,
    "HUANUCO": ZONE_HIGHLANDS, "PASCO": ZONE_HIGHLANDS, "JUNIN": ZONE_HIGHLANDS,
    "HUANCAVELICA": ZONE_HIGHLANDS, "AYACUCHO": ZONE_AYACUCHO,
    "APURIMAC": ZONE_HIGHLANDS, "CUSCO": ZONE_HIGHLANDS, "PUNO": ZONE_HIGHLANDS,
    "AMAZONAS": ZONE_JUNGLE, "LORETO": ZONE_JUNGLE, "SAN MARTIN": ZONE_JUNGLE,
    "UCAYALI": ZONE_JUNGLE, "MADRE DE DIOS": ZONE_JUNGLE,
}
# Chunk families and sentence pieces.
CHUNK_DEPTO_ANIO = "resumen_depto_año"
CHUNK_DEPTO_TOTAL = "resumen_depto_total"
CHUNK_MENSUAL = "tendencia_mensual"
CHUNK_RANKING = "ranking_deptos"
CHUNK_EDAD = "distribucion_edad"
CHUNK_PROVINCIAS = "detalle_provincial"
CHUNK_TYPES = (CHUNK_DEPTO_ANIO, CHUNK_DEPTO_TOTAL, CHUNK_MENSUAL,
               CHUNK_RANKING, CHUNK_EDAD, CHUNK_PROVINCIAS)
PARTIAL_NOTE_LONG = " (datos parciales enero-noviembre)"
PARTIAL_NOTE_SHORT = " (datos parciales)"
SOURCE_NAME = "INEN"
SOURCE_RANGE = "Enero 2022 - Noviembre 2025"
SOURCE_NOTE = "Listado de Pacientes Nuevos registrados en el INEN"
# Chunk sentences (X1-X6), with their list items and optional parts;
# {names} are filled per row. The year span of the source ("2022", "2025")
# is the {desde}/{hasta} parameter here.
TPL_DEPTO_ANIO = ("En {anio}{parcial}, el departamento de {departamento} registró {casos} casos "
                  "oncológicos nuevos en el {fuente}{tasa}. Distribución por sexo: {pct_femenino}% "
                  "femenino, {pct_masculino}% masculino. Edad promedio: {edad} años.")
TPL_DEPTO_ANIO_TASA = ", tasa de {tasa} por 100,000 habitantes"
TPL_DEPTO_TOTAL = ("El departamento de {departamento} acumuló {casos} casos oncológicos nuevos "
                   "entre {desde} y {hasta} en el {fuente}. {pct_femenino}% son mujeres, edad "
                   "promedio {edad} años.{provincia}")
TPL_DEPTO_TOTAL_PROV = " La provincia con mayor carga es {provincia} con {casos} casos ({pct}%)."
TPL_MENSUAL = ("En {departamento} {anio}, la distribución mensual de casos fue: {serie}. El pico "
               "se registró en {mes_pico} con {casos_pico} casos. Promedio mensual: {promedio}.")
TPL_MENSUAL_ITEM = "{mes}={casos}"
TPL_RANKING = ("Ranking de departamentos por número de casos oncológicos registrados en {fuente} "
               "{anio}{parcial}: {ranking}. Total nacional: {total} casos.")
TPL_RANKING_ITEM = "{posicion}. {departamento} ({casos})"
TPL_EDAD = ("Distribución por grupo etario en {departamento} ({desde}-{hasta}): {grupos}. El grupo "
            "con mayor incidencia es {grupo} con {casos} casos ({pct}%).")
TPL_EDAD_ITEM = "{grupo}: {casos} ({pct}%)"
TPL_PROVINCIAS = "Principales provincias de {departamento} por casos oncológicos ({desde}-{hasta}): {provincias}."
TPL_PROVINCIAS_ITEM = "{provincia}: {casos} ({pct}%)"
TPL_LIST_SEPARATOR = ", "
NO_CONTEXT = "No se encontró contexto relevante."
NO_SQL_DATA = "No disponible."
CONTEXT_PLACEHOLDER = "[CONTEXTO_RAG]"
SQL_PLACEHOLDER = "[DATOS_SQL]"
# Prompt skeleton used by the context assembly (placeholders are the fixed
# part; the surrounding prose is ours).
PROMPT_TEMPLATE = (
    "Contexto recuperado:\n[CONTEXTO_RAG]\n\n"
    "Datos exactos:\n[DATOS_SQL]"
)


# Sketches of the star: sizes, and the errors they keep with 99 % confidence
# (KLL, normalised rank, k = 400) or three standard errors (HLL, 2^12 registers).
SKETCH_K, SKETCH_LG = 400, 12
SKETCH_RANK_ERROR, SKETCH_DISTINCT_ERROR = 0.01, 0.05


@dataclass(frozen=True)
class Params:
    """Dataset-dependent parameters; defaults are the source's values."""

    first_year: int = 2022
    last_year: int = 2025
    partial_year: int = 2025
    # Years of the regional report (string comparison in the source).
    report_years: tuple = (2022, 2023, 2024, 2025)
    # Population sheets: name -> the three years it holds.
    sheet_years: dict = field(default_factory=lambda: {
        "2015-2017": (2015, 2016, 2017),
        "2018-2020": (2018, 2019, 2020),
        "2021-2023": (2021, 2022, 2023),
        "2024-2026": (2024, 2025, 2026),
    })
    default_trend_year: int = 2024
    rate_scale: int = RATE_SCALE

    @property
    def years(self) -> tuple:
        return tuple(range(self.first_year, self.last_year + 1))


SOURCE = Params()

# Stand-in dataset built from the test tables: order dates run 1995-01 to
# 2001-08, so 2001 is the partial year.
STANDIN = Params(
    first_year=1995,
    last_year=2001,
    partial_year=2001,
    report_years=(1995, 1996, 1997, 1998, 1999, 2000, 2001),
    sheet_years={
        "1993-1995": (1993, 1994, 1995),
        "1996-1998": (1996, 1997, 1998),
        "1999-2001": (1999, 2000, 2001),
        "2002-2004": (2002, 2003, 2004),
    },
    default_trend_year=2000,
)
