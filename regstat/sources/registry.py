"""S1 registry CSV reader, S3 report reader, S4 chunk-table scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat.functions.columns import clean_header

REGISTRY_COLUMNS = ("UUID", "HISTORIA", "FEC_FILIACION", "SEXO", "EDAD",
                    "UBIGEO_LUGAR_RESIDENCIA", "LUGAR_RESIDENCIA",
                    "CANT_ATENCIONES_CEX", "FECHA_CORTE")


def read_registry(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                  header_names: list | None = None, multi_line: bool = False,
                  detalle: bool = False) -> DataFrame:
    """Header CSV in Latin-1, every column a string, blank lines skipped.

    Columns are bound by the file's own header, whatever its order; names are
    cleaned (C1: trimmed, surrounding quotes removed). ``header_names`` are
    the columns wanted, in the order wanted. Quotes inside a quoted field are
    doubled. ``multi_line`` allows line ends inside quoted fields; such files
    cannot be split among tasks.

    ``detalle`` adds ``_orden``, a row's place in the file set (file, start of
    the block, number inside it: comparable whatever the partitioning), and
    ``_corrupto``, the text of a record with too many or too few fields (null
    for a sound one; missing fields are null, surplus ones are dropped).
    """
    # Only the header line is inspected (no type inference).
    reader = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
              .option("escape", '"').option("multiLine", multi_line).option("inferSchema", False))
    names = reader.csv(path).columns
    wanted = [clean_header(c) for c in names] if header_names is None else [clean_header(h) for h in header_names]
    places = {clean_header(c): c for c in names}
    if detalle:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupto"]])
        # a record is only seen to be broken when all of its fields are parsed
        df = (reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupto")
              .option("columnPruning", False).csv(path))
        place = F.struct(F.col("_metadata.file_path").alias("archivo"),
                         F.col("_metadata.file_block_start").alias("bloque"),
                         F.monotonically_increasing_id().alias("n")).alias("_orden")
        return df.select(*[F.col(f"`{places[w]}`").alias(w) for w in wanted], place, "_corrupto")
    return reader.csv(path).select(*[F.col(f"`{places[w]}`").alias(w) for w in wanted])


REPORT_SCHEMA = T.StructType([
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("por_año", T.MapType(T.StringType(), T.StructType([
        T.StructField("casos", T.LongType()), T.StructField("poblacion", T.LongType()),
        T.StructField("tasa_por_100k", T.DoubleType()), T.StructField("completo", T.BooleanType())]))),
    T.StructField("por_mes", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
    T.StructField("por_sexo", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
    T.StructField("por_grupo_etario", T.MapType(T.StringType(), T.StringType())),
    T.StructField("por_provincia", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
    T.StructField("atenciones_cex", T.StructType([
        T.StructField("promedio_total", T.DoubleType()),
        T.StructField("por_año", T.MapType(T.StringType(), T.StructType([
            T.StructField("promedio", T.DoubleType()), T.StructField("mediana", T.DoubleType()),
            T.StructField("max", T.LongType())])))])),
    T.StructField("poblacion_inei", T.MapType(T.StringType(), T.StructType([
        T.StructField("total", T.LongType()), T.StructField("hombres", T.LongType()),
        T.StructField("mujeres", T.LongType())]))),
])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """S3: load report documents (one JSON document per file). The age-band
    section holds its list of bands under ``grupos`` beside the years; the
    list is read into a column of its own, ``grupos``."""
    df = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    raw = F.col("por_grupo_etario")
    years = F.transform_values(F.map_filter(raw, lambda k, _: k != "grupos"),
                               lambda _, v: F.from_json(v, "map<string,bigint>"))
    return (df.withColumn("grupos", F.from_json(F.try_element_at(raw, F.lit("grupos")), "array<string>"))
            .withColumn("por_grupo_etario", years))


NUMERIC_VARIANT = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector; metadata parsed (``{}`` when absent) into
    typed columns. Values keep their JSON type, as a strict equality would:
    ``meta_departamento`` only from a JSON string, ``meta_anio`` only from
    a whole JSON number (a year written as text never matches)."""
    meta = F.try_parse_json(F.coalesce(F.col("metadata_json"), F.lit("{}")))
    dep = F.try_variant_get("_meta", "$.departamento", "variant")
    yr = F.try_variant_get("_meta", "$['año']", "variant")
    yr_num = F.try_variant_get("_meta", "$['año']", "double")
    return (chunks.where(F.col("embedding").isNotNull())
            .withColumn("_meta", meta)
            .withColumn("meta_departamento",
                        F.when(F.schema_of_variant(dep) == "STRING",
                               F.try_variant_get("_meta", "$.departamento", "string")))
            .withColumn("meta_anio",
                        F.when(F.schema_of_variant(yr).rlike(NUMERIC_VARIANT) & (yr_num == F.floor(yr_num)),
                               yr_num.cast("int")))
            .drop("_meta"))


def decodificar_blob(col) -> F.Column:
    """S4 legacy form: little-endian float32 bytes -> array<float>
    (Arrow-batched pandas UDF; null stays null)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(bytes(x), dtype="<f4").astype(np.float32))

    return _decode(F.col(col) if isinstance(col, str) else col)


def codificar_blob(col) -> F.Column:
    """K3 legacy form: array<float> -> little-endian float32 bytes (null stays null)."""
    @F.pandas_udf(T.BinaryType())
    def _encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return _encode(F.col(col) if isinstance(col, str) else col)


def guardar_chunks(chunks: DataFrame, path: str) -> None:
    """K3: chunk table (type, key, text, vector, metadata JSON) as Parquet;
    the vector stays a native array<float> column."""
    (chunks.select("chunk_type", "chunk_key", "content", F.col("embedding").cast("array<float>"),
                   "metadata_json")
     .write.mode("overwrite").parquet(path))
