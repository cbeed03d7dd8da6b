"""Incremental registry load with Structured Streaming (S1 -> C -> K1).

The source reloads the whole registry each time. Because surrogate keys are
hashes of natural keys (``operators.warehouse``), the same load can run
incrementally: new CSV files dropped in a folder are cleaned with the
national rules and appended to the accepted-record table, exactly once
(file source + parquet sink + checkpoint). No dimension state has to be
kept between micro-batches; dimensions are distinct natural keys of that
table and are derived on read (``estrella_desde_registro``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat import config as cfg
from regstat.operators import clean as CL
from regstat.operators import warehouse as WH
from regstat.sources.registry import REGISTRY_COLUMNS

REGISTRY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_COLUMNS])


def registro_stream(spark: SparkSession, source_dir: str, encoding: str = "ISO-8859-1",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming S1: Latin-1 header CSV files of the registry, all strings.
    A file whose header has other columns, or another order, is an error."""
    reader = (spark.readStream.schema(REGISTRY_SCHEMA).option("header", True)
              .option("encoding", encoding).option("escape", '"').option("enforceSchema", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def iniciar_carga(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                  params: cfg.Params = cfg.SOURCE, available_now: bool = True):
    """Start the incremental load; returns the ``StreamingQuery``.

    Accepted rows (natural keys, hashed ids, age, visits) are appended to
    ``out_dir`` partitioned by year. ``checkpoint`` must be on shared
    storage; with ``available_now`` the query drains the files present and
    stops (a scheduled batch), otherwise it keeps running.
    """
    clean = CL.limpiar_nacional(registro_stream(spark, source_dir), params)
    valid = clean.where(F.col("valido")).drop("valido")
    rows = valid.select("*", WH._id(*WH.TIME_KEY).alias("tiempo_id"),
                        WH._id(*WH.GEO_KEY).alias("geografia_id"),
                        WH._id(*WH.PATIENT_KEY).alias("paciente_id"))
    writer = (rows.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).partitionBy("anio").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def estrella_desde_registro(spark: SparkSession, registro_dir: str, poblacion: DataFrame,
                            params: cfg.Params = cfg.SOURCE) -> dict:
    """Star tables over the accumulated accepted rows."""
    acc = spark.read.parquet(registro_dir).withColumn("valido", F.lit(True))
    return WH.construir_estrella(spark, acc, poblacion, params)
