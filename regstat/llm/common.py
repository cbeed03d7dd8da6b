"""Helpers shared by the operators: table access, written intermediates and
gapless ranks."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SEEN: set = set()
#: folder of written intermediates, and how long they are kept
WRITTEN, KEEP_HOURS = "regstat-llm", 48.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests) without the setting gets a folder of its own;
    a cluster without it is an error, because executors could not read each
    other's files.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder on shared storage")
        key = sc.applicationId
        if key not in _LOCAL_DIRS:
            _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="regstat-llm-")
        folder = _LOCAL_DIRS[key]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    folder = folder.rstrip("/")
    if (sc.applicationId, folder) not in _SEEN:
        _SEEN.add((sc.applicationId, folder))
        expire(spark, folder)
    return folder


def expire(spark: SparkSession, folder: str, hours: float = KEEP_HOURS) -> int:
    """Remove what ``written`` left in ``folder`` more than ``hours`` ago;
    results read later than that must be written again. Returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{WRITTEN}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    limit = 1000 * (time.time() - 3600 * hours)
    old = [s.getPath() for s in files.listStatus(path) if s.getModificationTime() < limit]
    for p in old:
        files.delete(p, True)
    return len(old)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its
    lineage is cut, several readers compute it once, and a lost executor
    costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{WRITTEN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterations; Spark
    removes the files with the reference when its cleaner is told to."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(run):
    """The function on batches, giving freed memory back to the system when
    its task ends: Python workers are reused, and what one stage freed would
    count beside what the next one needs."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-int(rows) // per_bucket))


def gapless_rank(df: DataFrame, by: list[str], order: list[str], rank: str,
                 rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each group ``by`` from 0 without gaps.

    ``by`` + ``order`` must be all the columns of ``df``. Repeated rows are
    first counted (partial aggregation), a group is dealt into hash buckets
    of about ``per_bucket`` rows that are sorted separately, and a running
    sum over the bucket counts gives each bucket its first number, so no
    task sorts a whole group however many rows it has. Repeated rows get
    consecutive numbers.
    """
    n_buckets = buckets_for(rows, per_bucket)
    counted = (df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int")))
    counted = written(counted, "rank")
    sizes = counted.groupBy(*by, "_b").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_b").alias("_s_b"),
                          F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy(*by, "_b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by] + [F.col("_b") == F.col("_s_b")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = placed.join(starts, cond).withColumn("_first", F.col("_start") + F.col("_in"))
    step = 65_536
    spread = (joined
              .withColumn("_part", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
              .withColumn("_k", F.explode(F.sequence(
                  F.col("_part") * step,
                  F.least((F.col("_part") + 1) * step, F.col("_n")) - 1))))
    return spread.select(*by, *order, (F.col("_first") + F.col("_k")).alias(rank))
