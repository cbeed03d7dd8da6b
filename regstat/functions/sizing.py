"""Small intermediates that several branches read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materializar(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate that several branches read
    (a grouping-sets result): a reliable ``checkpoint`` into the shared
    folder named by ``spark.checkpoint.dir``. Every branch then reads the
    same materialized rows (one computation of the input, no per-branch
    re-planning), and a lost executor cannot force a recomputation."""
    from regstat.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
