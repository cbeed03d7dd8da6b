"""Shared checkpoint folder: read from the session, never overridden."""

import os

from regstat.functions.sizing import materializar
from regstat.session import checkpoint_dir


def test_checkpoint_dir_is_read_not_overridden(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == configured
    assert spark.conf.get("spark.checkpoint.dir") == configured


def test_materializar_writes_into_the_shared_folder(spark):
    before = sum(len(files) for _, _, files in os.walk(checkpoint_dir(spark)))
    df = materializar(spark.range(10).selectExpr("id", "id * 2 as doble"))
    assert df.count() == 10 and df.agg({"doble": "sum"}).collect()[0][0] == 90
    after = sum(len(files) for _, _, files in os.walk(checkpoint_dir(spark)))
    assert after > before
