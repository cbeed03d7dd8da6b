"""Make the package importable on the executors' Python workers.

Python stages (``mapInPandas``) run functions defined in this package; the
workers import them by name. ``ship_package`` zips the package once per
process and registers it with ``SparkContext.addPyFile`` once per context,
so it works whatever the driver's working directory or the cluster layout.
"""

from __future__ import annotations

import os
import shutil
import tempfile

_ZIP: str | None = None
_SHIPPED: set = set()


def _zip() -> str:
    global _ZIP
    if _ZIP is None or not os.path.exists(_ZIP):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = tempfile.mkdtemp(prefix="regstat-pkg-")
        base = os.path.join(out, "regstat")
        _ZIP = shutil.make_archive(base, "zip", root_dir=root, base_dir="regstat")
    return _ZIP


def ship_package(spark) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    sc.addPyFile(_zip())
    _SHIPPED.add(key)
