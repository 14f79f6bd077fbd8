"""Ships this package to Python workers, and names the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Add a zip of the package to the session's context, once per application, and bound the bytes of a batch that goes to
    Python, unless the session names its own bound: rows may be long texts, and a batch is held on both sides."""
    sc = spark.sparkContext
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(4 << 20))
    if sc.applicationId not in _DONE:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-zip-"), "quarry.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _DONE.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the checkpoint folder set on the session; only a local master may do without, with a folder of its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")
