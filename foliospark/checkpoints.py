"""Where checkpoints go: the cluster's spark.checkpoint.dir, a temporary folder only where that is unset (local runs)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or os.path.join(tempfile.gettempdir(), f"foliospark-{os.getpid()}"))
    return sc.getCheckpointDir()
