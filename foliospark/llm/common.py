"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STAGED: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), f"foliospark-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark-staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    _STAGED[path] = spark
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            _delete(path, _STAGED.pop(path, df.sparkSession))


def _delete(path: str, spark: SparkSession) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _STAGED.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(path, spark)
        except Exception:  # the application may be gone already
            return
