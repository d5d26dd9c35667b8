"""Small text formats: palettes, pair lists, quad lines, score reports, configuration."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_quad


def read_palette(spark: SparkSession, path: str, multilabel: bool = False) -> DataFrame:
    """class_id, r, g, b, codes of a white-space table: three columns, or (multilabel) more. The class is the row's number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda s: F.btrim(s) != "")).alias("class_id", "line"))
    parts = lines.withColumn("n", F.transform(F.split(F.btrim("line"), r"\s+"), lambda s: s.cast("double").cast("int")))
    good = F.size("n") > 3 if multilabel else F.size("n") == 3
    checked = parts.withColumn("n", F.when(good, F.col("n")).otherwise(F.raise_error(F.lit("a palette row has the wrong number of columns")).cast("array<int>")))
    return checked.select("class_id", *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate("rgb")], F.slice("n", F.lit(4), F.size("n")).alias("codes"))


def class_count(palette: DataFrame, multilabel: bool = False) -> int:
    """Classes of a palette: its rows, or the width of its codes."""
    return palette.agg(F.max(F.size("codes"))).first()[0] if multilabel else palette.count()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """image, label of a headerless CSV; labels are all null or all count."""
    return spark.read.csv(path, schema="image string, label string")


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.btrim("value") != "").select(parse_quad(F.col("value")).alias("q")).select("q.*")


def parse_scores(lines: DataFrame) -> DataFrame:
    """path, n (line number), value of reports -> basename, f1, p, r, ascending f1: rows between the header and the next blank line."""
    report = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    head = F.col("value").startswith("#P value")
    marked = lines.withColumn("_in", F.sum(head.cast("int")).over(report)).withColumn("_blank", F.sum(((F.col("_in") > 0) & (F.btrim("value") == "")).cast("int")).over(report))
    rows = marked.where((F.col("_in") > 0) & (F.col("_blank") == 0) & ~head).withColumn("c", F.transform(F.split("value", ","), lambda s: F.btrim(s)))
    number = lambda i: F.get("c", F.lit(i)).cast("double")
    return rows.select(F.element_at(F.split(F.get("c", F.lit(4)), "/"), -1).alias("basename"), number(2).alias("f1"), number(0).alias("p"), number(1).alias("r")).orderBy("f1", "basename")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return parse_scores(lines)


def config_digest(config: dict) -> str:
    """SHA-1 of the configuration as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()
