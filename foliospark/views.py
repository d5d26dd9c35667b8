"""Relations that stand in for scanned pages, derived from the driver's tables, with their SQL twins.

A pixel relation has a row for each pixel: image_id, y, x and values; the origin is the top left corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL: dict[str, str] = {
    "px": "SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, floor(e::DOUBLE * 1000000 + 0.5) / 1000000 AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings)",
    "prob": "SELECT image_id, y, x, floor((v - min(v) OVER (PARTITION BY image_id)) / (max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id)) * 1000000 + 0.5) / 1000000 AS v FROM px",
    "logits": "SELECT image_id, (k // 4)::INT AS y, (k % 4)::INT AS x, z, ((label + k // 4 + k % 4) % 4)::INT AS label FROM (SELECT vec_id AS image_id, label, unnest(range(16)) AS k, unnest([[floor(embedding[4 * j + c]::DOUBLE * 1000000 + 0.5) / 1000000 FOR c IN [1, 2, 3, 4]] FOR j IN range(16)]) AS z FROM embeddings)",
    "rgb": "SELECT vec_id AS image_id, (k // 7)::INT AS y, (k % 7)::INT AS x, floor((embedding[3 * k + 1]::DOUBLE + 0.6) * 210)::INT AS r, floor((embedding[3 * k + 2]::DOUBLE + 0.6) * 210)::INT AS g, floor((embedding[3 * k + 3]::DOUBLE + 0.6) * 210)::INT AS b FROM (SELECT vec_id, embedding, unnest(range(21)) AS k FROM embeddings)",
    "palette": "SELECT * FROM (VALUES (0, 0, 0, 0), (1, 0, 255, 0), (2, 255, 0, 0), (3, 0, 0, 255), (4, 128, 128, 128), (5, 0, 255, 255)) AS p(class_id, r, g, b)",
    "regions": "SELECT l_orderkey AS image_id, (l_partkey % 200)::INT AS x, (l_suppkey % 200)::INT AS y, l_quantity::INT AS w, (10 + l_linenumber)::INT AS h, l_returnflag AS flag, l_linestatus AS status FROM lineitem",
    "points": "SELECT l_orderkey AS id, l_linenumber AS n, (l_partkey % 50)::VARCHAR || ',' || (l_suppkey % 40)::VARCHAR || ' ' || (l_partkey % 50 + l_linenumber + 3)::VARCHAR || ',' || (l_suppkey % 40 + 2)::VARCHAR || ' ' || (l_partkey % 50 + 1)::VARCHAR || ',' || (l_suppkey % 40 + l_linenumber + 5)::VARCHAR AS points FROM lineitem",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views it needs as common table expressions."""
    needed: list[str] = []
    for name in names:
        needed += [n for n in (["px"] if name == "prob" else []) + [name] if n not in needed]
    clause = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    return (f"WITH {clause}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {clause} {sql}") if needed else sql


def r6(c: Column) -> Column:
    """Rounded to six decimals the way that any engine's arithmetic repeats."""
    return F.floor(c * 1_000_000 + 0.5) / 1_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def px(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 rasters: image_id, y, x, v."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), r6(F.col("e").cast("double")).alias("v"))


def prob(spark: SparkSession, d: str) -> DataFrame:
    """``px`` stretched to 0 to 1 by image."""
    from .operators.pixels import stretch

    return stretch(px(spark, d)).withColumn("v", r6(F.col("v")))


def logits(spark: SparkSession, d: str) -> DataFrame:
    """4 x 4 rasters of 4 channels: image_id, y, x, z (array), label."""
    cells = F.expr("transform(sequence(0, 15), j -> transform(sequence(0, 3), c -> floor(double(embedding[4 * j + c]) * 1000000 + 0.5) / 1000000))")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode(cells).alias("k", "z"))
    y, x = F.floor(F.col("k") / 4).cast("int"), (F.col("k") % 4).cast("int")
    return e.select("image_id", y.alias("y"), x.alias("x"), "z", ((F.col("label") + y + x) % 4).cast("int").alias("label"))


def rgb(spark: SparkSession, d: str) -> DataFrame:
    """3 x 7 colour rasters: image_id, y, x, r, g, b."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    channel = lambda j: F.floor((F.get("embedding", 3 * F.col("k") + j).cast("double") + 0.6) * 210).cast("int")
    return e.select("image_id", F.floor(F.col("k") / 7).cast("int").alias("y"), (F.col("k") % 7).cast("int").alias("x"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def palette(spark: SparkSession) -> DataFrame:
    """class_id, r, g, b, codes: a small multilabel palette."""
    # fixed values
    rows = [(0, 0, 0, 0, [0, 0, 0]), (1, 0, 255, 0, [1, 0, 0]), (2, 255, 0, 0, [0, 1, 0]), (3, 0, 0, 255, [0, 0, 1]), (4, 128, 128, 128, [1, 1, 0]), (5, 0, 255, 255, [0, 1, 1])]
    return spark.createDataFrame(rows, "class_id int, r int, g int, b int, codes array<int>")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles with two attributes: image_id, x, y, w, h, flag, status."""
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 200).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") + 10).cast("int").alias("h"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Triangles as point strings: id, n, points."""
    t = table(spark, d, "lineitem")
    p, s, n = F.col("l_partkey") % 50, F.col("l_suppkey") % 40, F.col("l_linenumber")
    pair = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string"))
    return t.select(F.col("l_orderkey").alias("id"), n.alias("n"), F.concat_ws(" ", pair(p, s), pair(p + n + 3, s + 2), pair(p + 1, s + n + 5)).alias("points"))
