"""Classes and colours: nearest palette entry, look-ups, multilabel codes, class decisions from logits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import ensure

#: Palettes of up to this many entries are inlined as one array expression or broadcast; larger ones are joined.
PALETTE_LIMIT = 256
#: Distinct colours are broadcast up to this number.
BROADCAST_COLOURS = 1_000_000
#: Values a channel may have, and span of classes, for a search over the cube of colours.
CUBE_SIDE, CLASS_SPAN = 512, 1 << 41
_FAR = np.int64(1 << 62)  # beyond any key: a squared distance, then a class in 41 bits


def _is_small(palette: DataFrame, limit: int = PALETTE_LIMIT) -> bool:
    return palette.limit(limit + 1).count() <= limit


def _side(palette: DataFrame) -> DataFrame:
    """The palette as a side of a join, broadcast if it is small."""
    return F.broadcast(palette) if _is_small(palette, BROADCAST_COLOURS) else palette


def nearest_class(pixels: DataFrame, palette: DataFrame, out: str = "class_id", limit: int = PALETTE_LIMIT) -> DataFrame:
    """Class of the palette colour nearest to r, g, b (squared distance; of equals the first class).

    A palette of up to ``limit`` colours is inlined, without a join; larger ones are searched by ``nearest_in_cube``.
    """
    if not _is_small(palette, limit):
        return nearest_in_cube(pixels, palette, out)
    entries = palette.select("class_id", "r", "g", "b").orderBy("class_id").collect()
    colours = F.array(*[F.struct(*[F.lit(e[c]).alias(c) for c in ("class_id", "r", "g", "b")]) for e in entries])
    square = lambda x: x * x
    far = F.transform(colours, lambda e: F.struct((square(F.col("r") - e["r"]) + square(F.col("g") - e["g"]) + square(F.col("b") - e["b"])).alias("d"), e["class_id"].alias("class_id")))
    return pixels.withColumn(out, F.array_min(far)["class_id"])


def nearest_in_cube(pixels: DataFrame, palette: DataFrame, out: str = "class_id") -> DataFrame:
    """``nearest_class`` for palettes of any size, one channel after the other: squared distances are sums over channels.

    Among the palette's colours of equal r the least keys (distance, class) are found for all b, then for all g; for
    each g then over all r. A step holds a square of the cube, whatever the palette, and distinct colours and 8 bytes
    for a place of the cube at most are shuffled. Channels of more than ``CUBE_SIDE`` values, and classes that aren't whole
    numbers within ``CLASS_SPAN``, go to ``nearest_in_cells``.
    """
    ensure(pixels.sparkSession)
    at = ["r", "g", "b"]
    kind = palette.schema["class_id"].dataType.simpleString()
    whole = lambda d: d.where("r is not null and g is not null and b is not null")
    spans = [f(c).alias(f"{n}_{c}") for c in at for n, f in (("low", F.min), ("high", F.max))]
    ends = whole(palette).agg(*spans, F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count_if(F.col("class_id").isNull()).alias("nulls")).first()
    asked = whole(pixels).agg(*spans).first()
    if ends["low_r"] is None or asked["low_r"] is None or ends["nulls"] or kind not in ("tinyint", "smallint", "int", "bigint") or ends["high"] - ends["low"] >= CLASS_SPAN:
        return nearest_in_cells(pixels, palette, out)
    low = {c: min(ends[f"low_{c}"], asked[f"low_{c}"]) for c in at}
    n = {c: max(ends[f"high_{c}"], asked[f"high_{c}"]) - low[c] + 1 for c in at}
    if max(n.values()) > CUBE_SIDE:
        return nearest_in_cells(pixels, palette, out)
    first, begin, end = ends["low"], asked["low_g"] - low["g"], asked["high_g"] - low["g"] + 1
    moved = [(F.col(c) - low[c]).cast("int").alias(c) for c in at]
    known = whole(palette).groupBy(*at).agg(F.min("class_id").alias("class")).select(*moved, (F.col("class") - first).cast("long").alias("class"))

    def slab(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.full((n["g"], n["b"]), _FAR)
        keys[rows["g"], rows["b"]] = rows["class"]
        keys = np.ascontiguousarray(_spread(np.ascontiguousarray(_spread(keys).T)).T)
        return pd.DataFrame({"r": rows["r"].iat[0], "g": range(begin, end), "line": [keys[g].tobytes() for g in range(begin, end)]})

    def meet(colours: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        best, places = np.full((n["r"], n["b"]), _FAR), np.arange(n["r"])
        for r, line in zip(lines["r"], lines["line"], strict=True) if len(colours) else ():
            np.minimum(best, np.frombuffer(line, np.int64) + (((places - r) ** 2) << 41)[:, None], out=best)
        found = best[colours["r"], colours["b"]] & (CLASS_SPAN - 1)
        return pd.DataFrame({**{c: colours[c] + low[c] for c in at}, "_class": found + first})

    lines = known.groupBy("r").applyInPandas(slab, "r int, g int, line binary")
    wanted = whole(pixels).select(*at).distinct().select(*moved)
    # classes come as a checkpoint, so that counting and joining them don't make them twice
    found = wanted.groupBy("g").cogroup(lines.groupBy("g")).applyInPandas(meet, "r int, g int, b int, _class long").checkpoint()
    return pixels.join(_side(found), at, "left").select(*pixels.columns, F.col("_class").cast(kind).alias(out))


def _spread(keys: np.ndarray) -> np.ndarray:
    """For each place of a row the least of the row's keys, each more by the square of how far it is."""
    out, places = np.full_like(keys, _FAR), np.arange(keys.shape[1])
    for k in np.flatnonzero((keys < _FAR).any(axis=0)):
        np.minimum(out, keys[:, k, None] + (((places - k) ** 2) << 41), out=out)
    return out


def nearest_in_cells(pixels: DataFrame, palette: DataFrame, out: str = "class_id", edge: int = 8) -> DataFrame:
    """``nearest_class`` for palettes of any size: the colour cube is cut into cells of ``edge`` values a side.

    Every distinct colour looks into its own cell, then into rings of cells around it, until the best colour found is
    nearer than anything beyond the rings can be. A cell holds edge^3 distinct colours at most, on either side, and the
    rings are 256 / edge at most, whatever the palette. Pixels with a null channel have a null class, and so has every
    pixel if the palette is empty.
    """
    spark, at = pixels.sparkSession, ["r", "g", "b"]
    ensure(spark)
    cell = lambda c: F.floor(F.col(c) / edge).cast("int")
    known = palette.groupBy(*[F.col(c).alias(f"p{c}") for c in at]).agg(F.min("class_id").alias("class"))
    known = known.select("*", *[cell(f"p{c}").alias(f"k{c}") for c in at]).checkpoint()
    ends = known.agg(*[f(f"k{c}").alias(f"{n}{c}") for c in at for n, f in (("low", F.min), ("high", F.max))]).first()
    wanted = pixels.select(*at).where("r is not null and g is not null and b is not null").distinct()
    square = lambda x: x * x
    distance = square(F.col("r") - F.col("pr")) + square(F.col("g") - F.col("pg")) + square(F.col("b") - F.col("pb"))
    left = wanted.select(*at, F.lit(None).cast("struct<d:int,class:" + palette.schema["class_id"].dataType.simpleString() + ">").alias("best")).checkpoint()
    found, ring = left.where("false"), 0
    while ends[0] is not None and not left.isEmpty():
        steps = F.sequence(F.lit(-ring), F.lit(ring))
        near = left
        for c in at:
            near = near.withColumn(f"s{c}", F.explode(steps)).withColumn(f"k{c}", cell(c) + F.col(f"s{c}")).where(F.col(f"k{c}").between(ends[f"low{c}"], ends[f"high{c}"]))
        near = near.where(F.greatest(*[F.abs(f"s{c}") for c in at]) == ring).join(known, [f"k{c}" for c in at])
        near = near.groupBy(*at).agg(F.min(F.struct(distance.cast("int").alias("d"), "class")).alias("new"))
        # beyond the rings a colour is at least this far away in one channel
        beyond = F.least(*[F.least(F.col(c) - (cell(c) - ring) * edge + 1, (cell(c) + ring + 1) * edge - F.col(c)) for c in at])
        over = F.lit(True)
        for c in at:  # the rings have passed all cells of the palette
            over = over & (cell(c) - ring <= ends[f"low{c}"]) & (cell(c) + ring >= ends[f"high{c}"])
        step = left.join(near, at, "left").select(*at, F.coalesce(F.least("best", "new"), "best", "new").alias("best"), over.alias("over"), beyond.alias("beyond"))
        step = step.withColumn("done", F.coalesce(F.col("best.d") < square(F.col("beyond")), F.lit(False)) | F.col("over")).checkpoint()
        found = found.unionByName(step.where("done").select(*at, "best"))
        left, ring = step.where("not done").select(*at, "best").checkpoint(), ring + 1
    classes = _side(found.select(*at, F.col("best.class").alias("_class")))
    return pixels.join(classes, at, "left").select(*pixels.columns, F.col("_class").alias(out))


def class_colour(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """class_id to r, g, b."""
    return pixels.join(_side(palette.select("class_id", "r", "g", "b")), "class_id", "left")


def nearest_codes(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Booleans of the nearest colour's codes, as ``labels``."""
    classes = _side(palette.select("class_id", F.transform("codes", lambda c: c > 0).alias("labels")))
    return nearest_class(pixels, palette, "class_id").join(classes, "class_id", "left")


def codes_colour(pixels: DataFrame, palette: DataFrame, codes: str = "codes") -> DataFrame:
    """Codes to r, g, b; combinations that the palette lacks are black."""
    known = _side(palette.select(F.col("codes").alias("_codes"), "r", "g", "b"))
    out = pixels.join(known, F.col(codes) == F.col("_codes"), "left").drop("_codes")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")})


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    powers = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def argmax(z: Column) -> Column:
    """Place of the largest value, from 0; of equals the first."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def decide(z: Column, kind: str) -> Column:
    """Predicted label of a pixel: its class, its booleans, or the value itself."""
    if kind == "classification":
        return argmax(z)
    if kind == "multilabel":
        return F.transform(z, lambda x: (sigmoid(x) >= 0.5))
    if kind == "regression":
        return z
    raise ValueError(f"unknown kind: {kind}")


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == label).cast("int"))


def class_table(colours: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """Rows r, g, b, codes of a multilabel palette made of base colours: all their sums (to 255 at most), a code for each channel that is set."""
    sums = {(0, 0, 0)}
    for c in colours:
        sums |= {tuple(min(255, a + b) for a, b in zip(c, s, strict=True)) for s in sums}
    return [(*s, *[int(v > 0) for v in s]) for s in sorted(sums)]
