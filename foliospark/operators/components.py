"""Connected components of foreground pixels (8-neighbourhood), and what is built on them.

``label_images`` labels image by image inside tasks, for images that fit one; ``label_tiled`` labels tiles and
joins their borders, for images of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels


def label_grid(mask: np.ndarray) -> np.ndarray:
    """Labels (1 + least reading-order place of the component; 0: background) of a boolean array."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        padded = np.full((h + 2, w + 2), big)
        padded[1:-1, 1:-1] = np.where(mask, labels, big)
        least = np.minimum.reduce([padded[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        new = np.where(mask, np.minimum(labels, least), 0)
        flat = np.append(0, new.ravel())
        flat = flat[flat]  # the label of the label's own pixel
        new = flat[1:].reshape(h, w)
        if (new == labels).all():
            return labels
        labels = new


def label_images(mask: DataFrame) -> DataFrame:
    """Foreground (image_id, y, x) -> + component: its first pixel in reading order, as y * (width of the box around the foreground) + x."""

    rows = mask.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int")).distinct()
    out = _labelled(rows, ["image_id"], "image_id long")
    return out.select("image_id", "y", "x", F.struct("cy", "cx").alias("component"))


def _labelled(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """keys, y, x, cy, cx: each pixel's component within its key's pixels."""

    def kernel(r: tuple) -> list[tuple]:
        y0, x0 = int(r.y.min()), int(r.x.min())
        grid = np.zeros((int(r.y.max()) - y0 + 1, int(r.x.max()) - x0 + 1), bool)
        grid[r.y - y0, r.x - x0] = True
        first = label_grid(grid)[r.y - y0, r.x - x0] - 1
        return [(*[getattr(r, k) for k in keys], r.y, r.x, first // grid.shape[1] + y0, first % grid.shape[1] + x0)]

    out = kernels.run(kernels.pack(rows, keys), kernel, f"{schema}, y array<int>, x array<int>, cy array<int>, cx array<int>")
    return kernels.unpack(out, keys, ["y", "x", "cy", "cx"])


def label_tiled(mask: DataFrame, tile: int = 1024, checkpoint: bool = True) -> DataFrame:
    """The same labels for images of any size: tiles are labelled in tasks, touching ones joined until nothing changes."""
    rows = mask.select("image_id", "y", "x").distinct().withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    rows = rows.select(*[F.col(c).cast(t) for c, t in (("image_id", "long"), ("ty", "long"), ("tx", "long"), ("y", "int"), ("x", "int"))])
    keep = lambda df: df.checkpoint() if checkpoint else df.persist()
    local = keep(_labelled(rows, ["image_id", "ty", "tx"], "image_id long, ty long, tx long").withColumn("node", F.struct("cy", "cx")))
    border = local.where((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)).select("image_id", "y", "x", "node")
    near = border.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])))
    near = near.select("image_id", (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"), F.col("node").alias("other"))
    links = near.join(border, ["image_id", "y", "x"]).where(F.col("node") != F.col("other")).select("image_id", "node", "other").distinct()
    links = keep(links)
    labels = local.select("image_id", "node").distinct().withColumn("component", F.col("node"))
    while True:
        around = links.join(labels.select("image_id", F.col("node").alias("other"), "component"), ["image_id", "other"]).groupBy("image_id", "node").agg(F.min("component").alias("near"))
        hooked = labels.join(around, ["image_id", "node"], "left").select("image_id", "node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        # the label of the label: a line over k tiles takes about log k rounds
        up = hooked.select("image_id", F.col("node").alias("component"), F.col("component").alias("top"))
        new = keep(hooked.join(up, ["image_id", "component"], "left").select("image_id", "node", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        changed = new.where(F.col("component") != F.col("was")).limit(1).count()
        if not checkpoint:
            labels.unpersist()
        labels = new.select("image_id", "node", "component")
        if not changed:
            return local.join(labels, ["image_id", "node"]).select("image_id", "y", "x", "component")


def hysteresis(pixels: DataFrame, low: float, high: float, value: str = "v", candidates: DataFrame | None = None) -> DataFrame:
    """Foreground above ``low`` in components that reach above ``high``, with component; of ``candidates`` (image_id, y, x) only, if given."""
    weak = pixels.where(F.col(value) > low).select("image_id", "y", "x", F.col(value).alias("_v"))
    if candidates is not None:
        weak = weak.join(candidates.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_semi")
    labelled = label_images(weak).join(weak, ["image_id", "y", "x"])
    strong = labelled.groupBy("image_id", "component").agg(F.max("_v").alias("_m")).where(F.col("_m") > high)
    return labelled.join(strong.select("image_id", "component"), ["image_id", "component"], "left_semi").select("image_id", "y", "x", "component")


def drop_border_components(labelled: DataFrame, sizes: DataFrame, margin: int) -> DataFrame:
    """Without components that come within ``margin`` pixels of the border. sizes: image_id, height, width."""
    near = labelled.join(sizes, "image_id").where((F.col("y") < margin) | (F.col("x") < margin) | (F.col("y") >= F.col("height") - margin) | (F.col("x") >= F.col("width") - margin))
    return labelled.join(near.select("image_id", "component").distinct(), ["image_id", "component"], "left_anti").select(*labelled.columns)


def boxes(labelled: DataFrame) -> DataFrame:
    """image_id, component, x, y, w, h, pixels of each component's upright box."""
    box = labelled.groupBy("image_id", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("_x"), F.max("y").alias("_y"), F.count("*").alias("pixels"))
    return box.select("image_id", "component", "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"), "pixels")


def largest(found: DataFrame, n: int, area: str = "area", key: str = "image_id", ties: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The n largest of each image."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(area), *ties))
    return found.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
