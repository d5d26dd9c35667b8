"""Seeded augmentation of colour rasters and the table that a training loop reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TrainingSettings
from . import labels, losses, pairing, pixels, resample, vectorize, windows


def uniform(key: Column, seed: int, name: str) -> Column:
    """0 to 1, the same for the same key, seed and name."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(name)), F.lit(1_000_003)) / 1_000_003


def hue_saturation(rows: DataFrame, turn: Column, factor: Column) -> DataFrame:
    """Hue turned by ``turn`` (1: all the way round) and saturation times ``factor``, by the HSV model; r, g, b are 0 to 255."""
    top, low = F.greatest("r", "g", "b").cast("double"), F.least("r", "g", "b").cast("double")
    chroma = top - low
    sector = F.when(F.col("r") == top, F.pmod((F.col("g") - F.col("b")) / chroma, F.lit(6.0))).when(F.col("g") == top, (F.col("b") - F.col("r")) / chroma + 2).otherwise((F.col("r") - F.col("g")) / chroma + 4)
    hue = F.when(chroma == 0, 0.0).otherwise(sector / 6)
    rows = rows.withColumns({"_h": F.pmod(hue + turn, F.lit(1.0)) * 6, "_s": F.least(F.lit(1.0), F.when(top == 0, 0.0).otherwise(chroma / top) * factor), "_v": top})

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + F.col("_h"), F.lit(6.0))
        return F.col("_v") - F.col("_v") * F.col("_s") * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return rows.withColumns({"r": channel(5), "g": channel(3), "b": channel(1)}).drop("_h", "_s", "_v")


def random_flips(rows: DataFrame, key: str = "image_id", seed: int = 0) -> DataFrame:
    """Each image flipped left-right and up-down with probability one half each."""
    both = pixels.flip(rows.withColumns({"_y": F.col("y"), "_x": F.col("x")}), True, True)
    lr, ud = uniform(F.col(key), seed, "lr") < 0.5, uniform(F.col(key), seed, "ud") < 0.5
    return both.withColumns({"y": F.when(ud, F.col("y")).otherwise(F.col("_y")), "x": F.when(lr, F.col("x")).otherwise(F.col("_x"))}).drop("_y", "_x")


def training_table(images: DataFrame, label_images: DataFrame, palette: DataFrame, settings: TrainingSettings, seed: int = 0, geometry: bool = False) -> DataFrame:
    """images and label_images (image_id, y, x, r, g, b) -> epoch, image_id, patch_y, patch_x, y, x, r, g, b, class_id, batch, all joins by pixel.

    Each epoch has its own flips and its own order of images; patches are cut last. With ``geometry`` images are also
    brought to about ``input_pixels`` pixels, scaled at random by ``augment_scale`` and turned by up to
    ``augment_rotation`` (radians) either way, colours and classes alike by nearest pixels; what a turn leaves out is
    absent. Without it these three settings aren't used. With a ``local_entropy_ratio`` above 0 there is a ``weight`` too:
    that share of the local entropy of class 1 around a pixel, the rest even. Images of different sizes in a batch
    are padded by ``pairing.pad_batches``. Settings of losses and learning rates concern training alone.
    """
    classes = labels.nearest_class(label_images, palette).select("image_id", "y", "x", "class_id")
    weights = settings.local_entropy_ratio > 0
    if weights:
        mixed = vectorize.local_entropy(classes.select("image_id", "y", "x", (F.col("class_id") == 1).cast("int").alias("v")), settings.local_entropy_sigma, seed=seed)
        share = losses.blended(F.lit(1.0), F.col("v"), settings.local_entropy_ratio)
        classes = classes.join(mixed.select("image_id", "y", "x", share.alias("weight")), ["image_id", "y", "x"])
    rows = images.join(classes, ["image_id", "y", "x"])
    order = pairing.epochs(images.select("image_id").distinct(), settings.n_epochs, "image_id", seed)
    order = pairing.batches(order, settings.batch_size, "epoch", ["shuffle_key", "image_id"])
    rows = rows.join(order.select("image_id", "epoch", "batch"), "image_id").withColumns({"_id": F.col("image_id"), "image_id": F.struct("image_id", "epoch")})
    if geometry:
        values = [c for c in rows.columns if c not in ("image_id", "y", "x")]
        extent = rows.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        sizes = extent.select("image_id", scaled_size(F.col("h"), F.col("w"), F.col("image_id"), settings, seed).alias("s")).select("image_id", "s.height", "s.width")
        rows = resample.nearest(rows, sizes, value=values)
        if settings.augment_rotation:
            rows = resample.rotate(rows, (2 * uniform(F.col("image_id"), seed, "turn") - 1) * settings.augment_rotation, values)
    if settings.augment_flip:
        rows = random_flips(rows, "image_id", seed)
    if settings.make_patches:
        rows = windows.patches(rows, settings.patch_height, settings.patch_width)
    else:
        rows = rows.withColumns({"patch_y": F.lit(0), "patch_x": F.lit(0)})
    return rows.select("epoch", F.col("_id").alias("image_id"), "patch_y", "patch_x", "y", "x", "r", "g", "b", "class_id", *(["weight"] if weights else []), "batch")


def scaled_size(height: Column, width: Column, key: Column, settings: TrainingSettings, seed: int = 0) -> Column:
    """Target height and width of an image under the pixel budget, randomly scaled."""
    budget = settings.input_pixels * resample.random_scale(key, settings.augment_scale, seed)
    ratio = F.sqrt(budget / (height * width))
    return F.struct(F.floor(height * ratio).cast("int").alias("height"), F.floor(width * ratio).cast("int").alias("width"))
